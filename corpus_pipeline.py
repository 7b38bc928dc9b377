"""A corpus pipeline: five stages over documents, each reading all that the one before kept.

Rows are told apart by doc_id and, where one id has different texts, by text.  A row with a null doc_id cannot be named by the stages that
compare documents with one another: it passes them, and is judged by the classifier and held against the benchmark.  Null texts count as empty.

Stages of one session share its executors and their Python workers.  Those that send texts to Python bound the session's batches, and keep them bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, exact_dedup, packing, quality, simhash
from lexloom.llm.common import Workspace, ascii_lower, benchmark, documents, small_batches, whole_text
from lexloom.llm.queries import PACK_TOKENIZER, tokenizer_path


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the ids in gone; its size, which is known since it is a written table, decides how they meet."""
    return docs.join(gone.withColumnRenamed("doc_id", "__gone"), F.col("doc_id") == F.col("__gone"), "left_anti")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts: good quality, not toxic."""
    small_batches(spark)
    model = quality.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.withColumn("__score", quality.scorer(model)("text", "lang", "source", "n_chars"))
    return scored.where(quality.accepted(F.col("__score"))).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest doc_id."""
    small_batches(spark)
    work = Workspace(spark, "stage-exact")
    groups = work.table(exact_dedup.exact_groups(spark, docs).select("doc_id", "kept", "text_sha256").where("doc_id is not null"), "groups")
    count = groups.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n"))
    left = _without(docs, work.table(count.where("kept = 0").select("doc_id"), "gone"))
    # Ids with several rows, of which some stay; rows that repeat an id and a text are one document.
    again = work.table(count.where("kept > 0 and n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    shas = F.sha2(ascii_lower(whole_text()), 256)
    several = left.join(again, "doc_id", "left_semi").withColumn("__sha", shas).dropDuplicates(["doc_id", "__sha"])
    stay = groups.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__of"))
    several = several.join(stay, (F.col("doc_id") == F.col("__id")) & (F.col("__sha") == F.col("__of")), "left_semi")
    return _without(left, again).unionByName(several.select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: the one with the smallest doc_id."""
    small_batches(spark)
    work = Workspace(spark, "stage-near")
    groups = simhash.simhash_groups(spark, docs).where("doc_id is not null")
    groups = work.table(groups.select("doc_id", "fp", (F.col("doc_id") == F.col("component_id")).alias("kept")), "groups")
    count = groups.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n"))
    left = _without(docs, work.table(count.where("kept = 0").select("doc_id"), "gone"))
    mixed = work.table(count.where("kept > 0 and kept < n").select("doc_id"), "mixed")
    if mixed.isEmpty():
        return left
    stay = groups.where("kept").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__of"))
    several = left.join(mixed, "doc_id", "left_semi").withColumn("__fp", simhash.fingerprints("text"))
    several = several.join(stay, (F.col("doc_id") == F.col("__id")) & (F.col("__fp") == F.col("__of")), "left_semi")
    return _without(left, mixed).unionByName(several.select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; a row is named by its id and a hash of its text."""
    work = Workspace(spark, "stage-decon")
    keyed = docs.withColumn("__key", F.struct(F.col("doc_id"), F.xxhash64("text").alias("text")))
    found = decontaminate.contaminated(spark, keyed, benchmark(spark, sf_dir), doc_id="__key")
    gone = work.table(found.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return keyed.join(gone, F.col("__key").eqNullSafe(F.col("__gone")), "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences' pieces, with their ids."""
    small_batches(spark)
    return packing.pack(spark, docs, tokenizer_path(PACK_TOKENIZER))


STAGES = [("quality", classify), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("pack", packed)]

#: Classifier, fingerprints and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again."""
    work, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
