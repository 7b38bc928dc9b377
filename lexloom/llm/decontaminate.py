"""Test items inside documents, by size-partitioned MinHash containment search.

An item's sketch is the bottom of its shingle hashes.  Items are partitioned by
size: in the class of 2^c to 2^(c+1) - 1 shingles, a document that contains the
required share lacks at most a known number of them, so a sketch of that many
hashes and ``SURE`` more has at least ``SURE`` hits in every such document, short or long.
Documents are probed shingle by shingle against the sketches; (document, item) pairs with
enough hits are then verified by the exact share of the item's shingles, as words.

The sketch table grows with the benchmark only; Catalyst broadcasts it while its
written size is under spark.sql.autoBroadcastJoinThreshold, and shuffles both sides
beyond.  Everything is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Workspace

WIDTH = 5
SHARE = 0.8
#: Hits that a sketch must have.
SURE = 2
APART = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), APART)
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def _runs(units: DataFrame, width: int, run) -> DataFrame:
    """A row for each run of ``width`` elements of the array ``w``; run makes it from the elements."""
    # Fewer words give null, which explodes to no row; a filter would split the text a second time.
    at = F.explode(F.when(F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width))).alias("at")
    exploded = units.select("*", at)
    elements = [F.get("w", F.col("at") + k) for k in range(width)]
    return exploded.select(*[c for c in units.columns if c != "w"], run(*elements))


def _shingles(units: DataFrame, width: int) -> DataFrame:
    return _runs(units, width, lambda *w: F.concat_ws(" ", *w).alias("shingle"))


def _hashes(units: DataFrame, width: int) -> DataFrame:
    return _runs(units, width, lambda *w: F.xxhash64(*w).alias("h"))


def _sketches(items: DataFrame, share: float) -> DataFrame:
    """(width, item_id, n, need, h): the bottom hashes of each item."""
    n = F.col("n")
    # The largest size of the item's class lacks at most this many shingles.
    top = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) + 1) - 1
    slack = F.floor(top * (1 - share) + 1e-9).cast("int")
    kept = F.slice(F.sort_array("hashes"), F.lit(1), F.least(n, slack + SURE))
    lacking = n - F.ceil(n * share - 1e-9).cast("int")
    need = F.greatest(F.least(n, slack + SURE) - lacking, F.lit(1))
    return items.select("width", "item_id", "n", need.alias("need"), F.explode(kept).alias("h"))


def contaminated(
    spark: SparkSession, docs: DataFrame, items: DataFrame, share: float = SHARE, width: int = WIDTH,
    doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for each document that holds at least ``share`` of an item's shingles.

    A shingle is ``width`` words; an item of fewer words is one shingle, sought as such.
    Items without words are never found, documents without words hold nothing.  Repeated
    items are found each by its own id; rows that share an id, of documents or of items, count
    as one set of shingles, and rows with a null id are left out, as nothing could name
    them.  Other columns are left out; an empty table gives no rows.
    """
    work = Workspace(spark, "decon")
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    units = docs.select("doc_id", words(F.col("text")).alias("w"))
    tests = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    tests = work.table(tests.withColumn("width", F.least(F.size("w"), F.lit(width))), "items")
    widths = sorted(r["width"] for r in tests.select("width").distinct().collect())  # at most ``width`` of them
    if not widths:
        return docs.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", tests.schema["item_id"].dataType), ("n_shingles", "int"), ("n_found", "long"), ("containment", "double"))])

    def every(make, of: DataFrame, own: bool) -> DataFrame:
        parts = [make(of.where(F.col("width") == k) if own else of.withColumn("width", F.lit(k)), k) for k in widths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    sets = every(_hashes, tests, True).groupBy("width", "item_id").agg(F.collect_set("h").alias("hashes"))
    sketches = work.table(_sketches(sets.withColumn("n", F.size("hashes")), share), "sketches")
    hits = every(_hashes, units, False).join(sketches, ["width", "h"])
    nominated = hits.groupBy("doc_id", "item_id", "width").agg(F.size(F.collect_set("h")).alias("hits"), F.first("need").alias("need"))
    nominated = work.table(nominated.where("hits >= need").select("doc_id", "item_id", "width"), "nominated")

    # Exact: the words themselves, of nominated documents only.
    held = docs.join(nominated.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    known = work.table(every(_shingles, tests, True).distinct(), "known")
    sizes = known.groupBy("item_id").agg(F.count("*").cast("int").alias("n_shingles"))
    found = every(_shingles, held, False).join(known, ["width", "shingle"]).groupBy("doc_id", "item_id")
    # A set, at most the item's shingles, is gathered in parts; a distinct count would keep a frequent shingle's rows in one task.
    found = found.agg(F.size(F.collect_set("shingle")).cast("long").alias("n_found"))
    found = found.join(nominated.select("doc_id", "item_id").distinct(), ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
    part = F.col("n_found") / F.col("n_shingles")
    return found.where(F.col("n_found") >= F.ceil(F.col("n_shingles") * share - 1e-9)).select("doc_id", "item_id", "n_shingles", "n_found", part.alias("containment"))
