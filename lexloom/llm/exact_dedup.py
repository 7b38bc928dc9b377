"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are cut into chunks.  A chunk's hash is a polynomial in its bytes
modulo a prime, and hashes combine by length-shifted arithmetic:
H(xy) = H(x) * B^len(y) + H(y).  So the chunks of a huge document can be hashed in
any order on any executors; its fingerprint is a sum, aggregated before the
shuffle.  Two such residues and the length make the fingerprint.

Equal fingerprints only nominate: each nominee is then compared with its group's
representative chunk by chunk, as rows of bounded size.  Texts that differ in
spite of equal fingerprints leave the group and are grouped anew, until every
group holds one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Workspace, ascii_lower, partitions, whole_text

#: Bytes of a chunk.
CHUNK = 1 << 16
#: Bytes from which a document's chunks are dealt out to all executors.
HUGE = 1 << 24
#: Primes under 2^31 with a base for each.
FIELDS = ((2147483647, 1099511628), (2147483629, 971215073))


@lru_cache
def _powers(prime: int, base: int, n: int) -> np.ndarray:
    """base^(n-1) ... base^0 modulo prime."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:  # the powers so far, shifted by their number, give as many more
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out[::-1].copy()


def chunk_hash(data: np.ndarray, prime: int, base: int) -> int:
    """Horner's value of the bytes (each plus one); at most CHUNK of them."""
    powers = _powers(prime, base, CHUNK)[CHUNK - len(data) :]
    # 2^9 * 2^31 * 2^16 stays below 2^64
    return int(np.dot(data.astype(np.uint64) + np.uint64(1), powers)) % prime


def combine(left: int, right: int, right_length: int, prime: int, base: int) -> int:
    """The hash of two strings laid end to end."""
    return (left * pow(base, right_length, prime) + right) % prime


def polynomial(data: bytes, prime: int, base: int) -> int:
    array, value = np.frombuffer(data, np.uint8), 0
    for at in range(0, len(array), CHUNK):
        part = array[at : at + CHUNK]
        value = combine(value, chunk_hash(part, prime, base), len(part), prime, base)
    return value


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, bytes) to the digest, the length and the fingerprint."""
    for batch in batches:
        texts = [x.lower() for x in batch.column(1).to_pylist()]  # of bytes: A-Z only
        columns = [pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(map(len, texts), pa.int64())]
        columns += [pa.array([polynomial(t, *field) for t in texts], pa.int64()) for field in FIELDS]
        yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "text_key", "n_bytes", "f0", "f1"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's hash, shifted by the bytes that follow it."""
    for batch in batches:
        rest, parts = batch.column(2).to_pylist(), [np.frombuffer(x.lower(), np.uint8) for x in batch.column(3).to_pylist()]
        sums = [pa.array([chunk_hash(x, p, b) * pow(b, n, p) % p for x, n in zip(parts, rest, strict=True)], pa.int64()) for p, b in FIELDS]
        yield pa.record_batch([batch.column(0), batch.column(1), *sums], names=["text_key", "part", "f0", "f1"])


def _chunks(size: int) -> Column:
    """Structs of number, bytes after it, and bytes, for each chunk of column ``bytes``; an empty text has one."""
    n = F.octet_length("bytes")
    starts = F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / size).cast("int"))
    return F.transform(
        starts,
        lambda k: F.struct(
            k.alias("part"),
            F.greatest(n - (k + 1) * size, F.lit(0)).cast("long").alias("rest"),
            F.substring(F.col("bytes"), k * size + 1, F.lit(size)).alias("piece"),
        ),
    )


def fingerprints(rows: DataFrame, huge: int = HUGE) -> DataFrame:
    """(doc_id, text_key, n_bytes, f0, f1) of rows (doc_id, bytes); text_key is the SHA-256 of the lower-cased text."""
    spark, id_type = rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    size = F.octet_length("bytes")
    whole = rows.where(size < huge).mapInArrow(_whole, f"doc_id {id_type}, text_key string, n_bytes long, f0 long, f1 long")
    # A huge text never goes to Python whole: its chunks are hashed on all executors, and their shifted hashes are summed.
    large = rows.where(size >= huge).select("doc_id", F.sha2(_lower("bytes"), 256).alias("text_key"), size.cast("long").alias("n_bytes"), "bytes")
    chunks = large.select("text_key", F.explode(_chunks(CHUNK)).alias("c")).select("text_key", "c.part", "c.rest", "c.piece").repartition(partitions(spark))
    hashed = chunks.mapInArrow(_parts, "text_key string, part int, f0 long, f1 long").dropDuplicates(["text_key", "part"])  # copies give equal parts
    sums = hashed.groupBy("text_key").agg(*[F.pmod(F.sum(f"f{k}"), F.lit(p).cast("long")).alias(f"f{k}") for k, (p, _) in enumerate(FIELDS)])
    return whole.unionByName(large.drop("bytes").join(sums, "text_key").select("doc_id", "text_key", "n_bytes", "f0", "f1"))


def _lower(column: str) -> Column:
    return ascii_lower(F.col(column).cast("string"))


def _unequal(members: DataFrame) -> DataFrame:
    """The representatives (rep) of groups that hold more than one text.

    members has text_key, rep and bytes.  A group's texts are equal if, chunk by chunk, the
    least is the greatest; both are aggregated before the shuffle, however many copies there are.
    """
    pieces = members.select("rep", F.octet_length("bytes").alias("n"), F.explode(_chunks(CHUNK)).alias("c")).select("rep", "n", "c.part", "c.piece")
    bounds = [f(c).alias(f"{k}_{c}") for c in ("n", "piece") for k, f in (("least", F.min), ("most", F.max))]
    spread = pieces.groupBy("rep", "part").agg(*bounds)
    return spread.where("least_n != most_n or least_piece != most_piece").select("rep").distinct()


def _differing(members: DataFrame) -> DataFrame:
    """text_key of members whose text is not that of their group's representative."""
    pieces = members.select("text_key", "rep", F.octet_length("bytes").alias("n"), F.explode(_chunks(CHUNK)).alias("c"))
    pieces = pieces.select("text_key", "rep", "n", "c.part", "c.piece").distinct()
    model = pieces.where(F.col("text_key") == F.col("rep")).select("rep", "part", F.col("n").alias("n2"), F.col("piece").alias("piece2"))
    held = pieces.where(F.col("text_key") != F.col("rep")).join(model, ["rep", "part"], "left")
    unlike = ~(F.col("piece").eqNullSafe(F.col("piece2")) & F.col("n").eqNullSafe(F.col("n2")))
    return held.where(unlike).select("text_key").distinct()


def exact_groups(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", huge: int = HUGE, weaken: int = 0) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, f0, f1.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The
    row with the largest doc_id of each group stays; rows that repeat both the text
    and the doc_id share its answer, and a null doc_id ranks lowest.  In a group
    that has null ids only, keep_id is null and every row is kept.  Other columns are left
    out; an empty table gives no rows.  ``weaken`` (tests) drops all but so many
    values of the fingerprint, to force collisions.
    """
    work = Workspace(spark, "exact")
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).cast("binary").alias("bytes"))
    prints = fingerprints(rows, huge)
    if weaken:
        prints = prints.withColumn("f0", F.pmod("f0", F.lit(weaken))).withColumn("f1", F.lit(0).cast("long")).withColumn("n_bytes", F.lit(0).cast("long"))
    # A text is named by its digest, so that the comparison below names it without a row number.
    prints = work.table(prints.withColumn("round", F.lit(0)), "prints")
    key = ["n_bytes", "f0", "f1", "round"]
    turn = 0
    while True:
        texts = prints.groupBy(*key, "text_key").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        groups = texts.groupBy(*key).agg(F.sum("n").alias("group_size"), F.max("top").alias("keep_id"), F.min("text_key").alias("rep"))
        groups = work.table(groups, f"groups-{turn}")
        members = prints.join(groups.where("group_size > 1").select(*key, "rep"), key)
        members = work.table(members.select("doc_id", "text_key", "rep").distinct(), f"members-{turn}")
        ids = work.table(members.where("doc_id is not null").select("doc_id").distinct(), f"ids-{turn}")
        # The texts to compare are fetched by id, then told apart by digest where an id has several; those without an id by digest alone.
        named = rows.where("doc_id is not null").join(ids, "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))
        named = named.withColumn("bytes", _lower("bytes").cast("binary")).withColumn("text_key", F.sha2("bytes", 256)).withColumnRenamed("doc_id", "id")
        fetched = named.join(members, named.id.eqNullSafe(members.doc_id) & (named.text_key == members.text_key)).select(members.doc_id, members.text_key, "rep", "bytes")
        unequal = work.table(_unequal(fetched), f"unequal-{turn}")
        if unequal.isEmpty():
            break
        unlike = work.table(_differing(fetched.join(unequal, "rep", "left_semi")), f"unlike-{turn}")
        turn += 1
        later = F.when(F.col("text_key") == F.col("odd"), F.lit(turn)).otherwise(F.col("round"))
        prints = prints.join(unlike.select(F.col("text_key").alias("odd")), F.col("text_key") == F.col("odd"), "left").withColumn("round", later).drop("odd")
        prints = work.table(prints, f"prints-{turn}")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return prints.join(groups.select(*key, "keep_id", "group_size"), key).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("text_key").alias("text_sha256"), "n_bytes", "f0", "f1"
    )
