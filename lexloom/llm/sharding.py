"""Reproducible shuffled shards by a Feistel permutation over global row numbers.

Rows are numbered by doc_id (a range sort and one offset per partition, never one
task).  A keyed Feistel network permutes the smallest even power of two that
holds the row count; a value outside the count walks the cycle until it falls
inside, which keeps the whole a permutation.  Shard and slot follow from the
permuted number by division, so either can be computed, and inverted, for one row
without the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Workspace, partitions

ROUNDS = 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _round(half: np.ndarray, key: int, turn: int) -> np.ndarray:
    """A keyed mix of one half (splitmix64's finish)."""
    with np.errstate(over="ignore"):
        x = half + np.uint64((key * 0x2545F4914F6CDD1D + turn * 0xD1342543DE82EF95) % 2**64) + _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, bits: int, key: int, turns) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    backwards = turns[0] > turns[-1]
    for t in turns:
        if backwards:
            left, right = right ^ (_round(left, key, t) & mask), left
        else:
            left, right = right, left ^ (_round(right, key, t) & mask)
    return (left << shift) | right


def permute(rows, n: int, key: int = 0, inverse: bool = False) -> np.ndarray:
    """Where each row number under n goes; with inverse, where it came from."""
    turns = range(ROUNDS)[::-1] if inverse else range(ROUNDS)
    bits, out = _half_bits(n), np.array(rows, dtype=np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        out[walk] = _network(out[walk], bits, key, turns)
        walk = out >= n
    return out.astype(np.int64)


def number_rows(work: Workspace, rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with a gapless row_number from 0 in that order, and how many there are."""
    parts = partitions(work.spark)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    mask = (1 << 33) - 1
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(mask)))
    ranged = work.table(ranged, "numbered")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n")).collect()  # one row for each partition
    offsets, total = {}, 0
    for part, n in sorted(sizes):
        offsets[part], total = total, total + n
    start = F.element_at(F.lit([offsets.get(k, 0) for k in range(max(offsets, default=0) + 1)]).cast("array<long>"), F.col("part") + 1)
    return ranged.withColumn("row_number", start + F.col("at")).drop("part", "at"), total


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = 16, key: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, row_number, shard, slot.

    size is the text's UTF-8 bytes (none for null) plus 1.  Shards differ by at most
    one row, and slots are gapless from 0 in each.  Row numbers go by doc_id (null
    first), then size and checksum; rows equal in all three are interchangeable.
    Other columns are left out; an empty table gives no rows.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    numbered, total = number_rows(Workspace(spark, "shards"), rows, ["doc_id", "size", "text_crc32"])

    @F.pandas_udf(T.LongType())
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row, total, key))

    placed = numbered.withColumn("place", place("row_number"))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).alias("slot")
    )
