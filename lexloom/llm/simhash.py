"""SimHash near-duplicates, searched with the pigeonring principle.

A fingerprint's 64 bits are cut into five segments laid out as a ring.  If two
fingerprints differ in at most 4 bits, then some segment starts a chain in which
the first l segments together differ in at most l * 4 / 5 bits, for every l from
1 to 5 (0, 1, 2, 3, 4 bits).  The first link of the chain - an equal segment, and
beyond ``ROOMY`` fingerprints also its neighbour with one bit of freedom - is the
join key; the later links prune the pairs inside a bucket before the full check.

Equal fingerprints are collapsed first, so a large group of copies is one row.
A bucket is searched by breadth-first visits that emit tree edges only, at most
one less than its rows, never all pairs; a bucket over ``BLOCK`` rows is dealt
out as pairs of blocks to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexloom.llm.common import Workspace, partitions
from lexloom.llm.components import connected_components

SEED = 42
SHINGLE = 4
BITS = 4
#: Widths of the ring's segments, from the lowest bit.
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = (0, 13, 26, 39, 52)
#: Rows of a bucket that are searched together.
BLOCK = 4096
#: Distinct fingerprints up to which one equal segment is a narrow enough key.
ROOMY = 1 << 23


def shingle_hashes(text: str, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``width`` words, repeats included; words part at ASCII white space."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the highest bit."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for k in range(0, len(bits), 255):  # 255 ones still fit a byte
            total += bits[k : k + 255].sum(0, dtype=np.uint8)
    return total


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is 1 if over half the shingle hashes have it; no words: zero."""
    hashes = shingle_hashes(text or "")
    if not hashes:
        return 0
    counts = _bit_counts(np.array(hashes, dtype=np.uint64))
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


@F.pandas_udf(LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    """The signed fingerprint of each text."""
    return pd.Series(np.fromiter(map(fingerprint, text), np.uint64, len(text)).view(np.int64))


def _neighbour_keys(n: int) -> int:
    """Links of the chain that go into the key: more when buckets would grow too large."""
    return 1 if n <= ROOMY else 2


def _segment(shift: int, width: int):
    return F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1))


def _keyed(prints: DataFrame, links: int) -> DataFrame:
    """A row for each bucket that a fingerprint belongs to, or (probe) that may hold a partner of it."""
    parts = []
    for k in range(5):
        first = _segment(SHIFTS[k], WIDTHS[k])
        if links == 1:
            parts.append(F.array(F.struct(F.lit(k).alias("start"), first.cast("long").alias("key"), F.lit(False).alias("probe"))))
            continue
        after = (k + 1) % 5
        second = _segment(SHIFTS[after], WIDTHS[after])
        whole = F.shiftleft(first.cast("long"), 13)
        flips = [0] + [1 << b for b in range(WIDTHS[after])]
        home = F.struct(F.lit(k).alias("start"), whole.bitwiseOR(second).alias("key"), F.lit(False).alias("probe"))
        near = [F.struct(F.lit(k).alias("start"), whole.bitwiseOR(second.bitwiseXOR(F.lit(f).cast("long"))).alias("key"), F.lit(True).alias("probe")) for f in flips[1:]]
        parts.append(F.array(home, *near))
    return prints.select("fp", F.explode(F.flatten(F.array(*parts))).alias("k")).select("k.start", "k.key", "k.probe", "fp")


def _chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """Masks of the chain's first 2 to 5 segments, with the bits they may differ in."""
    out, mask = [], 0
    for n in range(5):
        k = (start + n) % 5
        mask |= ((1 << WIDTHS[k]) - 1) << SHIFTS[k]
        out.append((np.uint64(mask), (n + 1) * BITS // 5))
    return out[1:]


def _linked(one: np.uint64, many: np.ndarray, masks: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Positions in ``many`` that the chain of budgets leaves linked to ``one``."""
    left = np.arange(len(many))
    diff = many ^ one
    for mask, budget in masks:
        keep = np.bitwise_count(diff & mask) <= budget
        left, diff = left[keep], diff[keep]
        if not len(left):
            break
    return left


def _tree_edges(values: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges that connect whatever the links in a bucket connect."""
    masks, n = _chain_masks(start), len(values)
    if n < 2:
        return []
    if n <= 512:
        diff = values[:, None] ^ values[None, :]
        a, b = np.nonzero(np.triu(np.bitwise_count(diff & masks[0][0]) <= masks[0][1], 1))
        for mask, budget in masks[1:]:
            keep = np.bitwise_count((values[a] ^ values[b]) & mask) <= budget
            a, b = a[keep], b[keep]
        if len(a) <= 4 * n:
            return list(zip(values[a].tolist(), values[b].tolist(), strict=True))
    edges, rest = [], values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            if len(found := _linked(one, rest, masks)):
                queue.extend(rest[found])
                edges.extend((int(one), x) for x in rest[found].tolist())
                rest = np.delete(rest, found)
    return edges


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, so that one bucket at a time is held."""

    def found(held: list, start: int) -> Iterator[tuple[int, int]]:
        yield from _tree_edges(np.unique(np.concatenate(held)), start)

    last, held, out = None, [], []
    for batch in batches:
        ids = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
        prints = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), len(prints)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            bucket = tuple(ids[:, a].tolist())
            if bucket != last:
                if held:
                    out.extend(found(held, last[0]))
                last, held = bucket, []
            held.append(prints[a:b])
        if len(out) > 50_000:
            yield _edge_batch(out)
            out = []
    if held:
        out.extend(found(held, last[0]))
    yield _edge_batch(out)


def _edge_batch(edges: list) -> pa.RecordBatch:
    pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(prints: DataFrame, chain: int | None = None) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp`` that connect all that Hamming distance 4 connects."""
    spark = prints.sparkSession
    keyed = _keyed(prints, chain or _neighbour_keys(prints.count()))
    counts = keyed.groupBy("start", "key").agg(F.count("*").alias("n"), F.min("probe").alias("alone")).where("n > 1 and not alone")
    dealt = keyed.join(counts, ["start", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).select(
        "start", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = dealt.select("start", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    sorted_ = dealt.repartition(partitions(spark), "start", "key", "x", "y").sortWithinPartitions("start", "key", "x", "y")
    return sorted_.mapInArrow(_search, "a long, b long")


def simhash_groups(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chain: int | None = None) -> DataFrame:
    """One row per document: doc_id, fp (signed 64 bits), component_id.

    component_id is the smallest doc_id that links of at most 4 differing bits reach.
    Null and empty texts, and those of white space only, have fingerprint zero and
    link like any other.  Repeated rows each get a row; rows with a null id are
    linked too, but a null id never names a component unless nothing else does.
    Other columns are left out; an empty table gives no rows.
    """
    work = Workspace(spark, "simhash")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    prints = work.table(rows.mapInArrow(_fingerprints, f"doc_id {id_type}, fp long"), "prints")
    each = work.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "each")
    roots = connected_components(work, links(each.select("fp"), chain))
    roots = each.join(roots, each.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = work.table(roots, "roots")
    # Written, like the rows it is joined to, so that a large component's join can be split.
    named = work.table(roots.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    member = work.table(roots.join(named, "root").select("fp", "component_id"), "member")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")
