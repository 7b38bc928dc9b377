"""Connected components by alternating large-star and small-star rounds.

Each round is a few shuffles over the remaining edges; the edges of a round are
written to the shared folder, so lineage stays one round deep.  A node's
neighbours are never gathered in one row: a round only needs their minimum,
which is aggregated before the shuffle and written.  The join back to the edges then has plain
shuffles on both sides, so that adaptive execution can split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Workspace


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = work.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """edges run from the larger node u to the smaller v."""
    least = work.table(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(work: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for each node of an edge: root is the component's smallest node.

    edges has two columns of one orderable type.  Loops and repeats do no harm;
    no edges give no rows.
    """
    a, b = edges.columns
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, turn = work.table(edges, f"{name}-0"), 0
    seen = _digest(now)
    while seen[0]:
        large = work.table(_large_star(work, now, f"{name}-{turn}-least"), f"{name}-{turn}-large")
        after = work.table(_small_star(work, large, f"{name}-{turn}-lower"), f"{name}-{turn + 1}")
        for done in ("", "-least", "-large", "-lower"):
            work.drop(f"{name}-{turn}{done}")
        now, turn, before = after, turn + 1, seen
        seen = _digest(now)
        if seen == before:
            break
    # A finished edge set is a star around each root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
