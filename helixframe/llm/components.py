"""Connected components of an edge table by rounds of smallest-label propagation, with path shortening.

Each round is a pre-aggregated minimum over edges and one join; labels are written to the shared folder each round, so
lineage stays short and a lost executor costs one round. Nothing is collected but one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def min_label_components(edges: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """(id, label) for each end of an edge of ``edges`` (a, b): label is the smallest id reachable.

    Edges to larger neighbours are linked to the smallest neighbour in turn, large ends first and small ends next, so that
    a chain halves in each round. Loops and repeated edges do no harm; nodes without edges have no row.
    """
    spark = edges.sparkSession
    now = written(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct(), folder, "e0")
    before = None
    for k in range(1, most_rounds + 1):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour (or itself).
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and all its smaller neighbours are linked to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = written(small.where("a != b").distinct(), folder, f"e{k}")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Settled: every edge is (node, smallest id of its component).
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).union(now.select(F.col("b").alias("id"), F.col("b").alias("label"))).distinct()
