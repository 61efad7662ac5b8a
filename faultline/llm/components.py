"""Connected components as alternating star contractions (large-star, small-star) in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.store import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component = smallest node reachable.

    ``edges`` is undirected; nodes may be of any orderable type.  Null ends, self loops and repeated
    edges are ignored.  Each round hangs every edge under the smallest neighbour of its smaller end
    (large-star) and then of its larger end (small-star); it stops when a round changes nothing, so
    there is no cap on rounds.  The edge set never grows, and each round is written to shared
    storage.  Minima are combined map-side and written before they are joined back, so a hub with a
    third of all edges is a plain skewed join that Spark splits.
    """
    edges = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    edges = materialise(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialise(least, "star")
        edges = edges.join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        edges = materialise(edges, "edges")
        least = materialise(edges.groupBy("b").agg(F.min("a").alias("m")), "star")
        moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = materialise(moved.union(least.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        old, state = state, _state(edges)
        if state == old:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
