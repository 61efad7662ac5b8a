"""File lineage = connected components of the rename graph, per repository.

Every path that ever occurs is a node; every RENAME (old -> new) is an edge.  A component is
labelled by its earliest-seen path (ties: the smallest).  Only nodes that touch an edge take part
in the iteration; all others are their own component.

Rounds are star contractions and end when nothing changes; each is written as Parquet to the shared
folder (cuts the plan, keeps its size estimate true, survives executor loss).  The only driver-side
data is a count and a checksum of the edges per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialise

LAST_ROUNDS = [0]  # rounds used by the last call (diagnostics)


def rename_edges(files: DataFrame) -> DataFrame:
    """``(repo, idx, pos, old_path, new_path)`` of real renames."""
    return (files.filter((F.col("change_type") == "RENAME") & F.col("old_path").isNotNull()
                         & F.col("new_path").isNotNull() & (F.col("old_path") != F.col("new_path")))
                 .select("repo", "idx", "pos", "old_path", "new_path"))


def path_nodes(files: DataFrame) -> DataFrame:
    return (files.select("repo", F.explode(F.array("old_path", "new_path")).alias("path"))
                 .filter(F.col("path").isNotNull()).distinct())


def components(edges: DataFrame, rank: DataFrame | None = None) -> DataFrame:
    """``(repo, node, label)`` for every node that occurs in ``edges(repo, src, dst)``; label = the node
    of the component that ranks first (ties: the smallest).

    A round hangs every edge under the smallest neighbour of its smaller end, then of its larger end
    (large-star and small-star contraction), which merges whole regions at once: rounds grow with the
    logarithm of a chain's length, also where two labelled regions meet.  It ends when a round
    changes nothing; there is no cap.  Every round is written to shared storage and read back.
    """
    ends = [F.struct(F.lit(0).cast("bigint").alias("r"), F.col(c).alias("n")) for c in ("src", "dst")]
    pairs = edges.select("repo", "src", "dst")
    if rank is not None:
        for c, at in (("src", "__s"), ("dst", "__d")):
            pairs = pairs.join(rank.select("repo", F.col("node").alias(c), F.col("rank").alias(at)), ["repo", c], "left")
        ends = [F.struct(F.coalesce(at, F.lit(0)).cast("bigint").alias("r"), F.col(c).alias("n"))
                for c, at in (("src", "__s"), ("dst", "__d"))]
    loops = edges.where(F.col("src") == F.col("dst")).select("repo", F.col("src").alias("node"), F.col("src").alias("label"))
    tree = pairs.select("repo", F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).where("a <> b").distinct()
    tree = materialise(tree, "renames")
    state = _state(tree)
    LAST_ROUNDS[0] = 0
    while state[0]:
        LAST_ROUNDS[0] += 1
        both = tree.union(tree.select("repo", F.col("b").alias("a"), F.col("a").alias("b")))
        top = materialise(both.groupBy("repo", "a").agg(F.min("b").alias("m")).select("repo", "a", F.least("a", "m").alias("m")), "tops")
        tree = materialise(tree.join(top, ["repo", "a"]).select("repo", F.col("m").alias("a"), "b").distinct(), "renames")
        top = materialise(tree.groupBy("repo", "b").agg(F.min("a").alias("m")), "tops")
        rest = tree.join(top, ["repo", "b"]).where("a <> m").select("repo", F.col("m").alias("a"), F.col("a").alias("b"))
        tree = materialise(rest.union(top.select("repo", F.col("m").alias("a"), "b")).distinct(), "renames")
        old, state = state, _state(tree)
        if state == old:
            break
    roots = tree.select("repo", F.col("a.n").alias("node"), F.col("a.n").alias("label")).distinct()
    found = tree.select("repo", F.col("b.n").alias("node"), F.col("a.n").alias("label")).union(roots)
    return found.union(loops.join(found, ["repo", "node"], "left_anti").distinct())


def _state(tree: DataFrame) -> tuple:
    """Count and checksum of the edges: equal when a round changed nothing."""
    row = tree.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("repo", "a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def first_seen(files: DataFrame) -> DataFrame:
    """``(repo, node, rank)``: position of the first commit that mentions each path."""
    seen = (files.select("repo", F.col("old_path").alias("node"), "idx")
                 .unionByName(files.select("repo", F.col("new_path").alias("node"), "idx")))
    return seen.filter(F.col("node").isNotNull()).groupBy("repo", "node").agg(F.min("idx").alias("rank"))


def path_lineage(files: DataFrame) -> DataFrame:
    """``(repo, path, lineage)`` for every path of ``files``.  ``lineage`` names the path's rename
    component by its earliest-seen path (ties: the smallest path) -- the file's original name."""
    e = rename_edges(files).select("repo", F.col("old_path").alias("src"), F.col("new_path").alias("dst"))
    comp = components(e, rank=first_seen(files)).select("repo", F.col("node").alias("path"),
                                                         F.col("label").alias("lineage"))
    nodes = path_nodes(files)
    return (nodes.join(comp, ["repo", "path"], "left")
                 .select("repo", "path", F.coalesce(F.col("lineage"), F.col("path")).alias("lineage")))
