"""File identity over time: which life of which file a file event belongs to.

A path starts a new life when it is added or when a rename leads to it; a rename continues the life
its old path had just before.  Two files that carried the same name at different times, and a file
that was deleted and added again, are therefore different lives, where the rename components of
``lineage`` join them.  Events before a path's first birth belong to the life it had before history.

The life of an event is the latest birth of its path (a prefix max).  Every life continues at most
one earlier life, so lives form chains in time, and pointer doubling finds their first names in
log2(chain length) rounds.  Rounds end when no pointer moves; there is no cap.  Each is written as
Parquet to the shared folder; the driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.ordered import DEFAULT_WIDTH, prefix_agg, spans_one_bucket
from faultline.session import materialise

FILES_A_COMMIT = 1 << 24  # positions of one commit on the time axis
BEFORE_HISTORY = -1

LAST_ROUNDS = [0]  # rounds used by the last call (diagnostics)


def _births(files: DataFrame) -> DataFrame:
    """Every event, and the old side of every rename, with the latest birth of its path:
    ``(repo, commit_hash, idx, pos, at, path, side, started, birth)``."""
    moved = (F.col("change_type") == "RENAME") & (F.col("old_path") != F.col("new_path"))
    at = F.col("idx") * F.lit(FILES_A_COMMIT) + F.col("pos")
    event = ["repo", "commit_hash", "idx", "pos", at.cast("bigint").alias("at")]
    own = files.select(*event, F.coalesce("new_path", "old_path").alias("path"), F.lit("own").alias("side"),
                       F.when((F.col("change_type") == "ADD") | moved, at).cast("bigint").alias("started"))
    old = files.filter(moved).select(*event, F.col("old_path").alias("path"), F.lit("old").alias("side"),
                                     F.lit(None).cast("bigint").alias("started"))
    rows = prefix_agg(own.unionByName(old).filter("path IS NOT NULL"), ["repo", "path"], "at", "started", "max", "birth",
                      inclusive=True, width=FILES_A_COMMIT * DEFAULT_WIDTH, whole=spans_one_bucket(files))
    return rows.withColumn("birth", F.coalesce("birth", F.lit(BEFORE_HISTORY).cast("bigint")))


def file_lives(files: DataFrame) -> DataFrame:
    """``(repo, commit_hash, idx, pos, path, life)`` for every file event; ``life`` = the first name
    of the file, ``@``, and the position of the commit that added it (-1: before the history)."""
    rows = materialise(_births(files), "births")
    new = (rows.filter("side = 'own' AND birth = at AND started IS NOT NULL")
               .select("repo", "at", F.col("path").alias("n_path")))
    links = (rows.filter("side = 'old'").select("repo", "at", F.col("path").alias("o_path"), F.col("birth").alias("o_birth"))
                 .join(new, ["repo", "at"])
                 .select("repo", F.struct(F.col("n_path").alias("path"), F.col("at").alias("birth")).alias("node"),
                         F.struct(F.col("o_path").alias("path"), F.col("o_birth").alias("birth")).alias("root")))
    links = materialise(links.withColumn("moved", F.lit(True)), "links")
    LAST_ROUNDS[0] = 0
    while links.filter("moved").limit(1).count():
        LAST_ROUNDS[0] += 1
        up = links.select("repo", F.col("node").alias("root"), F.col("root").alias("_up"))
        links = materialise(links.join(up, ["repo", "root"], "left").select(
            "repo", "node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "links")
    own = rows.filter("side = 'own'").withColumn("node", F.struct("path", "birth"))
    first = F.coalesce("root", "node")
    life = F.concat(first["path"], F.lit("@"), F.floor(first["birth"] / F.lit(FILES_A_COMMIT)).cast("string"))
    return (own.join(links.drop("moved"), ["repo", "node"], "left")
               .select("repo", "commit_hash", "idx", "pos", "path", life.alias("life")))
