"""SZZ on line slots -- which commit last touched the lines a fix changed.

Input lines are ``diff_lines`` whose ``line_no`` names a line slot of the file (stable across
versions in this model).  A fix blames, for every line it deleted/changed, the latest earlier
commit of the same file life that touched that line (an as-of join, backward and strict); the
bug-introducing commit of the (fix, file) pair is the oldest of those (J5).  Pairs with no blamed
line are dropped.

The as-of step is a prefix max over the (repo, life, line) axis, computed with the two-level
bucketed scan of ``ordered.prefix_agg`` -- no range join, and a hot file is split by buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.ordered import prefix_agg, spans_one_bucket


def touches(diff_lines: DataFrame, lives: DataFrame) -> DataFrame:
    """Every (repo, life, line_no, idx) touched by a diff line, with the event key."""
    return (diff_lines.join(lives.select("repo", "commit_hash", "pos", "life"), ["repo", "commit_hash", "pos"])
                      .select("repo", "life", "line_no", "idx", "commit_hash", "pos", "side"))


def blame(fix_events: DataFrame, diff_lines: DataFrame, lives: DataFrame) -> DataFrame:
    """``(repo, commit_hash, pos, line_no, prev_idx)`` for each deleted line of each fix event;
    ``prev_idx`` = position of the latest earlier commit touching the same line (NULL if none).

    ``fix_events(repo, commit_hash, pos)`` selects the file events to blame; ``lives`` comes from
    ``lives.file_lives``: lines of a file that had the same name earlier are never blamed.
    """
    key = ["repo", "commit_hash", "pos"]
    whole = spans_one_bucket(lives if "idx" in lives.columns else diff_lines)
    fix = fix_events.select(*key).withColumn("_fix", F.lit(True))
    # Only lives with a fix are asked about; their other lines travel as positions alone.
    asked = lives.join(fix, key, "left_semi").select("repo", "life").distinct()
    t = touches(diff_lines, lives.select(*key, "life").join(asked, ["repo", "life"], "left_semi")).join(fix, key, "left")
    event = F.when(F.col("_fix") & (F.col("side") == "deleted"), F.struct("commit_hash", "pos"))
    t = t.select("repo", "life", "line_no", "idx", event.alias("_event"))
    t = prefix_agg(t, ["repo", "life", "line_no"], "idx", "idx", "max", "prev_idx", whole=whole)
    return t.filter("_event IS NOT NULL").select("repo", "_event.commit_hash", "_event.pos", "life", "line_no", "prev_idx")


def oldest_inducing(blamed: DataFrame, commits: DataFrame) -> DataFrame:
    """``(repo, commit_hash, pos, bic, bic_idx)`` -- the oldest blamed commit per fix event."""
    agg = (blamed.filter(F.col("prev_idx").isNotNull())
                 .groupBy("repo", "commit_hash", "pos").agg(F.min("prev_idx").alias("bic_idx")))
    return agg.join(commits.select("repo", F.col("idx").alias("bic_idx"), F.col("commit_hash").alias("bic")),
                    ["repo", "bic_idx"])
