"""Canonical history tables and the scans over them.


* ``commits(repo, commit_hash, branch, idx, author, committed_at, msg)``
* ``files(repo, commit_hash, idx, pos, change_type, old_path, new_path, additions, deletions, hunks,
  content, content_before)`` -- one row per modified file of a commit
* ``diff_lines(repo, commit_hash, idx, pos, path, side, line_no, text)``
* ``tags(repo, commit_hash)`` -- release commits

``idx`` (position in date order) is the time axis of every comparison; ``repo`` leads every key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.ordered import DEFAULT_WIDTH, ordered_index


@dataclass(frozen=True)
class History:
    commits: DataFrame
    files: DataFrame
    diff_lines: DataFrame
    tags: DataFrame

    def where_repo(self, cond) -> "History":
        return replace(self, commits=self.commits.filter(cond), files=self.files.filter(cond),
                       diff_lines=self.diff_lines.filter(cond), tags=self.tags.filter(cond))


def with_positions(commits: DataFrame) -> DataFrame:
    """``idx`` = 0-based position of the commit in its repository by (committed_at, hash).

    Counted per (repo, day) and offset by the running count of earlier days, so a repository with
    a huge history is numbered by many tasks, not one.
    """
    day = F.unix_date(F.to_date(F.col("committed_at")))
    return ordered_index(commits, "repo", day, [F.col("committed_at"), F.col("commit_hash")], out="idx")


def on_branch(commits: DataFrame, branch: str | None) -> DataFrame:
    """Commits of one branch; ``None`` keeps every commit."""
    return commits if branch is None else commits.filter(F.col("branch") == branch)


def range_scan(commits: DataFrame, bounds: DataFrame) -> DataFrame:
    """S3: commits between two commits of the same repository, both ends included.

    ``bounds(repo, from_hash, to_hash)``; the two ends may be given in either order.  The bound
    positions are found with equi-joins on (repo, hash); the range is a filter on ``idx``.
    """
    pos = commits.select("repo", "commit_hash", "idx")
    b = (bounds.join(pos.withColumnRenamed("commit_hash", "from_hash").withColumnRenamed("idx", "_a"),
                     ["repo", "from_hash"])
               .join(pos.withColumnRenamed("commit_hash", "to_hash").withColumnRenamed("idx", "_b"),
                     ["repo", "to_hash"])
               .select("repo", F.least("_a", "_b").alias("_lo"), F.greatest("_a", "_b").alias("_hi")))
    return (commits.join(b, "repo")
                   .filter(F.col("idx").between(F.col("_lo"), F.col("_hi")))
                   .drop("_lo", "_hi"))


def point_scan(commits: DataFrame, hashes: DataFrame) -> DataFrame:
    """The commits named in ``hashes(repo, commit_hash)``."""
    return commits.join(hashes.select("repo", "commit_hash").distinct(), ["repo", "commit_hash"], "left_semi")


def release_checkpoints(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Release commits (tagged) numbered 0.. in date order -> ``(repo, commit_hash, idx, rel_no)``."""
    rel = commits.select("repo", "commit_hash", "idx").join(
        tags.select("repo", "commit_hash").distinct(), ["repo", "commit_hash"], "left_semi")
    return ordered_index(rel, "repo", F.floor(F.col("idx") / DEFAULT_WIDTH), [F.col("idx")], out="rel_no")


def commit_checkpoints(commits: DataFrame) -> DataFrame:
    """Every commit is a checkpoint."""
    return commits.select("repo", "commit_hash", "idx", F.col("idx").alias("rel_no"))


def file_events(files: DataFrame, change_types: list[str] | None = None) -> DataFrame:
    """Modified files, optionally restricted to some change types."""
    return files if change_types is None else files.filter(F.col("change_type").isin(change_types))


def diff_scan(diff_lines: DataFrame, side: str | None = None) -> DataFrame:
    """Added and/or deleted diff lines."""
    return diff_lines if side is None else diff_lines.filter(F.col("side") == side)
