"""Fixing commits: C13 with J1-J3, P5 and O3-O5.

Everything is a semi/anti join or a filter keyed by ``(repo, commit_hash)``; order is data
(``idx``) and only applied when a caller sorts the output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.classify import change_signals, classify, defect_commits

KEY = ["repo", "commit_hash"]
Keep = Callable[[Column, Column], Column]


def discard_undesired(commits: DataFrame, files: DataFrame, keep: Keep) -> DataFrame:
    """Keep a commit iff it has at least one MODIFY file the profile keeps (judged on the
    new path and new content).  A RENAME does not count here."""
    ok = files.filter((F.col("change_type") == "MODIFY") & keep(F.col("new_path"), F.col("content")))
    return commits.join(ok.select(*KEY), KEY, "left_semi")


def skip_known(commits: DataFrame, known: DataFrame | None) -> DataFrame:
    """P5: do not classify commits already known as fixing."""
    return commits if known is None else commits.join(known.select(*KEY), KEY, "left_anti")


def sort_commits(hashes: DataFrame, commits: DataFrame) -> DataFrame:
    """Hashes -> known commits with their position, de-duplicated (unknown hashes drop out).
    Sort by ``idx`` at output time."""
    return (hashes.select(*KEY).distinct()
                  .join(commits.select(*KEY, "idx"), KEY))


def fixing_commits(commits: DataFrame, files: DataFrame, diff_lines: DataFrame, keep: Keep,
                   ansible_signals: bool, known: DataFrame | None = None, focus: str | None = None,
                   families: DataFrame | None = None) -> DataFrame:
    """New fixing commits ``(repo, commit_hash, idx, labels)`` -- commits not in ``known``
    whose labels are non-empty and that modify a file the profile keeps."""
    todo = skip_known(commits, known)
    # Change signals only matter for commits with a defect word; parse only their files.
    hot = defect_commits(todo)
    signals = change_signals(files.join(hot, KEY, "left_semi"), diff_lines.join(hot, KEY, "left_semi"),
                             ansible=ansible_signals, families=families)
    labelled = classify(todo, signals, focus).filter(F.size("labels") > 0)
    return discard_undesired(labelled, files, keep).select(*KEY, "idx", "labels")


def merge_known(new: DataFrame, known: DataFrame | None, commits: DataFrame) -> DataFrame:
    """O3: known + new fixing commits, de-duplicated, positioned (sort by ``idx`` at output)."""
    allc = new.select(*KEY) if known is None else new.select(*KEY).unionByName(known.select(*KEY))
    return sort_commits(allc, commits)
