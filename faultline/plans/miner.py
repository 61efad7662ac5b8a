"""The mining plan: fixing commits -> fixed files -> failure-prone file versions.

Each step is a function from DataFrames to DataFrames over any number of repositories; there is
no object state, so steps can be run, cached or written out independently.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.blame import blame, oldest_inducing
from faultline.operators.line_identity import blame_lines
from faultline.operators.fixed_files import merge_by_path, merge_with_renames
from faultline.operators.fixes import fixing_commits
from faultline.operators.labels import failure_prone
from faultline.operators.lineage import path_lineage
from faultline.operators.lives import file_lives
from faultline.operators.ordered import spans_one_bucket
from faultline.plans.profiles import Profile
from faultline.session import ensure_checkpoint_dir, materialise
from faultline.sources.history import History, on_branch


def mine_fixing_commits(h: History, profile: Profile, known: DataFrame | None = None,
                        families: DataFrame | None = None, branch: str | None = None) -> DataFrame:
    """``(repo, commit_hash, idx, labels)`` of new fixing commits (of one branch when given, S2)."""
    return fixing_commits(on_branch(h.commits, branch), h.files, h.diff_lines, profile.keep, profile.ansible_signals,
                          known=known, families=families)


def fix_events(h: History, profile: Profile, fixing: DataFrame) -> DataFrame:
    """MODIFY/RENAME events of fixing commits on files the profile keeps."""
    return (h.files.join(fixing.select("repo", "commit_hash"), ["repo", "commit_hash"], "left_semi")
                   .filter(F.col("change_type").isin("MODIFY", "RENAME")
                           & profile.keep(F.col("new_path"), F.col("content"))))


def szz_fixes(h: History, profile: Profile, fixing: DataFrame, lineage: DataFrame, lives: DataFrame,
              lines: bool = True) -> DataFrame:
    """J4+J5: fix events with their oldest bug-introducing commit
    ``(repo, commit_hash, idx, pos, lineage, change_type, old_path, new_path, bic, bic_idx)``.

    ``line_no`` of the diff lines is a line number of the old or new version; with ``lines=False`` it is
    a slot that keeps its meaning between versions (``blame.blame``)."""
    ev = fix_events(h, profile, fixing)
    blamed = blame_lines(ev, h.files, h.diff_lines, lives) if lines else blame(ev, h.diff_lines, lives)
    oldest = oldest_inducing(blamed, h.commits)
    return (ev.select("repo", "commit_hash", "idx", "pos", "change_type", "old_path", "new_path")
              .join(oldest, ["repo", "commit_hash", "pos"])
              .join(lineage.withColumnRenamed("path", "new_path"), ["repo", "new_path"]))


def fix_range(fixing: DataFrame) -> DataFrame:
    """``(repo, lo, hi)``: first and last fixing commit per repository."""
    return fixing.groupBy("repo").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))


def attach_hashes(fixed: DataFrame, commits: DataFrame) -> DataFrame:
    c = commits.select("repo", "idx", "commit_hash")
    return (fixed.join(c.withColumnRenamed("idx", "fic_idx").withColumnRenamed("commit_hash", "fic"), ["repo", "fic_idx"])
                 .join(c.withColumnRenamed("idx", "bic_idx").withColumnRenamed("commit_hash", "bic"), ["repo", "bic_idx"]))


def fixed_files(h: History, profile: Profile, fixing: DataFrame, lineage: DataFrame | None = None,
                follow_renames: bool = True, fixes: DataFrame | None = None, lives: DataFrame | None = None) -> DataFrame:
    """``(repo, filepath, fic, bic, fic_idx, bic_idx)``.  ``fixes`` = a precomputed ``szz_fixes``;
    ``lineage`` and ``lives`` may be passed when they are known."""
    lineage = lineage if lineage is not None else path_lineage(h.files)
    if fixes is None:
        # The fix table (one row per blamed fix event) feeds several branches below: compute it once.
        lives = lives if lives is not None else file_lives(h.files)
        fixes = materialise(szz_fixes(h, profile, fixing, lineage, lives), "fixes")
    if follow_renames:
        merged = merge_with_renames(fixes, h.files, lineage, fix_range(fixing))
    else:
        merged = merge_by_path(fixes.withColumnRenamed("new_path", "filepath").withColumnRenamed("idx", "fic_idx"),
                               whole=spans_one_bucket(h.files))
    return attach_hashes(merged.select("repo", "filepath", "fic_idx", "bic_idx"), h.commits).select(
        "repo", "filepath", "fic", "bic", "fic_idx", "bic_idx")


def label(h: History, fixed: DataFrame, fixing: DataFrame, follow_names: bool = True, follow_chain: bool = False,
          lives: DataFrame | None = None) -> DataFrame:
    """``(repo, filepath, commit, idx, fixing_commit, fic_idx)`` failure-prone file versions.  Names follow one
    rename, or with ``follow_chain`` all renames of the file's life (``lives`` may be passed when known)."""
    if follow_chain and lives is None:
        lives = materialise(file_lives(h.files), "lives")
    return failure_prone(fixed, h.files, h.commits, fix_range(fixing).select("repo", "hi"), follow_names, lives, follow_chain)


@dataclass(frozen=True)
class Mined:
    lineage: DataFrame
    fixing: DataFrame
    fixed: DataFrame
    failure_prone: DataFrame


def mine(h: History, profile: Profile, known: DataFrame | None = None, follow_renames: bool = True,
         branch: str | None = None) -> Mined:
    """Whole plan.  Lineage and fixing commits are each used several times downstream, so they are
    written once (Parquet in the shared folder): computed once, short plans."""
    ensure_checkpoint_dir(h.commits.sparkSession)
    lineage = materialise(path_lineage(h.files), "lineage")
    fixing = materialise(mine_fixing_commits(h, profile, known, branch=branch), "fixing")
    fixed = fixed_files(h, profile, fixing, lineage, follow_renames)
    return Mined(lineage, fixing, fixed, label(h, fixed, fixing, follow_renames))
