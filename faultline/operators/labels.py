"""Failure-prone labels: J7 (range), J8 (name at the commit), J9 (0/1 flag).

J7 emits, for every fixed file, one row per commit with ``bic_idx <= idx < fic_idx``.  Instead of a
range join (commits x intervals), each interval is cut into short pieces, which meet the commits of
their piece of the axis in an equi-join (``ordered.join_range``): the rows of the result are made after
the last shuffle.

J8: renames cut the time axis of a name into *eras*, numbered by the renames before them.  One sweep
over renames and interval ends on the same (key, time) axis gives every interval the numbers of its
first and last era, so it meets exactly the eras it overlaps: each of these pairs has an output row,
however many fixes and renames a path has.

* One hop (the default): the key is the path.  Walking back from the last fix, a rename ``old -> new``
  seen after a commit makes rows of ``new`` at that commit carry ``old``: the name is the ``old_path`` of the
  earliest rename with ``new_path = filepath`` and ``c < rename_idx <= last fix``.
* ``follow_chain``: the key is the life of the file (``lives.file_lives``), and the name is the one the file
  had at the commit, along all its renames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.lives import FILES_A_COMMIT
from faultline.operators.ordered import DEFAULT_WIDTH, expand_range, join_range, prefix_agg, prefix_aggs, spans_one_bucket
from faultline.session import materialise

FIXED_KEY = ["repo", "filepath", "fic_idx", "bic_idx"]


def eras(renames: DataFrame, whole: bool = False) -> DataFrame:
    """``(repo, key, era, since, until, name)`` from ``renames(repo, key, idx, old_name, last_name)``: the commits
    ``since <= idx < until`` of each era and the name there; null bounds are open.  Before a rename the name is
    its ``old_name``, after the last one ``last_name``."""
    r = renames.groupBy("repo", "key", "idx").agg(F.min(F.struct("old_name", "last_name")).alias("_n"))
    one = F.lit(1).cast("bigint")
    r = prefix_aggs(r.withColumn("_one", one), ["repo", "key"], "idx", [("_one", "sum", "era", False), ("idx", "max", "since", False)],
                    whole=whole)
    last = r.groupBy("repo", "key").agg(F.max_by(F.struct((F.col("era") + 1).alias("era"), F.col("idx").alias("since"),
                                                          F.col("_n.last_name").alias("name")), "idx").alias("_l"))
    return r.select("repo", "key", "era", "since", F.col("idx").alias("until"), F.col("_n.old_name").alias("name")).unionByName(
        last.select("repo", "key", "_l.era", "_l.since", F.lit(None).cast("bigint").alias("until"), "_l.name"))


def name_spans(fixed: DataFrame, renames: DataFrame, whole: bool = False) -> DataFrame:
    """``fixed(repo, key, ...FIXED_KEY)`` cut at renames: ``(*FIXED_KEY, name, lo, hi)``, ``lo <= idx <= hi``; the
    name is null where no rename tells."""
    fixed = materialise(fixed.filter(F.col("bic_idx") < F.col("fic_idx")), "intervals")
    renames = materialise(renames, "renames")
    no, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    ends = fixed.select("repo", "key", F.explode(F.array(F.col("bic_idx"), F.col("fic_idx") - 1)).alias("idx"))
    axis = ends.distinct().select("repo", "key", "idx", no.alias("_step")).unionByName(
        renames.select("repo", "key", "idx").distinct().select("repo", "key", "idx", one.alias("_step")))
    at = prefix_agg(axis, ["repo", "key"], "idx", "_step", "sum", "era", inclusive=True, whole=whole)
    at = at.filter("_step = 0").select("repo", "key", "idx", "era")
    first = at.select("repo", "key", F.col("idx").alias("bic_idx"), F.col("era").alias("_first"))
    last = at.select("repo", "key", (F.col("idx") + 1).alias("fic_idx"), F.col("era").alias("_last"))
    met = fixed.join(first, ["repo", "key", "bic_idx"]).join(last, ["repo", "key", "fic_idx"])
    met = expand_range(met, F.col("_first"), F.col("_last"), "era", ["repo", "key"]).drop("_first", "_last")
    cut = met.join(eras(renames, whole), ["repo", "key", "era"], "left")
    return cut.select(*FIXED_KEY, "name", F.greatest("since", "bic_idx").alias("lo"), (F.least("until", "fic_idx") - 1).alias("hi"))


def lives_of_names(fixed: DataFrame, files: DataFrame, lives: DataFrame, whole: bool = False) -> DataFrame:
    """``fixed`` with ``life``: of the file that has the name ``filepath`` at the fix, else of the next one to have it."""
    moved = (F.col("change_type") == "RENAME") & (F.col("old_path") != F.col("new_path"))
    ev = files.join(lives.select("repo", "commit_hash", "pos", "life"), ["repo", "commit_hash", "pos"])
    at = (F.col("idx") * F.lit(FILES_A_COMMIT) + F.col("pos")).cast("bigint")
    # Per path and commit the last event tells; a name that was taken away is no one's.
    taken = ev.filter(moved).select("repo", F.col("old_path").alias("path"), at.alias("at"), "idx", F.lit(None).cast("string").alias("life"))
    had = ev.select("repo", F.coalesce("new_path", "old_path").alias("path"), at.alias("at"), "idx",
                    F.when(F.col("change_type") != "DELETE", F.col("life")).alias("life"))
    states = had.unionByName(taken).groupBy("repo", "path", "idx").agg(F.max(F.struct("at", "life")).alias("_s")).select(
        "repo", "path", "idx", F.struct("idx", "_s.life").alias("state"))
    asked = fixed.select("repo", F.col("filepath").alias("path"), F.col("fic_idx").alias("idx")).distinct()
    none = F.lit(None).cast("struct<idx:bigint,life:string>")
    axis = materialise(states.withColumn("asked", F.lit(False)).unionByName(
        asked.withColumn("state", none).withColumn("asked", F.lit(True))), "name-states")
    before = prefix_agg(axis, ["repo", "path"], "idx", "state", "max", "before", inclusive=True, whole=whole).filter("asked").select(
        "repo", "path", "idx", "before")
    held = F.when(F.col("state.life").isNotNull(), F.col("state"))
    back = axis.withColumn("_neg", -F.col("idx"))
    after = prefix_agg(back, ["repo", "path"], "_neg", held, "min", "after", width=DEFAULT_WIDTH, whole=whole).filter("asked").select(
        "repo", "path", "idx", "after")
    life = before.join(after, ["repo", "path", "idx"]).select(
        "repo", F.col("path").alias("filepath"), F.col("idx").alias("fic_idx"), F.coalesce("before.life", "after.life", F.lit("")).alias("life"))
    return fixed.join(life, ["repo", "filepath", "fic_idx"])


def failure_prone(fixed: DataFrame, files: DataFrame, commits: DataFrame, last_fix: DataFrame,
                  follow_names: bool = True, lives: DataFrame | None = None, follow_chain: bool = False) -> DataFrame:
    """``fixed(repo, filepath, fic_idx, bic_idx)``, ``last_fix(repo, hi)`` ->
    ``(repo, filepath, commit, idx, fixing_commit, fic_idx)``.  ``follow_chain`` needs ``lives``."""
    f, whole = fixed.select(*FIXED_KEY), spans_one_bucket(files)
    renamed = files.filter(F.col("change_type") == "RENAME")
    if follow_chain:
        chain = renamed.filter("old_path <> new_path").join(lives.select("repo", "commit_hash", "pos", "life"),
                                                            ["repo", "commit_hash", "pos"])
        spans = name_spans(lives_of_names(f, files, lives, whole).withColumnRenamed("life", "key"), chain.select(
            "repo", F.col("life").alias("key"), "idx", F.col("old_path").alias("old_name"), F.col("new_path").alias("last_name")), whole)
    elif follow_names:
        seen = renamed.join(last_fix, "repo").filter(F.col("idx") <= F.col("hi"))
        spans = name_spans(f.withColumn("key", F.col("filepath")), seen.select(
            "repo", F.col("new_path").alias("key"), "idx", F.col("old_path").alias("old_name"), F.lit(None).cast("string").alias("last_name")), whole)
    else:
        spans = f.select(*FIXED_KEY, F.lit(None).cast("string").alias("name"), F.col("bic_idx").alias("lo"),
                         (F.col("fic_idx") - 1).alias("hi"))
    named = spans.select("repo", F.coalesce("name", "filepath").alias("name"), "fic_idx", "lo", "hi")
    ch = commits.select("repo", "idx", "commit_hash")
    named = named.filter("lo <= hi").join(
        ch.select("repo", F.col("idx").alias("fic_idx"), F.col("commit_hash").alias("fixing_commit")), ["repo", "fic_idx"])
    rows = join_range(named, F.col("lo"), F.col("hi"), ch, "repo", "idx")
    return rows.select("repo", F.col("name").alias("filepath"), F.col("commit_hash").alias("commit"), "idx",
                       "fixing_commit", "fic_idx")


def label_flag(rows: DataFrame, prone: DataFrame) -> DataFrame:
    """``failure_prone`` = 1 when ``(repo, filepath, commit)`` is labelled (the fixing commit is
    not part of the key), else 0."""
    keys = prone.select("repo", "filepath", "commit").distinct().withColumn("_hit", F.lit(1))
    return (rows.join(keys, ["repo", "filepath", "commit"], "left")
                .withColumn("failure_prone", F.coalesce(F.col("_hit"), F.lit(0)))
                .drop("_hit"))
