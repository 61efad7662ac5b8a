"""Fixed files: merge (fix, bug-introducing) intervals per file -- W1/W2.

A file's newest run of overlapping fixes is one interval; every fix older than the first gap (a fix
older than the oldest bug-introducing commit so far) is a row of its own.

* ``merge_by_path`` (W2): window form keyed by the path at the fix -- exact when no rename happens in
  the fix range.
* ``merge_with_renames`` (W1): fixes are filed under the newest name of their file, until a gap shows
  up; from there on a file keeps the name it had.

W1 works on *stretches*: the fixes of one path up to the rename that took its name away.  A rename
hangs the stretch it ends below the stretch it leads to, so the stretches of a file form a tree.
Spark cuts every stretch into runs of overlapping fixes.  A run is indivisible: each of its fixes
reaches back beyond the next one, so if its newest fix falls into an interval all of them do, also
when other stretches feed the same interval in between.  What is left to decide in order is the name
of each run, from one small row per run and per rename; fixes are then grouped by it in Spark.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.ordered import DEFAULT_WIDTH, prefix_agg, spans_one_bucket
from faultline.session import materialise

# Ship the ordered step by value: executors need pandas only, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES_A_COMMIT = 1 << 24   # positions of one commit on the axis "newest commit first"
OPEN = 1 << 62             # end of a stretch whose name was never taken away
RUN_NAMES = "repo string, path string, ended long, run long, head string"

def merge_by_path(fixes: DataFrame, path_col: str = "filepath", whole: bool = False) -> DataFrame:
    """``fixes(repo, <path_col>, fic_idx, bic_idx, ...)`` -> ``(repo, filepath, fic_idx, bic_idx)``.
    ``whole``: the commits span one bucket (``ordered.spans_one_bucket``)."""
    d = fixes.select("repo", F.col(path_col).alias("filepath"), "fic_idx", "bic_idx",
                     (-F.col("fic_idx")).alias("_neg"))
    keys = ["repo", "filepath"]
    d = prefix_agg(d, keys, "_neg", "bic_idx", "min", "_prev_min", whole=whole)
    d = d.withColumn("_brk", F.coalesce(F.col("fic_idx") < F.col("_prev_min"), F.lit(False)).cast("int"))
    d = prefix_agg(d, keys, "_neg", "_brk", "sum", "_island", inclusive=True, whole=whole, placed=True)
    head = (d.filter(F.col("_island") == 0).groupBy(*keys)
             .agg(F.max("fic_idx").alias("fic_idx"), F.min("bic_idx").alias("bic_idx")))
    rest = d.filter(F.col("_island") > 0).select(*keys, "fic_idx", "bic_idx")
    return head.unionByName(rest)


def _newest_first() -> F.Column:
    """Position of a file event on an axis that runs from the newest commit to the oldest."""
    return F.col("pos").cast("bigint") - F.col("idx") * F.lit(FILES_A_COMMIT)


def stretches(fixes: DataFrame, renames: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both inputs with the ``ended`` of the stretch they belong to: the position of the rename that
    took the path's name away next (``OPEN``: none).  For a rename it names the stretch it leads to."""
    cols = ["repo", "lineage", "at", "path", "was", "idx", "bic_idx"]
    none = F.lit(None).cast("bigint")
    fx = fixes.select("repo", "lineage", _newest_first().alias("at"), F.col("new_path").alias("path"),
                      F.lit(None).cast("string").alias("was"), "idx", "bic_idx", none.alias("taken"))
    rn = renames.withColumn("at", _newest_first())
    to = rn.select("repo", "lineage", "at", F.col("new_path").alias("path"), F.col("old_path").alias("was"),
                   "idx", none.alias("bic_idx"), none.alias("taken"))
    away = rn.select("repo", "lineage", "at", F.col("old_path").alias("path"), F.lit(None).cast("string").alias("was"),
                     "idx", none.alias("bic_idx"), F.col("at").alias("taken"))
    rows = prefix_agg(fx.unionByName(to).unionByName(away), ["repo", "path"], "at", "taken", "max", "ended",
                      inclusive=True, width=FILES_A_COMMIT * DEFAULT_WIDTH, whole=whole)
    rows = materialise(rows.withColumn("ended", F.coalesce("ended", F.lit(OPEN))), "stretches")
    # A name that was given away and used again has several stretches; they may meet in one interval
    # fix by fix, so in such files every fix is a run.
    again = (rows.groupBy("repo", "path").agg(F.min("ended").alias("_a"), F.max("ended").alias("_b"),
                                              F.max("lineage").alias("lineage"))
                 .filter("_a <> _b").select("repo", "lineage").distinct().withColumn("reused", F.lit(True)))
    rows = rows.filter("taken IS NULL").join(again, ["repo", "lineage"], "left")
    return (rows.filter("was IS NULL").select(*cols, "ended", F.coalesce("reused", F.lit(False)).alias("reused")),
            rows.filter("was IS NOT NULL").select(*cols, "ended"))


def runs(fixes: DataFrame, whole: bool = False) -> DataFrame:
    """``fixes`` with ``run``: the number of gaps before the fix in its stretch (reused names: the fix)."""
    key, width = ["repo", "path", "ended"], FILES_A_COMMIT * DEFAULT_WIDTH
    d = prefix_agg(fixes, key, "at", "bic_idx", "min", "_reach", width=width, whole=whole)
    gap = F.coalesce(F.col("idx") < F.col("_reach"), F.lit(False)).cast("int")
    d = prefix_agg(d, key, "at", gap, "sum", "_gaps", inclusive=True, width=width, whole=whole, placed=True)
    return d.withColumn("run", F.when(F.col("reused"), F.col("at")).otherwise(F.col("_gaps")).cast("bigint")).drop(
        "_reach", "_gaps")


def _name_runs(batches):
    """Name of the interval of every run (``head``; null: each fix stands alone).  Rows of one file
    come together, newest first; memory holds the names of one file."""
    file, names, reach = None, {}, {}
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if (row.repo, row.lineage) != file:
                file, names, reach = (row.repo, row.lineage), {}, {}
            stretch = (row.path, row.ended)
            filed_under = names.get(stretch, row.path)
            if row.was is not None:              # the stretch that ends here takes over the name
                names[(row.was, row.at)] = filed_under
                continue
            head = filed_under
            if row.newest < reach.get(head, row.newest):
                names[stretch] = row.path        # gap: from here on the file has its own name
                head = None if row.path in reach else row.path
            if head is not None:
                reach[head] = min(row.oldest_bic, reach.get(head, row.oldest_bic))
            out.append((row.repo, row.path, row.ended, row.run, head))
        yield pd.DataFrame(out, columns=["repo", "path", "ended", "run", "head"]).astype(
            {"ended": "int64", "run": "int64"})


def merge_with_renames(fixes: DataFrame, files: DataFrame, lineage: DataFrame, fix_range: DataFrame) -> DataFrame:
    """Exact merge with rename resolution.

    ``fixes(repo, lineage, idx, pos, change_type, old_path, new_path, bic_idx)`` -- fix events with
    their oldest bug-introducing commit; ``fix_range(repo, lo, hi)`` -- first/last fixing commit;
    ``lineage(repo, path, lineage)``.  Returns ``(repo, lineage, filepath, fic_idx, bic_idx)``.
    Files without a rename in the fix range take ``merge_by_path``.
    """
    whole = spans_one_bucket(files)
    renames = (files.filter((F.col("change_type") == "RENAME") & (F.col("old_path") != F.col("new_path")))
                    .join(fix_range, "repo")
                    .filter(F.col("idx").between(F.col("lo"), F.col("hi")))
                    .join(lineage.withColumnRenamed("path", "new_path"), ["repo", "new_path"])
                    .select("repo", "lineage", "idx", "pos", "old_path", "new_path"))
    renamed = renames.select("repo", "lineage").distinct()
    fx = (fixes.filter(F.col("bic_idx").isNotNull())
               .select("repo", "lineage", "idx", "pos", "new_path", F.col("bic_idx").cast("long")))

    plain = fx.join(renamed, ["repo", "lineage"], "left_anti")
    simple = (merge_by_path(plain.withColumnRenamed("new_path", "filepath").withColumnRenamed("idx", "fic_idx"), whole=whole)
              .join(plain.select("repo", F.col("new_path").alias("filepath"), "lineage").distinct(),
                    ["repo", "filepath"]))

    in_stretch, links = stretches(fx.join(renamed, ["repo", "lineage"], "left_semi"), renames, whole)
    in_run = materialise(runs(in_stretch, whole), "runs")  # read for the steps and for the result
    key = ["repo", "path", "ended", "run"]
    zero = F.lit(0).cast("bigint")
    steps = (in_run.groupBy("lineage", *key)
                   .agg(F.min("at").alias("at"), F.max("idx").alias("newest"), F.min("bic_idx").alias("oldest_bic"))
                   .withColumn("was", F.lit(None).cast("string"))
                   .unionByName(links.select("repo", "lineage", "path", "ended", "at", "was", zero.alias("run"),
                                             zero.alias("newest"), zero.alias("oldest_bic"))))
    named = (steps.repartition("repo", "lineage")
                  .sortWithinPartitions("repo", "lineage", "at", F.col("was").isNull())
                  .mapInPandas(_name_runs, RUN_NAMES))
    filed = in_run.join(named, key)
    heads = (filed.filter("head IS NOT NULL").groupBy("repo", "lineage", F.col("head").alias("filepath"))
                  .agg(F.max("idx").alias("fic_idx"), F.min("bic_idx").alias("bic_idx")))
    alone = filed.filter("head IS NULL").select("repo", "lineage", F.col("path").alias("filepath"),
                                                F.col("idx").alias("fic_idx"), "bic_idx")
    return simple.select("repo", "lineage", "filepath", "fic_idx", "bic_idx").unionByName(heads).unionByName(alone)
