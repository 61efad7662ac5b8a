"""The per-file, per-checkpoint metrics dataset with labels and deltas.

Rows: files present at a checkpoint (S9) with non-empty content (S10) that the profile keeps
(P3).  Columns: ``repo, filepath, commit, committed_at, failure_prone`` + process metrics (J10,
missing -> 0) + product metrics (computed once per distinct content, then spread over the checkpoints
that its versions cover) + ``delta_<m>`` = round(m - m at the file's previous appearance, 3).

Process metrics and the previous appearance belong to the file's life (``operators/lives.py``): they
follow its renames, and a file that was deleted and added again starts anew.  The previous appearance
is found with a prefix max over checkpoint numbers per life and an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.labels import label_flag
from faultline.operators.ordered import join_range, prefix_agg, spans_one_bucket
from faultline.operators.process import PROCESS_METRICS, process_metrics
from faultline.operators.product import ANSIBLE_METRICS, TOSCA_METRICS
from faultline.operators.snapshot import alive_intervals, checkpoint_axis, covered
from faultline.operators.versions import keyed, measure
from faultline.plans.profiles import Profile
from faultline.session import materialise
from faultline.sources.history import History

ID_COLUMNS = ["filepath", "commit", "committed_at", "failure_prone"]


def product_profile(profile: Profile) -> str | None:
    return profile.metrics


def add_deltas(df: DataFrame, metrics: list[str], key: list[str], order: str = "rel_no") -> DataFrame:
    """``delta_m`` for each metric against the previous row of the same ``key`` by ``order``."""
    # The latest row before: if a life shows two paths at one checkpoint, the greatest path is its representative.
    row = F.when(F.col(order).isNotNull(), F.struct(order, "filepath", *metrics))
    d = prefix_agg(df, key, order, row, "max", "_prev", whole=spans_one_bucket(df, order))
    deltas = {f"delta_{m}": F.round(F.coalesce(F.col(m).cast("double"), F.lit(0.0)) - F.col(f"_prev.{m}").cast("double"), 3)
              for m in metrics}
    return d.withColumns(deltas).drop("_prev")


def build_dataset(h: History, profile: Profile, checkpoints: DataFrame, lives: DataFrame,
                  prone: DataFrame | None, product: bool = True, process: bool = True,
                  delta: bool = False, process_df: DataFrame | None = None,
                  product_df: DataFrame | None = None, axis: DataFrame | None = None) -> DataFrame:
    """``checkpoints(repo, commit_hash, idx, rel_no)``; ``prone(repo, filepath, commit)`` or None;
    ``lives`` from ``lives.file_lives``.

    ``process_df`` (output of ``process_metrics`` for these checkpoints), ``product_df``
    (``repo, idx, path`` + product metrics of each file version) and ``axis`` (``checkpoint_axis``)
    may be passed when a pipeline has already computed them; otherwise they are computed here.
    """
    # The checkpoint axis and the kept file versions each feed several branches: written once.
    if axis is None:
        axis = materialise(checkpoint_axis(h.commits, checkpoints), "axis")
    # Only the key of a content travels (S10, P3 are decided where it is read).
    iv = alive_intervals(keyed(h.files, profile.keep), ["content_key", "kept"]).filter("kept")
    iv = iv.filter(~F.regexp_extract("path", r"^(.*)/", 1).contains(".git"))
    # The state a path has after a commit is that of the commit's last event on it.
    state = lives.groupBy("repo", "path", "idx").agg(F.max_by("life", "pos").alias("life"))
    iv = materialise(iv.join(state, ["repo", "path", "idx"]), "versions")
    metric_cols: list[str] = []
    prod = product_profile(profile) if product else None
    if prod:
        if product_df is None:
            iv = iv.join(measure(h.files, profile.keep, profile.product_metrics), "content_key", "left")
        else:
            iv = iv.join(product_df, ["repo", "path", "idx"], "left")
        metric_cols = list(ANSIBLE_METRICS if prod == "ansible" else TOSCA_METRICS)
    cp = (checkpoints.select("repo", "rel_no", F.col("commit_hash").alias("commit"))
                     .join(h.commits.select("repo", F.col("commit_hash").alias("commit"),
                                            F.col("committed_at").cast("string").alias("committed_at")),
                           ["repo", "commit"]))
    if process:
        pr = process_df if process_df is not None else materialise(process_metrics(h.files, h.commits, axis, lives), "process")
        cp = cp.join(pr.select("repo", "rel_no", "change_set_max", "change_set_avg").distinct(), ["repo", "rel_no"], "left")
    # What belongs to a checkpoint comes with it; rows are made after the shuffles for it.
    rows = join_range(covered(iv.drop("content_key", "kept"), axis), F.col("_first"), F.col("_last"), cp, "repo", "rel_no")
    rows = rows.drop("_first", "_last").withColumnRenamed("path", "filepath")
    if prone is not None:
        rows = label_flag(rows, prone)
    else:
        rows = rows.withColumn("failure_prone", F.lit(0))
    if process:
        rows = rows.join(pr.drop("filepath", "change_set_max", "change_set_avg"), ["repo", "rel_no", "life"], "left")
        for m in PROCESS_METRICS:
            rows = rows.withColumn(m, F.coalesce(F.col(m), F.lit(0)))
        metric_cols = PROCESS_METRICS + metric_cols
    out = rows.select("repo", "rel_no", "life", *ID_COLUMNS, *metric_cols)
    if delta and metric_cols:
        # Deltas read the rows twice (own row, previous row): materialise them first.
        out = add_deltas(materialise(out, "rows"), metric_cols, ["repo", "life"])
    return out
