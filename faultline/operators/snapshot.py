"""Checkpoint axis, snapshot reconstruction (S9) and file content.

``checkpoint_axis`` gives every commit the number of checkpoints strictly before it.  With it:

* a checkpoint window (J11) is found without a range join: a checkpoint commit ``r`` closes
  window ``r`` and opens window ``r+1``; any other commit belongs to the window of the next
  checkpoint;
* a file state that holds on ``[idx, next_idx)`` covers exactly the checkpoints
  ``before(idx) .. before(next_idx) - 1`` and is expanded with ``sequence`` -- each generated row
  is an output row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.ordered import expand_range, prefix_agg, spans_one_bucket


def checkpoint_axis(commits: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``(repo, idx, rel_no?, before, n_cp)``: ``before`` = checkpoints with a smaller position,
    ``n_cp`` = checkpoints of the repository, ``rel_no`` set on checkpoint commits."""
    cp = checkpoints.select("repo", "idx", "rel_no")
    axis = (commits.select("repo", "idx").join(cp, ["repo", "idx"], "left")
                   .withColumn("_is", F.col("rel_no").isNotNull().cast("int")))
    axis = prefix_agg(axis, "repo", "idx", "_is", "sum", "before", whole=spans_one_bucket(commits))
    counts = cp.groupBy("repo").agg(F.count(F.lit(1)).alias("n_cp"))
    return axis.join(counts, "repo").drop("_is")


def window_membership(axis: DataFrame) -> DataFrame:
    """``(repo, idx, rel_no)`` -- each commit with the windows ``[previous checkpoint, this
    checkpoint]`` that contain it (both ends included; the first window is its checkpoint alone)."""
    is_cp = F.col("rel_no").isNotNull()
    b, n = F.col("before"), F.col("n_cp")
    wins = (F.when(is_cp & (b + 1 < n), F.array(b, b + 1))
             .when(is_cp, F.array(b))
             .when((b >= 1) & (b < n), F.array(b))
             .otherwise(F.array().cast("array<bigint>")))
    return axis.select("repo", "idx", F.explode(wins).alias("rel_no"))


def path_states(files: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Every change of a path's existence: ``(repo, path, idx, pos, alive, *carry)``.
    ADD/MODIFY/RENAME make ``new_path`` alive with the event's values; DELETE/RENAME end ``old_path``."""
    ct = F.col("change_type")
    born = files.filter(ct != "DELETE").select("repo", F.col("new_path").alias("path"), "idx", "pos",
                                                F.lit(True).alias("alive"), *carry)
    gone = (files.filter((ct == "DELETE") | ((ct == "RENAME") & (F.col("old_path") != F.col("new_path"))))
                 .select("repo", F.col("old_path").alias("path"), "idx", "pos", F.lit(False).alias("alive"),
                         *[F.lit(None).cast(files.schema[c].dataType).alias(c) for c in carry]))
    return born.unionByName(gone).filter(F.col("path").isNotNull())


def alive_intervals(files: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``(repo, path, idx, next_idx, *carry)``: the path exists, in the version of that event, on commits
    ``idx <= c < next_idx`` (``next_idx`` NULL = until the end).  ``carry`` names narrow columns, such as the
    content's key (``versions.keyed``): contents themselves need not travel."""
    st, whole = path_states(files, carry), spans_one_bucket(files)
    if whole:
        st = st.repartition("repo", "path")
    last = (st.groupBy("repo", "path", "idx")
              .agg(F.max_by(F.struct("alive", *carry), F.col("pos")).alias("_s"))
              .select("repo", "path", "idx", "_s.*")
              .withColumn("_neg", -F.col("idx")))
    nxt = prefix_agg(last, ["repo", "path"], "_neg", "idx", "min", "next_idx", whole=whole, placed=True)
    return nxt.filter("alive").select("repo", "path", "idx", "next_idx", *carry)


def covered(intervals: DataFrame, axis: DataFrame) -> DataFrame:
    """Intervals ``(repo, idx, next_idx, ...)`` with the checkpoints they cover: ``_first`` to ``_last``."""
    a = axis.select("repo", "idx", "before", "n_cp")
    lo = (intervals.join(a, ["repo", "idx"]).withColumnRenamed("before", "_first"))
    hi = a.select("repo", F.col("idx").alias("next_idx"), F.col("before").alias("_until"))
    both = lo.join(hi, ["repo", "next_idx"], "left")
    last = F.coalesce(F.col("_until"), F.col("n_cp")) - 1
    return both.withColumn("_last", last).drop("_until", "n_cp").filter("_first <= _last")


def expand_to_checkpoints(intervals: DataFrame, axis: DataFrame) -> DataFrame:
    """Intervals ``(repo, idx, next_idx, ...)`` -> one row per covered checkpoint ``rel_no``."""
    return expand_range(covered(intervals, axis), F.col("_first"), F.col("_last"), "rel_no", ["repo", "path", "idx"]).drop(
        "_first", "_last")


def snapshot(files: DataFrame, axis: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``(repo, rel_no, path, idx, *carry)`` -- files present at each checkpoint, in the version of the event
    at ``idx``; paths under a folder whose name contains ``.git`` (also ``.github``) are skipped."""
    iv = alive_intervals(files, carry).filter(~F.regexp_extract("path", r"^(.*)/", 1).contains(".git"))
    return expand_to_checkpoints(iv, axis).select("repo", "rel_no", "path", "idx", *carry)


def valid_content(df: DataFrame, col: str = "content") -> DataFrame:
    """Only rows whose content is a non-empty text."""
    return df.filter(F.col(col).isNotNull() & (F.length(col) > 0))


def write_text_files(docs: DataFrame, name_col: str, content_col: str, path: str) -> None:
    """One file per row below ``path``, in a folder ``<name_col>=<name>``: the content (text or bytes, null:
    empty) and a final newline.  Names must be unique."""
    rows = docs.select(F.col(name_col), F.coalesce(F.col(content_col).cast("binary"), F.lit(b"")).cast("string").alias("value"))
    rows.write.partitionBy(name_col).text(path)


def read_text_files(spark, path: str, final_newline: bool = False) -> DataFrame:
    """S10 on real files: ``(path, length, content, ...)`` and the columns that folder names ``a=b`` give; bytes that
    are not valid UTF-8 give a null content.  ``final_newline``: one newline at the end is not part of it."""
    raw = spark.read.format("binaryFile").load(path)
    body = F.col("content")
    if final_newline:
        body = F.expr("CASE WHEN right(content, 1) = X'0A' THEN substring(content, 1, length(content) - 1) ELSE content END")
    return raw.drop("modificationTime").withColumn("content", body).withColumn("length", F.length("content").cast("bigint")).withColumn(
        "content", F.try_validate_utf8(F.col("content").cast("string")))
