"""Incremental fixing-commit mining (P5 "resume from known fixing commits") as a stateful stream.

Two feeds arrive as files in folders, in any order and any number of batches: commits (the canonical
``commits`` schema, positions included) and file events, each with its diff lines nested and with the number of
events of its commit.  The stream keeps one keyed state per commit in the state store:

* *waiting*: what has arrived of it, until its commit row and all its events are there;
* *done*: it was handed on; whatever arrives again is dropped.

A commit is handed on once, with its events, in the batch that completes it.  That batch classifies the
commits it completes from the rows the state hands on, and reads no table of earlier batches: the work of an
epoch follows what arrives in it and what it completes, not the history.  Results go to the folder
``epoch=<id>`` with overwrite, so an epoch that runs again after a failure writes the same rows again; the state
store commits with the stream's checkpoint.  Output and checkpoint live in shared storage given by the caller.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultline.operators.fixes import fixing_commits, skip_known
from faultline.plans.profiles import Profile

COMMITS_SCHEMA = ("repo string, commit_hash string, branch string, author string, "
                  "committed_at timestamp_ntz, msg string, idx bigint")
EVENTS_SCHEMA = ("repo string, commit_hash string, idx bigint, pos int, change_type string, old_path string, new_path string, "
                 "content string, content_before string, lines array<struct<side:string,line_no:int,text:string>>, n_files int")
_ROWS = "repo string, commit_hash string, part int, n_files int, payload string"
_STATE = "done boolean, n_files int, parts array<int>, payloads array<string>"
COMMIT = -1     # the part of a commit row; events have their position


def event_feed(files: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """File events in the form of the feed: diff lines nested, and the number of events of the commit."""
    key = ["repo", "commit_hash", "pos"]
    lines = diff_lines.groupBy(*key).agg(F.collect_list(F.struct("side", F.col("line_no").cast("int").alias("line_no"), "text")).alias("lines"))
    counts = files.groupBy("repo", "commit_hash").agg(F.count(F.lit(1)).cast("int").alias("n_files"))
    return files.join(lines, key, "left").join(counts, ["repo", "commit_hash"]).select(
        "repo", "commit_hash", "idx", F.col("pos").cast("int").alias("pos"), "change_type", "old_path", "new_path", "content",
        "content_before", "lines", "n_files")


def _complete(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State machine of one commit: wait for its row and ``n_files`` events, hand everything on, be done."""
    done, n_files, parts, payloads = state.get if state.exists else (False, None, [], [])
    parts, payloads = list(parts), list(payloads)
    if done:
        return
    for pdf in batches:
        for part, n, payload in zip(pdf["part"], pdf["n_files"], pdf["payload"]):
            if int(part) in parts:      # a repeated row
                continue
            parts.append(int(part))
            payloads.append(payload)
            if part != COMMIT:
                n_files = int(n)
    if COMMIT in parts and n_files is not None and len(parts) - 1 >= n_files:
        state.update((True, n_files, [], []))
        yield pd.DataFrame({"repo": key[0], "commit_hash": key[1], "part": pd.Series(parts, dtype="int32"),
                            "n_files": pd.Series([n_files] * len(parts), dtype="int32"), "payload": payloads})
    else:
        state.update((False, n_files, parts, payloads))


def _as_rows(df: DataFrame, part, n_files) -> DataFrame:
    return df.select("repo", "commit_hash", part.cast("int").alias("part"), n_files.cast("int").alias("n_files"),
                     F.to_json(F.struct(*df.columns)).alias("payload"))


def completed(commits: DataFrame, events: DataFrame) -> DataFrame:
    """Rows ``(repo, commit_hash, part, n_files, payload)`` of the commits that the feeds complete, each once."""
    rows = _as_rows(commits, F.lit(COMMIT), F.lit(None)).unionByName(_as_rows(events, F.col("pos"), F.col("n_files")))
    return rows.groupBy("repo", "commit_hash").applyInPandasWithState(
        _complete, _ROWS, _STATE, "append", GroupStateTimeout.NoTimeout)


def unpack(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, files, diff lines) from rows of ``completed``."""
    commits = rows.where(F.col("part") == COMMIT).select(F.from_json("payload", COMMITS_SCHEMA).alias("r")).select("r.*")
    events = rows.where(F.col("part") != COMMIT).select(F.from_json("payload", EVENTS_SCHEMA).alias("r")).select("r.*")
    lines = events.select("repo", "commit_hash", "idx", "pos", F.coalesce("new_path", "old_path").alias("path"), F.explode("lines").alias("l")).select(
        "repo", "commit_hash", "idx", "pos", "path", "l.*")
    return commits, events.drop("lines", "n_files"), lines


def start(spark: SparkSession, commits_dir: str, events_dir: str, profile: Profile, out_dir: str, checkpoint_location: str,
          known: DataFrame | None = None, available_now: bool = True, files_a_batch: int | None = None) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there and stops.  ``known`` holds fixing
    commits of runs before the stream; they are not classified again.  ``files_a_batch`` limits what a batch
    takes of each feed."""
    def feed(schema: str, folder: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)

    def batch(df: DataFrame, epoch_id: int) -> None:
        df = df.persist()       # three readers; dropped with the batch
        try:
            commits, files, lines = unpack(df)
            new = fixing_commits(skip_known(commits, known), files, lines, profile.keep, profile.ansible_signals)
            (new.select("repo", "commit_hash", "idx", "labels")
                .write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch_id}")))
        finally:
            df.unpersist()

    rows = completed(feed(COMMITS_SCHEMA, commits_dir), feed(EVENTS_SCHEMA, events_dir))
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
