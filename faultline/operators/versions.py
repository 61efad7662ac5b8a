"""File versions by content: each distinct content is stored and measured once.

A content is known by a 128-bit key, computed where the content is read.  Events, snapshots and datasets
carry the key; the contents themselves are brought together once, by key (copies within a task first), in
the version table, and whatever is computed from a content alone is computed there and joined by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import materialise

Keep = Callable[[Column, Column], Column]


def content_key(content: Column) -> Column:
    """128 bits of the content as 32 hex digits; null for a missing content."""
    return F.md5(content)


def keyed(files: DataFrame, keep: Keep) -> DataFrame:
    """``files`` without contents but with ``content_key`` and ``kept``: whether the new content is a non-empty
    text of a file the profile keeps."""
    kept = (F.length("content") > 0) & keep(F.col("new_path"), F.col("content"))
    return files.withColumns({"content_key": content_key(F.col("content")), "kept": F.coalesce(kept, F.lit(False))}).drop(
        "content", "content_before")


def version_table(files: DataFrame, keep: Keep) -> DataFrame:
    """``(content_key, content)``: every distinct content of the files the profile keeps, once."""
    rows = files.filter((F.col("change_type") != "DELETE") & F.col("content").isNotNull() & keep(F.col("new_path"), F.col("content")))
    # Copies are found by hashing: an aggregate that carries contents along would sort them all.
    rows = rows.select("content").distinct()
    return materialise(rows.select(content_key(F.col("content")).alias("content_key"), "content"), "contents")


def measure(files: DataFrame, keep: Keep, metrics: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``(content_key, ...)``: ``metrics(contents, keys)`` of every distinct content, stored."""
    return materialise(metrics(version_table(files, keep), ["content_key"]), "measured")
