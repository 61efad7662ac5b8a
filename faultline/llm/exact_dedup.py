"""Exact duplicates with a heavy-hitter split.

1. Every text is reduced to its SHA-256, row by row; only (id, digest) goes further.
2. Misra-Gries counters (``DataFrame.stat.freqItems``: at most 1/support counters a task, merged)
   name every digest that holds more than ``support`` of all rows, and some that do not.
3. An exact count over the named digests alone verifies them and finds the row that stays.  The
   verified winners, 1/support rows at most, are broadcast, so the rows of hot groups are decided
   where they lie.
4. The remaining digests, each at most ``support`` of all rows, are grouped and joined by an ordinary
   shuffle of their narrow rows.

Only built-in functions: no Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.store import materialise

#: A digest with more than this share of all rows is certain to be split off; 1/SUPPORT counters and
#: winners at most.
SUPPORT = 0.002


def _same(text: Column) -> Column:
    return text


def _narrow(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column], tie: Column) -> DataFrame:
    text = normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), tie.alias("tie"))
    return materialise(rows, "digests")


def _best(rows: DataFrame) -> DataFrame:
    """``(digest, n, doc_id, tie)`` of the row that stays: largest id (null below any), then largest tie."""
    found = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "tie")).alias("best"))
    return found.select("digest", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.tie").alias("keep_tie"))


def heavy_hitters(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(digest, n, keep_id, keep_tie)`` of every digest with more than ``support`` of the rows, exact."""
    total = rows.count()
    named = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    named = materialise(named, "frequent")
    mine = rows.join(F.broadcast(named), "digest", "left_semi")  # 1/support rows at most
    return materialise(_best(mine).where(F.col("n") > support * total), "winners")


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT,
          normalise: Callable[[Column], Column] = _same) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when their normalised forms (unchanged by default) are; a null text is the empty
    text.  The row with the largest doc_id of a group stays, null ids below all others; of rows that
    share that id exactly one is kept (whichever was written last).  A group of null ids alone has a
    null keep_id.  Other columns take no part, whatever their names.  An empty table gives no rows.
    """
    rows = _narrow(docs, id_col, text_col, normalise, F.monotonically_increasing_id())
    marked = rows.join(F.broadcast(heavy_hitters(rows, support)), "digest", "left")  # 1/support rows at most
    rest = marked.where("n IS NULL").select("digest", "doc_id", "tie")
    decided = marked.where("n IS NOT NULL").unionByName(rest.join(_best(rest), "digest"))
    return decided.select("doc_id", "keep_id", F.col("n").alias("group_size"),
                          (F.col("tie") == F.col("keep_tie")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT,
                normalise: Callable[[Column], Column] = _same) -> DataFrame:
    """The documents that stay, columns unchanged: one row per distinct text.

    As in ``label``; of rows that share text and id, that with the largest hash of its columns stays,
    and one of wholly equal rows.  Losers of hot groups go before the shuffle, by the broadcast
    winners; the other rows are grouped by digest, copies within a task being dropped first.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    tie = F.xxhash64(*hashed)
    winners = heavy_hitters(_narrow(docs, id_col, text_col, normalise, tie), support)
    text = normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(F.sha2(text, 256).alias("digest"), F.col(f"`{id_col}`").cast("long").alias("id"), tie.alias("tie"),
                       F.struct(*columns).alias("row"))
    left = rows.join(F.broadcast(winners), "digest", "left").where(
        F.col("n").isNull() | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("tie") == F.col("keep_tie"))))
    kept = left.groupBy("digest").agg(F.max_by("row", F.struct("id", "tie")).alias("row"))
    return kept.select([F.col("row").getField(c).alias(c) for c in docs.columns])
