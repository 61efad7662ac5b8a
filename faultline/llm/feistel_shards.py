"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Every document gets its position ``p`` in a keyed pseudo-random permutation of ``0 .. n-1``.
``shard = p mod shards`` and ``slot = p div shards``, so shards differ by at most one row, slots are
gapless, and both can be computed from the row number alone -- or inverted (``row_at``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from faultline.llm.ordering import row_numbers

ROUNDS = 6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser over (half, round key)."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(0, 2**64, ROUNDS, dtype=np.uint64)]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Positions of ``rows`` (each in ``0 .. n-1``) in the permutation of ``0 .. n-1``.

    The Feistel network permutes ``0 .. 4^h - 1``, the smallest such range that holds n (under 4n);
    values outside ``0 .. n-1`` walk on along their cycle until they come back inside.
    """
    h = _half_bits(n)
    mask, shift = np.uint64((1 << h) - 1), np.uint64(h)
    keys = _keys(seed)
    out = np.asarray(rows).astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x >> shift, x & mask
            for key in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_mix(left, key) & mask), left
                else:
                    left, right = right, left ^ (_mix(right, key) & mask)
            out[todo] = x = (left << shift) | right
            todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global row number that sits in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def shard(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, one row per input row.

    Global row numbers follow ascending id (null ids first), then size and checksum, so reruns over
    the same rows agree; rows equal in all three are interchangeable.  Null texts count as empty
    (size 1, checksum 0).  An empty table gives an empty result.  Only the three small columns are
    shuffled, never the text; other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = row_numbers(small, [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], "__row")
    n = rows.count()

    @F.pandas_udf(LongType())
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    return (rows.withColumn("__p", position("__row"))
            .select("doc_id", "size", "text_crc32", (F.col("__p") % shards).cast("int").alias("shard"),
                    F.floor(F.col("__p") / shards).cast("long").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the documents as one folder per shard, in slot order (ids must be unique)."""
    placed = shard(docs, shards, seed, id_col, text_col).select(F.col("doc_id").alias(id_col), "shard", "slot")
    (docs.join(placed, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
