"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Rows are dealt into blocks.  In a block, every tree sorts its rows by a long hash string (the signs
of random projections).  A query descends every tree to its longest matching prefix by binary search;
then all trees ascend together, one bit at a time, until the rows under the matched prefixes are
enough candidates.  Candidates are scored exactly, and the best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.store import materialise

TREES = 32
BITS = 64                # length of a hash string
SHARE = 0.45             # part of a block's rows that a query's candidates reach at least
LEAST = 64               # candidates in a block at least
BLOCK_ROWS = 1 << 16     # rows of a block at most, on average: bounds a task's memory
LEAST_BLOCKS = 32        # so that small tables are searched by several tasks too


def _usable(vec: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


class Forest:
    """The sorted hash strings of one block of vectors (rows of ``x``, all of one length)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int = TREES, seed: int = 42):
        self.ids, self.x = ids, x
        big = np.abs(x).max(axis=1)                      # norms without overflow or underflow
        self.norm = big * np.sqrt(((x / big[:, None]) ** 2).sum(axis=1))
        self.planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((trees, x.shape[1], BITS))
        self.order, self.strings = [], []
        for t in range(trees):
            s = self.hash(x, t)
            o = np.argsort(s, kind="stable")
            self.order.append(o)
            self.strings.append(s[o])

    def hash(self, x: np.ndarray, tree: int) -> np.ndarray:
        scaled = x / np.abs(x).max(axis=1)[:, None]
        bits = (scaled @ self.planes[tree] > 0).astype(np.uint8)
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)

    def spans(self, q: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query, the rows [lo, hi) of the sorted array that share ``level`` bits."""
        lo, hi = [], []
        low = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(level) if level < 64 else np.uint64(0)
        for t, s in enumerate(self.strings):
            lo.append(np.searchsorted(s, q[t] & ~low))
            hi.append(np.searchsorted(s, q[t] | low, side="right"))
        return np.array(lo), np.array(hi)

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, share: float, least: int) -> Iterator[tuple]:
        """Per query the k nearest candidates: (query number, ids, scores), ties to smaller ids."""
        need = min(len(self.ids), max(least, int(np.ceil(share * len(self.ids)))))
        strings = [self.hash(q, t) for t in range(len(self.strings))]
        done = np.zeros(len(q), dtype=bool)
        big = np.abs(q).max(axis=1)
        norms = big * np.sqrt(((q / big[:, None]) ** 2).sum(axis=1))
        for level in range(BITS if need < len(self.ids) else 0, -1, -1):   # all rows: straight to the roots
            open_ = np.flatnonzero(~done)
            if not len(open_):
                return
            lo, hi = self.spans([s[open_] for s in strings], level)
            enough = (hi - lo).sum(axis=0) >= need          # counts rows once for each tree
            for j in np.flatnonzero(enough):
                i = open_[j]
                seen = np.zeros(len(self.ids), dtype=bool)
                for t, o in enumerate(self.order if level else self.order[:1]):
                    seen[o[lo[t, j]:hi[t, j]]] = True
                if seen.sum() < need and level:
                    continue
                done[i] = True
                rows = np.flatnonzero(seen & (self.ids != q_ids[i]))
                unit = q[i] / norms[i]
                rough = (self.x[rows] @ unit) / self.norm[rows]
                if len(rows) > k:
                    rows = rows[rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-9]
                exact = ((self.x[rows] / self.norm[rows][:, None]) * unit).sum(axis=1)
                best = np.lexsort((self.ids[rows], -exact))[:k]
                yield i, self.ids[rows[best]], exact[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, share: float = SHARE,
           least: int = LEAST, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id",
           vec_col: str = "embedding", seed: int = 42) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found, nearest first, ties to smaller ids.

    Candidates are all rows of ``vectors`` but those with the query's own id (all of them are
    returned when there are fewer than k).  Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do null ids; vectors are compared with vectors of the same length only.
    Exact repeats of a row (same id and vector) count once; an empty table gives an empty result.
    Score: cosine in double precision.

    Vectors go to ``blocks`` by a hash of their id, as many as the table's size asks for, so that a
    third of all rows being one vector spreads evenly; queries stream through every block in Arrow
    batches, each task answers with k rows a query and block.  Only a block's forest is held in memory.
    """
    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return df.where(F.col("id").isNotNull() & _usable(F.col("vec"))).distinct()

    rows = materialise(clean(vectors), "vectors")
    blocks = max(LEAST_BLOCKS, -(-rows.count() // block_rows))
    data = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
    asks = clean(queries).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, then data before queries."""
        block, held, forests = None, [], None
        for b in batches:
            at, is_ask = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            ids = b.column("id").to_numpy()
            vecs = b.column("vec")
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (is_ask[1:] != is_ask[:-1])]) if len(at) else []
            for s, e in zip(cuts, [*cuts[1:], len(at)]):
                if at[s] != block:
                    block, held, forests = at[s], [], None
                part = _by_length(ids[s:e], vecs.slice(s, e - s))
                if not is_ask[s]:
                    held.append(part)
                    continue
                if forests is None:
                    forests = {n: Forest(np.concatenate([h[n][0] for h in held if n in h]),
                                         np.concatenate([h[n][1] for h in held if n in h]), trees, seed)
                               for n in {n for h in held for n in h}}
                for n, (q_ids, q) in part.items():
                    if n not in forests:
                        continue
                    for lo in range(0, len(q), 256):
                        out = [(q_ids[lo + i], v, x) for i, found, score in forests[n].search(q_ids[lo:lo + 256], q[lo:lo + 256], k, share, least)
                               for v, x in zip(found.tolist(), score.tolist())]
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))],
                                                             ["query_id", "vec_id", "score"])

    dealt = data.unionByName(asks).repartition("block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _by_length(ids: np.ndarray, vecs: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and a matrix for each length of vector."""
    size = vecs.value_lengths().to_numpy()
    flat = vecs.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    return {int(n): (ids[size == n], flat[(start[size == n][:, None] + np.arange(n))]) for n in np.unique(size)}
