"""SimHash near-duplicates through pivot distance tables.

1. Fingerprints: 64 majority bits over the XXH64 hashes of a text's word shingles.
2. Pivot table: Hamming distances of every distinct fingerprint to many reference fingerprints
   (pivots), for the whole 64 bits and for each of ``BLOCKS`` slices of the bits.
3. Candidates: at most ``max_bits`` = 3 differing bits touch at most 3 of 6 slices, so two linked
   fingerprints have equal pivot distances in some 3 slices.  Every fingerprint is filed under the
   20 choices of 3 slices by its distances there.
4. Pairs filed together are discarded when any whole-width pivot distance differs by more than
   ``max_bits`` (triangle inequality) and verified by their exact Hamming distance otherwise.
   Per file only a spanning forest of the verified links is kept: no pairs are emitted that the
   components do not need.
5. Files with more than ``file_rows`` fingerprints are not gathered: their fingerprints are linked
   exactly by meeting points (x and y are within 3 bits iff some z is within 2 of x and 1 of y),
   which costs a fixed number of rows for each fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import connected_components
from faultline.llm.store import materialise

MAX_BITS = 3
SHINGLE_WORDS = 3
BLOCKS = 6
FILE_ROWS = 8192
#: 64 reference fingerprints; on a slice of 11 bits the distances to them tell its values apart.
PIVOTS = np.random.default_rng(20240607).integers(0, 2**64, 64, dtype=np.uint64)
#: Whole-width coordinates that the discarding step compares, one after the other.
WIDE = 24
_STEP = 1 << 16


def _slices(blocks: int) -> list[np.uint64]:
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash; bit i is set if it is set in over half of the shingle hashes.

    A-Z are lower-cased; words are runs without ASCII white space; texts with fewer words than a
    shingle hash the whole sequence; null and wordless texts give 0.
    """
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
        n = 1
    else:
        n = len(tokens) - words + 1
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _STEP):
        count = min(_STEP, n - start)
        h = np.fromiter((digest(next(shingles), 42) for _ in range(count)), dtype="<u8", count=count)
        ones += np.unpackbits(h.view(np.uint8).reshape(count, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp, *carry)`` per input row; ``fp`` holds the unsigned fingerprint's bits in a long.
    ``carry`` names long columns that are handed through."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), *(b.column(c) for c in carry)],
                                             ["doc_id", "fp", *carry])

    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} long" for c in carry))


def _file_keys(fps: np.ndarray, blocks: int, max_bits: int) -> np.ndarray:
    """One 64-bit key for each fingerprint and choice of slices: a hash of its pivot distances there."""
    odd = np.random.default_rng(77).integers(0, 2**63, len(PIVOTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    per_slice = []
    with np.errstate(over="ignore"):
        for s in _slices(blocks):
            h = np.zeros(len(fps), dtype=np.uint64)
            for p, o in zip(PIVOTS, odd):
                h = (h ^ np.bitwise_count((fps ^ p) & s).astype(np.uint64)) * o
                h ^= h >> np.uint64(29)
            per_slice.append(h)
        keys = []
        for k, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
            h = np.full(len(fps), k + 1, dtype=np.uint64)
            for c in chosen:
                h = (h ^ per_slice[c]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            keys.append(h)
    return np.stack(keys, axis=1)


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within one file, by breadth-first search.

    Every step compares one fingerprint with those not reached yet: coordinates of the pivot table
    first, the exact distance for what is left.
    """
    if len(fps) == 2:
        near = np.bitwise_count(fps[0] ^ fps[1]) <= max_bits
        return (fps[:1], fps[1:]) if near else (fps[:0], fps[:0])
    table = np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS[:WIDE]]).astype(np.int8)
    left = np.arange(len(fps))
    src, dst = [], []
    while len(left) > 1:
        queue = [left[0]]
        left = left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.arange(len(left))
            for row in table:
                hit = hit[np.abs(row[left[hit]] - row[x]) <= max_bits]
                if not len(hit):
                    break
            hit = hit[np.bitwise_count(fps[left[hit]] ^ fps[x]) <= max_bits]
            if len(hit):
                found = left[hit]
                src.append(np.full(len(found), fps[x], dtype=np.uint64))
                dst.append(fps[found])
                queue.extend(found)
                left = np.delete(left, hit)
    if not src:
        return fps[:0], fps[:0]
    return np.concatenate(src), np.concatenate(dst)


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, file_rows: int = FILE_ROWS) -> DataFrame:
    """Edges ``(a, b)`` over distinct fingerprints (column ``fp``) that connect the same components as
    all pairs within ``max_bits`` do (3 at most).  Nulls take no part."""
    if max_bits > 3 or blocks <= max_bits:
        raise ValueError("links() handles up to 3 differing bits and needs more slices than bits")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 4096):
                part = x[at:at + 4096]
                keys = _file_keys(part, blocks, max_bits)
                fp = np.repeat(part, keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])

    def pack(a: list, b: list, hot: bool) -> pa.RecordBatch:
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a file is held until its key ends or it outgrows ``file_rows``."""
        key, held, size, spilled = None, [], 0, False
        a, b = [], []

        def close() -> None:
            if not spilled and size > 1:
                x, y = _forest(np.concatenate(held), max_bits)
                if len(x):
                    a.append(x)
                    b.append(y)

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                if key is None or keys[s] != key:
                    if size > 1:
                        close()
                    key, held, size, spilled = keys[s], [], 0, False
                held.append(fp[s:e])
                size += e - s
                if spilled or size > file_rows:
                    rest = np.concatenate(held)
                    yield pack([rest], [rest], True)
                    held, spilled = [], True
            if a:
                yield pack(a, b, False)
                a, b = [], []
        close()
        if a:
            yield pack(a, b, False)

    filed = fps.select("fp").where("fp IS NOT NULL").distinct().mapInArrow(file, "key long, fp long")
    filed = filed.repartition("key").sortWithinPartitions("key", "fp")
    found = materialise(filed.mapInArrow(search, "a long, b long, hot boolean"), "links")
    edges = found.where("NOT hot").select("a", "b").distinct()
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    return edges.union(_meeting_links(hot, max_bits))


def _meeting_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Exact links among crowded fingerprints, linear in their number.

    A point z within 1 bit of y joins y with every x within ``max_bits - 1`` bits of z.
    """
    one = [0] + [1 << i for i in range(64)]
    far = [sum(1 << i for i in c) for r in range(max_bits) for c in combinations(range(64), r)]

    def around(masks: list[int]):
        m = np.array(masks, dtype=np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(x), 256):
                    part = x[at:at + 256]
                    z = (part[:, None] ^ m[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(np.repeat(part, len(m)).view(np.int64))], ["z", "fp"])

        return run

    near = fps.mapInArrow(around(one if max_bits else [0]), "z long, fp long").groupBy("z").agg(F.min("fp").alias("a"))
    wide = fps.mapInArrow(around(far if max_bits else [0]), "z long, fp long").withColumnRenamed("fp", "b")
    return wide.join(near, "z").where("a <> b").select("a", "b").distinct()


def _members(kinds: DataFrame, max_bits: int, **options) -> DataFrame:
    """``kinds`` (one row per fingerprint ``fp``) with the smallest fingerprint reachable as ``root``."""
    found = connected_components(links(kinds, max_bits, **options), "a", "b")
    member = kinds.join(found, F.col("fp") == F.col("node"), "left")
    return materialise(member.select(*kinds.columns, F.coalesce("component", "fp").alias("root")), "members")


def classes(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id",
            text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, fp, component_id)`` per input row; component_id = smallest doc_id reachable over links.

    Null and wordless texts have fingerprint 0 and are linked like any other.  Rows that repeat a
    doc_id stay; null doc_ids are kept, belong to their fingerprint's component and never name it
    (a component of null ids alone has a null id).  An empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    kinds = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "kinds")
    member = _members(kinds, max_bits, **options)
    named = materialise(member.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    label = materialise(member.join(named, "root").select("fp", "component_id"), "labels")
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """16 lower-case hex digits of a fingerprint column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id",
             text_col: str = "text", repeats: bool = True) -> DataFrame:
    """One row of every component, columns unchanged: that with the smallest id, null ids last; among
    rows of one id that with the smallest hash of its columns, and any one of equal rows.

    Ids may repeat or be null: an id in two components names a row of each, and a component of null ids
    alone keeps one row.  With ``repeats`` the rows of the component that share the kept row's id stay as
    well.  Only (id, hash, fingerprint) of the rows is written; texts go through one shuffle, to meet the
    keys of the rows that stay, and only copies of a kept row that are equal in every column are grouped.
    """
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*hashed).alias("tie"),
                       F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    fps = materialise(fingerprints(rows.select("doc_id", "text", "tie"), words, carry=("tie",)), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    member = _members(materialise(fps.groupBy("fp").agg(F.min(order).alias("best")), "kinds"), max_bits)
    best = materialise(member.groupBy("root").agg(F.min("best").alias("best")), "named")
    mine = fps.join(member.select("fp", "root").join(best, "root"), "fp").where(F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    one = (F.col("tie") == F.col("best.tie")) & ~(F.lit(repeats) & F.col("doc_id").isNotNull())
    kept = mine.where((F.lit(repeats) & F.col("doc_id").isNotNull()) | one).groupBy("doc_id", "tie").agg(
        F.count(F.lit(1)).alias("n"), F.first(one).alias("one"))
    kept = materialise(kept.select(F.col("doc_id").alias("keep_id"), F.col("tie").alias("keep_tie"),
                                   (F.col("one") & (F.col("n") > 1)).alias("single")), "kept")
    # The same join at every size: texts are shuffled by key once, unsorted, and meet the keys of their partition.
    found = rows.drop("text").join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("tie") == F.col("keep_tie")))
    plain = found.where("NOT single").select("row")
    copies = found.where("single").groupBy("doc_id", "tie").agg(F.first("row").alias("row")).select("row")
    return plain.union(copies).select([F.col("row").getField(c).alias(c) for c in docs.columns])
