"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word with the words that follow it in its piece, as lead
columns w1..w5, padded with '' past the end.  ROLLUP over (lang, w1, ..., w5) sums them to successively
shorter prefixes, and a prefix that ends in a word is an n-gram with its exact frequency, so no n-gram
of another order is ever generated.

Before that, a pass for each order counts words, word pairs, triples and so on by hash bucket, over hashes of the
words that are stored once.  A sequence in a bucket below the least frequency is in no candidate, so windows are
padded from there on, and words of such buckets are counted by number only: buckets only overestimate, so no
candidate loses an occurrence, and few windows stay long.  The bitmaps of full buckets have a fixed largest size
(``MOST_BITS``); a corpus that overfills them is cut less, never wrongly.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.store import materialise, packed, shuffle_partitions, unpacked

LONGEST = 5
LEAST = 100
TOP = 2000
#: Buckets per byte of text (about one for two words), and their number: 2**16 to 2**28 (32 MB of bits).
BITS_PER_BYTE = 1 / 12
LEAST_BITS, MOST_BITS = 16, 28
#: Words a worker collects before it counts them, and distinct words it remembers.
BATCH_WORDS = 300_000
KNOWN_WORDS = 300_000
_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_MIX_INT, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_MIX = np.uint64(_MIX_INT)
#: Number of all words that are too rare for any phrase.
RARE = 1
#: Bits by which the buckets are fewer from the third order on, as few sequences get there; parts of the buckets that
#: travel as a row; words whose hashes are stored as a row.
FEWER_BITS = 2
BLOCKS = 64
ROW_WORDS = 1 << 15


class _Words(dict):
    """Numbers words as they come; 0 stands for the end of a piece, ``RARE`` for every word that is not in a frequent
    bucket of ``bitmap`` (without one, no word is).  Rare words are not remembered: most come once in a task."""

    def __init__(self, lang: str, bitmap: np.ndarray | None) -> None:
        from xxhash import xxh64_intdigest

        self.names: list[bytes] = [b"", b""]
        self.hashes, self.digest = array("Q", [0, 0]), xxh64_intdigest
        self.bitmap, self.salt = None if bitmap is None else memoryview(bitmap), self.digest(lang, 7)
        self.shift = 0 if bitmap is None else 65 - (8 * len(bitmap)).bit_length()

    def __missing__(self, word: bytes) -> int:
        hash_ = self.digest(word) or 1
        if self.bitmap is not None:
            h = hash_ ^ self.salt     # as in _Cuts
            at = ((h ^ (h >> 31)) * _MIX_INT & _MASK) >> self.shift
            if not self.bitmap[at >> 3] >> (at & 7) & 1:
                return RARE
        self[word] = n = len(self.names)
        self.names.append(word)
        self.hashes.append(hash_)
        return n


def _streams(batches: Iterator[pa.RecordBatch], most: int, known: int,
             bitmap: np.ndarray | None = None) -> Iterator[tuple[str, _Words, np.ndarray, bool]]:
    """Bounded streams ``(lang, words, word numbers with 0 after each piece, last)`` of the texts of a task: of
    ``most`` words in all.  ``last``: the numbering of ``words`` ends here, as ``known`` are remembered in all.
    ``bitmap`` tells which words are frequent; the others are all ``RARE``."""
    held: dict[str, tuple[_Words, list[int]]] = {}
    size = 0

    def out(last: bool) -> Iterator[tuple[str, _Words, np.ndarray, bool]]:
        for lang, (words, ids) in held.items():
            yield lang, words, np.array(ids, dtype=np.int64), last
            ids.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            for piece in text.as_py().lower().translate(_BREAKS).split(b"\n"):
                found = piece.split()
                if found:
                    words, ids = held.get(lang) or held.setdefault(lang, (_Words(lang, bitmap), []))
                    ids.extend(map(words.__getitem__, found))
                    ids.append(0)
                    size += len(found)
                    if size >= most:
                        full = sum(len(w) for w, _ in held.values()) >= known
                        yield from out(full)
                        size = 0
                        if full:
                            held = {}
    yield from out(True)


def word_hashes(docs: DataFrame) -> DataFrame:
    """``(lang, hashes)``: the words of ``docs(lang, text binary)`` as 64-bit hashes, 0 after each piece; rows end with a piece."""
    limits = (BATCH_WORDS, KNOWN_WORDS)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids, _ in _streams(batches, *limits):
            ends = np.flatnonzero(ids == 0) + 1
            cuts = np.r_[0, np.unique(ends[np.searchsorted(ends, np.arange(ROW_WORDS, len(ids), ROW_WORDS))]), len(ids)]
            raw = np.array(words.hashes, dtype=np.uint64)[ids]
            rows = [raw[a:z].tobytes() for a, z in zip(cuts, cuts[1:]) if z > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.binary())], ["lang", "hashes"])

    return docs.mapInArrow(number, "lang string, hashes binary")


def _stored(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, np.ndarray]]:
    """``(lang, hashes)`` of ``word_hashes`` in bounded streams, of about ``most`` words in all."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0
    for b in batches:
        for lang, raw in zip(b.column("lang").to_pylist(), b.column("hashes")):
            held.setdefault(lang, []).append(np.frombuffer(raw.as_py(), dtype=np.uint64))
            size += len(held[lang][-1])
            if size >= most:
                yield from ((k, np.concatenate(parts)) for k, parts in held.items())
                held, size = {}, 0
    yield from ((k, np.concatenate(parts)) for k, parts in held.items())


class _Cuts:
    """Which words and sequences of a stream of word hashes are in frequent buckets, order by order."""

    def __init__(self, lang: str, hashes: np.ndarray):
        import xxhash

        self.real = hashes != 0
        with np.errstate(over="ignore"):
            h = hashes ^ np.uint64(xxhash.xxh64_intdigest(lang, 7))
            self.word = (h ^ (h >> np.uint64(31))) * _MIX
        self.hash, self.starts, self.order = self.word, self.real, 1

    def buckets(self, bits: int) -> np.ndarray:
        """Bucket of the sequence of the present order that starts at each word."""
        return (self.hash >> np.uint64(64 - bits)).astype(np.int64)

    def frequent(self, bitmap: np.ndarray) -> np.ndarray:
        at = self.buckets((8 * len(bitmap)).bit_length() - 1)
        return self.starts & ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    def longer(self, kept: np.ndarray) -> None:
        """Go on to the next order: sequences whose two parts of this order are ``kept``."""
        self.starts = kept & np.roll(kept, -1) & np.roll(self.real, -self.order)
        with np.errstate(over="ignore"):
            h = (self.hash ^ (self.hash >> np.uint64(29))) * _MIX + np.roll(self.word, -self.order)
            self.hash = (h ^ (h >> np.uint64(32))) * _MIX
        self.order += 1

    def follow(self, bitmaps: list[np.ndarray]) -> list[np.ndarray]:
        """For orders 2, 3, ...: where a sequence starts that is frequent as far as the bitmaps tell."""
        kept = []
        if bitmaps:
            self.longer(self.real)
            for i, bitmap in enumerate(bitmaps):
                if i:
                    self.longer(kept[-1])
                kept.append(self.frequent(bitmap))
        return kept


def frequent_buckets(hashed: DataFrame, bits: int, least: int, below: list[Broadcast]) -> np.ndarray:
    """Bitmap (little bit order) of the buckets that sequences of the next order hit ``least`` times or more, whose
    parts are frequent by the bitmaps ``below``; the first bitmap (pairs) takes in single words, too.  ``hashed``
    are the words by ``word_hashes``.

    Tasks hand on, for each of ``BLOCKS`` parts of the buckets, the buckets hit and how often (``least`` at most,
    which tells as much); parts are summed up one at a time."""
    most, size = BATCH_WORDS, max(8, (1 << bits) // BLOCKS)
    kind = np.uint8 if least < 256 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, hashes in _stored(batches, most):
            cuts = _Cuts(lang, hashes)
            if below:
                cuts.longer(cuts.follow([b.value for b in below])[-1])
                found = cuts.buckets(bits)[cuts.starts]
            else:
                single = cuts.buckets(bits)[cuts.starts]
                cuts.longer(cuts.real)
                found = np.concatenate([single, cuts.buckets(bits)[cuts.starts]])
            bucket, n = np.unique(found, return_counts=True)
            n = np.minimum(n, least).astype(kind)
            edges = np.searchsorted(bucket, np.arange(0, (1 << bits) + size, size))
            inside = (bucket % size).astype(np.uint32)
            parts = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in parts], pa.int64()), pa.array([inside[a:b].tobytes() for _, a, b in parts], pa.binary()),
                     pa.array([n[a:b].tobytes() for _, a, b in parts], pa.binary())], ["block", "buckets", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(size, dtype=np.int32)

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for block, buckets, n in zip(b.column("block").to_pylist(), b.column("buckets"), b.column("n")):
                if block != now:
                    if now is not None:
                        yield full()
                    now = block
                    total[:] = 0
                at = np.frombuffer(buckets.as_py(), dtype=np.uint32)
                total[at] = np.minimum(total[at] + np.frombuffer(n.as_py(), dtype=kind), least)
        if now is not None:
            yield full()

    hits = hashed.mapInArrow(count, "block long, buckets binary, n binary").repartition(BLOCKS, "block").sortWithinPartitions("block")
    bitmap = np.zeros(max(1 << bits, 8 * BLOCKS) // 8, dtype=np.uint8)
    for row in materialise(hits.mapInArrow(add, "block long, bits binary"), "buckets").toLocalIterator():  # 2**MOST_BITS / 8 bytes at most
        part = np.frombuffer(row["bits"], dtype=np.uint8)
        bitmap[row["block"] * len(part):(row["block"] + 1) * len(part)] = part
    return bitmap[:(1 << bits) // 8]


def windows(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Partial counts ``(lang, w1, ..., n)`` of the padded longest windows of ``docs(lang, text binary)``.

    A task's counts travel as one table for each part of the windows, not as a row each: most tasks have most of
    the frequent windows, so rows would grow with their number times the tasks.  Tables of a part are summed where they meet."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(size * BITS_PER_BYTE, 1))), LEAST_BITS, MOST_BITS))
    hashed = materialise(word_hashes(docs), "hashes")
    known: list[Broadcast] = []  # each bitmap travels once
    while len(known) < longest - 1:
        fewer = bits if len(known) < 2 else max(bits - FEWER_BITS, LEAST_BITS)
        known.append(docs.sparkSession.sparkContext.broadcast(frequent_buckets(hashed, fewer, least, known[:])))
    names, limits, blocks = [f"w{i + 1}" for i in range(longest)], (BATCH_WORDS, KNOWN_WORDS), max(BLOCKS, shuffle_partitions(docs.sparkSession))

    def merged(tables: list[pa.Table], keys: list[str]) -> pa.Table:
        found = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return pa.table([*(found[w] for w in keys), found["n_sum"]], [*keys, "n"]).combine_chunks()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [b.value for b in known]
        alone: dict[str, np.ndarray] = {}    # windows of one word, while their words keep their numbers
        held: dict[str, list[pa.Table]] = {}  # longer windows

        def out(lang: str, words: _Words, columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
            vocabulary, hashes = pa.array(words.names, pa.binary()), np.array(words.hashes, dtype=np.uint64)
            with np.errstate(over="ignore"):
                block = ((hashes[columns[0]] * _MIX + hashes[columns[1]]) * _MIX >> np.uint64(32)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            edges = np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))
            for k, a, z in zip(range(blocks), edges, edges[1:]):
                if z > a:
                    at = order[a:z]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int64()), pa.array([lang], pa.string()),
                         pa.array([packed(pa.RecordBatch.from_arrays([vocabulary.take(pa.array(c[at])) for c in columns] + [pa.array(n[at])], [*names, "n"]))], pa.binary())],
                        ["block", "lang", "counts"])

        for lang, words, ids, last in _streams(batches, *limits, bitmaps[0]):
            if len(ids):
                cuts = _Cuts(lang, np.array(words.hashes, dtype=np.uint64)[ids])
                single = cuts.frequent(bitmaps[0])
                kept = cuts.follow(bitmaps)
                linked = kept[0]
                # Words that are too rare for any phrase are counted by number only, under 0; no sequence goes across them.
                lone = ~linked & (ids != 0)
                counts = np.bincount(np.where(single[lone], ids[lone], 0), minlength=len(words.names))
                before = alone.get(lang, counts[:0])
                counts[:len(before)] += before
                alone[lang] = counts
                starts = np.flatnonzero(linked)
                columns, open_ = [ids[starts], ids[(starts + 1) % len(ids)]], np.ones(len(starts), dtype=bool)
                for lead in range(2, longest):
                    order = min(lead, len(kept)) - 1      # the sequence of the highest order that ends at the lead
                    open_ &= kept[order][(starts + lead - order - 1) % len(ids)]
                    columns.append(np.where(open_, ids[(starts + lead) % len(ids)], 0))
                lot = pa.table([*(c.astype(np.int32) for c in columns), np.ones(len(starts), dtype=np.int64)], [*names, "n"])
                lots = held.setdefault(lang, [])
                lots.append(merged([lot], names))
                # The first table is what was merged so far; the others join it when they have doubled it.
                if last or sum(t.num_rows for t in lots[1:]) > lots[0].num_rows + limits[0]:
                    lots[:] = [merged(lots, names)]
            lots = held.get(lang, [])
            if lots and (last or lots[0].num_rows > 2 * limits[0]):
                table = merged(lots, names)
                yield from out(lang, words, [table[w].to_numpy() for w in names], table["n"].to_numpy())
                lots.clear()
            if last and lang in alone:
                single = alone.pop(lang)
                found = np.flatnonzero(single)
                yield from out(lang, words, [found] + [np.zeros(len(found), dtype=np.int64)] * (longest - 1), single[found])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lots = None, []

        def out() -> Iterator[pa.RecordBatch]:
            table = merged(lots, names)
            yield from table.add_column(0, "lang", pa.array([now[1]] * table.num_rows, pa.string())).to_batches(1 << 16)

        for b in batches:
            for block, lang, counts in zip(b.column("block").to_pylist(), b.column("lang").to_pylist(), b.column("counts")):
                if (block, lang) != now:
                    if lots:
                        yield from out()
                    now, lots = (block, lang), []
                lots.append(unpacked(counts.as_py()))
                if sum(t.num_rows for t in lots[1:]) > lots[0].num_rows + limits[0]:
                    lots = [merged(lots, names)]
                    if lots[0].num_rows > 2 * limits[0]:
                        yield from out()
                        lots = []
        if lots:
            yield from out()

    parts = docs.mapInArrow(count, "block long, lang string, counts binary").repartition(blocks, "block").sortWithinPartitions("block", "lang")
    return parts.mapInArrow(add, "lang string, " + ", ".join(f"{w} binary" for w in names) + ", n long")


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``(lang, k, phrase, words, f)`` of every phrase of up to ``longest`` words that occurs ``least`` times
    in its lang, and one row with k = 0 for each lang: the number of all its words.

    A window of one word is its own only prefix, so it need not go through the ROLLUP; its count is added
    to the word's."""
    names = [f"w{i + 1}" for i in range(longest)]
    counted = materialise(windows(docs, longest, least), "windows")
    single = F.length("w2") == 0
    rolled = counted.where(~single).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    rolled = rolled.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    k = F.lit(longest)
    for i in range(longest):
        k = F.when(F.col("gid") == (1 << (longest - i)) - 1, i).otherwise(k)
    words = F.slice(F.array(*[F.col(w).cast("string") for w in names]), F.lit(1), F.col("k"))
    rolled = rolled.where(F.col("gid") < (1 << (longest + 1)) - 1).withColumn("k", k).withColumn("words", words)
    whole = F.element_at("words", -1) != ""
    rolled = rolled.where((F.col("k") == 0) | whole & ((F.col("k") == 1) | (F.col("f") >= least)))
    rolled = materialise(rolled.select("lang", "k", "words", "f"), "rolled")
    alone = counted.where(single).groupBy("lang", "w1").agg(F.sum("n").alias("f"))
    alone = alone.select("lang", F.lit(1).alias("k"), F.array(F.col("w1").cast("string")).alias("words"), "f")
    total = alone.groupBy("lang").agg(F.sum("f").alias("f")).select("lang", F.lit(0).alias("k"), F.array().cast("array<string>").alias("words"), "f")
    short = alone.union(total).union(rolled.where("k < 2")).groupBy("lang", "k", "words").agg(F.sum("f").alias("f"))
    short = short.where("k = 0 OR words[0] <> ''").where((F.col("k") == 0) | (F.col("f") >= least))
    found = rolled.where("k > 1").union(short)
    return found.select("lang", "k", F.concat_ws(" ", "words").alias("phrase"), "words", "f")


def _decimal(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(15,0)")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = 100,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of 2 to ``longest`` words of each lang.

    a, l, r are the frequencies of the phrase and of the two parts at its weakest cut, n the lang's
    words, score floor(1000 a n / (l r)); equal scores go by falling a, then by phrase in UTF-8 order.
    A phrase goes if it lies inside a longer one that has at least ``share`` percent of its frequency.

    Null texts count as empty, a null lang as ``und``; texts without words add nothing; repeated rows
    count each; other columns take no part; an empty table gives no rows.  Decimals keep the score
    exact up to 10**15 words a lang.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    counts = materialise(phrase_counts(texts, longest, least), "phrases")
    known = counts.where("k > 0").select("lang", "phrase", "f")
    found = counts.where("k > 1").select("lang", "k", "phrase", "words", F.col("f").alias("a"))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("cut"))).alias("head"),
        F.concat_ws(" ", F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("tail"))
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    scored = (cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
              .join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
              .join(total, "lang"))
    score = F.call_function("div", _decimal("a") * _decimal("n") * F.lit(1000).cast("decimal(4,0)"), _decimal("l") * _decimal("r"))
    best = (scored.withColumn("score", score).groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")))
    inner = found.where("k > 2").select("lang", "words", "k", "a").withColumn(
        "part", F.explode(F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(words, i, s), ' '))))")))
    longer = inner.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_decimal("longer") * 100 < _decimal("a") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", F.col("best.score").alias("score"))
