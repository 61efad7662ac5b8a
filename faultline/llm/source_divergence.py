"""Source divergence audit by chunk factorization.

1. Chunks (runs without ASCII white space, A-Z lower-cased) are counted per document and combined
   per (lang, chunk) into numbers of documents.  Partial counts travel as tables, one for each part of the
   chunks by hash, and are summed where they meet.
2. Every globally distinct chunk is tokenized there, once.  A chunk that is a term itself needs no
   entry; for every other chunk its terms are kept as (chunk, term, times).
3. A term's documents in a lang: at least those of its most widespread chunk, at most the sum over
   its chunks.  Terms whose sum stays below ``least`` are done with, and so are their chunks: the
   second count leaves them out by a bitmap of the chunks that are left (fixed largest size,
   ``MOST_BITS``; an overfull one lets more chunks through, and the joins drop them).
4. The second count combines occurrences per (lang, source, chunk), again in tables by part.  Terms are joined
   back and their occurrences summed.  Where the two bounds leave it open whether a term reaches ``least``, its
   distinct documents are counted in the task that reads them: a document is in one task, so sums by (lang, term)
   are handed on, not (document, chunk) pairs.
5. Smoothed shares of the kept terms give each source's distance to every other source of its lang
   and the terms it uses more than the lang does.

All arithmetic is on integers and decimals.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.store import by_part, materialise, met_parts, shuffle_partitions

LEAST = 30
SMOOTH = 5
SCALE = 1_000_000_000
#: Terms of a chunk: ASCII letters and everything beyond ASCII, byte by byte in UTF-8.
_TERM = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
#: Words a worker collects before it counts them; sums, chunks or terms it holds before it hands them on.
BATCH_WORDS = 400_000
HELD = 800_000
SUMS = 4                  # sums (two numbers each) held for each chunk that may be remembered
#: Bits of the bitmap for each chunk in it, and their number: 2**16 to 2**28 (32 MB).
BITS_PER_CHUNK = 16
LEAST_BITS, MOST_BITS = 16, 28
_SEED = 42  # of Spark's xxhash64
#: Parts of the chunks for each shuffle partition, and in all at least: a task takes one at a time.
PARTS, LEAST_PARTS = 4, 1024
_OUTSIDE = np.array([b == 0x20 for b in _TERM])  # bytes that are in no term
_SLICE = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The chunks of a text, lower-cased; a very long text comes in slices cut at white space."""
    at = 0
    while len(text) - at > _SLICE:
        cut = _SPACE.search(text, at + _SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end
    yield text[at:].lower().split()


class _Numbers(dict):
    """Numbers chunks as they come, from 1 on; those whose hash bucket is not in ``bitmap`` are all 0."""

    def __init__(self, bitmap: bytes, bits: int) -> None:
        from xxhash import xxh64_intdigest

        self.bitmap, self.mask, self.digest = bitmap, (1 << bits) - 1, xxh64_intdigest
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.names, self.hashes = [b""], array("Q", [0])

    def __missing__(self, chunk: bytes) -> int:
        hash_ = self.digest(chunk, _SEED)
        at = hash_ & self.mask
        if not self.bitmap[at >> 3] >> (at & 7) & 1:
            self[chunk] = 0
            return 0
        self[chunk] = n = len(self.names)
        self.names.append(chunk)
        self.hashes.append(hash_)
        return n


class _Terms:
    """The distinct terms, numbered as they come, of the chunks of a numbering whose bucket is in ``open_``."""

    def __init__(self, known: _Numbers, open_: bytes) -> None:
        self.known, self.open = known, open_
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.flat, self.ends = array("q"), array("q", [0])

    def of(self, document: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (document, term) pairs of the words with the chunk numbers ``ids``."""
        known = self.known
        for k in range(len(self.ends), len(known.names)):
            at = known.hashes[k] & known.mask
            if self.open[at >> 3] >> (at & 7) & 1:
                self.flat.extend({self.numbers.setdefault(t, len(self.numbers)) for t in known.names[k].translate(_TERM).split()})
            self.ends.append(len(self.flat))
        ends, flat = np.array(self.ends), np.array(self.flat)
        first, many = np.r_[0, ends[:-1]], np.diff(ends, prepend=0)
        follow = many[ids] > 0
        document, chunk = _distinct(document[follow], ids[follow])
        return _distinct(np.repeat(document, many[chunk]), flat[_ranges(first[chunk], many[chunk])])


class _Sums:
    """Sums by an integer key: sorted arrays, merged whenever they have doubled."""

    def __init__(self) -> None:
        self.keys, self.values, self.size, self.merged = [], [], 0, 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys.append(keys)
        self.values.append(values)
        self.size += len(keys)
        if self.size > 2 * self.merged + 200_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, values = np.concatenate(self.keys), np.concatenate(self.values)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.keys, self.values = [keys[first]], [np.add.reduceat(values, first)]
        self.size = self.merged = len(first)
        return self.keys[0], self.values[0]


def _documents(batches: Iterator[pa.RecordBatch], known: _Numbers, most: int, limit: int) -> Iterator[tuple]:
    """Documents in lots of about ``most`` words: ``(their other columns, document index and chunk number of
    each word, last)``; ``last``: the numbering of chunks ends here (the caller clears it)."""
    rows, lengths, ids = [], [], []
    for b in batches:
        columns = [b.column(c).to_pylist() for c in b.schema.names if c != "text"]
        for *row, text in zip(*columns, b.column("text")):
            before = len(ids)
            for chunks in _slices(text.as_py()):
                ids.extend(map(known.__getitem__, chunks))
            rows.append(tuple(row))
            lengths.append(len(ids) - before)
            if len(ids) >= most:
                yield rows, np.repeat(np.arange(len(rows)), np.array(lengths, dtype=np.int64)), np.array(ids, dtype=np.int64), len(known) >= limit
                rows, lengths, ids = [], [], []
    yield rows, np.repeat(np.arange(len(rows)), np.array(lengths, dtype=np.int64)), np.array(ids, dtype=np.int64), True


def _distinct(document: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, chunk) pairs."""
    pairs = np.unique(document << 32 | ids)
    return pairs >> 32, pairs & 0xFFFFFFFF


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``first``, first + 1, ... of each entry, ``many`` numbers each."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def _parts(docs: DataFrame) -> int:
    return max(LEAST_PARTS, PARTS * shuffle_partitions(docs.sparkSession))


def _met(parts: DataFrame) -> DataFrame:
    return parts.repartition("part").sortWithinPartitions("part")


def chunk_spread(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Partial counts ``(lang, chunk, n)``, n documents, of ``docs(lang, text binary)`` as tables by part of the chunks."""
    parts = _parts(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        tables: dict[str, Counter] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, table in tables.items():
                part = np.fromiter((xxh64_intdigest(c, _SEED) % parts for c in table), np.int64, len(table))
                yield by_part(pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(table), pa.string()), pa.array(list(table), pa.binary()),
                     pa.array(list(table.values()), pa.int64())], ["lang", "chunk", "n"]), part)

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                table = tables.setdefault(lang, Counter())
                before = len(table)
                table.update(set().union(*_slices(text.as_py())))
                size += len(table) - before
                if size > held:
                    yield from out()
                    tables, size = {}, 0
        yield from out()

    return docs.select("lang", "text").mapInArrow(count, "part long, counts binary")


def _split(met: pa.Table) -> tuple[pa.Table, pa.Table]:
    """``(lang, term, low, high)`` and ``(chunk, term, times)`` of a table of distinct ``(lang, chunk, n)``: chunks that
    are a term by themselves have rows in the first only."""
    chunk = met["chunk"].combine_chunks()
    _, offsets, raw = chunk.buffers()
    at = np.frombuffer(offsets, np.int32)[chunk.offset:chunk.offset + len(chunk) + 1].astype(np.int64)
    outside = np.r_[0, np.cumsum(_OUTSIDE[np.frombuffer(raw, np.uint8)[at[0]:at[-1]]])]
    mixed = np.flatnonzero(np.diff(outside[at - at[0]]))
    alone = np.delete(np.arange(len(chunk)), mixed)

    coded = chunk.take(pa.array(mixed)).dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy()
    terms = [Counter(c.translate(_TERM).split()) for c in names.to_pylist()]
    many = np.array([len(t) for t in terms], dtype=np.int64)
    flat = pa.array([t for of in terms for t in of], pa.binary())
    times = pa.array([n for of in terms for n in of.values()], pa.int64())
    parts = pa.table([names.take(pa.array(np.repeat(np.arange(len(names)), many))), flat, times], ["chunk", "term", "times"])

    row, of = np.r_[alone, np.repeat(mixed, many[code])], _ranges((np.cumsum(many) - many)[code], many[code])
    n = met["n"].take(pa.array(row))
    term = pa.chunked_array([chunk.take(pa.array(alone)), flat.take(pa.array(of))])
    return pa.table([met["lang"].take(pa.array(row)), term, n, n], ["lang", "term", "low", "high"]), parts


def tokenize(spread: DataFrame, held: int = HELD) -> DataFrame:
    """``(lang, term, low, high, chunk, times)`` from partial chunk counts, every distinct chunk tokenized once.

    low and high bound the term's documents by the chunks seen in one place; ``chunk`` and ``times`` are
    set in rows of their own (without lang) for chunks that are not a term by themselves."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("low", pa.int64()), ("high", pa.int64()),
                        ("chunk", pa.binary()), ("times", pa.int64())])

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [table[f.name] if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in schema]
        yield from pa.table(columns, schema=schema).to_batches(1 << 16)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: list[pa.Table] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            found = pa.concat_tables(bounds).group_by(["lang", "term"], use_threads=False).aggregate([("low", "max"), ("high", "sum")])
            yield from rows(found.select(["lang", "term", "low_max", "high_sum"]).rename_columns(["lang", "term", "low", "high"]))

        for met in met_parts(batches, held):
            of_lang, parts = _split(met)
            yield from rows(parts)
            bounds.append(of_lang)
            size += of_lang.num_rows
            if size > held:
                yield from out()
                bounds, size = [], 0
        if bounds:
            yield from out()

    return _met(spread).mapInArrow(split, "lang string, term binary, low long, high long, chunk binary, times long")


def _bucket(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1))


def _bitmap(chunks: DataFrame, bits: int) -> bytes:
    """One bit for each hash bucket that holds a chunk, in little bit order."""
    at = _bucket(F.col("chunk"), bits) + 1
    maps = chunks.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bitmap = bytearray((1 << bits) // 8)
    for row in maps.toLocalIterator():  # 4 KB for each 32,768 buckets: 2**MOST_BITS / 8 bytes at most
        bitmap[(row["part"] - 1) * 4096:row["part"] * 4096] = row["bits"]
    return bytes(bitmap)


def chunk_counts(docs: DataFrame, chunks: DataFrame, held: int = HELD) -> DataFrame:
    """``(lang, source, name, n)`` of ``docs(lang, source, text binary)``: the occurrences of the given
    ``chunks(chunk, open)`` and a few others, and in rows without source the documents that hold a term of an
    ``open`` chunk.  Counts of a name meet in one place."""
    docs = docs.select("lang", "source", "text")
    bits = int(np.clip(np.ceil(np.log2(max(chunks.count() * BITS_PER_CHUNK, 1))), LEAST_BITS, MOST_BITS))
    spark, most, parts = docs.sparkSession, BATCH_WORDS, _parts(docs)
    wanted = spark.sparkContext.broadcast((_bitmap(chunks, bits), _bitmap(chunks.where("open"), bits)))

    def table(groups: list[tuple], sums: _Sums, names: list[bytes], hashes: np.ndarray) -> pa.RecordBatch:
        """The sums, by group and number of a name, as tables by part."""
        keys, values = sums.merge()
        group, at = pa.array(keys >> 32), keys & 0xFFFFFFFF
        return by_part(pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in groups], pa.string()).take(group), pa.array([g[1] for g in groups], pa.string()).take(group),
             pa.array(names, pa.binary()).take(pa.array(at)), pa.array(values)], ["lang", "source", "name", "n"]),
            (hashes[at] % np.uint64(parts)).astype(np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, open_ = wanted.value
        known, sums, found, groups, langs = _Numbers(bitmap, bits), _Sums(), _Sums(), {}, {}
        terms = _Terms(known, open_)
        for rows, document, ids, last in _documents(batches, known, most, held):
            group = np.array([groups.setdefault(row, len(groups)) for row in rows], dtype=np.int64)
            lang = np.array([langs.setdefault((row[0], None), len(langs)) for row in rows], dtype=np.int64)
            document, ids = document[ids > 0], ids[ids > 0]
            sums.add(*np.unique(group[document] << 32 | ids, return_counts=True))
            document, term = terms.of(document, ids)
            found.add(*np.unique(lang[document] << 32 | term, return_counts=True))
            if last or sums.size + found.size > SUMS * held:
                if sums.size:
                    yield table(list(groups), sums, known.names, np.array(known.hashes))
                if found.size:
                    names = list(terms.numbers)
                    yield table(list(langs), found, names, np.fromiter((known.digest(t, _SEED) for t in names), np.uint64, len(names)))
                sums, found = _Sums(), _Sums()
            if last:
                known.clear()
                terms.clear()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in met_parts(batches, held):
            yield from met.to_batches(1 << 16)

    return _met(docs.mapInArrow(count, "part long, counts binary")).mapInArrow(add, "lang string, source string, name binary, n long")


def term_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, source, term, n)``: occurrences of every term that is in at least ``least`` documents of
    its lang, for the sources that have it.  ``docs`` holds lang, source and text without nulls."""
    docs = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    tokens = materialise(tokenize(chunk_spread(docs)), "tokens")
    bounds = tokens.where("chunk IS NULL").groupBy("lang", "term").agg(F.max("low").alias("low"), F.sum("high").alias("high"))
    bounds = materialise(bounds.where(F.col("high") >= least), "bounds")
    left = bounds.select("term").distinct()
    terms = tokens.where("chunk IS NOT NULL").select("chunk", "term", "times").join(left, "term", "left_semi")
    terms = materialise(terms.union(left.select("term", "term", F.lit(1).cast("long"))), "chunk_terms")

    open_ = bounds.where(F.col("low") < least).select("lang", "term")
    wanted = terms.join(open_.select("term").distinct().withColumn("open", F.lit(True)), "term", "left")
    wanted = materialise(wanted.groupBy("chunk").agg(F.max(F.coalesce("open", F.lit(False))).alias("open")), "wanted")
    counts = materialise(chunk_counts(docs, wanted), "counts")
    counted = (counts.where("source IS NULL").select("lang", F.col("name").alias("term"), "n").join(open_, ["lang", "term"])
               .groupBy("lang", "term").agg(F.sum("n").alias("documents")))
    kept = bounds.where(F.col("low") >= least).select("lang", "term").union(
        counted.where(F.col("documents") >= least).select("lang", "term"))
    found = counts.where("source IS NOT NULL").withColumnRenamed("name", "chunk").join(terms, "chunk").groupBy("lang", "source", "term").agg(
        F.sum(F.col("n") * F.col("times")).alias("n"))
    return found.join(materialise(kept, "kept"), ["lang", "term"]).select("lang", "source", F.col("term").cast("string").alias("term"), "n")


def _share(n: Column | str, total: Column | str, kinds: Column | str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kinds)), exact; null without kept terms."""
    top = (F.col(n) if isinstance(n, str) else n).cast("decimal(20,0)") + F.lit(SMOOTH)
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * top,
                                      F.nullif(F.col(total) + F.col(kinds) * SMOOTH, F.lit(0)).cast("decimal(20,0)"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = 50, text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair``: every other source of the lang with the sum of absolute differences of the two
    sources' shares over all kept terms (0 where the lang has none).  Part ``term``: the ``top`` terms
    whose share in the source exceeds their share in the lang, by that excess.  Ranks go by falling
    value, then by item in UTF-8 order.

    Null lang, source and text count as ''; rows without terms still make their (lang, source) group;
    repeated rows count each; other columns take no part; an empty table gives no rows.
    """
    names = ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(a) for c, a in names])
    counts = materialise(term_counts(docs, least), "term_counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = of_lang.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("kinds"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = (docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["total", "own", "kinds"]))
    groups = materialise(groups.withColumn("p0", _share(F.lit(0), "total", "kinds")), "groups")
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "total", "kinds").alias("p"), "p0")
    shares = materialise(shares, "shares")

    of_lang = of_lang.join(langs, "lang").select("lang", "term", _share("n", "lang_total", "kinds").alias("q"))
    more = shares.join(of_lang, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = _distances(groups, shares).withColumn("rank", F.row_number().over(order))
    return terms.unionByName(pairs).select("lang", "source", "part", "item", "value", "rank")


def _distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Sums of |p - q| over all kept terms, for every two sources a < b of a lang, from the terms they
    have: a term that a source lacks has its share ``p0`` there.

    Sum = (terms neither has) |p0a - p0b| + (of a) |p - p0b| + (of b) |p - p0a|, the terms of both
    being counted out of the last two and in with |pa - pb|.  Terms of equal count share one p, so the
    middle parts go over a histogram of shares; only terms of both meet in a join.
    """
    a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("p0a"), F.col("own").alias("na"), "kinds")
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0b"), F.col("own").alias("nb"))
    base = a.join(b, "lang").where("a < b").select("lang", "a", "b", F.expr("(kinds - na - nb) * abs(p0a - p0b)").alias("value"))
    steps = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    alone = steps.join(other, "lang").where("source <> other").select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"),
        F.expr("m * abs(p - q0)").alias("value"))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("p0a"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("p0b"))
    both = left.join(right, ["lang", "term"]).where("a < b").select(
        "lang", "a", "b", F.expr("abs(pa - pb) - abs(pa - p0b) - abs(pb - p0a) + abs(p0a - p0b)").alias("value"))
    summed = base.union(alone).union(both).groupBy("lang", "a", "b").agg(
        F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                              F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
