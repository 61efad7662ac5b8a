"""Token-id files with Re-Pair grammar compression and random access.

Documents are range-partitioned by id; each task encodes its documents in order and writes files of
about ``FILE_IDS`` ids.  Within a file the most frequent pairs of neighbouring symbols are replaced
by new symbols, again and again, until no frequent pair is left; rules are stored with the lengths
they expand to.  No rule spans two documents, so a document, or a range of its ids, is decoded from
its own symbols alone.

File: 8-byte magic, 8-byte header length, JSON header, then zstandard-compressed sections: document
ids, validity, id counts and symbol counts; rules (left, right) and their expanded lengths; symbols
in blocks of ``BLOCK`` (low 16 bits, then high 16 bits), each block compressed on its own.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe
from faultline.llm.ordering import row_numbers
from faultline.llm.store import filesystem, materialise, new_folder, qualified, shuffle_partitions

MAGIC = b"REPAIR01"
FILE_IDS = 1 << 22        # ids of a file, about
BLOCK = 1 << 16           # symbols of a block
PAIRS_A_ROUND = 4096      # pairs replaced together
LEAST_FREQUENT = 16       # a pair that occurs less often is left alone
LEAST_GAIN = 0.02         # part of the symbols that a round has to save
LEAD = 32                 # characters of a text that order rows of one id
_BUCKETS = 20


def _frequent_pairs(a: np.ndarray, b: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the most frequent pairs (a[i], b[i]) and the number of the pair at each.

    Pairs are counted by hash bucket; a full enough bucket stands for the pair seen last in it, whose
    count is then exact.  Other pairs of that bucket wait for a later round.
    """
    size = 1 << _BUCKETS
    bucket = ((a * np.uint32(2654435761)) ^ (b * np.uint32(2246822519) + np.uint32(0x9E3779B9))) >> np.uint32(32 - _BUCKETS)
    counts = np.bincount(bucket, minlength=size) - np.bincount(bucket[~inside], minlength=size)
    least = LEAST_FREQUENT
    if (counts >= least).sum() > PAIRS_A_ROUND:
        least = max(least, int(np.partition(counts, size - PAIRS_A_ROUND)[size - PAIRS_A_ROUND]))
    full = counts >= least
    at = np.flatnonzero(full[bucket] & inside)
    # From here on full buckets go by number: few, so that what is known of them stays in the cache.
    held, x, y = (np.cumsum(full, dtype=np.int32) - 1)[bucket[at]], a[at], b[at]
    last = np.zeros(int(full.sum()), dtype=np.int64)
    last[held] = np.arange(len(held))
    same = (x[last][held] == x) & (y[last][held] == y) if len(held) else np.zeros(0, dtype=bool)
    at, held = at[same], held[same]
    chosen = np.bincount(held, minlength=len(last)) >= LEAST_FREQUENT
    number = np.cumsum(chosen) - 1
    keep = chosen[held]
    return at[keep], number[held[keep]]


def compress(ids: np.ndarray, doc_lengths: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: ``(symbols, rules, symbols per document)``; rule r makes symbol ``terminals + r``.

    Every round counts all pairs inside documents, replaces the most frequent ones from left to
    right, and counts again, until a round saves under 2 %.  An occurrence that overlaps one replaced
    just before it in a run stays.
    """
    sym = ids.astype(np.uint32)
    counts = doc_lengths.astype(np.int64)         # a copy
    last = np.zeros(len(sym), dtype=bool)         # the last symbol of its document
    last[np.cumsum(counts)[counts > 0] - 1] = True
    rules: list[np.ndarray] = []
    top = terminals
    while len(sym) > 1:
        where, pair = _frequent_pairs(sym[:-1], sym[1:], ~last[:-1])
        if not len(where):
            break
        first = np.r_[True, np.diff(where) != 1]      # of a run of neighbouring hits
        run = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
        odd = (np.arange(len(where)) - run) % 2 == 0
        where, pair = where[odd], pair[odd]
        made = int(pair.max()) + 1
        rule = np.zeros((made, 2), dtype=np.uint32)
        rule[pair, 0], rule[pair, 1] = sym[where], sym[where + 1]
        rules.append(rule)
        sym[where] = top + pair
        keep = np.ones(len(sym), dtype=bool)
        keep[where + 1] = False
        last[where] = last[where + 1]
        before = len(sym)
        sym, last = sym[keep], last[keep]
        top += made
        if before - len(sym) < LEAST_GAIN * before:
            break
    rules_ = np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.uint32)
    counts[counts > 0] = np.diff(np.flatnonzero(last), prepend=-1)
    return sym, rules_, counts


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Number of ids that each rule stands for."""
    out = np.empty(len(rules), dtype=np.int64)
    size = lambda s: 1 if s < terminals else int(out[s - terminals])
    for r, (a, b) in enumerate(rules.tolist()):
        out[r] = size(a) + size(b)
    return out


class Reader:
    """Random access to one file: documents by position, or ranges of their ids."""

    def __init__(self, path: str):
        import zstandard

        fs, inner = filesystem(path)
        with fs.open_input_file(inner) as f:
            head = f.read(16)
            if head[:8] != MAGIC:
                raise ValueError(f"{path} is not a grammar file")
            size = int.from_bytes(head[8:], "little")
            self.head = json.loads(f.read(size))
            self.body = f.read()
        self.z = zstandard.ZstdDecompressor()
        self.terminals = self.head["terminals"]
        section = lambda n, t: np.frombuffer(self._section(n), dtype=t)
        self.doc_ids, self.valid = section("doc_ids", "<i8"), section("valid", "u1")
        self.n_ids, self.n_symbols = section("n_ids", "<i8"), section("n_symbols", "<i8")
        self.rules, self.lengths = section("rules", "<u4").reshape(-1, 2), section("lengths", "<i8")
        self.first = np.r_[0, np.cumsum(self.n_symbols)]
        self._flatten()

    def _section(self, name: str) -> bytes:
        at, size, raw = self.head["sections"][name]
        return self.z.decompress(self.body[at:at + size], max_output_size=raw) if raw else b""

    def _flatten(self) -> None:
        """All rules' expansions one after the other; a rule only uses symbols made before it."""
        self.offset = np.r_[0, np.cumsum(self.lengths)]
        self.flat = np.empty(int(self.offset[-1]), dtype=np.uint32)
        for r, pair in enumerate(self.rules.tolist()):
            at = int(self.offset[r])
            for s in pair:
                if s < self.terminals:
                    self.flat[at] = s
                    at += 1
                else:
                    lo, hi = self.offset[s - self.terminals], self.offset[s - self.terminals + 1]
                    self.flat[at:at + hi - lo] = self.flat[lo:hi]
                    at += hi - lo

    def symbols(self, start: int, end: int) -> np.ndarray:
        parts = []
        for k in range(start // BLOCK, -(-end // BLOCK)):
            at, size, n = self.head["blocks"][k]
            raw = self.z.decompress(self.body[at:at + size], max_output_size=4 * n)
            low, high = np.frombuffer(raw[:2 * n], dtype="<u2"), np.frombuffer(raw[2 * n:], dtype="<u2")
            block = low.astype(np.uint32) | (high.astype(np.uint32) << 16)
            parts.append(block[max(0, start - k * BLOCK):end - k * BLOCK])
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)

    def expand(self, sym: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        rule = sym.astype(np.int64) - self.terminals
        made = rule >= 0
        size = np.where(made, self.lengths[np.maximum(rule, 0)], 1) if len(self.lengths) else np.ones(len(sym), dtype=np.int64)
        end = np.cumsum(size)
        out = np.empty(int(end[-1]) if len(end) else 0, dtype="<u4")
        out[(end - size)[~made]] = sym[~made]
        if made.any():
            n, start = size[made], (end - size)[made]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(start, n) + step] = self.flat[np.repeat(self.offset[rule[made]], n) + step]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols(int(self.first[k]), int(self.first[k + 1])))

    def ids(self, k: int, start: int, end: int) -> np.ndarray:
        """Ids start..end of document k; only the symbols that cover them are expanded."""
        sym = self.symbols(int(self.first[k]), int(self.first[k + 1]))
        rule = sym.astype(np.int64) - self.terminals
        size = np.where(rule >= 0, self.lengths[np.maximum(rule, 0)], 1) if len(self.lengths) else np.ones(len(sym), dtype=np.int64)
        reach = np.cumsum(size)
        a, b = int(np.searchsorted(reach, start, side="right")), int(np.searchsorted(reach, end))
        skipped = int(reach[a - 1]) if a else 0
        return self.expand(sym[a:b + 1])[start - skipped:end - skipped]


def write_file(folder: str, doc_ids: list, arrays: list[np.ndarray], terminals: int) -> tuple[str, int]:
    """Write one file; its name is new, so a task that runs again never touches an earlier file."""
    import zstandard

    n_ids = np.array([len(a) for a in arrays], dtype="<i8")
    sym, rules, n_symbols = compress(np.concatenate(arrays) if arrays else np.empty(0, "<u4"), n_ids, terminals)
    z, body, at = zstandard.ZstdCompressor(level=1), [], 0
    head: dict = {"terminals": terminals, "sections": {}, "blocks": []}

    def add(raw: bytes) -> tuple[int, int]:
        nonlocal at
        packed = z.compress(raw)
        body.append(packed)
        at += len(packed)
        return at - len(packed), len(packed)

    sections = {"doc_ids": np.array([0 if d is None else d for d in doc_ids], dtype="<i8"),
                "valid": np.array([d is not None for d in doc_ids], dtype="u1"), "n_ids": n_ids,
                "n_symbols": n_symbols.astype("<i8"), "rules": rules.astype("<u4"),
                "lengths": expansion_lengths(rules, terminals).astype("<i8")}
    for name, values in sections.items():
        raw = values.tobytes()
        head["sections"][name] = [*add(raw), len(raw)]
    for k in range(0, len(sym), BLOCK):
        part = sym[k:k + BLOCK]
        head["blocks"].append([*add((part & 0xFFFF).astype("<u2").tobytes() + (part >> 16).astype("<u2").tobytes()), len(part)])
    text = json.dumps(head).encode()
    path = f"{folder}/ids-{uuid.uuid4().hex}.repair"
    fs, inner = filesystem(path)
    with fs.open_output_stream(inner) as f:
        f.write(MAGIC + len(text).to_bytes(8, "little") + text)
        for part in body:
            f.write(part)
    return path, len(sym)


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, compress and write all documents in ascending id order; the manifest of the files:
    ``(first_id, path, n_docs, n_ids, n_symbols, start)`` with ``start`` = ids of all files before.

    Null texts count as empty (the end id alone); null ids come first; rows that repeat an id go by the first
    ``LEAD`` characters of their texts, then by a hash of the text.  Rows are told apart by where they were
    read at last, so ranges of partitions cut a third of all rows that share an id.  An empty table writes no file.  The manifest is materialised, so files
    of lost attempts are never read.  Ids must be integers.
    """
    spark = docs.sparkSession
    vocabulary = path or bpe.vocabulary_path()
    folder = qualified(spark, folder) if folder else new_folder(spark, "tokens")
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"lead": F.left("text", F.lit(LEAD)), "hash": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("lead"), F.col("hash"), F.col("at")]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, terminals = bpe.encoder(vocabulary), len(bpe.byte_table(vocabulary))
        end = np.array([end_id], dtype="<u4")
        ids, arrays, size, files = [], [], 0, []

        def flush() -> None:
            name, n_symbols = write_file(folder, ids, arrays, max(terminals, end_id + 1))
            files.append((ids[0], name, len(ids), sum(map(len, arrays)), n_symbols))

        for b in batches:
            keys, k = b.column("doc_id").to_pylist(), 0
            for group in bpe.text_groups(b.column("text")):
                for found in encoder.encode_all(group):
                    ids.append(keys[k])
                    arrays.append(np.concatenate([found, end]))
                    size, k = size + len(found) + 1, k + 1
                    if size >= FILE_IDS:
                        flush()
                        ids, arrays, size = [], [], 0
        if ids:
            flush()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*files), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                             ["first_id", "path", "n_docs", "n_ids", "n_symbols"])

    manifest = materialise(ordered.mapInArrow(run, "first_id long, path string, n_docs long, n_ids long, n_symbols long"), "manifest")
    return with_starts(manifest)


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add ``start``: ids of all files before, in order of their first document."""
    from pyspark.sql import Window

    placed = row_numbers(manifest, [F.col("first_id").asc_nulls_first(), F.col("path")], "__row")
    # Sums within fixed runs of files, then over the runs, so that no task holds all files.
    placed = placed.withColumn("__run", F.floor(F.col("__row") / 4096))
    runs = placed.groupBy("__run").agg(F.sum("n_ids").alias("__ids"))
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("__run", F.coalesce(F.sum("__ids").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("__run").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("__in", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(runs, "__run")
            .withColumn("start", F.col("__base") + F.col("__in")).drop("__row", "__run", "__base", "__in"))


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` per document, from the files of a manifest."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                r = Reader(path)
                starts = start + np.r_[0, np.cumsum(r.n_ids)]
                for lo in range(0, len(r.doc_ids), 1024):
                    hi = min(lo + 1024, len(r.doc_ids))
                    found = r.expand(r.symbols(int(r.first[lo]), int(r.first[hi])))
                    cut = np.r_[0, np.cumsum(r.n_ids[lo:hi])]
                    each = [found[a:z] for a, z in zip(cut, cut[1:])]
                    cols = [pa.array(r.doc_ids[lo:hi], mask=r.valid[lo:hi] == 0), pa.array(starts[lo:hi], type=pa.int64()),
                            pa.array([len(e) for e in each], type=pa.int64()),
                            pa.array([zlib.crc32(e.astype("<u4").tobytes()) for e in each], type=pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([e.tolist() for e in each], type=pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    files = manifest.select("path", "start").repartition(shuffle_partitions(spark))
    return files.mapInArrow(run, schema)
