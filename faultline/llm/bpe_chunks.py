"""BPE encoding and decoding with content-defined chunk reuse.

1. A rolling hash cuts every distinct text into chunks; a chunk that occurs in several texts is
   owned by one of them.
2. Every text encodes the chunks that are its own or unshared.  Owners also hand out the ids of
   their shared chunks; a text that borrows some waits with holes where they belong.
3. Borrowed ids are joined to the waiting texts.
4. The chunks' ids are joined.  Where a chunk end is not itself a place at which both sides provably
   agree with the encoding of the whole text, the window between the nearest such places is encoded
   again, and widened until its ends meet token ends on both sides, so the ids are those of the
   whole text.

Texts are known by a 128-bit hash, so each distinct text is handled once and its copies -- a third of
all rows may be copies -- take the result by a join of hashes.  A text crosses the network once, in
compressed form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import bpe
from faultline.llm.store import materialise

SHORTEST, LONGEST = 256, 4096      # bytes of a chunk
WORD_MASK = np.uint32(0x3F << 20)  # one in 64 word ends is a cut
ANY_MASK = np.uint32(0x7FF << 16)  # one in 2048 characters is a cut anyway, as in texts without spaces
_GEAR = np.random.default_rng(9001).integers(0, 2**32, 256, dtype=np.uint32)
_WHITE_LEADS = frozenset(b"\xc2\xe1\xe2\xe3")   # lead bytes that white space beyond ASCII has in UTF-8


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``: where a hash of the last 32 bytes hits -- often at word ends,
    rarely between any two characters -- within the length bounds (the last chunk may be shorter)."""
    n = len(raw)
    if n <= SHORTEST:
        return [n] if n else []
    b = np.frombuffer(raw, dtype=np.uint8)
    h = _GEAR[b]
    for step in (1, 2, 4, 8, 16):
        old = h.copy()
        h[step:] += old[:-step] << np.uint32(step)
    starts = (b & 0xC0) != 0x80
    words = np.zeros(n, dtype=bool)
    words[1:-1] = (b[1:-1] == 32) & (b[:-2] > 32) & (b[2:] > 32)
    hits = np.flatnonzero((((h[:-1] & WORD_MASK) == 0) & words[1:]) | (((h[:-1] & ANY_MASK) == 0) & starts[1:])) + 1
    ends, at = [], 0
    while n - at > SHORTEST:
        k = int(np.searchsorted(hits, at + SHORTEST))
        end = int(hits[k]) if k < len(hits) else n
        if end - at > LONGEST:
            end = at + LONGEST
            while end > at + 1 and not starts[end]:
                end -= 1
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _hash(raw: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _safe(raw: bytes, at: int, low: int, high: int) -> bool:
    """True where the encodings of raw[low:high] and of any text around it both cut: before a single
    space between two visible characters, all three inside."""
    if not low < at < high - 1 or raw[at] != 32 or raw[at - 1] <= 32 or raw[at + 1] <= 32 or raw[at + 1] in _WHITE_LEADS:
        return False
    if raw[at - 1] < 0x80:
        return True
    first = at - 1
    while first > low and raw[first] & 0xC0 == 0x80:
        first -= 1
    return raw[first] not in _WHITE_LEADS


def join_chunks(raw: bytes, ends: list[int], parts: list[np.ndarray], path: str) -> np.ndarray:
    """The ids of the whole text from the ids of its chunks, windows around the joins encoded again."""
    if len(parts) < 2:
        return parts[0] if parts else np.empty(0, dtype="<u4")
    starts = [0, *ends[:-1]]
    lengths = bpe.byte_lengths(path)
    reach = [s + np.cumsum(lengths[p]) for s, p in zip(starts, parts)]

    def agreed(k: int, at: int) -> int | None:
        """Tokens of chunk k that end by ``at``, if one ends there and both encodings cut there."""
        if not _safe(raw, at, starts[k], ends[k]):
            return None
        i = int(np.searchsorted(reach[k], at))
        return i + 1 if i < len(reach[k]) and reach[k][i] == at else None

    def before(k: int) -> tuple[int, int, int]:
        """Last agreement in chunk k or an earlier one: chunk, offset, tokens."""
        while k >= 0:
            at = raw.rfind(b" ", starts[k], ends[k])
            while at > starts[k]:
                if (i := agreed(k, at)) is not None:
                    return k, at, i
                at = raw.rfind(b" ", starts[k], at)
            k -= 1
        return 0, 0, 0

    def after(k: int) -> tuple[int, int, int]:
        while k < len(parts):
            at = raw.find(b" ", starts[k], ends[k])
            while at >= 0:
                if (i := agreed(k, at)) is not None:
                    return k, at, i
                at = raw.find(b" ", at + 1, ends[k])
            k += 1
        return len(parts) - 1, len(raw), len(parts[-1])

    windows: list[list] = []
    for k in range(len(parts) - 1):
        if _safe(raw, ends[k], 0, len(raw)):
            continue    # both sides end a pre-token here, as the whole text does: they agree
        left, right = before(k), after(k + 1)
        if windows and left[1] <= windows[-1][1][1]:
            windows[-1][1] = max(windows[-1][1], right, key=lambda w: w[1])
        else:
            windows.append([left, right])
    if not windows:
        return np.concatenate(parts)
    again = bpe.encoder(path).encode_all([raw[l[1]:r[1]].decode("utf-8", "surrogatepass") for l, r in windows])
    out, chunk, taken = [], 0, 0
    for (left, right), ids in zip(windows, again):
        while chunk < left[0]:
            out.append(parts[chunk][taken:])
            chunk, taken = chunk + 1, 0
        out.append(parts[chunk][taken:left[2]])
        out.append(ids)
        chunk, taken = right[0], right[2]
    out.append(parts[chunk][taken:])
    out += parts[chunk + 1:]
    return np.concatenate(out)


@lru_cache(maxsize=2)
def _digits(path: str) -> list[str]:
    return [str(i) for i in range(len(bpe.byte_table(path)))]


class _Finished:
    """Rows of finished texts, with the columns that are asked for."""

    def __init__(self, path: str, keep: tuple[str, ...]):
        self.table, self.digits, self.keep, self.rows = bpe.byte_table(path), _digits(path), keep, []

    def add(self, key: tuple[int, int], ids: np.ndarray) -> None:
        numbers = ids.tolist()
        row = {"t1": key[0], "t2": key[1], "n_tokens": len(numbers)}
        row["ids_sha256"] = hashlib.sha256(",".join(map(self.digits.__getitem__, numbers)).encode()).hexdigest()
        text = b"".join(map(self.table.__getitem__, numbers)).decode("utf-8", "replace")
        row["decoded_sha256"] = hashlib.sha256(text.encode()).hexdigest()
        if "ids" in self.keep:
            row["ids"] = numbers
        if "decoded" in self.keep:
            row["decoded"] = text
        self.rows.append(row)


_RESULT = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}
_ARROW = {"t1": pa.int64(), "t2": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(),
          "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string(),
          "c1": pa.int64(), "c2": pa.int64(), "chunk_ids": pa.binary(),
          "parts": pa.list_(pa.struct([("c1", pa.int64()), ("c2", pa.int64()), ("chunk_ids", pa.binary())]))}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], type=_ARROW[n]) for n in names], names)


def encode_decode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = (), id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded])``, one row per input row.

    ``keep`` may name ``ids`` (array<int>) and ``decoded`` (string).  Null texts count as empty (no
    ids); repeated rows give repeated results; null ids stay null.  Other columns are ignored.
    ``path`` is a byte-level BPE file of the tokenizers library, readable on every executor.
    """
    path = path or bpe.vocabulary_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *[k for k in ("ids", "decoded") if k in keep]]
    result = ", ".join(f"{n} {_RESULT[n]}" for n in names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, t1, t2, seq, c1, c2 = [], [], [], [], [], []
            for t in b.column("text"):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                key, at = _hash(raw), 0
                keys.append(key)
                for k, end in enumerate(chunk_ends(raw)):
                    h = _hash(raw[at:end])
                    t1.append(key[0]), t2.append(key[1]), seq.append(k), c1.append(h[0]), c2.append(h[1])
                    at = end
            n, ids = len(seq), b.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids, *[None] * n], type=b.schema.field("doc_id").type),
                 pa.array([*[k[0] for k in keys], *t1], type=pa.int64()),
                 pa.array([*[k[1] for k in keys], *t2], type=pa.int64()),
                 pa.array([*[None] * len(keys), *seq], type=pa.int32()),
                 pa.array([*[None] * len(keys), *c1], type=pa.int64()),
                 pa.array([*[None] * len(keys), *c2], type=pa.int64())], ["doc_id", "t1", "t2", "seq", "c1", "c2"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    marks = materialise(rows.mapInArrow(cut, f"doc_id {id_type}, t1 long, t2 long, seq int, c1 long, c2 long"), "chunks")
    chunks = marks.where("seq IS NOT NULL").select("t1", "t2", "seq", "c1", "c2").distinct()
    shared = (chunks.groupBy("c1", "c2").agg(F.min("t1").alias("owner"), F.max("t1").alias("__last"))
              .where("owner <> __last").drop("__last"))
    shared = materialise(shared, "shared")
    uses = materialise(chunks.join(shared, ["c1", "c2"]).withColumn("own", F.col("owner") == F.col("t1")), "uses")
    plan = uses.groupBy("t1", "t2").agg(F.collect_list(F.struct("seq", "own")).alias("plan"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raws = [t.as_py().encode("utf-8", "surrogatepass") for t in b.column("text")]
            once = dict(zip(map(_hash, raws), raws))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in once], type=pa.int64()), pa.array([k[1] for k in once], type=pa.int64()),
                                              pa.array([z.compress(r) for r in once.values()], type=pa.binary())], ["t1", "t2", "packed"])

    texts = rows.select("text").mapInArrow(squeeze, "t1 long, t2 long, packed binary")
    texts = texts.groupBy("t1", "t2").agg(F.first("packed").alias("packed")).join(plan, ["t1", "t2"], "left")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, encoder = zstandard.ZstdDecompressor(), bpe.encoder(path)
        columns = ["t1", "t2", *names, "c1", "c2", "chunk_ids", "parts"]
        for b in batches:
            held, size, last = [], 0, b.num_rows - 1
            for i, (t1, t2, packed, plan_) in enumerate(zip(*(b.column(c) for c in ("t1", "t2", "packed", "plan")))):
                raw = z.decompress(packed.as_py(), max_output_size=1 << 31)
                held.append(((t1.as_py(), t2.as_py()), raw, {p["seq"]: p["own"] for p in plan_.as_py() or ()}))
                size += len(raw)
                if size > 1 << 22 or i == last:
                    yield _batch(_encode_group(held, encoder, path, keep), columns)
                    held, size = [], 0

    state = texts.mapInArrow(encode, f"t1 long, t2 long, {result}, c1 long, c2 long, chunk_ids binary, "
                             "parts array<struct<c1: long, c2: long, chunk_ids: binary>>")
    state = materialise(state, "encoded")
    ready = state.where("n_tokens IS NOT NULL").select("t1", "t2", *names)
    lent = state.where("chunk_ids IS NOT NULL").groupBy("c1", "c2").agg(F.first("chunk_ids").alias("chunk_ids"))
    lent = materialise(lent, "lent")
    waiting = state.where("parts IS NOT NULL").select("t1", "t2", "parts")
    asked = uses.where("NOT own").select("t1", "t2", "c1", "c2").distinct()
    filled = materialise(asked.join(lent, ["c1", "c2"]), "filled").groupBy("t1", "t2").agg(
        F.collect_list(F.struct("c1", "c2", "chunk_ids")).alias("borrowed"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.byte_table(path)
        for b in batches:
            done = _Finished(path, keep)
            for t1, t2, parts, borrowed in zip(*(b.column(c) for c in ("t1", "t2", "parts", "borrowed"))):
                have = {(x["c1"], x["c2"]): x["chunk_ids"] for x in borrowed.as_py() or ()}
                ids = [_unpack(p["chunk_ids"] if p["chunk_ids"] is not None else have[p["c1"], p["c2"]]) for p in parts.as_py()]
                raws = [bpe.decode(i, table) for i in ids]
                done.add((t1.as_py(), t2.as_py()), join_chunks(b"".join(raws), np.cumsum([len(r) for r in raws]).tolist(), ids, path))
            if done.rows:
                yield _batch(done.rows, ["t1", "t2", *names])

    late = waiting.join(filled, ["t1", "t2"], "left").mapInArrow(finish, f"t1 long, t2 long, {result}")
    ready = materialise(ready.union(late), "texts") if not keep else ready.union(late)
    return marks.where("seq IS NULL").select("doc_id", "t1", "t2").join(ready, ["t1", "t2"]).select("doc_id", *names)


def _pack(ids: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(ids.tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(raw, max_output_size=1 << 31), dtype="<u4")


def _encode_group(held: list, encoder: bpe.Encoder, path: str, keep: tuple[str, ...]) -> list[dict]:
    """Encode what each text has to encode itself; chunks that repeat within the group once."""
    todo: dict[bytes, int] = {}
    cuts = []
    for _, raw, plan in held:
        ends, at, own = chunk_ends(raw), 0, []
        for k, end in enumerate(ends):
            own.append(None if plan.get(k) is False else todo.setdefault(raw[at:end], len(todo)))
            at = end
        cuts.append((ends, own))
    encoded = encoder.encode_all([c.decode("utf-8", "surrogatepass") for c in todo])
    done, rows = _Finished(path, keep), []
    for (key, raw, plan), (ends, own) in zip(held, cuts):
        starts = [0, *ends[:-1]]
        for k, i in enumerate(own):
            if plan.get(k):
                h = _hash(raw[starts[k]:ends[k]])
                rows.append({"c1": h[0], "c2": h[1], "chunk_ids": _pack(encoded[i])})
        if None not in own:
            done.add(key, join_chunks(raw, ends, [encoded[i] for i in own], path))
        else:
            parts = []
            for k, i in enumerate(own):
                h = _hash(raw[starts[k]:ends[k]]) if i is None else (None, None)
                parts.append({"c1": h[0], "c2": h[1], "chunk_ids": None if i is None else _pack(encoded[i])})
            rows.append({"t1": key[0], "t2": key[1], "parts": parts})
    return done.rows + rows
