"""WARC archives with an external index merge.

Tasks write gzip-per-record WARC files and a locally sorted run of index entries for what they wrote.
The runs are cut at common splitters and merged k ways with a loser tree, by URL key, timestamp and
record, into one globally ordered index: the capture history of every URL, in order, with file,
offset and length of each record.  Reading goes through that index.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.store import filesystem, materialise, new_folder, qualified

LEAST_BYTES = 1000          # smaller payloads are never written as revisits
FILE_BYTES = 64 << 20       # a file is closed when it is larger
RUN_ENTRIES = 20_000        # entries of a run at most
RANGE_ENTRIES = 2_000       # entries that one merge handles, about
MOST_RANGES = 1 << 16       # bounds what the driver sees of the index: SAMPLE keys a range
SAMPLE = 8
READ_BYTES = 4 << 20        # archive bytes that one reading task handles, about
MOST_TASKS = 100_000
NO_ID = -(1 << 63)          # stands in the index for a page without an id
EPOCH = 946_684_800         # capture time of page 0; page n is captured n seconds later
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then the rest (``http://a.b/c`` -> ``b,a)/c``)."""
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(F.instr(url, "://") > 0, key).otherwise(F.coalesce(url, F.lit("")))


def _time(page_id: int | None) -> int:
    """Capture time of a page; pages without an id are captured at ``EPOCH``."""
    return EPOCH if page_id is None else EPOCH + page_id


def _record(page_id: int | None, url: str, digest: str, payload: bytes, size: int, refers: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member.  A revisit has no block but names its response."""
    from datetime import datetime, timezone

    date = datetime.fromtimestamp(EPOCH + (page_id or 0) % 3_000_000_000, tz=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {''.join(c if c.isprintable() else ' ' for c in url)}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}", "Content-Type: text/html; charset=utf-8"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {_PROFILE}"]
        payload = b""
    head = "\r\n".join([*lines, f"Content-Length: {len(payload)}"]).encode("utf-8", "surrogatepass")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head + b"\r\n\r\n") + z.compress(payload) + z.compress(b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and payload of one gzip member."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    found = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    found["payload"] = rest[:int(found["content-length"])]
    return found


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


_INDEX = {"url_key": pa.string(), "timestamp": pa.int64(), "page_id": pa.int64(), "path": pa.string(),
          "offset": pa.int64(), "length": pa.int64()}
INDEX_SCHEMA = "url_key string, timestamp long, page_id long, path string, offset long, length long"


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), _INDEX.values())], list(_INDEX))


def with_references(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                    least: int = LEAST_BYTES) -> DataFrame:
    """``(page_id, url, html, digest, bytes, refers_to)``: of pages with equal payloads of at least
    ``least`` bytes the largest id is the response and the others refer to it; pages without an id are
    never referred to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html").cast("long")})
    first = (rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("__r"), F.count(F.lit(1)).alias("__n"))
             .where("__n > 1 AND __r IS NOT NULL").select(F.col("digest").alias("__d"), "__r"))
    first = materialise(first, "responses")
    rows = rows.join(first, rows["digest"] == first["__d"], "left")
    return rows.select("page_id", "url", "html", "digest", "bytes",
                       F.when(~F.col("__r").eqNullSafe(F.col("page_id")), F.col("__r")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write one record per page; the runs of index entries (materialised, sorted within each run).

    Null html is an empty payload, a null URL an empty target.  Pages without an id get records of their
    own, captured at ``EPOCH``.  Rows that repeat an id with the same payload are written each, as responses of
    that id.  File names are new in every attempt, and only files that the index names are read.
    """
    folder = qualified(pages.sparkSession, folder) if folder else new_folder(pages.sparkSession, "warc")
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    rows = with_references(pages, **columns).withColumn("key", url_key(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at, held = None, "", 0, []
        for b in batches:
            for page_id, url, html, digest, size, refers, key in zip(*(b.column(c) for c in ("page_id", "url", "html", "digest", "bytes", "refers_to", "key"))):
                if out is None:
                    path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    fs, inner = filesystem(path)
                    out = fs.open_output_stream(inner, compression=None)
                page = page_id.as_py()
                raw = _record(page, url.as_py() or "", digest.as_py(), html.as_py().encode("utf-8", "surrogatepass"), size.as_py(), refers.as_py())
                out.write(raw)
                held.append((key.as_py(), _time(page), NO_ID if page is None else page, path, at, len(raw)))
                at += len(raw)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
                if len(held) >= RUN_ENTRIES:
                    yield _run(held)
                    held = []
        if out is not None:
            out.close()
        if held:
            yield _run(held)

    return materialise(rows.mapInArrow(run, INDEX_SCHEMA + ", run string, place int"), "runs")


def _run(rows: list[tuple]) -> pa.RecordBatch:
    """A sorted run: its entries, its name, and each entry's place in it."""
    b = _entries(sorted(rows))
    return pa.RecordBatch.from_arrays([*b.columns, pa.array([uuid.uuid4().hex] * len(rows)), pa.array(range(len(rows)), type=pa.int32())],
                                      [*b.schema.names, "run", "place"])


class LoserTree:
    """k-way merge: inner nodes hold losers, so the next smallest costs one path to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = [r for r in runs if r], 0
        self.k = len(self.runs)
        self.at = [0] * self.k
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _head(self, i: int):
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self._head(i), self._head(j)
        return b is None or (a is not None and (a, i) <= (b, j))

    def _play(self, i: int) -> None:
        """Run ``i`` climbs; at each node the loser stays.  While the tree fills up, an empty node holds it."""
        node = (i + self.k) // 2
        while node:
            j = self.tree[node]
            if j < 0:
                self.tree[node] = i
                return
            if self._beats(j, i):
                self.tree[node], i = i, j
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (best := self._head(self.tree[0])) is not None:
            yield best
            self.at[self.tree[0]] += 1
            self._play(self.tree[0])


def merge(runs: DataFrame) -> DataFrame:
    """The globally ordered index: the entries with ``position`` (from 0) and ``capture`` (from 1
    within a URL key).

    Splitters come from a bounded sample of keys; every run is cut at them into slices, slices of one
    range meet in one task in runs' order, and a loser tree merges them.  Keys end in page id and
    record place, so a URL captured a third of all times is cut like any other.
    """
    spark = runs.sparkSession
    n = runs.count()
    ranges = min(MOST_RANGES, max(1, -(-n // RANGE_ENTRIES)))
    every = max(1, n // (SAMPLE * ranges))
    key = ["url_key", "timestamp", "page_id"]
    sample = sorted(tuple(r) for r in runs.where(F.pmod(F.xxhash64("page_id", "path", "offset"), F.lit(every)) == 0).select(*key).collect())
    cuts = spark.sparkContext.broadcast([sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else [])  # MOST_RANGES keys

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring entries of one run and range make one row."""
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in _INDEX)))
            names, places = b.column("run").to_pylist(), b.column("place").to_pylist()
            spots = [bisect.bisect_right(cuts.value, r[:3]) for r in rows]
            ends = [i for i in range(1, len(rows) + 1) if i == len(rows) or spots[i] != spots[i - 1] or names[i] != names[i - 1]]
            starts = [0, *ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([spots[s] for s in starts], type=pa.int32()), pa.array([names[s] for s in starts]),
                 pa.array([places[s] for s in starts], type=pa.int32()),
                 pa.array([[dict(zip(_INDEX, r)) for r in rows[s:e]] for s, e in zip(starts, ends)], type=pa.list_(pa.struct(list(_INDEX.items()))))],
                ["range", "run", "place", "slice"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range, run and place."""
        current, held = None, {}
        for b in batches:
            for spot, name, piece in zip(b.column("range").to_pylist(), b.column("run").to_pylist(), b.column("slice")):
                if spot != current:
                    yield from _merged(current, held)
                    current, held = spot, {}
                held.setdefault(name, []).extend(tuple(r[c] for c in _INDEX) for r in piece.as_py())
        yield from _merged(current, held)

    slices = runs.select(*_INDEX, "run", "place").mapInArrow(cut, f"range int, run string, place int, slice array<struct<{INDEX_SCHEMA.replace(' long', ': long').replace(' string', ': string')}>>")
    slices = slices.repartition(ranges, "range").sortWithinPartitions("range", "run", "place")
    merged = materialise(slices.mapInArrow(join, INDEX_SCHEMA + ", range int, place int"), "index")
    return _positions(merged).withColumn("page_id", F.nullif(F.col("page_id"), F.lit(NO_ID)))


def _merged(spot: int | None, held: dict[str, list[tuple]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    done = 0
    for r in LoserTree(list(held.values())):
        rows.append(r)
        if len(rows) == 10_000:
            yield _numbered(rows, spot, done)
            done, rows = done + len(rows), []
    if rows:
        yield _numbered(rows, spot, done)


def _numbered(rows: list[tuple], spot: int, first: int) -> pa.RecordBatch:
    b = _entries(rows)
    return pa.RecordBatch.from_arrays([*b.columns, pa.array([spot] * len(rows), type=pa.int32()), pa.array(range(first, first + len(rows)), type=pa.int32())],
                                      [*b.schema.names, "range", "place"])


def _positions(merged: DataFrame) -> DataFrame:
    """Global positions from places within ranges (one row a range), and captures within URL keys."""
    from pyspark.sql import Window

    sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))  # MOST_RANGES rows at most
    placed = merged.join(F.broadcast(base), "range").withColumn("position", F.col("__base") + F.col("place"))
    first = placed.groupBy("url_key").agg(F.min("position").alias("__first"))
    first = materialise(first.withColumnRenamed("url_key", "__key"), "firsts")
    return (placed.join(first, placed["url_key"] == first["__key"])
            .select(*_INDEX, "position", (F.col("position") - F.col("__first") + 1).alias("capture")))


def read(index: DataFrame) -> DataFrame:
    """Read the records that an index names: ``(page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload, position, capture)``.

    Entries are dealt by file and stretch of ``READ_BYTES`` and read in order of offset.  A response's size and
    digest are computed from its payload; a revisit's come from its headers.
    """
    stretch = F.floor(F.col("offset") / F.lit(READ_BYTES))
    dealt = index.select("path", "offset", "length", "position", "capture").withColumn("stretch", stretch)
    # As many tasks as the archives ask for: the index itself is tiny beside them.
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = dealt.repartition(min(MOST_TASKS, -(-total // READ_BYTES) + 1), "path", "stretch").sortWithinPartitions("path", "offset")
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, payload binary, position long, capture long")
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for b in batches:
            out, size = [], 0
            for p, offset, length, position, capture in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length", "position", "capture"))):
                if p != path:
                    if source is not None:
                        source.close()
                    fs, inner = filesystem(p)
                    path, source = p, fs.open_input_file(inner)
                source.seek(offset)
                r = parse(source.read(length))
                body = r["payload"]
                full = r["warc-type"] == "response"
                out.append((_page(r["warc-record-id"]), r["warc-target-uri"], len(body) if full else int(r["x-payload-bytes"]),
                            hashlib.sha1(body).hexdigest() if full else r["warc-payload-digest"].removeprefix("sha1:"),
                            r["warc-type"], None if full else _page(r["warc-refers-to"]), body, position, capture))
                size += len(body)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], schema_names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], schema_names)
        if source is not None:
            source.close()

    schema_names = [c.split()[0] for c in schema.split(", ")]
    return dealt.mapInArrow(run, schema)
