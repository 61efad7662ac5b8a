"""SZZ with real line numbers -- which commit wrote the lines that a fix deleted.

A diff names deleted lines by their number in the old version and added lines by their number in the
new one, so an event maps every line of the new version either to the event itself or to a line of the
version before.  That map is piecewise a shift of line numbers: a list of segments, one or two for each
hunk.  Maps compose associatively, which lets the history of one file be cut into blocks:

1. diff lines travel once, to the block of their event, where consecutive numbers become runs;
2. every block of ``WIDTH`` commits of a file life composes its events' maps and answers the fixes in
   it, as far as the lines were written in the block; a line that is older is handed on with its number
   at the start of the block;
3. the blocks' composed maps are the events of the next level, whose blocks span ``WIDTH`` times more
   commits, until one block spans the history: log(commits) levels in base ``WIDTH``.

Lines older than the history, or of a version the history does not show whole, have no writer.  A task
holds the segments of one file version at a time, so a file that a third of all commits touch is
replayed by as many tasks as it has blocks.  Each level is written to the shared folder.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialise

# Ship the helpers by value: executors need numpy and pyarrow only, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Commits of a block at the first level, and blocks of a block above (a power of two).
WIDTH = 64
END = 1 << 60          # the last segment of a file is open: lines the diffs never reached
FILES_A_COMMIT = 1 << 24

# Segments are (lo, hi, writer, old): lines lo..hi-1 were written by ``writer``, or were the lines from
# ``old`` on at the start of the block; neither: unknown.
START = [(1, END, None, 1)]
LOST = [(1, END, None, None)]

EVENT, DELETED, ADDED, PENDING, SEGMENT, ANSWER = range(6)


def pieces(segments: list[tuple], lo: int, n: int) -> list[tuple]:
    """``(lo, n, writer, old)`` for the parts of lines ``lo .. lo+n-1``."""
    end, lo, out = lo + n, max(lo, 1), []
    at = bisect_right(segments, (lo, END + 1)) - 1
    while at < len(segments) and lo < end:
        start, stop, writer, old = segments[at]
        if stop > end:
            stop = end
        if stop > lo:
            out.append((lo, stop - lo, writer, None if old is None else old + lo - start))
            lo = stop
        at += 1
    return out


def _join(parts: list[tuple]) -> list[tuple]:
    """Segments from parts ``(n, writer, old)`` in line order; parts that continue each other are one."""
    out: list[tuple] = []
    lo, first, by, since = 1, 0, None, None     # the segment that is open: its first line, writer and old (0: none)
    for n, writer, old in parts:
        hi = lo + n
        if hi > END:
            hi = END
        if hi <= lo:
            continue
        if not first or by != writer or (old is not None if since is None else since + lo - first != old):
            if first:
                out.append((first, lo, by, since))
            first, by, since = lo, writer, old
        lo = hi
    if first:
        out.append((first, lo, by, since))
    return out


def advance(segments: list[tuple], deleted: list[tuple[int, int]], added: list[tuple[int, int]], writer: int) -> list[tuple]:
    """Segments after an event that deletes and adds runs ``(first line, lines)``, each list in order."""
    kept, lo = [], 1
    for start, n in [*deleted, (END, 0)]:
        if start > lo:
            kept += pieces(segments, lo, start - lo)
        if start + n > lo:
            lo = start + n

    parts, at, next_, left, by, old = [], 1, 0, 0, None, None   # at: next line of the new version; left: of a kept part
    for start, n in added:
        while at < start:
            if not left:
                if next_ == len(kept):
                    break
                _, left, by, old = kept[next_]
                next_ += 1
            m = min(left, start - at)
            parts.append((m, by, old))
            left -= m
            if old is not None:
                old += m
            at += m
        if at < start:                       # the diff reaches beyond the file
            parts.append((start - at, None, None))
        parts.append((n, writer, None))
        at = start + n
    if left:
        parts.append((left, by, old))
    parts += [part[1:] for part in kept[next_:]]
    return _join(parts)


def compose(outer: list[tuple], inner: list[tuple]) -> list[tuple]:
    """The map that follows ``outer`` to the start of its block and ``inner`` from there."""
    parts = []
    for lo, hi, writer, old in outer:
        if writer is not None or old is None:
            parts.append((hi - lo, writer, None))
        else:
            parts += [part[1:] for part in pieces(inner, old, hi - lo)]
    return _join(parts)


_COLUMNS = ["repo", "life", "at", "kind", "lo", "n", "flag", "writer", "old", "fix"]
_SCHEMA = "repo string, life string, at long, kind int, lo long, n long, flag int, writer long, old long, fix long"
RESET, GONE = 1, 2     # flags of an event: the file starts here, the file ends here


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _COLUMNS)


def _values(column: pa.Array) -> list:
    """``column.to_pylist()`` by way of numpy and of dictionaries, as value by value it costs more than the replay."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode(null_encoding="encode")
        return list(map(coded.dictionary.to_pylist().__getitem__, coded.indices.to_numpy(zero_copy_only=False).tolist()))
    values = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    if column.null_count:
        return [v if known else None for v, known in zip(values, column.is_valid().to_numpy(zero_copy_only=False).tolist())]
    return values


def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``batch`` (sorted) with consecutive and equal lines of an event's side as one row each."""
    lo, n, kind, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 3, 2))
    if len(lo) < 2:
        return batch
    line = (kind == DELETED) | (kind == ADDED)
    more = line[1:] & (kind[1:] == kind[:-1]) & (at[1:] == at[:-1]) & (lo[1:] <= lo[:-1] + 1) & (n[1:] == 1) & (n[:-1] == 1)
    for i in (0, 1):      # the same life, of the same repository
        coded = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        more &= coded[1:] == coded[:-1]
    if not more.any():
        return batch
    first = np.flatnonzero(np.concatenate(([True], ~more)))
    last = np.concatenate((first[1:], [len(lo)])) - 1
    n = np.where(line[first], lo[last] - lo[first] + 1, n[first])
    return batch.take(pa.array(first)).set_column(5, "n", pa.array(n, pa.int64()))


def _replay(shift: int):
    """One pass over blocks of ``at >> shift``: rows come sorted by (repo, life, at, kind, lo).

    Lines of an event's side come one by one; consecutive numbers become a run (repeats count once).
    ``at`` is the time of an event (first level) or of a child block; ``fix`` is the time of the fix an
    open line belongs to, and its ``lo`` is the line's number there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, segments, out = None, START, []
        now, deleted, added, flag, asked, child, copies = None, [], [], 0, False, [], 0

        def collect(side: list[tuple[int, int]], lo: int, n: int) -> None:
            if side and lo <= sum(side[-1]):
                side[-1] = (side[-1][0], max(lo + n, sum(side[-1])) - side[-1][0])
            else:
                side.append((lo, n))

        def answer(first: int, lo: int, n: int, fix: int) -> None:
            for at_line, m, writer, old in pieces(segments, lo, n):
                if writer is not None:
                    out.append((*block[:2], fix, ANSWER, first + at_line - lo, m, None, writer, None, fix))
                elif old is not None:
                    out.append((*block[:2], block[2], PENDING, first + at_line - lo, m, None, None, old, fix))

        def step() -> None:
            """Apply what was read of one event or child block."""
            nonlocal segments, deleted, added, flag, asked, child, now, copies
            if now is None:
                return
            if copies > 1:       # an event that is given twice brings its lines twice
                deleted, added = [r for r in deleted for _ in range(copies)], [r for r in added for _ in range(copies)]
            if child:
                segments = compose(child, segments)
            else:
                if asked:
                    for lo, n in deleted:
                        answer(lo, lo, n, now)
                writer = now // FILES_A_COMMIT
                if flag == GONE:
                    segments = LOST
                else:
                    segments = advance(LOST if flag == RESET else segments, [] if flag == RESET else deleted, added, writer)
            now, deleted, added, flag, asked, child, copies = None, [], [], 0, False, [], 0

        def close() -> None:
            nonlocal segments
            step()
            if block is not None:
                out.extend((*block, SEGMENT, lo, hi - lo, None, writer, old, None) for lo, hi, writer, old in segments)
            segments = START

        for batch in batches:
            for repo, life, at, kind, lo, n, mark, writer, old, fix in zip(*map(_values, runs(batch).columns)):
                if at != now or life != block[1] or repo != block[0]:
                    if block != (repo, life, at >> shift):
                        close()
                        block = (repo, life, at >> shift)
                    else:
                        step()
                if kind == PENDING:      # asked of the state before this child block
                    answer(lo, old, n, fix)
                    continue
                now = at
                if kind == EVENT:
                    flag, asked, copies = mark & 3, bool(mark & 4), copies + 1
                elif kind == DELETED:
                    collect(deleted, lo, n)
                elif kind == ADDED:
                    collect(added, lo, n)
                else:
                    child.append((lo, lo + n, writer, old))
            if len(out) > 20000:
                yield _batch(out)
                out.clear()
        close()
        if out:
            yield _batch(out)

    return run


def _level(rows: DataFrame, shift: int) -> DataFrame:
    placed = (rows.withColumn("block", F.shiftright("at", shift)).repartition("repo", "life", "block")
                  .sortWithinPartitions("repo", "life", "at", "kind", "lo").select(*_COLUMNS))
    return materialise(placed.mapInArrow(_replay(shift), _SCHEMA), "line-maps")


def blame_lines(fix_events: DataFrame, files: DataFrame, diff_lines: DataFrame, lives: DataFrame,
                width: int = WIDTH) -> DataFrame:
    """``(repo, commit_hash, idx, pos, life, lo, n, prev_idx)``: the lines ``lo .. lo+n-1`` that a fix event
    deleted and the position of the commit that wrote them.

    ``fix_events(repo, commit_hash, pos)`` selects the events to answer for; ``lives`` comes from
    ``lives.file_lives``, so a file follows its renames and a path that is added again starts anew.  Only
    lives in which a fix deletes a line are replayed.  Lines without a known writer give no row.
    """
    key = ["repo", "commit_hash", "pos"]
    at = (F.col("idx") * F.lit(FILES_A_COMMIT) + F.col("pos")).cast("long")
    asked = fix_events.select(*key).distinct().withColumn("asked", F.lit(4))
    touched = asked.join(diff_lines.where("side = 'deleted'").select(*key), key, "left_semi")
    touched = lives.join(touched, key, "left_semi").select("repo", "life").distinct()
    events = (files.select(*key, "idx", "change_type").join(lives.select(*key, "life"), key)
                   .join(touched, ["repo", "life"], "left_semi").join(asked, key, "left"))
    events = materialise(events.select("repo", "life", *key[1:], "idx", at.alias("at"), F.coalesce("asked", F.lit(0)).alias("asked"),
                                       F.when(F.col("change_type") == "ADD", RESET).when(F.col("change_type") == "DELETE", GONE)
                                        .otherwise(0).alias("flag")), "line-events")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    heads = events.select("repo", "life", "at", F.lit(EVENT).alias("kind"), zero.alias("lo"), zero.alias("n"),
                          F.col("flag").bitwiseOR(F.col("asked")).cast("int").alias("flag"),
                          none.alias("writer"), none.alias("old"), none.alias("fix"))
    lines = diff_lines.select(*key, "side", F.col("line_no").cast("long").alias("lo")).where("lo > 0")
    body = lines.join(events.select(*key, "life", "at"), key).select(
        "repo", "life", "at", F.when(F.col("side") == "deleted", DELETED).otherwise(ADDED).alias("kind"), "lo",
        F.lit(1).cast("long").alias("n"), F.lit(0).alias("flag"), none.alias("writer"), none.alias("old"), none.alias("fix"))
    step = width.bit_length() - 1
    shift, answers = FILES_A_COMMIT.bit_length() - 1 + step, []
    last = events.agg(F.max("at")).first()[0]
    level = _level(heads.unionByName(body), shift) if last is not None else heads.limit(0)
    answers.append(level.where(F.col("kind") == ANSWER))
    top = (last or 0) >> shift
    while top:
        level = _level(level.where(F.col("kind").isin(PENDING, SEGMENT)), step)
        answers.append(level.where(F.col("kind") == ANSWER))
        top >>= step
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    found = found.select("repo", "life", F.col("fix").alias("at"), "lo", "n", F.col("writer").alias("prev_idx"))
    return found.join(events.where("asked > 0").drop("flag", "asked"), ["repo", "life", "at"]).select(
        "repo", "commit_hash", "idx", "pos", "life", "lo", "n", "prev_idx")


def by_line(blamed: DataFrame) -> DataFrame:
    """One row per line: ``(repo, commit_hash, pos, life, line_no, prev_idx)``."""
    return blamed.select("repo", "commit_hash", "pos", "life", "prev_idx",
                         F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("n") - 1)).alias("line_no"))
