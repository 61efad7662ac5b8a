import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.operators.blame import oldest_inducing
from faultline.operators.line_identity import LOST, START, advance, blame_lines, by_line, compose, pieces
from faultline.operators.lives import file_lives

FILES = "repo string, commit_hash string, idx long, pos int, change_type string, old_path string, new_path string"
LINES = "repo string, commit_hash string, idx long, pos int, side string, line_no int"


def apply(lines, deleted, added, writer):
    """The writers of a version's lines after an event, line by line."""
    kept = [w for i, w in enumerate(lines, 1) if i not in deleted]
    out = []
    for j in range(1, len(kept) + len(added) + 1):
        out.append(writer if j in added else kept.pop(0))
    return out


def as_runs(lines):
    out = []
    for n in sorted(lines):
        if out and out[-1][0] + out[-1][1] == n:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((n, 1))
    return out


def random_event(rng, length):
    deleted = set(rng.sample(range(1, length + 1), rng.randint(0, min(3, length))))
    new = length - len(deleted)
    added = set()
    for _ in range(rng.randint(0, 4)):
        added.add(rng.randint(1, new + len(added) + 1))
    # line numbers of the new version must be reachable: each within kept lines plus added ones before it
    added = {n for i, n in enumerate(sorted(added)) if n <= new + i + 1}
    return deleted, added


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 6))
def test_maps_equal_a_replay_and_compose(seed):
    rng = random.Random(seed)
    length = rng.randint(1, 12)
    lines = [-i for i in range(1, length + 1)]        # -i: line i of the version before history
    whole, blocks, block = START, [], START
    for writer in range(100, 100 + rng.randint(1, 12)):
        deleted, added = random_event(rng, len(lines))
        lines = apply(lines, deleted, added, writer)
        whole = advance(whole, as_runs(deleted), as_runs(added), writer)
        block = advance(block, as_runs(deleted), as_runs(added), writer)
        if rng.random() < 0.4:
            blocks.append(block)
            block = START
    composed = START
    for b in [*blocks, block]:
        composed = compose(b, composed)

    def read(segments):
        return [w if w is not None else -old for lo, n, w, old in pieces(segments, 1, len(lines)) for w, old in
                [(w, None if old is None else old + k) for k in range(n)]]

    assert read(whole) == read(composed) == lines


def test_lines_out_of_range():
    assert list(pieces(LOST, 0, 3)) == [(1, 2, None, None)]
    assert advance(LOST, [], [(1, 2), (5, 1)], 7)[:3] == [(1, 3, 7, None), (3, 5, None, None), (5, 6, 7, None)]


def story(rng, repo, commits, paths):
    """Random history of several files with renames, deletions and names that come back, with the
    expected writer of every line a commit deletes."""
    files, diff, want, alive = [], [], [], {}
    for p in paths:
        alive[p] = [None, None]                       # before the history: lines unknown, their number too
    for idx in range(commits):
        commit = f"{repo}c{idx}"
        for pos, path in enumerate(sorted(alive) if rng.random() < 0.7 else []):
            lines = alive[path][1]
            kind = rng.choice(["MODIFY"] * 6 + ["RENAME", "DELETE", "ADD"])
            if kind == "ADD":
                if lines is not None and alive[path][0] != "gone":
                    continue
                n = rng.randint(0, 9)
                files.append((repo, commit, idx, pos, "ADD", None, path))
                diff += [(repo, commit, idx, pos, "added", i) for i in range(1, n + 1)]
                alive[path] = ["here", [idx] * n]
                continue
            if alive[path][0] == "gone":
                continue
            known = lines is not None
            length = len(lines) if known else 15
            if kind == "DELETE":
                files.append((repo, commit, idx, pos, "DELETE", path, None))
                diff += [(repo, commit, idx, pos, "deleted", i) for i in range(1, length + 1)]
                if known:
                    want += [(commit, pos, i, w) for i, w in enumerate(lines, 1) if w is not None]
                alive[path] = ["gone", []]
                continue
            if not known:
                lines = [None] * 60                   # unknown lines, far more than any event reaches
            deleted, added = random_event(rng, length)
            diff += [(repo, commit, idx, pos, "deleted", i) for i in deleted] + [(repo, commit, idx, pos, "added", i) for i in added]
            want += [(commit, pos, i, lines[i - 1]) for i in deleted if lines[i - 1] is not None]
            alive[path] = ["here", apply(lines, deleted, added, idx)]
            if kind == "RENAME" and path + "x" not in alive:
                files.append((repo, commit, idx, pos, "RENAME", path, path + "x"))
                alive[path + "x"] = alive.pop(path)
            else:
                files.append((repo, commit, idx, pos, "MODIFY", path, path))
    return files, diff, want


@pytest.mark.parametrize("width", [2, 8, 64])
def test_blame_equals_a_replay(spark, width):
    rng = random.Random(11)
    files, diff, want = [], [], []
    for repo, commits in (("r", 90), ("s", 40)):
        f, d, w = story(rng, repo, commits, ["a", "b", "c"])
        files, diff, want = files + f, diff + d, want + [(repo, *x) for x in w]
    events = spark.createDataFrame(files, FILES)
    changes = events.where("change_type IN ('MODIFY', 'RENAME', 'DELETE')").select("repo", "commit_hash", "pos")
    blamed = blame_lines(changes, events, spark.createDataFrame(diff, LINES).union(spark.createDataFrame(diff[:50], LINES)),
                         file_lives(events), width)
    got = sorted((r.repo, r.commit_hash, r.pos, r.line_no, r.prev_idx) for r in by_line(blamed).collect())
    assert got == sorted(want)


def test_only_lives_of_fixes_are_replayed(spark):
    files = [("r", "c0", 0, 0, "ADD", None, "a.yml"), ("r", "c1", 1, 0, "MODIFY", "a.yml", "a.yml"),
             ("r", "c2", 2, 0, "RENAME", "a.yml", "b.yml"), ("r", "c3", 3, 0, "MODIFY", "b.yml", "b.yml"),
             ("r", "c3", 3, 1, "MODIFY", "z.yml", "z.yml")]
    diff = [("r", "c0", 0, 0, "added", i) for i in (1, 2, 3)] + [
        ("r", "c1", 1, 0, "deleted", 2), ("r", "c1", 1, 0, "added", 2), ("r", "c2", 2, 0, "added", 1),
        ("r", "c3", 3, 0, "deleted", 3), ("r", "c3", 3, 0, "deleted", 4), ("r", "c3", 3, 1, "deleted", 1)]
    events, lines = spark.createDataFrame(files, FILES), spark.createDataFrame(diff, LINES)
    fix = spark.createDataFrame([("r", "c3", 0)], "repo string, commit_hash string, pos int")
    blamed = blame_lines(fix, events, lines, file_lives(events))
    assert sorted((r.commit_hash, r.lo, r.n, r.prev_idx) for r in blamed.collect()) == [("c3", 3, 1, 1), ("c3", 4, 1, 0)]
    commits = spark.createDataFrame([("r", f"c{i}", i) for i in range(4)], "repo string, commit_hash string, idx long")
    assert [(r.commit_hash, r.bic) for r in oldest_inducing(blamed, commits).collect()] == [("c3", "c0")]
    none = blame_lines(fix.where("pos = 9"), events, lines, file_lives(events))
    assert none.count() == 0
    assert blame_lines(fix, events.limit(0), lines.limit(0), file_lives(events.limit(0))).count() == 0


def test_a_long_life_is_split_over_tasks(spark):
    """One file, changed by each of 5,000 commits: the first level has a block for every 64 of them."""
    n = 5000
    files = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("c"), "id").alias("commit_hash"), F.col("id").alias("idx"),
                                  F.lit(0).alias("pos"), F.when(F.col("id") == 0, "ADD").otherwise("MODIFY").alias("change_type"),
                                  F.lit("f").alias("old_path"), F.lit("f").alias("new_path"))
    # The first commit writes 10 lines; each later one adds a line at the top and deletes the last but 9th line but for the newest.
    added = files.select("repo", "commit_hash", "idx", "pos", F.lit("added").alias("side"),
                         F.explode(F.when(F.col("idx") == 0, F.sequence(F.lit(1), F.lit(10))).otherwise(F.array(F.lit(1)))).alias("line_no"))
    deleted = files.where("idx = 4999").select("repo", "commit_hash", "idx", "pos", F.lit("deleted").alias("side"),
                                               F.explode(F.array(F.lit(1), F.lit(4000), F.lit(4998), F.lit(4999), F.lit(5008))).alias("line_no"))
    fix = files.where("idx = 4999").select("repo", "commit_hash", "pos")
    got = by_line(blame_lines(fix, files, added.union(deleted), file_lives(files))).collect()
    assert sorted((r.line_no, r.prev_idx) for r in got) == [(1, 4998), (4000, 999), (4998, 1), (4999, 0), (5008, 0)]


def test_batches_are_read_as_value_by_value():
    import pyarrow as pa

    from faultline.operators.line_identity import _values

    for column in (pa.array([1, None, 1 << 60, -5]), pa.array([None, None], pa.int64()), pa.array(["a", None, "a", ""]),
                   pa.array([], pa.string()), pa.array([3, 4], pa.int32()), pa.array(["b", "a", "b"]).slice(1)):
        assert _values(column) == column.to_pylist()
        assert all(v is None or type(v) in (int, str) for v in _values(column))
