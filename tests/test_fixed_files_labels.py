import random

from pyspark.sql import functions as F

from faultline.operators.fixed_files import merge_by_path, merge_with_renames
from faultline.operators.labels import failure_prone
from faultline.operators.lineage import path_lineage

FILES_SCHEMA = ("repo string, commit_hash string, idx long, pos int, change_type string, old_path string, "
                "new_path string")


def _run_all(spark, histories):
    """Merged intervals of several histories in one job, each its own repository."""
    repos = [(f"r{h}", events) for h, events in enumerate(histories)]
    files = spark.createDataFrame([(r, f"c{i}", i, p, ct, old, new) for r, events in repos
                                   for i, p, ct, old, new, _ in events], FILES_SCHEMA)
    lin = path_lineage(files)
    fix_rows = [(r, i, p, ct, old, new, bic) for r, events in repos for i, p, ct, old, new, bic in events
                if bic is not None]
    fixes = (spark.createDataFrame(fix_rows, "repo string, idx long, pos int, change_type string, old_path string, "
                                             "new_path string, bic_idx long")
                  .join(lin.withColumnRenamed("path", "new_path"), ["repo", "new_path"]))
    span = [(r, min(f[1] for f in fix_rows if f[0] == r), max(f[1] for f in fix_rows if f[0] == r)) for r, _ in repos]
    rng = spark.createDataFrame(span, "repo string, lo long, hi long")
    got = merge_with_renames(fixes, files, lin, rng).collect()
    merged = [sorted((g.filepath, g.fic_idx, g.bic_idx) for g in got if g.repo == r) for r, _ in repos]
    return merged, [hi for _, _, hi in span], files


def test_golden_history(spark):
    # Positions 0..19; a rename at 18; fixes at 7, 12 and 19 (FIXTURES.md, golden mini-history).
    events = [(i, 0, "MODIFY", "tasks/other.yml", "tasks/other.yml", None) for i in range(20)]
    events += [(18, 1, "RENAME", "tasks/task2.yml", "tasks/task2-renamed.yml", None),
               (19, 1, "MODIFY", "tasks/task2-renamed.yml", "tasks/task2-renamed.yml", 13),
               (12, 1, "MODIFY", "tasks/task2.yml", "tasks/task2.yml", 8),
               (7, 1, "MODIFY", "tasks/task1.yml", "tasks/task1.yml", 2)]
    (got,), (hi,), files = _run_all(spark, [events])
    assert got == [("tasks/task1.yml", 7, 2), ("tasks/task2-renamed.yml", 19, 13), ("tasks/task2.yml", 12, 8)]

    fixed = spark.createDataFrame([("r0", fp, fic, bic) for fp, fic, bic in got],
                                  "repo string, filepath string, fic_idx long, bic_idx long")
    commits = spark.createDataFrame([("r0", f"c{i}", i) for i in range(20)], "repo string, commit_hash string, idx long")
    prone = failure_prone(fixed, files, commits, spark.createDataFrame([("r0", hi)], "repo string, hi long"))
    rows = sorted((r.filepath, r.idx, r.fixing_commit) for r in prone.collect())
    expected = ([("tasks/task2-renamed.yml", 18, "c19")] + [("tasks/task2.yml", i, "c19") for i in range(13, 18)]
                + [("tasks/task2.yml", i, "c12") for i in range(8, 12)] + [("tasks/task1.yml", i, "c7") for i in range(2, 7)])
    assert rows == sorted(expected)


def _random_history(rnd):
    names = ["a.yml", "b.yml", "c.yml", "d.yml", "e.yml"]
    events = []
    for i in range(rnd.randint(8, 25)):
        for pos in range(rnd.randint(1, 2)):
            if rnd.random() < 0.3:
                old, new = rnd.sample(names, 2)
                ct = "RENAME"
            else:
                old = new = rnd.choice(names)
                ct = "MODIFY"
            bic = rnd.randint(0, i - 1) if i > 0 and rnd.random() < 0.5 else None
            events.append((i, pos, ct, old, new, bic))
    return events


def _fix(idx, path, bic):
    return (idx, 0, "MODIFY", path, path, bic)


def _rename(idx, old, new):
    return (idx, 0, "RENAME", old, new, None)


STORIES = [
    # overlapping fixes become one interval from the newest fix back to the oldest cause
    ([_fix(9, "a", 4), _fix(7, "a", 2)], [("a", 9, 2)]),
    # a fix older than the newest interval opens its own; such older ones never join each other
    ([_fix(9, "a", 6), _fix(5, "a", 3), _fix(4, "a", 1)], [("a", 4, 1), ("a", 5, 3), ("a", 9, 6)]),
    # a fix before the rename counts for the name the file has later
    ([_fix(9, "b", 5), _rename(8, "a", "b"), _fix(6, "a", 2)], [("b", 9, 2)]),
    # once a fix fell outside, the old name is on its own
    ([_fix(9, "b", 7), _rename(8, "a", "b"), _fix(5, "a", 3), _fix(4, "a", 1)], [("a", 5, 1), ("b", 9, 7)]),
    # two renames in a row
    ([_fix(12, "c", 3), _rename(10, "b", "c"), _rename(6, "a", "b"), _fix(5, "a", 1)], [("c", 12, 1)]),
    # files without a common name do not meet
    ([_fix(9, "a", 2), _fix(8, "z", 1)], [("a", 9, 2), ("z", 8, 1)]),
    # two files that ended under one name feed one interval, and one of them leaves it at its gap
    ([_fix(20, "c", 15), _rename(18, "a", "c"), _rename(17, "b", "c"), _fix(16, "a", 9), _fix(12, "b", 10),
      _fix(5, "b", 2), _fix(4, "a", 3), _fix(3, "b", 1)], [("a", 4, 3), ("b", 5, 1), ("c", 20, 9)]),
    # a name given away and used again: its old file falls out of the newer name's interval one by one
    ([_fix(20, "a", 19), _rename(15, "a", "b"), _fix(14, "b", 12), _fix(10, "a", 7), _fix(8, "a", 6)],
     [("a", 8, 6), ("a", 10, 7), ("a", 20, 19), ("b", 14, 12)]),
]


def test_w1_stories(spark):
    assert _run_all(spark, [events for events, _ in STORIES])[0] == [want for _, want in STORIES]


def test_w1_properties_on_random_histories(spark):
    histories = [_random_history(random.Random(seed)) for seed in range(20)]
    histories = [events for events in histories if any(e[5] is not None for e in events)]
    for events, got in zip(histories, _run_all(spark, histories)[0]):
        fixes = [e for e in events if e[5] is not None]
        assert 0 < len(got) <= len(fixes)
        assert {f[1] for f in got} <= {e[0] for e in fixes} and {f[2] for f in got} <= {e[5] for e in fixes}
        assert max(f[1] for f in got) == max(e[0] for e in fixes)
        assert min(f[2] for f in got) == min(e[5] for e in fixes)


def test_w1_is_w2_without_renames(spark):
    rnd = random.Random(11)
    events = [_fix(i, rnd.choice(["a.yml", "b.yml"]), rnd.randint(0, i - 1)) for i in range(1, 60)]
    fixes = spark.createDataFrame([("r", new, i, bic) for i, _, _, _, new, bic in events],
                                  "repo string, filepath string, fic_idx long, bic_idx long")
    got = sorted((r.filepath, r.fic_idx, r.bic_idx) for r in merge_by_path(fixes).collect())
    assert got == _run_all(spark, [events])[0][0]
