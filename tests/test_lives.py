import random

from faultline.operators import lives
from faultline.operators.process import process_metrics
from faultline.operators.snapshot import checkpoint_axis

SCHEMA = ("repo string, commit_hash string, idx long, pos int, change_type string, old_path string, new_path string, "
          "additions long, deletions long, hunks int")


def _files(spark, events):
    return spark.createDataFrame([(r, f"{r}-{i}", i, p, ct, old, new, add, 0, 1)
                                  for r, i, p, ct, old, new, add in events], SCHEMA)


def _expected(events):
    """Walk each repository in time: a living path maps to its life."""
    now, out = {}, {}
    for r, i, p, ct, old, new, _ in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        path = new or old
        if ct == "ADD":
            now[r, path] = f"{path}@{i}"
        elif ct == "RENAME":
            now[r, path] = now.get((r, old), f"{old}@-1")
        out[r, i, p] = now.setdefault((r, path), f"{path}@-1")
    return out


def test_lives_match_a_walk_in_time(spark):
    rnd = random.Random(3)
    events = []
    for k in range(12):  # versions renamed on, deletions, paths added again
        version = {c: 0 for c in "abc"}
        for i in range(30):
            for p, c in enumerate("abc"):
                name = f"{c}{version[c]}"
                ct = rnd.choice(["ADD", "MODIFY", "MODIFY", "DELETE", "RENAME"])
                if ct == "RENAME":
                    version[c] = (version[c] + 1) % 4  # names come back
                    events.append((f"r{k}", i, p, ct, name, f"{c}{version[c]}", 1))
                else:
                    events.append((f"r{k}", i, p, ct, None if ct == "ADD" else name, None if ct == "DELETE" else name, 1))
    chain = [("long", 0, 0, "ADD", None, "n0", 1)]
    chain += [("long", i, 0, "RENAME", f"n{i - 1}", f"n{i}", 1) for i in range(1, 201)]
    events += chain
    got = {(r.repo, r.idx, r.pos): r.life for r in lives.file_lives(_files(spark, events)).collect()}
    assert got == _expected(events) and got["long", 200, 0] == "n0@0"
    assert lives.LAST_ROUNDS[0] < 15


def test_a_name_used_again_has_its_own_process_metrics(spark):
    files = _files(spark, [("r", 0, 0, "ADD", None, "a", 100), ("r", 1, 0, "RENAME", "a", "b", 6),
                           ("r", 2, 0, "ADD", None, "a", 8), ("r", 3, 0, "MODIFY", "b", "b", 2)])
    commits = spark.createDataFrame([("r", f"r-{i}", i, "dev") for i in range(4)],
                                    "repo string, commit_hash string, idx long, author string")
    cps = spark.createDataFrame([("r", 0, 0), ("r", 3, 1)], "repo string, idx long, rel_no long")
    got = process_metrics(files, commits, checkpoint_axis(commits, cps), lives.file_lives(files)).filter("rel_no = 1")
    assert sorted((r.life, r.filepath, r.additions, r.commits_count) for r in got.collect()) == [
        ("a@0", "b", 108, 3), ("a@2", "a", 8, 1)]


def test_every_metric_and_delta_varies(spark):
    from conftest import SF001
    from faultline.plans import queries

    from pyspark.sql import functions as F
    for q in (queries.q_prod_ansible, queries.q_prod_tosca, queries.q_dataset_process_delta, queries.q_dataset_tosca):
        df = q(spark, SF001)
        cols = [c for c, t in df.dtypes if t in ("bigint", "double") and c not in ("pos", "failure_prone")]
        values = df.agg(*[F.countDistinct(c).alias(c) for c in cols]).first().asDict()
        few = {"minor_contributors_count": 2}  # a window of 25 commits has no or one such author
        assert not {c: n for c, n in values.items() if n < few.get(c, 3)}
