"""Steps that must not grow faster than their input: what is shuffled, parsed and sent to the driver."""

import tempfile

from pyspark.sql import functions as F

from faultline.operators import classify, versions
from faultline.session import materialise
from faultline.sources import binding

DOC = "- copy:\n    src: a{}\n"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrow_stored_rows_are_not_broadcast_by_file_size(spark):
    # 400,000 rows of run-length columns take next to no bytes of Parquet, but tens of MB in memory.
    axis = materialise(spark.range(400_000).select(F.lit("r").alias("repo"), "id", F.lit(1).alias("before")), "axis")
    joined = spark.range(10).join(axis, "id")
    assert "BroadcastHashJoin" not in plan_of(joined)
    assert joined.count() == 10
    small = spark.range(5).join(spark.range(400_000).groupBy((F.col("id") % 7).alias("id")).count(), "id")
    assert len(small.collect()) == 5 and "BroadcastHashJoin" in plan_of(small)   # by its measured size


def test_contents_are_parsed_once_each(spark, monkeypatch):
    stored = {}

    def record(df, name):
        out = materialise(df, name)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(classify, "materialise", record)
    rows = [("r", f"c{i}", 0, "MODIFY", "tasks/a.yml", DOC.format(i % 2), DOC.format((i + i // 10) % 2)) for i in range(20)]
    files = spark.createDataFrame(rows, "repo string, commit_hash string, pos int, change_type string, new_path string, "
                                        "content string, content_before string")
    got = {r.commit_hash: r.data_changed for r in classify.ansible_change_signals(files).collect()}
    assert got == {f"c{i}": i >= 10 for i in range(20)}
    assert stored["parsed"] == 2


def test_copies_of_contents_are_found_without_sorting(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(versions, "materialise", lambda df, name: plans.append(plan_of(df)) or df)
    files = spark.createDataFrame([("MODIFY", "a.yml", "x: 1"), ("ADD", "b.yml", "x: 1")],
                                  "change_type string, new_path string, content string")
    assert versions.version_table(files, lambda p, c: F.lit(True)).count() == 1
    assert "SortAggregate" not in plans[0]


def test_binding_shuffles_no_contents(spark, monkeypatch):
    stored = {}
    monkeypatch.setattr(binding, "materialise", lambda df, name: stored.setdefault(name, df) and materialise(df, name))
    folder = tempfile.mkdtemp(prefix="faultline-bind-")
    # One file of two commits: the second one changes what the first one added.  A line item without a part is file null.
    spark.sql("SELECT * FROM VALUES (0L, 1L, 'F', timestamp_ntz'1997-01-01'), (1L, 2L, 'F', timestamp_ntz'1997-01-02')"
              " AS t(o_orderkey, o_custkey, o_orderstatus, o_orderdate)").write.parquet(f"{folder}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (0L, 4L, 10L, 1, 3D, 0.01D), (1L, 4L, 3L, 2, 5D, 0.02D), (0L, NULL, 3L, 1, 3D, 0D), (1L, NULL, 3L, 1, 4D, 0D)"
              " AS t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount)").write.parquet(f"{folder}/lineitem.parquet")
    h = binding.bind(spark, folder)
    assert list(stored) == ["commits", "files"]
    exchanges = [line for line in plan_of(stored["files"]).splitlines() if "Exchange" in line]
    assert exchanges and not any("content" in line for line in exchanges)
    got = {(r.idx, r.pos): (r.change_type, r.content, r.content_before) for r in h.files.collect()}
    assert got[0, 4][0] == "ADD" and got[0, 4][2] is None
    assert got[1, 4][0] == "MODIFY" and got[1, 4][2] == got[0, 4][1] and "src: f3" in got[0, 4][1] and "src: f5" in got[1, 4][1]
    assert got[1, None] == ("MODIFY", "x = 4\n", None)


def test_bound_contents_are_made_by_code_that_is_compiled(spark, monkeypatch):
    # The JVM interprets methods of 8,000 bytes and more, and Spark does what janino refuses (-1 bytes).
    import re

    stored = {}
    monkeypatch.setattr(binding, "materialise", lambda df, name: stored.setdefault(name, df) and materialise(df, name))
    monkeypatch.setattr(binding, "prefix_aggs", lambda df, keys, order, specs: df.withColumns(
        {"ver": F.lit(0), "_prev": F.struct("idx", "change_type", "slot", "additions", "hunks")}))
    folder = tempfile.mkdtemp(prefix="faultline-bind-")
    spark.sql("SELECT 0L AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, timestamp_ntz'1997-01-01' AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    spark.sql("SELECT 0L AS l_orderkey, p AS l_partkey, 10L AS l_suppkey, 1 AS l_linenumber, 323D AS l_quantity, 0D AS l_discount"
              " FROM VALUES (4L), (6L) AS t(p)").write.parquet(f"{folder}/lineitem.parquet")
    h = binding.bind(spark, folder)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = stored["files"].select("*")
        code = spark._jvm.PythonSQLUtils.explainString(files._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", code)]
    assert sizes and all(0 < n < 8000 for n in sizes)
    got = {r.pos: r.content for r in h.files.collect()}     # 323 = 17 * 19: a tab, and a bracket or quote left open
    assert got[4].startswith("- name: t1\n  zfs:\n".replace("zfs", binding.MODULES[323 % 3 * 5 + 1]) + "    src: [f323\n\twhen: a == 1\n- name: e1\n")
    assert got[4].endswith("  when: b3 < 1 and b4 >= 2\n- hosts: w1\n\n\n".replace("  when", "\twhen"))
    assert "\n\tnode_templates" in got[6] and 'type: "my.nodes' in got[6] and "  t.N2: root" in got[6]


def test_steps_drop_their_shuffles_and_hash_small_partitions(spark):
    materialise(spark.range(10), "any")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    a = spark.range(3000).selectExpr("cast(id as string) AS k", "id AS a").repartition(3)
    b = spark.range(3000).selectExpr("cast(id as string) AS k", "id AS b").repartition(3)
    limit = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    was = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        joined = a.join(b, "k")
        assert len(joined.collect()) == 3000 and "ShuffledHashJoin" in plan_of(joined)
    finally:
        spark.conf.set(limit, was) if was else spark.conf.unset(limit)


def test_positions_in_one_bucket_are_shuffled_once(spark):
    from faultline.operators.ordered import prefix_agg, spans_one_bucket

    # Rows without a key or a position answer as they do with bucket totals.
    df = spark.range(60).selectExpr("CASE WHEN id % 5 > 0 THEN id % 3 END AS k", "CASE WHEN id % 7 > 0 THEN id DIV 4 END AS o", "id AS v")
    assert spans_one_bucket(df, "o") and not spans_one_bucket(df, "o", width=9) and spans_one_bucket(df.limit(0), "o")
    for how in ("sum", "min", "max"):
        for inclusive in (False, True):
            whole = prefix_agg(df, "k", "o", "v", how, "out", inclusive, whole=True)
            twice = prefix_agg(whole, "k", "o", "v", how, "more", inclusive, whole=True, placed=True)
            assert plan_of(twice).count("Exchange") == 1
            want = prefix_agg(df, "k", "o", "v", how, "out", inclusive)
            got = {r.v: (r.out, r.more) for r in twice.collect()}
            assert got == {r.v: (r.out, r.out) for r in want.collect()}, (how, inclusive)


def test_ranges_meet_points_without_shuffling_rows(spark):
    from faultline.operators.ordered import join_range

    points = [("r", i, f"c{i}") for i in range(0, 300, 2)] + [("r", 130, "again"), ("s", 5, "s5"), ("r", None, "none")]
    ranges = [("r", "a", 3, 290), ("r", "b", 128, 130), ("r", "c", 7, 6), ("s", "d", -70, 5), ("q", "e", 0, 9), ("r", "f", None, 4)]
    at = spark.createDataFrame(points, "repo string, idx long, hash string")
    df = spark.createDataFrame(ranges, "repo string, name string, lo long, hi long")
    made = join_range(df, F.col("lo"), F.col("hi"), at, "repo", "idx")
    want = sorted((r, n, i, h) for r, n, lo, hi in ranges if lo is not None for p, i, h in points if p == r and i is not None and lo <= i <= hi)
    assert sorted((r.repo, r.name, r.idx, r.hash) for r in made.collect()) == want
    plan = plan_of(made)
    assert plan.index("Generate") < plan.index("Exchange")     # the rows of the result are made above every shuffle


def test_lines_of_an_event_become_runs_in_its_block():
    import pyarrow as pa

    from faultline.operators.line_identity import ADDED, DELETED, EVENT, _batch, _COLUMNS, _replay, runs

    def line(at, kind, lo, life="f@0"):
        return ("r", life, at, kind, lo, 1, 0, None, None, None)

    rows = [("r", "f@0", 5, EVENT, 0, 0, 4, None, None, None), *[line(5, DELETED, n) for n in (2, 3, 3, 7)],
            *[line(5, ADDED, n) for n in (2, 8, 9)], line(6, ADDED, 10), line(6, ADDED, 11, "g@0")]
    got = [tuple(r.values()) for r in runs(_batch(rows)).to_pylist()]
    assert [(r[1], r[2], r[3], r[4], r[5]) for r in got] == [
        ("f@0", 5, EVENT, 0, 0), ("f@0", 5, DELETED, 2, 2), ("f@0", 5, DELETED, 7, 1), ("f@0", 5, ADDED, 2, 1), ("f@0", 5, ADDED, 8, 2),
        ("f@0", 6, ADDED, 10, 1), ("g@0", 6, ADDED, 11, 1)]
    # The same answers wherever a batch ends.
    first = [("r", "f@0", 0, EVENT, 0, 0, 1, None, None, None), *[line(0, ADDED, n) for n in range(1, 10)]]
    whole = [pa.Table.from_batches(_replay(40)(iter([_batch(first + rows)]))).to_pylist()]
    for cut in range(1, len(first + rows)):
        parts = [_batch((first + rows)[:cut]), _batch((first + rows)[cut:])]
        whole.append(pa.Table.from_batches(_replay(40)(iter(parts))).to_pylist())
    assert whole[0] and all(w == whole[0] for w in whole) and list(whole[0][0]) == _COLUMNS


def test_events_of_windows_are_joined_once(spark, monkeypatch):
    from faultline.operators import process
    from faultline.operators.snapshot import checkpoint_axis

    stored = []
    monkeypatch.setattr(process, "materialise", lambda df, name: stored.append(name) or materialise(df, name))
    files = spark.createDataFrame([("r", f"c{i}", i, 0, "MODIFY", "a", "a", i, 1, 1) for i in range(4)],
                                  "repo string, commit_hash string, idx long, pos int, change_type string, old_path string, "
                                  "new_path string, additions long, deletions long, hunks int")
    commits = spark.createDataFrame([("r", f"c{i}", i, "dev") for i in range(4)], "repo string, commit_hash string, idx long, author string")
    lives = files.selectExpr("repo", "commit_hash", "pos", "'a@-1' AS life")
    cps = spark.createDataFrame([("r", 1, 0), ("r", 3, 1)], "repo string, idx long, rel_no long")
    got = process.process_metrics(files, commits, checkpoint_axis(commits, cps), lives)
    assert stored == ["touched"]
    assert sorted((r.rel_no, r.commits_count, r.additions) for r in got.collect()) == [(0, 1, 1), (1, 3, 6)]


def test_deltas_take_the_greatest_path_of_the_row_before(spark):
    from faultline.plans.dataset import add_deltas

    rows = [("r", "l", 0, "a", 1), ("r", "l", 0, "b", 5), ("r", "l", 2, "b", 7), ("r", "l", 3, "b", None), ("r", "m", 1, "c", 2)]
    df = spark.createDataFrame(rows, "repo string, life string, rel_no long, filepath string, m long")
    out = add_deltas(df, ["m"], ["repo", "life"])
    assert out.columns == ["repo", "life", "rel_no", "filepath", "m", "delta_m"]
    assert plan_of(out).count("Exchange") == 1
    assert sorted((r.rel_no, r.filepath, r.delta_m) for r in out.where("life = 'l'").collect()) == [
        (0, "a", None), (0, "b", None), (2, "b", 2.0), (3, "b", -7.0)]


def test_slots_of_lives_without_a_fix_are_not_followed(spark):
    from faultline.operators.blame import blame

    lines = [("r", "c0", 0, 0, "added", 1), ("r", "c1", 1, 0, "deleted", 1), ("r", "c1", 1, 1, "deleted", 1), ("r", "c0", 0, 1, "added", 1)]
    diff = spark.createDataFrame(lines, "repo string, commit_hash string, idx long, pos int, side string, line_no int")
    lives = diff.selectExpr("repo", "commit_hash", "idx", "pos", "concat('f', pos) AS life")
    blamed = blame(spark.createDataFrame([("r", "c1", 0)], "repo string, commit_hash string, pos int"), diff, lives)
    assert [tuple(r) for r in blamed.collect()] == [("r", "c1", 0, "f0", 1, 0)]
    exchanges = [line for line in plan_of(blamed).split("== Initial Plan ==")[0].splitlines() if "Exchange hash" in line and "line_no" in line.split("(")[1]]
    assert len(exchanges) <= 1
