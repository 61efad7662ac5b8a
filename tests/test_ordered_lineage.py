import random

from pyspark.sql import functions as F

from faultline.operators.lineage import components
from faultline.operators.ordered import ordered_index, prefix_agg


def _brute(data, how, inclusive):
    out = []
    for k, o, v in data:
        prev = [w for kk, oo, w in data if kk == k and (oo <= o if inclusive else oo < o) and w is not None]
        if how == "sum":
            out.append(sum(prev))
        else:
            out.append((min if how == "min" else max)(prev) if prev else None)
    return out


def test_prefix_agg_matches_brute_force(spark):
    rnd = random.Random(7)
    data = [(rnd.randint(0, 2), rnd.randint(0, 40), rnd.choice([None, rnd.randint(-5, 9)])) for _ in range(120)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "id long, k long, o long, v long")
    for how in ("sum", "min", "max"):
        for inclusive in (False, True):
            got = prefix_agg(df, "k", "o", "v", how, "out", inclusive=inclusive, width=4)
            got = [r.out for r in got.orderBy("id").collect()]
            assert got == _brute(data, how, inclusive), (how, inclusive)


def test_ordered_index_is_row_number(spark):
    rnd = random.Random(3)
    data = [(i, rnd.randint(0, 1), rnd.randint(0, 50)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, k long, o long")
    got = ordered_index(df, "k", F.floor(F.col("o") / 7), [F.col("o"), F.col("id")])
    got = {r.id: r.idx for r in got.collect()}
    for k in (0, 1):
        rows = sorted((o, i) for i, kk, o in data if kk == k)
        for pos, (_, i) in enumerate(rows):
            assert got[i] == pos


def test_rename_components(spark):
    edges = spark.createDataFrame([("r", "b", "c"), ("r", "a", "b"), ("r", "x", "y"), ("q", "c", "a"),
                                   ("r", "e", "d"), ("r", "c", "d")], "repo string, src string, dst string")
    got = {(r.repo, r.node): r.label for r in components(edges).collect()}
    assert got == {("r", n): "a" for n in "abcde"} | {("r", "x"): "x", ("r", "y"): "x",
                                                         ("q", "a"): "a", ("q", "c"): "a"}


def test_prefix_aggs_many_specs_one_pass(spark):
    from faultline.operators.ordered import prefix_aggs
    rnd = random.Random(5)
    data = [(rnd.randint(0, 2), rnd.randint(0, 30), rnd.choice([None, rnd.randint(-5, 9)])) for _ in range(90)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "id long, k long, o long, v long")
    specs = [("v", "sum", "s_in", True), ("v", "min", "mn_ex", False), ("v", "max", "mx_in", True)]
    got = prefix_aggs(df, "k", "o", specs, width=4).orderBy("id").collect()
    for col, (_, how, _, inc) in zip(["s_in", "mn_ex", "mx_in"], specs):
        assert [r[col] for r in got] == _brute(data, how, inc), col


def test_components_match_union_find(spark):
    rnd = random.Random(17)
    for trial in range(3):
        edges = [(rnd.choice("rq"), f"n{rnd.randint(0, 24):02d}", f"n{rnd.randint(0, 24):02d}") for _ in range(30)]
        edges = [e for e in edges if e[1] != e[2]]
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for repo, a, b in edges:
            ra, rb = find((repo, a)), find((repo, b))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        want = {}
        for node in list(parent):
            want[node] = min(n for n in parent if find(n) == find(node))[1]
        df = spark.createDataFrame(edges, "repo string, src string, dst string")
        got = {(r.repo, r.node): r.label for r in components(df).collect()}
        assert got == want, trial


def test_blame_matches_brute_force(spark):
    from faultline.operators.blame import blame
    rnd = random.Random(23)
    rows, fixes = [], set()
    for i in range(80):
        path = rnd.choice(["a.yml", "b.yml"])
        side = rnd.choice(["added", "deleted"])
        rows.append(("r", f"c{i}", i, 0, path, side, rnd.randint(0, 4)))
        if side == "deleted" and rnd.random() < 0.5:
            fixes.add(f"c{i}")
    diff = spark.createDataFrame(rows, "repo string, commit_hash string, idx long, pos int, path string, side string, "
                                       "line_no int")
    lives = spark.createDataFrame([r[:2] + (r[3], r[4]) for r in rows],
                                  "repo string, commit_hash string, pos int, life string")
    fx = spark.createDataFrame([("r", c, 0) for c in sorted(fixes)], "repo string, commit_hash string, pos int")
    got = sorted((r.commit_hash, r.line_no, r.prev_idx) for r in blame(fx, diff, lives).collect())
    want = []
    for _, c, i, _, path, side, line in rows:
        if c in fixes and side == "deleted":
            prev = [j for _, _, j, _, p2, _, l2 in rows if p2 == path and l2 == line and j < i]
            want.append((c, line, max(prev) if prev else None))
    assert got == sorted(want)


def test_components_of_meeting_chains(spark):
    """Two chains that end in the same name, the older one short: few rounds for any length."""
    from faultline.operators import lineage
    for length in (20, 200):
        a = [f"a{i:04d}" for i in range(length)] + ["end"]
        b = [f"b{i}" for i in range(5)] + ["end"]
        pairs = [("r", x, y) for c in (a, b) for x, y in zip(c, c[1:])]
        rank = {n: 1000 + i for i, n in enumerate(a)} | {n: i for i, n in enumerate(b)}
        df = spark.createDataFrame(pairs, "repo string, src string, dst string")
        seen = spark.createDataFrame([("r", n, i) for n, i in rank.items()], "repo string, node string, rank long")
        got = {r.node: r.label for r in lineage.components(df, rank=seen).collect()}
        assert got == {n: "b0" for n in (*a, *b)} and lineage.LAST_ROUNDS[0] < 15
