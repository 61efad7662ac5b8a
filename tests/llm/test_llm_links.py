"""Operators on pairs, links and order: neighbours (1), URL aliases (4), WARC (6), fingerprints (7), SimHash (10)."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import (ann_forest, components, compression_quality, entry, mixing, ordering, simhash_pivots, url_aliases,
                           warc_archive, weighted_fingerprints)
from conftest import SF001


def groups(pairs, nodes):
    top = {n: n for n in nodes}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_row_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)] + [(None, "y"), (3, "x")], "k long, row_number string")
    got = ordering.row_numbers(df, [F.col("k").asc_nulls_first()], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(52))
    assert [r.k for r in got] == [None, *sorted([*range(50), 3])]


@pytest.mark.parametrize("seed", [0])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)]
    pairs += [(i, i + 1) for i in range(1000, 1100)] + [(i, 5000) for i in range(5001, 5200)] + [(7, 7)]
    df = spark.createDataFrame([*pairs, (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df, "a", "b").collect()}
    assert got == groups([p for p in pairs if p[0] != p[1]], {n for p in pairs if p[0] != p[1] for n in p})


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


# ---------------------------------------------------------------------------------------- 1
def vectors(spark, n=400, dim=16):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dim))
    x[50:120] = x[50] + 1e-4 * rng.standard_normal((70, dim))   # one crowded place
    x[200:210] = x[200]                                          # equal vectors: ties
    rows = [(i, v.tolist(), "s", 1.0) for i, v in enumerate(x)]
    rows += [(5000, None, "s", 1.0), (5001, [0.0] * dim, "s", 1.0), (5002, [float("nan")] * dim, "s", 1.0),
             (5003, [float("inf")] + [0.0] * (dim - 1), "s", 1.0), (5004, [], "s", 1.0), (None, [1.0] * dim, "s", 1.0),
             (5005, [None] + [1.0] * (dim - 1), "s", 1.0), (7, x[7].tolist(), "s", 1.0), (5006, [1.0, 2.0], "s", 1.0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank double")


def test_ann_whole_share_is_exact(spark):
    x, df = vectors(spark)
    got = ann_forest.search(df, df.where("vec_id % 10 = 0"), share=1.0).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 400, 10):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        s = np.array([sum(u[q] * v) for v in u])
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[1] for m in mine] == order
        assert np.allclose([m[2] for m in mine], s[order])


def test_ann_recall(spark):
    x, df = vectors(spark, 3000, 32)
    got = ann_forest.search(df, df.where("vec_id % 50 = 0"), least=16).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = []
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        if not 50 <= q < 120:
            hits.append(len(set(np.argsort(-s)[:5]) & {r.vec_id for r in got if r.query_id == q}) / 5)
    assert np.mean(hits) >= 0.9


def test_ann_small(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0])], "vec_id int, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann_forest.search(df, df).collect()]
    assert sorted(got) == [(0, 1, 1), (1, 1, 0)]
    assert ann_forest.search(df.limit(0), df.limit(0)).count() == 0


# ---------------------------------------------------------------------------------------- 4
PAGES = [
    (0, "https://A.Example.NET/en/x?q=1#f", None), (1, "http://b.example.net/de/", ""), (2, "http://example.com/de/a", "x"),
    (3, "http://example.org/de/a", '<link rel="canonical" href="http://www.example.com/de/1">'),
    (4, "http://example.org/fr/a", '<LINK href=http://www.example.com/de/1 rel=canonical>'),
    (5, "http://example.org/de/b", '<meta http-equiv="refresh" content="0; url=/de/a">'),
    (6, "http://badexample.com/de/a", None), (7, "http://net", None), (8, "no scheme", None), (9, None, None),
    (10, "http://example.org/en/x", '<link rel="canonical" href="http://example.org/en/y">'), (10, "http://example.org/en/x", None),
    (None, "http://x.example.com/de/q?a=http://z.net/", None), (11, "http://u.example.org", "<p>" + "y" * 200000)]
JUDGED = {0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("b.example.net", "/de/", "net/", "block"),
          2: ("example.com", "/de/a", "example.com/de/", "block"), 3: ("example.org", "/de/a", None, "block"),
          4: ("example.org", "/fr/a", "org/fr/", "allow"), 5: ("example.org", "/de/b", None, "block"),
          6: ("badexample.com", "/de/a", None, "allow"), 7: ("net", "", None, "allow"), 8: ("", "", None, "allow"),
          9: ("", "", None, "allow"), 10: ("example.org", "/en/x", None, "allow"), 11: ("u.example.org", "", None, "allow"),
          None: ("x.example.com", "/de/q", "example.com/de/", "block")}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "v", "h") for p in PAGES], "page_id long, url string, html string, verdict string, host string")


def test_url_aliases(pages, spark):
    got = url_aliases.judge(pages, entry.RULES).collect()
    assert len(got) == len(PAGES)
    assert all((r.host, r.path, r.rule, r.verdict) == JUDGED[r.page_id] for r in got)
    assert {r.page_id for r in got if r.inherited} == {3, 5}
    moved = spark.createDataFrame([("http://u.example.org", "http://b.example.net/de/"), (None, "x")], "src_url string, dst_url string")
    assert {r.page_id for r in url_aliases.judge(pages, entry.RULES, moved).collect() if r.inherited} == {3, 5, 11}
    assert url_aliases.judge(pages.limit(0), entry.RULES).count() == 0


LINKS = [("http://a.example.com/fr/1", '<link rel="canonical" href="../de/1">', "http://a.example.com/de/1"),
         ("http://e.org/a/b?x=1", "<link rel=canonical href=index.html>", "http://e.org/a/index.html"),
         ("http://e.org/a/c?x=1", '<link rel="canonical" href="?p=1&amp;q=2&copy=3&#x41;&#228;">', "http://e.org/a/c?p=1&q=2&copy=3Aä"),
         ("http://e.org", "<link rel='canonical' href='x?u=http://z.net/'>", "http://e.org/x?u=http://z.net/"),
         ("http://e.org/a/d", '<link rel="canonical" href="./../../..//y/./z/..">', "http://e.org//y/"),
         ("http://e.org/r1", '<meta http-equiv="refresh" content="0; url=/p;v=1?a=b;c#top">', "http://e.org/p;v=1?a=b;c"),
         ("http://e.org/r2", """<meta http-equiv=refresh content="0;URL='s t'">""", "http://e.org/s t"),
         ("http://e.org/r3", '<base href="/deep/er/"><meta http-equiv="refresh" content="0; url=../n">', "http://e.org/deep/n"),
         ("http://e.org/x/../y", None, "http://e.org/y"),
         ("http://e.org/w", '<link rel="canonical" href="/w&rarr;&uArr;x">', "http://e.org/w→⇑x"),
         ("http://e.org/m", '<link rel="canonical" href="mailto:a@b">', None), ("http://e.org/n", "<link rel=canonical href=#top>", None)]


def test_links_resolve(spark):
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(LINKS)], "page_id long, url string, html string")
    got = {r.src: r.dst for r in url_aliases.page_links(df).collect()}
    assert got == {u if u.count("/") > 2 else u + "/": want for u, _, want in LINKS if want}
    judged = {r.page_id: (r.verdict, r.inherited) for r in url_aliases.judge(df, entry.RULES).collect()}
    assert judged[0] == ("block", True) and judged[1] == ("allow", False)


def test_every_link_of_a_page_counts(spark):
    html = ('<link rel="canonical" href="/a"><link rel="canonical" href="/b"><meta http-equiv=refresh content="0;url=/c">'
            '<meta http-equiv="refresh" content="5; url=http://x.example.com/de/z">')
    df = spark.createDataFrame([(1, "http://e.org/p", html), (2, "http://e.org/b", None)], "page_id long, url string, html string")
    assert {r.dst for r in url_aliases.page_links(df).collect()} == {
        "http://e.org/a", "http://e.org/b", "http://e.org/c", "http://x.example.com/de/z"}
    assert {r.page_id for r in url_aliases.judge(df, entry.RULES).collect() if r.inherited} == {1, 2}


def test_url_aliases_stay_native(pages):
    plan = url_aliases.judge(pages, entry.RULES)._jdf.queryExecution().toString()
    assert not re.search(r"ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython|FlatMapGroupsIn", plan)


# ---------------------------------------------------------------------------------------- 6
def test_loser_tree():
    rng = random.Random(3)
    for _ in range(400):
        runs = [sorted((rng.randint(0, 9), i) for i in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 9))]
        assert list(warc_archive.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc_archive, "RANGE_ENTRIES", 7)
    big = "ü" * 600
    rows = [(i, f"http://H{i % 3}.org/{i % 5}", big if i % 4 == 0 else f"<p>{i}" * (i * 9)) for i in range(60)]
    rows += [(100, None, None), (101, "http://h.org/\r\nx", ""), (102, "u", "s"), (103, "u", "s"), (None, "u", "no id"), (None, "u", "no id"), (None, "v", big),
             (None, None, "n" * 2000), (None, None, "n" * 2000), (4, "http://H1.org/4", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, path string, offset int").repartition(5)
    index = warc_archive.merge(warc_archive.write(pages))
    keys = [(r.url_key, r.timestamp, r.page_id) for r in index.orderBy("position").collect()]
    order = [(u, t, warc_archive.NO_ID if i is None else i) for u, t, i in keys]
    assert order == sorted(order) and len(keys) == len(rows)
    seen = Counter()
    for r in index.orderBy("position").collect():
        seen[r.url_key] += 1
        assert r.capture == seen[r.url_key]
    want = Counter()
    last = max(i for i, _, h in rows if h == big and i is not None)
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = last if h == big and i != last else None
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers,
             raw if refers is None else b""] += 1
    got = warc_archive.read(index).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    none = warc_archive.merge(warc_archive.write(pages.limit(0)))
    assert none.count() == 0 and warc_archive.read(none).count() == 0


def test_reading_is_dealt_by_payload(spark, monkeypatch):
    monkeypatch.setattr(warc_archive, "READ_BYTES", 4000)
    rng = random.Random(1)
    pages = spark.createDataFrame([(i, "http://h.org/", "".join(rng.choice("abcdefgh") for _ in range(3000))) for i in range(40)],
                                  "page_id long, url string, html string").repartition(2)
    found = warc_archive.read(warc_archive.merge(warc_archive.write(pages)))
    assert found.rdd.getNumPartitions() >= 10 and found.count() == 40


# ---------------------------------------------------------------------------------------- 7
def bag(t):
    return Counter(w for w in re.split(r"[ \t-\r]+", t) if w)


def jaccard(a, b):
    a, b = bag(a), bag(b)
    top = sum(max(a[k], b[k]) for k in a | b)
    return sum(min(a[k], b[k]) for k in a | b) / top if top else 1.0


def test_weighted_fingerprints(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    texts += ["", None, " \n\t", "é" * 7, texts[3], "one", "x" * 100000]
    rows = [(3 * i - 20, t, "f", 1) for i, t in enumerate(texts)] + [(None, "the id is missing here", "f", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, row int").repartition(4)
    got = {r.doc_id: r for r in weighted_fingerprints.compare_edits(df, 128).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    off = []
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, after)]
        if not bag(t):
            assert set(r.fingerprint) == {"0"}
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.2
    assert got[3 * 3 - 20].fingerprint == got[3 * 44 - 20].fingerprint
    own = {r.doc_id: r.fingerprint for r in weighted_fingerprints.fingerprints(df, 128).collect()}
    assert own == {i: r.fingerprint for i, r in got.items()}
    twice = weighted_fingerprints.compare_edits(df.union(df.where("doc_id = -20")), 32).collect()
    assert len(twice) == len(rows) + 1
    alone = weighted_fingerprints.compare_edits(df.where("doc_id = -20")).first()
    assert alone.near_next == 1.0
    assert weighted_fingerprints.compare_edits(df.limit(0)).count() == 0


def test_error_with_the_registered_samples(spark):
    """Against exact generalised Jaccard, with the samples of the registered query, on real documents."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    got = [(r.near_edited, r.near_next) for r in weighted_fingerprints.compare_edits(docs).orderBy("doc_id").collect()]
    off = []
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        q = len(t) // 4
        off += [got[k][0] - jaccard(t, t[:len(t) - q] + after[:q]), got[k][1] - jaccard(t, after)]
    off = np.array(off)
    assert abs(off.mean()) < 0.02 and np.sqrt((off ** 2).mean()) < 0.08 and np.abs(off).max() < 0.3


def test_weighted_fingerprints_stay_native(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    plan = weighted_fingerprints.compare_edits(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


# --------------------------------------------------------------------------------------- 10
def near(a, b):
    return bin(a ^ b).count("1") <= 3


def linked(fps):
    u = sorted(set(fps))
    return groups([(a, b) for i, a in enumerate(u) for b in u[i + 1:] if near(a & (2**64 - 1), b & (2**64 - 1))], u)


def crowd(n, seed):
    """Fingerprints in Hamming balls and chains around a few centres, and lone ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(n // 30):
        c = rng.getrandbits(64)
        for _ in range(20):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
        for _ in range(6):
            for _ in range(3):
                c ^= 1 << rng.randrange(64)
            out.append(c)
        out += [rng.getrandbits(64) for _ in range(4)]
    return [x - (1 << 64) if x >> 63 else x for x in [*out, 0]]


@pytest.mark.parametrize("file_rows", [8192, 4])
def test_simhash_links(spark, file_rows):
    fps = crowd(300, file_rows)
    df = spark.createDataFrame([(f,) for f in [*fps, fps[0], None]], "fp long")
    pairs = [(r.a, r.b) for r in simhash_pivots.links(df, file_rows=file_rows).collect()]
    assert all(near(a & (2**64 - 1), b & (2**64 - 1)) for a, b in pairs)
    assert groups(pairs, set(fps)) == linked(fps)


def test_simhash_classes(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 400))) for _ in range(30)]
    rows = [(2 * i, t) for i, t in enumerate(base)] + [(200 + i, t + " More") for i, t in enumerate(base)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "two Words"), (304, "TWO words"), (None, base[0].upper()), (0, base[0]), (305, "ß" * 100000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, fp int, component_id string").repartition(4)
    got = simhash_pivots.classes(df).collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: r.fp for r in got}
    for i, t in rows:
        if i is not None:
            assert fps[i] & (2**64 - 1) == simhash_pivots.fingerprint(t)
    root = linked([r.fp for r in got])
    first = {}
    for r in got:
        if r.doc_id is not None:
            first[root[r.fp]] = min(first.get(root[r.fp], r.doc_id), r.doc_id)
    assert all(r.component_id == first[root[r.fp]] for r in got)
    kept = simhash_pivots.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i in set(first.values()))
    assert simhash_pivots.classes(df.limit(0)).count() == 0 and simhash_pivots.keep_one(df.limit(0)).count() == 0


def test_one_row_of_each_component(spark):
    """Ids that repeat, ids in two components, components of null ids alone."""
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "x"), (2, "a b c d", "x"), (1, "k l m n", "x"), (0, "k l m n", "x"),
            (None, "p q r s", "x"), (None, "p q r s", "x"), (None, "p q r s", "z"), (None, "u v w x", "x"), (None, "a b c d", "x"),
            (1, "e f g h", "x"), (3, "e f g h", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    want = Counter([(1, "a b c d"), (0, "k l m n"), (None, "p q r s"), (None, "u v w x"), (1, "e f g h")])
    stage = corpus_pipeline.near_duplicates(spark, df, SF001)
    assert stage.columns == df.columns and Counter((r.doc_id, r.text) for r in stage.collect()) == want
    want[1, "a b c d"] = 3
    assert Counter((r.doc_id, r.text) for r in simhash_pivots.keep_one(df).collect()) == want
    copies = spark.createDataFrame([(None, "p q r s")] * 3000, "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, copies, SF001).count() == 1


def test_fingerprint_of_words():
    import xxhash
    h = xxhash.xxh64_intdigest("a b", 42)
    assert simhash_pivots.fingerprint("A\tb") == h and simhash_pivots.fingerprint(None) == 0
    assert simhash_pivots.fingerprint("É a b") == xxhash.xxh64_intdigest("É a b", 42)


# ---------------------------------------------------------------------------------- pipeline
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = docs.columns
    model = compression_quality.fit(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    scorer = compression_quality._Scorer(model)
    good = {r.doc_id: r for r in docs.collect() if scorer.score(r.text) >= entry.THRESHOLD}
    stage = corpus_pipeline.quality(spark, docs, SF001)
    assert stage.columns == names and {r.doc_id for r in stage.collect()} == set(good)
    fps = {i: simhash_pivots.fingerprint(r.text) for i, r in good.items()}
    root = linked(list(fps.values()))
    first = {}
    for i in sorted(fps):
        first.setdefault(root[fps[i]], i)
    stage = corpus_pipeline.near_duplicates(spark, stage, SF001)
    assert stage.columns == names and sorted(r.doc_id for r in stage.collect()) == sorted(first.values())
    want = Counter({r.doc_id: r.copies for r in mixing.copies(stage).collect() if r.copies})
    stage = corpus_pipeline.mixture(spark, stage, SF001)
    assert stage.columns == names and Counter(r.doc_id for r in stage.collect()) == want
    out = corpus_pipeline.run(spark, SF001).collect()
    assert Counter(r.doc_id for r in out) == want
    assert all(r.decoded_sha256 == hashlib.sha256((good[r.doc_id].text or "").encode()).hexdigest() for r in out
               if "<|endoftext|>" not in (good[r.doc_id].text or ""))


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in entry.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 4
