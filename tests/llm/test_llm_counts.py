"""Divergence audit (11), exact dedup (12) and collocations (13) against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from faultline.llm import collocations, exact_dedup, source_divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, digest string, n long, w1 string, chunk int, row long, rank string, tie string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, "w", 2, 3, "r", "t") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["The", "the,", "THE", "É-tat", "état", "a1b", "ab", "naïve", "x", "𝒳y", "of", "(of)", "zu", "--", "9", "\x1fq", "Ω."]
    out = []
    for i in range(260):
        text = "".join(rng.choice(words) + rng.choice([" ", "\t", "\n", "  ", ". ", " "]) for _ in range(rng.randint(0, 40)))
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "ß", None])))
    out += [(1000, None, "en", "only"), (1001, "", "xx", None), (None, "The the, ab", "en", "s1"), (None, "The the, ab", "en", "s1")]
    out += [(2000 + i, "same text for all ab", "de", "s1") for i in range(120)]  # copies with a third of all rows
    out += [(7, "again", "en", "s2")] * 3 + [(3000, "The of " * 9000 + "end", "en", "s2")]
    return out


# ---------------------------------------------------------------------------------------- 11
def divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, spread, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = term.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        spread[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in spread[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine = shares(counts[lang, source])
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        pairs = [(-sum(abs(mine[t] - p) for t, p in shares(counts[lang, s]).items()), s.encode()) for s in sources if s != source]
        terms = [(whole[t] - mine[t], t.encode()) for t in kept if counts[lang, source][t] and mine[t] > whole[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least,top,held,bits", [(30, 50, 400_000, 16), (12, 3, 50, 15), (10_000, 50, 400_000, 16)])
def test_divergence(spark, rows, least, top, held, bits, monkeypatch):
    monkeypatch.setattr(source_divergence, "LEAST_BITS", bits)
    monkeypatch.setattr(source_divergence, "MOST_BITS", bits)
    monkeypatch.setattr(source_divergence.chunk_spread, "__defaults__", (held,))
    monkeypatch.setattr(source_divergence.tokenize, "__defaults__", (held,))
    monkeypatch.setattr(source_divergence.chunk_counts, "__defaults__", (held,))
    monkeypatch.setattr(source_divergence, "BATCH_WORDS", min(held, 1000))
    got = source_divergence.divergence(table(spark, rows).repartition(3), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == divergence(rows, least, top)


def test_documents_of_a_term_in_several_chunks(spark):
    # 'ab' stands in 12 documents, always in two chunks: the sum over chunks alone would be 24.
    rows = [(i, "Ab, (ab) other", "en", "s") for i in range(12)]
    docs = table(spark, rows).select("lang", "source", "text")
    assert {r.term: r.n for r in source_divergence.term_counts(docs, 12).collect()} == {"ab": 24, "other": 12}
    assert source_divergence.term_counts(docs, 13).count() == 0


def test_counts_of_a_chunk_meet_before_they_are_rows(spark):
    # Every task has every chunk: a row for each would grow with the tasks, and one for each document with them.
    rows = [(i, "Ab, (ab) \u0085\u00a0x other", "en", f"s{i % 2}") for i in range(48)]
    docs = table(spark, rows).selectExpr("lang", "source", "CAST(text AS BINARY) AS text").repartition(12)
    spread = source_divergence.chunk_spread(docs)
    assert spread.count() <= 12 * 4
    found = {(r.lang, bytes(r.term)): (r.low, r.high) for r in source_divergence.tokenize(spread).where("chunk IS NULL").groupBy("lang", "term").agg(
        F.max("low").alias("low"), F.sum("high").alias("high")).collect()}
    assert found == {("en", b"ab"): (48, 96), ("en", b"other"): (48, 48), ("en", "\u0085\u00a0x".encode()): (48, 48)}
    chunks = spark.createDataFrame([(bytearray(b"ab,"), True), (bytearray(b"(ab)"), True), (bytearray(b"other"), False)], "chunk binary, open boolean")
    counts = [tuple(r) for r in source_divergence.chunk_counts(docs, chunks).collect()]
    assert sorted(((s or "", bytes(name), n) for _, s, name, n in counts if name != "\u0085\u00a0x".encode())) == [
        ("", b"ab", 48), *((s, c, 24) for s in ("s0", "s1") for c in (b"(ab)", b"ab,", b"other"))]


def test_long_texts_are_sliced(monkeypatch):
    text = ("The of\tzu\n" * 500 + "x" * 300).encode()
    whole = [Counter(s) for s in source_divergence._slices(text)]
    monkeypatch.setattr(source_divergence, "_SLICE", 64)
    cut = [Counter(s) for s in source_divergence._slices(text)]
    assert len(whole) == 1 < len(cut)
    assert sum(cut, Counter()) == whole[0] == {b"the": 500, b"of": 500, b"zu": 500, b"x" * 300: 1}


# ---------------------------------------------------------------------------------------- 12
def labels(rows):
    kept = defaultdict(list)
    for i, text, *_ in rows:
        kept[text or ""].append(i)
    out = []
    for text, ids in kept.items():
        known = [i for i in ids if i is not None]
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, max(known, default=None), len(ids), digest) for i in ids]
    return out


def order(row):
    return [(x is None, x if x is not None else 0) for x in row]


@pytest.mark.parametrize("support", [0.002, 0.3])
def test_exact_dedup(spark, rows, support):
    got = exact_dedup.label(table(spark, rows).repartition(5), support=support).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=order) == sorted(labels(rows), key=order)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert Counter(r.text_sha256 for r in got if r.kept) == {r.text_sha256: 1 for r in got}


def test_heavy_hitters(spark):
    digests = ["h"] * 400 + [f"d{i % 300}" for i in range(600)] + ["g"] * 100
    rows = spark.createDataFrame([(i, d, i) for i, d in enumerate(digests)], "doc_id long, digest string, tie long")
    got = {r.digest: (r.n, r.keep_id) for r in exact_dedup.heavy_hitters(rows.repartition(4), 0.05).collect()}
    assert got == {"h": (400, 399), "g": (100, 1099)}


def test_drop_copies(spark, rows):
    docs = table(spark, rows)
    for support in (0.002, 0.3):
        got = exact_dedup.drop_copies(docs, support=support)
        assert got.schema.names == docs.schema.names
        kept = got.collect()
        assert sorted(((r.doc_id, r.text or "") for r in kept), key=order) == sorted(
            {(keep, text or "") for i, text, *_ in rows for keep in [max((j for j, t, *_ in rows if (t or "") == (text or "") and j is not None), default=None)]}, key=order)
    folded = exact_dedup.drop_copies(docs, normalise=F.lower)
    assert folded.count() == len({(t or "").lower() for _, t, *_ in rows})


def test_dedup_stays_native(spark, rows):
    plan = exact_dedup.label(table(spark, rows))._jdf.queryExecution().toString()
    assert not re.search(r"ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython|FlatMapGroups", plan)


# ---------------------------------------------------------------------------------------- 13
def phrases(rows, least, top, share, longest=5):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i:i + size]] = max(longer[p[i:i + size]], a)
        ranked = []
        for p, a in found.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top,share,words", [(100, 2000, 100, 1_000_000), (5, 40, 60, 97), (2, 2000, 100, 300)])
def test_collocations(spark, rows, least, top, share, words, monkeypatch):
    monkeypatch.setattr(collocations, "BATCH_WORDS", words)
    monkeypatch.setattr(collocations, "KNOWN_WORDS", 9 if words == 97 else 400_000)
    got = collocations.collocations(table(spark, rows).repartition(3), least=least, top=top, share=share)
    assert sorted(tuple(r) for r in got.collect()) == phrases(rows, least, top, share)


def test_overfull_buckets_cut_less_never_wrongly(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 3)
    monkeypatch.setattr(collocations, "MOST_BITS", 3)
    got = collocations.collocations(table(spark, rows), least=20)
    assert sorted(tuple(r) for r in got.collect()) == phrases(rows, 20, 2000, 100)


def test_tasks_hand_on_tables_not_rows(spark):
    # Every task has all the frequent windows (40 of each of five lengths): rows for each would grow with the tasks.
    rows = [(i, " ".join(f"w{(i + j) % 40}" for j in range(40)), "en", "s") for i in range(1200)]
    docs = table(spark, rows).selectExpr("lang", "CAST(text AS BINARY) AS text")
    assert all(collocations.windows(docs.repartition(tasks)).count() <= 200 for tasks in (2, 12))


def test_rare_words_are_not_remembered():
    # A worker remembers the words that may be in a phrase, however many others a task reads.
    import numpy as np
    import pyarrow as pa

    frequent = collocations._Cuts("en", np.array([xxh64_intdigest(b"often")], dtype=np.uint64)).buckets(20)[0]
    bitmap = np.zeros((1 << 20) // 8, dtype=np.uint8)
    bitmap[frequent >> 3] |= 1 << (frequent & 7)
    texts = [" often ".join(f"w{i}x{k}" for k in range(20)).encode() for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 100), pa.array(texts, pa.binary())], ["lang", "text"])
    lots = list(collocations._streams(iter([batch]), 500, 1000, bitmap))
    assert all(len(words) <= 10 for _, words, _, _ in lots) and [last for *_, last in lots].count(True) == 1
    ids = np.concatenate([ids for _, _, ids, _ in lots])
    assert (ids == lots[0][1][b"often"]).sum() == 1900 and (ids == collocations.RARE).sum() >= 1990 and (ids == 0).sum() == 100


def test_windows_are_cut_by_every_order(spark):
    # Six words in any order: triples are frequent, sequences of four and five words are not.
    import random

    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices("abcdef", k=200)), "en", "s") for i in range(200)]
    found = collocations.windows(table(spark, rows).selectExpr("lang", "CAST(text AS BINARY) AS text"))
    assert found.where("w3 <> ''").count() > 0 and found.where("w4 <> ''").count() == 0


def test_shorter_phrases(spark, rows):
    got = collocations.collocations(table(spark, rows), longest=2, least=9)
    assert sorted(tuple(r) for r in got.collect()) == phrases(rows, 9, 2000, 100, 2)


def test_empty_tables(spark):
    none = table(spark, [])
    assert source_divergence.divergence(none).count() == exact_dedup.label(none).count() == collocations.collocations(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    bare = table(spark, [(1, None, None, None), (2, "", "en", "s"), (3, " .,\n", "en", "t")])
    assert collocations.collocations(bare).count() == 0
    assert sorted(tuple(r) for r in source_divergence.divergence(bare).collect()) == [
        ("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
