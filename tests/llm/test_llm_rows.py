"""Row-wise operators: BPE chunks (2), grammar files (3), quality (5), shards (8), mixing (9)."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import bpe, bpe_chunks, compression_quality, feistel_shards, grammar_tokens, mixing, store

ODD = ["a", " ", "  ", "\n", "\t", "é", "'s", "'ll", " ", " ", "12", "!", "<|endoftext|>", "日本", "\x1c", "\x85",
       "👍", " the", " of", "\r\n", "\x00", "́"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, score double, ids string, t1 long"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeth") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    shared = " ".join(rng.choice(words) for _ in range(1500))
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 900))) for _ in range(n)]
    out += [out[0] + " " + shared + " end", "head " + shared + " " + out[1], shared, shared, "", " ", "x" * 30000, "日本" * 5000]
    return out + ["".join(rng.choice(ODD) for _ in range(400)) for _ in range(10)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t), 3, 0.5, "x", 1) for i, t in enumerate(texts())]
    rows += [(5, rows[5][1], "en", "s1", 0, 1, 0.1, "y", 2), (None, "no id", None, "s2", 0, 1, 0.1, "y", 2),
             (900, None, "en", None, 0, 1, 0.1, "y", 2), (901, None, "en", "empty", 0, 1, 0.1, "y", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def local(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


def test_encoder_equals_library(library):
    rng, e = random.Random(2), bpe.Encoder(bpe.vocabulary_path())
    for _ in range(1500):
        t = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 20)))
        assert e.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_joins_are_repaired(library):
    rng, e, path = random.Random(3), bpe.encoder(bpe.vocabulary_path()), bpe.vocabulary_path()
    for _ in range(1500):
        t = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))
        raw = t.encode()
        starts = [k for k in range(1, len(raw)) if raw[k] & 0xC0 != 0x80]
        ends = sorted(rng.sample(starts, min(len(starts), rng.randint(0, 6)))) + ([len(raw)] if raw else [])
        parts = [e.encode(raw[a:b].decode()) for a, b in zip([0, *ends], ends)]
        assert bpe_chunks.join_chunks(raw, ends, parts, path).tolist() == library.encode(t, add_special_tokens=False).ids


def test_chunks_follow_content():
    raw = " ".join(texts()[:30]).encode()
    ends = bpe_chunks.chunk_ends(raw)
    assert ends[-1] == len(raw) and max(np.diff([0, *ends])) <= bpe_chunks.LONGEST
    cut = {raw[a:b] for a, b in zip([0, *ends], ends)}
    moved = b"something new in front " + raw
    ends = bpe_chunks.chunk_ends(moved)
    again = {moved[a:b] for a, b in zip([0, *ends], ends)}
    assert len(cut & again) >= len(cut) - 2


def test_bpe_chunks(docs, library):
    got = bpe_chunks.encode_decode(docs, keep=("ids", "decoded")).collect()
    want = Counter()
    for i, t, _ in local(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(text.encode()).hexdigest(), tuple(ids), text] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in got) == want


def test_empty_tables(none, spark):
    assert bpe_chunks.encode_decode(none).count() == 0
    assert grammar_tokens.read(spark, grammar_tokens.write(none)).count() == 0
    assert feistel_shards.shard(none).count() == 0
    assert mixing.copies(none).count() == 0 and mixing.mix(none).columns == none.columns
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = compression_quality.fit(none, labels)
    assert compression_quality.score(none, model, name="p").count() == 0
    assert compression_quality._Scorer(model).score("any") == 0.5


def test_grammar_round_trip():
    rng = np.random.default_rng(5)
    arrays = [np.r_[np.tile(rng.integers(0, 9, 6), rng.integers(0, 60)), [7, 7, 7, 7, 7][:rng.integers(0, 6)]].astype("<u4") for _ in range(80)]
    n = np.array([len(a) for a in arrays])
    sym, rules, per_doc = grammar_tokens.compress(np.concatenate(arrays), n, 10)
    assert len(sym) < n.sum() / 4 and len(rules) and per_doc.sum() == len(sym)
    import tempfile
    path, _ = grammar_tokens.write_file("file://" + tempfile.mkdtemp(prefix="faultline-test-"), list(range(80)), arrays, 10)
    r = grammar_tokens.Reader(path)
    for k, a in enumerate(arrays):
        assert r.document(k).tolist() == a.tolist()
        lo = len(a) // 3
        assert r.ids(k, lo, lo + 5).tolist() == a[lo:lo + 5].tolist()
    assert grammar_tokens.expansion_lengths(rules, 10).min() >= 2


def test_grammar_files(docs, library, spark, monkeypatch):
    manifest = grammar_tokens.write(docs)
    got = sorted(grammar_tokens.read(spark, manifest, with_ids=True).collect(), key=lambda r: r.start)
    rows = sorted(local(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32].encode(),
                                              np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64)))
    start = 0
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(got, rows):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (i, start, len(ids), crc, ids)
        start += len(ids)


def test_one_id_is_spread_over_files(spark):
    """Rows without an id, most of them equal, do not end up in one task."""
    docs = spark.createDataFrame([(None, "same text " * 5)] * 900 + [(i, f"t{i}") for i in range(100)], "doc_id long, text string").repartition(4)
    manifest = grammar_tokens.write(docs).collect()
    assert sum(r.n_docs for r in manifest) == 1000 and max(r.n_docs for r in manifest) < 500


def test_shared_paths(spark):
    assert store.filesystem_uri("s3a://bucket/x") == "s3://bucket/x" and store.filesystem_uri("hdfs://h:9000/x") == "hdfs://h:9000/x"
    assert store.filesystem_uri("file:/a/b") == store.filesystem_uri("file:///a/b") == "file:///a/b"
    with pytest.raises(ValueError):
        store.filesystem_uri("/a/b")
    assert store.qualified(spark, "/a/b") == "file:/a/b" and store.new_folder(spark, "x").startswith("file:/")
    taken = spark.createDataFrame([(1, 2)], "Score int, score_ int")
    assert store.free_name(taken, "score") == "score__"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = feistel_shards.permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert feistel_shards.permute(p, n, 7, inverse=True).tolist() == list(range(n))
    if n >= 1000:
        assert abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.1 and p.tolist() != feistel_shards.permute(np.arange(n), n, 8).tolist()


def test_shards(docs):
    got = feistel_shards.shard(docs, 8).collect()
    assert sorted(((r.doc_id is not None, r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        ((i is not None, i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in local(docs))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    again = feistel_shards.shard(docs.repartition(3), 8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
    spot = order[17]
    assert feistel_shards.row_at(spot.shard, spot.slot, len(got), 8, 42) == 17


def test_write_shards(docs, spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="faultline-test-") + "/shards"
    own = docs.where("doc_id IS NOT NULL AND doc_id <> 5")
    feistel_shards.write_shards(own, path, 4)
    back = spark.read.parquet(path)
    assert back.count() == own.count() and back.select("shard").distinct().count() == 4


def water_fill(sizes, weights, share, limit):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(limit * sizes[s] for s in order if s not in free)) / sum(w[s] for s in free)
        above = {s for s in free if limit * sizes[s] <= w[s] * level}
        if not above:
            break
        free -= above
    return {s: w[s] * level if s in free else limit * sizes[s] for s in order}


def test_mixing(docs):
    import re
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    rows = mixing.copies(docs).collect()
    sizes = Counter()
    for _, t, s in local(docs):
        sizes[s] += words(t)
    want = water_fill(dict(sizes), (3, 1, 2), 1.5, 2.0)
    assert len(rows) == docs.count()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= min(2, int(rate) + 1)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.copies(docs.repartition(2)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    drawn = Counter()
    for r in rows:
        drawn[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in drawn.items() if v})


def test_repeated_rows_reach_their_target(spark):
    """1,000 rows without an id, 600 copies of one row and single rows: every source comes near its target."""
    rows = [(None, "a b c", "s1", 1)] * 1000 + [(5, "d e", "s2", 2)] * 600 + [(100 + i, "x y z w", "s3", 3) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long").repartition(5)
    taken, target = Counter(), {}
    for r in mixing.copies(docs).collect():
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 0.05 * t for s, t in target.items()) and len(target) == 3
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.source] += len(r.text.split())
    assert got == taken


def test_uniform_is_uniform(spark):
    u = [r.u for r in spark.range(4000).select(mixing.uniform(1, F.col("id")).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02


def test_quality(spark):
    rng = random.Random(9)
    clean = [f"{''.join(rng.choice('aeiourstln') for _ in range(rng.randint(2, 9)))}" for _ in range(500)]
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(rng.randint(20, 200))]
        bad = i % 3 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else ". ".join(w), "z", float(i)))
        marks.append((i, 0 if bad else 1))
    rows += [(1000, None, "z", 0.0), (1001, "", "z", 0.0), (None, "no id", None, 0.0), (3, rows[3][1], "again", 1.0)]
    marks += [(None, 1), (2000, 1), (7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, y double")
    model = compression_quality.fit(d, spark.createDataFrame(marks, "doc_id long, quality int"))
    got = compression_quality.score(d, model, name="p").collect()
    assert len(got) == len(rows) and all(0 <= r.p <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.p >= 0.5) == (r.doc_id % 3 != 0) for r in held]) > 0.95
    empty = {r.p for r in got if not r.text}
    assert empty == {model.empty} and len({r.p for r in got if r.doc_id == 3}) == 1
    folds = spark.range(50).select("id", compression_quality.fold_of(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in folds)


def test_words_are_encoded_without_offsets():
    from faultline.llm import bpe

    class Fast:      # the library without its slower call
        def __init__(self, tokenizer):
            self.encode_batch_fast = tokenizer.encode_batch_fast

    e = bpe.Encoder(bpe.vocabulary_path())
    whole, e.tokenizer = e.tokenizer, Fast(e.tokenizer)
    text = "Grammar tokens  of naïve words, zzyzx\n and more qwrtpl words"
    assert e.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_grammar_of_documents_without_ids_between_others():
    import numpy as np

    from faultline.llm import grammar_tokens

    lengths = np.array([0, 40, 0, 0, 41, 0])
    given = lengths.copy()
    ids = np.array([1, 2] * 40 + [1], dtype="<u4")
    symbols, rules, counts = grammar_tokens.compress(ids, lengths, 3)
    spell = lambda s: [s] if s < 3 else spell(int(rules[s - 3, 0])) + spell(int(rules[s - 3, 1]))
    texts = [[i for s in part for i in spell(int(s))] for part in np.split(symbols, np.cumsum(counts)[:-1])]
    assert texts == [p.tolist() for p in np.split(ids, np.cumsum(given)[:-1])]
    assert len(rules) and (lengths == given).all()
