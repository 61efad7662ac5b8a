"""Registered queries of the training-data operators and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (ann_forest, bpe_chunks, collocations, compression_quality, exact_dedup, feistel_shards,
                           grammar_tokens, mixing, simhash_pivots, source_divergence, url_aliases, warc_archive,
                           weighted_fingerprints)

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
THRESHOLD = 0.3
SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_forest.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_decode(_table(spark, sf_dir, "documents"))


def op3_grammar_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_tokens.read(spark, grammar_tokens.write(_table(spark, sf_dir, "documents")))


def op4_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_aliases.judge(_table(spark, sf_dir, "pages"), RULES).drop("inherited")


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression_quality.fit(docs, _table(spark, sf_dir, "labels"))
    return compression_quality.score(docs, model).select(
        "doc_id", (compression_quality.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_archive.merge(warc_archive.write(_table(spark, sf_dir, "pages")))
    return warc_archive.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprints.compare_edits(_table(spark, sf_dir, "documents"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = feistel_shards.shard(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.copies(_table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pivots.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_pivots.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ann_forest, op2_bpe_chunks, op3_grammar_tokens, op4_url_aliases, op5_compression_quality, op6_warc_archive,
    op7_weighted_fingerprints, op8_feistel_shards, op9_mixing, op10_simhash_pivots,
    op11_source_divergence, op12_exact_dedup, op13_collocations)}

_HOST = "coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}'))"


def _by_rule(value: Callable[[str, str], str]) -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    return "CASE " + " ".join(f"WHEN {_fits(rule)} THEN '{value(kind, rule)}'" for kind, rule in longest)


_KEY = ("CASE WHEN contains({0}, '://') THEN translate(regexp_extract({0}, '^(.*?)://', 1, 's'), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || " + _HOST.replace("url", "{0}") + " || "
        "CASE WHEN " + _PATH.replace("url", "{0}") + " = '' THEN '/' ELSE " + _PATH.replace("url", "{0}") + " END || "
        "regexp_extract({0}, '^[^#?]*(\\?[^#]*)', 1, 's') END")


def _key(column: str) -> str:
    return _KEY.replace("{0}", column)


# The links of a page, and aliases as the transitive closure over them (small here: pages link rarely).
_OP4 = f"""WITH RECURSIVE links AS (
  SELECT url, regexp_extract(tag, '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is') AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is')) AS tag FROM pages WHERE url IS NOT NULL)
  UNION ALL
  SELECT url, regexp_extract(tag, '\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1, 'is')
  FROM (SELECT url, unnest(regexp_extract_all(html, '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is')) AS tag FROM pages WHERE url IS NOT NULL)),
full_links AS (
  SELECT url, CASE WHEN starts_with(target, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || target
                   WHEN starts_with(target, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || target
                   ELSE target END AS target
  FROM links WHERE target <> ''),
edges AS (SELECT {_key('url')} AS a, {_key('target')} AS b FROM full_links),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
judged AS (SELECT a, url AS b, {_HOST} AS host, {_PATH} AS path FROM (SELECT a, b AS url FROM reach)),
tainted AS (SELECT DISTINCT a FROM judged WHERE {_by_rule(lambda kind, rule: kind)} END = 'block'),
rows_ AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, {_key('url')} AS node FROM pages)
SELECT page_id, host, path, {_by_rule(lambda kind, rule: rule)} END AS rule,
       {_by_rule(lambda kind, rule: kind)} WHEN node IN (SELECT a FROM tainted) THEN 'block' ELSE 'allow' END AS verdict
FROM rows_"""

_OP6 = """WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT payload_digest AS d, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN response IS DISTINCT FROM page_id AND response IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM p LEFT JOIN r ON d = payload_digest"""

# Water filling in closed form: sources are cut in order of size over weight, the rest share what is left.
_OP9 = """WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS i FROM s),
w AS (SELECT *, CASE i WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, 2.0::DOUBLE * source_size AS cap FROM o),
q AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS k FROM w),
c AS (SELECT k, cap / weight AS turn, (SELECT sum(source_size) FROM w) * 1.5::DOUBLE AS total,
             sum(cap) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) - cap AS below,
             sum(weight) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS above FROM q),
l AS (SELECT (total - below) / above AS level FROM c WHERE (total - below) / above < turn ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM l), cap)) AS target FROM w),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
             CAST(('0x' || substr(md5('42|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || CAST(d.size AS VARCHAR)), 1, 12)) AS BIGINT)
               / 281474976710656.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

# Dense: every group of a lang meets every kept term of the lang.
_OP11 = f"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 translate(coalesce(text, ''), {_UPPER}, {_LOWER}) AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY lang, source, term),
gc AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN kept k ON k.lang = g.lang
       LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gp AS (SELECT gc.*, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v.v) AS p
       FROM gc JOIN v USING (lang)),
lc AS (SELECT lang, term, sum(c) AS c FROM gc GROUP BY lang, term),
lp AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v.v) AS q FROM lc JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN gp x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN gp y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM gp JOIN lp USING (lang, term) WHERE gp.c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
FROM terms QUALIFY rank <= 50"""

_OP12 = """WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

# Every n-gram is generated here, order by order.
_OP13 = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_UPPER}, {_LOWER}) AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
grams AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
          WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
scored AS (SELECT cuts.lang, cuts.phrase, a, n, cut, x.f AS l, y.f AS r,
                  ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cuts JOIN total USING (lang)
           JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(words[1:cut], ' ')
           JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, a, k, words, unnest(range(2, k)) AS size FROM c),
parts AS (SELECT lang, a, size, words, unnest(range(1, k - size + 2)) AS i FROM inner_),
longer AS (SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM parts GROUP BY 1, 2)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase,
       a, l, r, n, score
FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000"""

ORACLE_SQL = {"op4_url_aliases": _OP4, "op6_warc_archive": _OP6, "op9_mixing": _OP9, "op11_source_divergence": _OP11,
              "op12_exact_dedup": _OP12, "op13_collocations": _OP13}
