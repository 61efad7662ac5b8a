"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is the bag of its words, weighted by their counts.  For sample k every word draws r, c from
Gamma(2, 1) and b from [0, 1), all from hashes of (word, k); with weight w it stands at
``t = floor(ln w / r + b)`` and has the value ``a = c exp(-r (t - b) - r)``.  The word with the
smallest a, with its t, is the sample.  Two texts agree in a sample with a probability equal to
their generalised Jaccard similarity, sum of min weights over sum of max weights.  As ln a is a
function of (word, t, k), the smallest ln a stands for the sample itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.ordering import row_numbers
from faultline.llm.store import materialise

SAMPLES = 32
#: Samples computed side by side: few enough that the generated code of a row stays small.
SIDE = 4
WHITE = r"[ \t-\r]+"
_NO_ID = -(2**63)
_BITS = 21


def _uniform(h: Column, third: int) -> Column:
    """21 bits of a 64-bit hash as a number inside (0, 1)."""
    bits = F.shiftrightunsigned(h, third * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))
    return (bits + F.lit(0.5)) * F.lit(2.0**-_BITS)


def _sampled(weighted: DataFrame, keys: list[str], weights: list[str], samples: int) -> DataFrame:
    """``(keys, parts)`` from ``(keys, kind, term, weights)``: rows of kind 1 are weighted words, others
    carry a long in ``term``.  ``parts`` is sorted by ``g``: groups of samples, then the carried longs."""
    groups = -(-samples // SIDE)
    g = F.when(F.col("kind") == 1, F.array(*[F.lit(i) for i in range(groups)])).otherwise(F.array(F.col("kind") + groups - 2))
    rows = weighted.withColumn("g", F.explode(g))
    k = [F.col("g") * SIDE + i for i in range(SIDE)]
    side = range(SIDE)
    rows = rows.select(*keys, "g", *[F.when(F.col(w) > 0, F.log(w)).alias(w) for w in weights],
                       F.when(F.col("kind") > 1, F.col("term")).alias("carried"),
                       *[F.xxhash64("term", k[i] * 2).alias(f"h{i}") for i in side],
                       *[F.xxhash64("term", k[i] * 2 + 1).alias(f"j{i}") for i in side])
    rows = rows.select(*keys, "g", *weights, "carried",
                       *[(-F.log(_uniform(F.col(f"h{i}"), 0) * _uniform(F.col(f"h{i}"), 1))).alias(f"r{i}") for i in side],
                       *[F.log(-F.log(_uniform(F.col(f"j{i}"), 0) * _uniform(F.col(f"j{i}"), 1))).alias(f"c{i}") for i in side],
                       *[_uniform(F.col(f"h{i}"), 2).alias(f"b{i}") for i in side])

    def value(w: str, i: int) -> Column:
        r, c, b = F.col(f"r{i}"), F.col(f"c{i}"), F.col(f"b{i}")
        return c - r * (F.floor(F.col(w) / r + b) - b) - r

    least = rows.groupBy(*keys, "g").agg(*[F.min(value(w, i)).alias(f"{w}{i}") for w in weights for i in side],
                                         F.max("carried").alias("carried"))

    def short(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.shiftright(F.xxhash64(c), 32).cast("int"))

    parts = least.select(*keys, F.struct("g", *[F.array(*[short(f"{w}{i}") for i in side]).alias(w) for w in weights], "carried").alias("p"))
    return parts.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("parts"))


def _signature(w: str, samples: int) -> Column:
    """The samples of one weight column; zeros for a text without words."""
    groups = -(-samples // SIDE)
    found = F.flatten(F.transform(F.filter("parts", lambda p: p["g"] < groups), lambda p: p[w]))
    return F.when(F.size(found) > 0, F.slice(found, 1, samples)).otherwise(F.array_repeat(F.lit(0), samples))


def hex_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(samples))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` per input row, 8 hex digits for every sample.

    Words are runs without ASCII white space, as they stand.  Null texts count as empty; texts without
    words have the fingerprint of zeros.  Repeated rows stay.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.sha2("text", 256))
    texts = rows.groupBy("h").agg(F.first("text").alias("text"))
    words = texts.select("h", F.explode(F.split("text", WHITE)).alias("word"))
    weighted = words.groupBy("h", F.lit(1).alias("kind"), F.xxhash64("word").alias("term")).agg(
        F.sum(F.when(F.col("word") != "", 1).otherwise(0)).alias("w"))
    sigs = _sampled(weighted, ["h"], ["w"], samples).select("h", _signature("w", samples).alias("sig"))
    return rows.join(sigs, "h").select("doc_id", hex_string(F.col("sig")).alias("fingerprint"))


def compare_edits(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The edited text replaces the last floor(n/4) code points by the first as many (or all) of the next
    document in ascending id order; after the last comes the first (a single document follows itself).
    One row per input row.  Null texts are empty.  A null id sorts first.  Rows that repeat an id have
    the same next document; if the next id is repeated, its smallest needed beginning and its
    smallest fingerprint count.

    Texts are shuffled once, by id; the beginnings that go to the document before are cut to the
    length that it needs.  Words are counted and sampled where the text arrived, without another
    exchange of words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), text.alias("text"))
    ids = rows.groupBy("id").agg(F.max(F.char_length("text")).cast("long").alias("n"))
    ids = row_numbers(ids, [F.col("id")], "at")
    count = ids.count()
    before = ids.select(F.col("id").alias("to"), F.floor(F.col("n") / 4).cast("int").alias("take"),
                        F.pmod(F.col("at") + 1, F.lit(max(count, 1))).alias("__at"))
    sent = ids.join(before, ids["at"] == before["__at"]).select("id", "to", "take")
    sent = materialise(sent, "sent")
    heads = (rows.join(sent, "id").select("to", F.expr("substring(text, 1, take)").alias("head"))
             .groupBy("to").agg(F.min("head").alias("head")))
    n, q = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    pair = rows.join(heads, rows["id"] == heads["to"]).select("id", "text", "head")
    pair = pair.select("id", "text", n.cast("long").alias("n"), F.concat(
        F.substring("text", F.lit(1), n - q), F.substring("head", F.lit(1), q)).alias("edited"))
    pair = pair.withColumn("row", F.monotonically_increasing_id())
    # Kinds 0, 1: words of the text and of the edited text; 2 to 6: the digest in four parts and n.
    sha = F.sha2("edited", 256)
    kinds = [F.struct(F.lit(k).alias("kind"), t.alias("t")) for k, t in enumerate(
        [F.col("text"), F.col("edited"), *[F.substring(sha, 16 * i + 1, 16) for i in range(4)], F.hex("n")])]
    both = pair.select("id", "row", F.explode(F.array(*kinds)).alias("x")).select("id", "row", "x.kind", "x.t")
    words = both.select("id", "row", "kind", F.explode(F.split("t", WHITE)).alias("word")).where("word <> ''")
    term = F.when(F.col("kind") < 2, F.xxhash64("word")).otherwise(F.conv("word", 16, -10).cast("long"))
    one = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    weighted = words.groupBy("id", "row", F.greatest("kind", F.lit(1)).alias("kind"), term.alias("term")).agg(
        one(0).alias("w"), one(1).alias("e"))
    groups = -(-samples // SIDE)
    carried = lambda i: F.filter("parts", lambda p: p["g"] == groups + i)[0]["carried"]
    found = _sampled(weighted, ["id", "row"], ["w", "e"], samples).select(
        "id", carried(4).alias("n_chars"),
        F.concat(*[F.lpad(F.lower(F.hex(carried(i))), 16, "0") for i in range(4)]).alias("edited_sha256"),
        _signature("w", samples).alias("sig"), _signature("e", samples).alias("edited_sig"))
    found = materialise(found, "signatures")
    following = found.join(sent, "id").groupBy("to").agg(F.min("sig").alias("next_sig"))
    return found.join(following, found["id"] == following["to"]).select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        hex_string(F.col("sig")).alias("fingerprint"), hex_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig"), samples).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig"), samples).alias("near_next"))
