"""Mixing sources to target weights by repetition rates.

Tokens are aggregated per source, targets follow from the weights, a source's rate is target over
size, and each document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with
probability equal to the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.ordering import row_numbers
from faultline.llm.store import materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space); null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A reproducible number in [0, 1): the first 48 bits of an MD5 over seed and columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` per document.

    Sources in code-point order (null last) take ``weights`` in turn and share ``share`` x all
    tokens; a target above ``limit`` x its source's size is cut to that, and the excess is dealt
    again by weight among the others until none is above.  The dealing is a fixed point on one
    number (tokens per unit of weight): each round is an aggregate over the source table that
    returns one row, and every round fixes at least one more source, so it ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = row_numbers(per, [F.col("source").asc_nulls_last()], "__i")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("__w", F.element_at(turn, (F.col("__i") % len(weights) + 1).cast("int")))
    per = materialise(per.withColumn("__cap", F.col("source_size") * float(limit)), "sources")
    total = per.agg(F.sum("source_size")).first()[0]
    level, cut = None, -1
    while total is not None:
        above = F.lit(False) if level is None else F.col("__cap") <= F.col("__w") * level
        row = per.agg(F.sum(F.when(above, 1).otherwise(0)).alias("n"),
                      F.sum(F.when(above, F.col("__cap")).otherwise(0.0)).alias("cap"),
                      F.sum(F.when(~above, F.col("__w")).otherwise(0.0)).alias("w")).first()
        if row["n"] == cut:
            break
        cut = row["n"]
        if not row["w"]:
            level = float("inf")
            break
        level = (total * float(share) - row["cap"]) / row["w"]
    target = F.least(F.col("__cap"), F.col("__w") * F.lit(level if level is not None else 0.0))
    return per.select("source", "source_size", target.alias("target"))


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _taken(seed: int, turn: Column) -> Column:
    """Copies of a document: floor(rate) and one more by chance; ``turn`` tells equal (id, size, source) apart."""
    u = F.when(turn > 0, uniform(seed, F.col("doc_id"), F.col("size"), turn)).otherwise(uniform(seed, F.col("doc_id"), F.col("size")))
    return (F.floor(_rate()) + F.when(u < _rate() - F.floor(_rate()), 1).otherwise(0)).cast("long")


def _same(left: str, right: str) -> Column:
    return F.expr(f"{left}.doc_id <=> {right}.doc_id AND {left}.source <=> {right}.source AND {left}.size = {right}.size")


def _turns(rows: DataFrame) -> DataFrame:
    """``rows`` (stored, with their number ``at``) and ``turn``: 0, 1, ... within equal (id, source, size).

    Rows are numbered within a key and stored partition, then moved on by the key's rows in earlier
    partitions, so a key with a third of all rows is counted in many tasks."""
    key = ["doc_id", "source", "size"]
    rows = rows.withColumn("part", F.shiftright("at", 33))
    inside = Window.partitionBy(*key, "part").orderBy("at")
    rows = rows.withColumn("turn", F.row_number().over(inside) - 1)
    counts = rows.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    met = rows.alias("r").join(counts.alias("c"), _same("r", "c") & F.expr("r.part = c.part"))
    return met.select("r.*", "c.before").withColumn("turn", F.col("turn") + F.col("before")).drop("before", "part")


def _sources(docs: DataFrame, weights: Sequence[float], share: float, limit: float, id_col: str, text_col: str,
             source_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored sizes with row numbers, targets per source, keys (id, source, size) that several rows share)."""
    sizes = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                        word_count(F.col(f"`{text_col}`")).alias("size"), F.monotonically_increasing_id().alias("at"))
    sizes = materialise(sizes, "sizes")
    targets = materialise(source_targets(sizes.select("source", "size"), weights, share, limit), "targets")
    again = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return sizes, targets, materialise(again, "again")


def _with_target(rows: DataFrame, targets: DataFrame) -> DataFrame:
    right = targets.withColumnRenamed("source", "__s")
    return rows.join(right, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
           seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)``, one row per input row.

    The number of copies depends on the id, the size and the source's rate, and among rows that share
    these on their turn, so repeated rows and null ids draw on their own; reruns agree (as a whole for
    such rows).  Null texts have size 0 (no words); sources without words have rate 0 and contribute no
    copies.  A document never gets more than ceil(``limit``) copies.  An empty table gives an empty
    result.  The text is scanned once and never shuffled; a source with a third of all rows is
    pre-aggregated map-side and joined as a skewed key.
    """
    sizes, targets, again = _sources(docs, weights, share, limit, id_col, text_col, source_col)
    rows = sizes.withColumn("turn", F.lit(0).cast("long"))
    if not again.isEmpty():
        alone = sizes.alias("r").join(again.alias("c"), _same("r", "c"), "left_anti")
        rows = alone.withColumn("turn", F.lit(0).cast("long")).unionByName(
            _turns(sizes.alias("r").join(again.alias("c"), _same("r", "c"), "left_semi")))
    return _with_target(rows, targets).select("doc_id", "source", "size", "source_size", "target",
                                              _taken(seed, F.col("turn")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it (columns unchanged).

    Word count and draw are made where the document lies; only the table of sources is joined.  Rows that
    share id, size and source are set apart (by their keys), stored with a number and drawn in turn.
    """
    _, targets, again = _sources(docs, weights, share, limit, id_col, text_col, source_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                       F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    turn = F.lit(0).cast("long")
    if again.isEmpty():
        rows = rows.withColumn("turn", turn)
    else:
        many = rows.alias("r").join(again.alias("c"), _same("r", "c"), "left_semi")
        many = materialise(many.withColumn("at", F.monotonically_increasing_id()), "repeated")
        rows = rows.alias("r").join(again.alias("c"), _same("r", "c"), "left_anti").withColumn("turn", turn).unionByName(
            _turns(many).drop("at"))
    taken = _with_target(rows, targets).withColumn("copies", _taken(seed, F.col("turn")).cast("int")).where("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select([F.col("row").getField(c).alias(c) for c in docs.columns])
