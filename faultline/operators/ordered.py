"""Ordered scans that stay parallel when one group is huge.

Every ordered question in this engine ("position of a commit", "last commit that touched this
line before", "smallest bug-introducing commit among newer fixes") is a prefix aggregate over an
ordered axis inside a group.  A plain ``Window.partitionBy(group)`` puts a whole group into one
task; if one repository or file holds a third of all rows that task holds a third of the data.

``prefix_agg`` splits the axis into fixed-width buckets and answers in two levels:

1. one row per (group, bucket) with the bucket's aggregate -- a table ``width`` times smaller;
2. a running aggregate over those bucket rows gives each bucket its carry-in;
3. a window partitioned by (group, bucket) finishes inside the bucket and combines with the carry.

The big side is shuffled once, by (group, bucket): both the bucket totals and the in-bucket
window read that one exchange (so the upstream plan runs once), and the final join finds the big
side already partitioned; only the small bucket table is re-partitioned.  The aggregate must be
associative (sum, min, max), which covers every use here.

Where the whole axis is no wider than one bucket (``spans_one_bucket``, from one look at the stored
positions) there is nothing to carry in: with ``whole`` the rows are shuffled once, by group, no bucket
totals are made, and what follows on the same group finds its rows in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Width of one bucket on an integer axis (commit positions).  A repository with a million commits
# becomes ~16 buckets; the small table has rows / DEFAULT_WIDTH entries.
DEFAULT_WIDTH = 1 << 16

_AGG = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def _cols(xs: Sequence[str] | str) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


def spans_one_bucket(df: DataFrame, order: str = "idx", width: int = DEFAULT_WIDTH) -> bool:
    """Whether the ``order`` of all rows lies within one bucket's width.  ``df`` should be stored."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    return lo is None or hi - lo < width - 1


def prefix_aggs(df: DataFrame, keys: Sequence[str] | str, order: str,
                specs: Sequence[tuple[Column | str, str, str, bool]], width: int = DEFAULT_WIDTH,
                whole: bool = False, placed: bool = False) -> DataFrame:
    """Several prefix aggregates over the same (keys, order) axis in one two-level pass.

    ``specs``: ``(value, how, out, inclusive)`` -- ``out`` = ``how(value)`` over the rows of the same
    ``keys`` whose integer ``order`` is strictly smaller (or smaller-or-equal when ``inclusive``).
    Ties in ``order`` are treated alike, so the answer does not depend on row order.  Rows with a
    NULL ``value`` do not contribute.  One repartition, one bucket table, one window operator and
    one join serve all specs.  ``whole``: the axis spans one bucket; ``placed``: and the rows of a group
    are in one partition already.
    """
    keys = _cols(keys)
    if whole:
        return prefix_whole(df, keys, order, specs, placed)
    b = "_pa_bucket"
    d = df.withColumn(b, F.floor(F.col(order) / F.lit(width)))
    for i, (value, _, _, _) in enumerate(specs):
        d = d.withColumn(f"_pa_v{i}", F.col(value) if isinstance(value, str) else value)
    d = d.repartition(*keys, b)

    buckets = d.groupBy(*keys, b).agg(*[_AGG[how][0](f"_pa_v{i}").alias(f"_pa_v{i}")
                                        for i, (_, how, _, _) in enumerate(specs)])
    carry_w = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*keys, b, *[_AGG[how][0](f"_pa_v{i}").over(carry_w).alias(f"_pa_c{i}")
                                         for i, (_, how, _, _) in enumerate(specs)])
    for i, (_, how, _, inclusive) in enumerate(specs):
        in_w = (Window.partitionBy(*keys, b).orderBy(F.col(order))
                      .rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        d = d.withColumn(f"_pa_i{i}", _AGG[how][0](f"_pa_v{i}").over(in_w))
    d = d.join(buckets, on=[*keys, b], how="left")
    for i, (_, how, out, _) in enumerate(specs):
        d = d.withColumn(out, _AGG[how][1](F.col(f"_pa_c{i}"), F.col(f"_pa_i{i}")))
    tmp = [b] + [f"_pa_{k}{i}" for i in range(len(specs)) for k in ("v", "c", "i")]
    return d.drop(*tmp)


def prefix_whole(df: DataFrame, keys: Sequence[str] | str, order: str, specs: Sequence[tuple],
                 placed: bool = False) -> DataFrame:
    """``prefix_aggs`` over whole groups.  Rows without a position come before all others, but where a key is
    null they are apart: there nothing is carried in from their bucket."""
    keys, b = _cols(keys), "_pa_bucket"
    unknown = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    d = (df if placed else df.repartition(*keys)).withColumn(b, unknown & F.col(order).isNull())
    for i, (value, how, _, inclusive) in enumerate(specs):
        w = Window.partitionBy(*keys, b).orderBy(F.col(order)).rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        found = _AGG[how][0](F.col(value) if isinstance(value, str) else value).over(w)
        d = d.withColumn(f"_pa_i{i}", F.coalesce(found, F.lit(0)) if how == "sum" else found)
    for i, (_, _, out, _) in enumerate(specs):
        d = d.withColumn(out, F.col(f"_pa_i{i}"))
    return d.drop(b, *[f"_pa_i{i}" for i in range(len(specs))])


def prefix_agg(df: DataFrame, keys: Sequence[str] | str, order: str, value: Column | str, how: str, out: str,
               inclusive: bool = False, width: int = DEFAULT_WIDTH, whole: bool = False, placed: bool = False) -> DataFrame:
    """One prefix aggregate (see ``prefix_aggs``)."""
    return prefix_aggs(df, keys, order, [(value, how, out, inclusive)], width, whole, placed)


def ordered_index(df: DataFrame, keys: Sequence[str] | str, bucket: Column, order: Sequence[Column | str],
                  out: str = "idx") -> DataFrame:
    """0-based position of each row inside ``keys`` by ``order`` (a ``row_number() - 1``).

    ``bucket`` must be an integer column that is monotone in ``order`` (e.g. the day of the commit
    timestamp when ordering by timestamp); positions are the count of rows in earlier buckets plus
    the row number inside the bucket.
    """
    keys = _cols(keys)
    b, base = "_oi_bucket", "_oi_base"
    d = df.withColumn(b, bucket).repartition(*keys, b)
    counts = d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_oi_n"))
    w = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, b, F.coalesce(F.sum("_oi_n").over(w), F.lit(0)).alias(base))
    rn = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order))
    d = d.withColumn(out, rn).join(counts, on=[*keys, b], how="left")
    return d.withColumn(out, (F.col(out) + F.col(base) - 1).cast("bigint")).drop(b, base)


def expand_range(df: DataFrame, lo: Column, hi: Column, out: str, keys: Sequence[str],
                 chunk: int = 4096) -> DataFrame:
    """One row per integer ``out`` in ``[lo, hi]`` for each input row (no row when ``lo > hi``).

    Two levels, so a single huge range is produced by many tasks: the range is first cut into
    ``chunk``-wide pieces (few rows), the pieces are hash-distributed by ``keys`` + piece, and each
    piece is expanded where it lands.  Every generated row is an output row.
    """
    c = "_er_chunk"
    d = (df.withColumn("_er_lo", lo).withColumn("_er_hi", hi)
           .filter(F.col("_er_lo") <= F.col("_er_hi"))
           .withColumn(c, F.explode(F.sequence(F.floor(F.col("_er_lo") / chunk), F.floor(F.col("_er_hi") / chunk))))
           .repartition(*keys, c))
    a = F.greatest(F.col("_er_lo"), F.col(c) * chunk)
    b = F.least(F.col("_er_hi"), F.col(c) * chunk + (chunk - 1))
    return d.withColumn(out, F.explode(F.sequence(a, b))).drop(c, "_er_lo", "_er_hi")


def join_range(df: DataFrame, lo: Column, hi: Column, points: DataFrame, keys: Sequence[str] | str, at: str,
               chunk: int = 64) -> DataFrame:
    """Each row of ``df`` with every row of ``points`` of the same ``keys`` whose integer ``at`` lies in ``[lo, hi]``.

    The points of ``chunk`` positions travel as one row and so does the part of a range in them; they meet
    in an equi-join on keys and chunk, and rows are made where they meet: none of them is shuffled.  A long
    range is many pieces, made by many tasks.
    """
    keys, c = _cols(keys), "_jr_chunk"
    rest = [x for x in points.columns if x not in keys]
    held = points.groupBy(*keys, F.floor(F.col(at) / chunk).alias(c)).agg(F.collect_list(F.struct(*rest)).alias("_jr_points"))
    d = (df.withColumn("_jr_lo", lo).withColumn("_jr_hi", hi).filter(F.col("_jr_lo") <= F.col("_jr_hi"))
           .withColumn(c, F.explode(F.sequence(F.floor(F.col("_jr_lo") / chunk), F.floor(F.col("_jr_hi") / chunk)))))
    d = d.join(held, [*keys, c]).withColumn("_jr_point", F.explode("_jr_points"))
    d = d.filter(F.col(f"_jr_point.{at}").between(F.col("_jr_lo"), F.col("_jr_hi")))
    return d.select(*df.columns, *[F.col(f"_jr_point.{x}").alias(x) for x in rest])
