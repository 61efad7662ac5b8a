"""Global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.store import materialise, shuffle_partitions

_LOCAL = (1 << 33) - 1


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Append ``name``: the 0-based, gapless position of each row in the given order.

    Rows are range-partitioned and sorted inside each partition; a row's position is its index in
    the partition plus the rows of all partitions before it.  The only driver-side or single-task
    data is one count per partition.  The result is materialised, so positions are stable.  Rows
    that tie in ``order`` get consecutive positions in an arbitrary but fixed order; they are told apart
    by where they were read, so a third of all rows may tie and still be spread over partitions.
    """
    n = shuffle_partitions(df.sparkSession)
    order = [*order, F.col("__tie")]
    placed = (df.withColumn("__tie", F.monotonically_increasing_id())
              .repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__tie")
              .withColumn("__at", F.monotonically_increasing_id()))
    placed = materialise(placed, "ranked")
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (placed.withColumn("__part", part)
            .join(F.broadcast(offsets), "__part")  # one row per partition of the range shuffle
            .withColumn(name, F.col("__off") + F.col("__at").bitwiseAND(F.lit(_LOCAL)))
            .drop("__at", "__part", "__off"))
