"""Ranks over any order, whatever its values: range partitions from a sample, and counts carried between them.

``positions`` cuts an order by a bucket that the caller derives from the values, and is as even as that bucket. Here
Spark samples the order itself and cuts it into ranges of equal size. A number drawn for each row is the last part of
the order, so rows that are equal in all of it are spread as well: no value, prefix or constant makes a task large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrum.plans.durable import durable

_PART_BITS = 33
"""``monotonically_increasing_id`` holds the number of the partition above this many bits."""


def in_order(df: DataFrame, order: Sequence[Column], out: str = "_place", ranges: int | None = None) -> DataFrame:
    """Rows dealt by ranges of ``order``, with ``out``, a number that grows with the order; stored, so it stays.

    Rows equal in ``order`` get any order among themselves. ``ranges`` is the session's number of shuffle partitions
    unless given.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = [*order, F.col("_drawn").asc()]
    sorted_rows = df.withColumn("_drawn", F.rand(11)).repartitionByRange(ranges, *drawn).sortWithinPartitions(*drawn)
    return durable(sorted_rows.drop("_drawn").withColumn(out, F.monotonically_increasing_id()))


def range_of(place: str = "_place") -> Column:
    """The range a row lies in: a tile for :func:`metrum.plans.ordered.running`."""
    return F.shiftright(F.col(place), _PART_BITS)


def ranked(df: DataFrame, order: Sequence[Column], out: str = "rank", ranges: int | None = None) -> DataFrame:
    """Add ``out``: the zero-based position of each row in ``order`` over all rows, as a long."""
    placed = in_order(df, order, "_place", ranges)
    counts = placed.groupBy(range_of().alias("_range")).count()
    # One row for each range, as many as there are partitions.
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.col("_place").bitwiseAND((1 << _PART_BITS) - 1)
    joined = placed.withColumn("_range", range_of()).join(F.broadcast(carried), "_range")
    return joined.select(*df.columns, (F.col("_before") + within).cast("long").alias(out))
