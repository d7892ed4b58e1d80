"""Places and neighbours of rows in an order, without a window over everything or over a whole group.

Both come from one range partitioning, written with the number of the range.  What ranges must know of each other, their
sizes or their last rows, is a row for each range (and group in it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narravane.functions.scratch import written


def _ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` in ranges of ``keys``, with ``_place`` (rising in their order, gapless in a range) and ``_range``."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ranged.withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str], name: str = "place") -> DataFrame:
    """``df`` with the place of each row in the order of ``keys``, which tell rows apart, from 1."""
    ranged = _ranged(df, keys)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_range", (before - F.col("_first") + 1).alias("_shift"))
    return ranged.join(F.broadcast(shift), "_range").withColumn(name, (F.col("_place") + F.col("_shift")).cast("long")).drop("_place", "_range", "_shift")


def lagged(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``value`` of the row before in each group by ``order`` (which tells rows apart), null for the first row.

    Inside a range of the order it is a window over the range; the first row of a group in a range takes the last one
    of the group in the ranges before.
    """
    ranged = _ranged(df.withColumn("_value", value), [*group, *order])
    inside = Window.partitionBy("_range", *group).orderBy("_place")
    own = ranged.withColumn("_lag", F.lag(F.struct("_value")).over(inside))
    ends = ranged.groupBy("_range", *group).agg(F.max_by(F.struct("_value"), "_place").alias("_last"))
    carried = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*group).orderBy("_range"))).drop("_last")
    same = F.col("o._range") == F.col("c._range")
    for g in group:
        same = same & F.col(f"o.{g}").eqNullSafe(F.col(f"c.{g}"))
    joined = own.alias("o").join(carried.alias("c"), same, "left")
    return joined.select(*[F.col(f"o.{c}") for c in df.columns], F.coalesce("o._lag", "c._carried")["_value"].alias(name))
