"""Places of rows in a total order, from one range partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.scratch import written


def in_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` as a written table with ``_place`` (rising in the order of ``keys``, without gaps in a range) and ``_range``.

    A last key splits rows that are equal in all others; their order is any.  Both numbers are stored with the rows, so
    nothing depends on the ranges being drawn in the same way twice.
    """
    order = [*keys, "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.drop("_row").withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
