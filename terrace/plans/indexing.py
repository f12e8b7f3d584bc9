"""Consecutive row numbers without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.plans.durable import durable

_WITHIN = 33  # monotonically_increasing_id keeps a row's place within its partition in so many low bits


def row_index(df: DataFrame, order: list[str], name: str = "k") -> DataFrame:
    """``df`` with ``name``, the row's place from 0 in the order of the columns ``order``.

    Rows are range-partitioned and sorted; places are those within the partition
    plus the sizes of the partitions before. Only these sizes, one row for each
    partition, meet in one task.
    """
    place = F.monotonically_increasing_id()
    dealt = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", place))
    part = F.shiftright("_id", _WITHIN)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    joined = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << _WITHIN) - 1))).drop("_id", "_part", "_start")
