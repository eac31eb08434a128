"""Running totals and ranks that do not put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.storage import shared_folder, written

BLOCK = 65_536  # numbers listed at once by explode_range


def running_total(
    rows: DataFrame, group: Sequence[str], position: str, value: Column, name: str
) -> DataFrame:
    """Add `name`: the sum of `value` over the earlier rows of the same group.

    `position` is unique within its group. A plain window would sort a whole group in one
    task. Here the rows are range-partitioned by group and position and written once with
    the number of their partition. The sums of each group and partition, one row for each
    that has any, are accumulated, and only the rows of one partition are windowed together;
    so a group of any size, and a table without groups, is spread over many tasks. Rows with
    a null group or position are kept, with a null total. The ranges are drawn from a sample, so the
    rows are computed twice: write them first if that is dear.
    """
    keys = [F.col(column) for column in group]
    known = F.col(position).isNotNull()
    for key in keys:
        known = known & key.isNotNull()
    ranged = rows.withColumn("_value", F.when(known, value)).repartitionByRange(*keys, position)
    spark = rows.sparkSession
    table = written(ranged.withColumn("_part", F.spark_partition_id()), shared_folder(spark))
    sums = table.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    before_part = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sums.select(
        *group, "_part", F.coalesce(F.sum("_sum").over(before_part), F.lit(0)).alias("_start")
    )
    before_row = (
        Window.partitionBy(*keys, "_part")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = table.withColumn("_within", F.coalesce(F.sum("_value").over(before_row), F.lit(0)))
    return (
        within.join(starts, [*group, "_part"], "left")
        .withColumn(name, F.when(known, F.col("_start") + F.col("_within")))
        .drop("_part", "_value", "_within", "_start")
    )


def rank_from_zero(
    rows: DataFrame, group: Sequence[str], position: str, name: str
) -> DataFrame:
    """Add `name`: 0, 1, 2, ... by `position` within the group, with no gaps."""
    return running_total(rows, group, position, F.lit(1).cast("bigint"), name)


def explode_range(rows: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per whole number from `first` to `last`; none where last < first.

    Done in two steps, so that a very long range is never held as one array.
    """
    step = F.lit(BLOCK)
    begun = rows.withColumns({"_first": first.cast("bigint"), "_last": last.cast("bigint")}).where(
        F.col("_last") >= F.col("_first")
    )
    stretches = begun.withColumn("_from", F.explode(F.sequence("_first", "_last", step)))
    to = F.least(F.col("_from") + BLOCK - 1, F.col("_last"))
    return stretches.withColumn(name, F.explode(F.sequence(F.col("_from"), to))).drop(
        "_first", "_last", "_from"
    )
