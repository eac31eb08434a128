"""Sorted rows that can be opened at any page number.

The rows are kept in ranges of the sort order, one folder a range, each row with its place within its
range, beside a table with the number of rows in each range. A page is found from those counts,
and only the ranges that hold it are read; within them, row groups are skipped by the place.
So the last page costs what the first one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioflow.operators.catalog import PAGE_SIZES, sort_keys

# Fixed value: monotonically_increasing_id counts the rows of a task in its lower 33 bits.
_ROW_BITS = 33


def create(
    rows: DataFrame, root: str, column: str, key: str = "file_id", descending: bool = False,
    parts: int | None = None,
) -> None:
    """Write rows sorted by the named column, as `sort_rows` sorts them, and their counts.

    Ranges are cut on the column and the unique key, so that rows with one value are spread. The
    rows are computed twice, as the cuts are drawn from a sample. Without `parts` Spark decides on
    the number of ranges.
    """
    order = sort_keys(column, dict(rows.dtypes)[column], key, descending)
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    numbered = ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = numbered.withColumns(
        {"_at": F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1), "_part": F.shiftright("_id", _ROW_BITS)}
    ).drop("_id")
    placed.write.partitionBy("_part").parquet(f"{root}/rows")
    counts = _rows(rows.sparkSession, root, rows.schema).groupBy("_part").agg(F.count("*").alias("n_rows"))
    # One row a range meets in one task.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))
    starts.write.parquet(f"{root}/counts")


def _rows(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    stored = StructType([*schema.fields, *[StructField(name, LongType()) for name in ("_at", "_part")]])
    return spark.read.schema(stored).parquet(f"{root}/rows")


def _counts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("_part bigint, n_rows bigint, start bigint").parquet(f"{root}/counts")


def page_total(spark: SparkSession, root: str, size: int) -> int:
    """Number of pages, from the counts alone."""
    total = _counts(spark, root).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return -(-total // size)


def page_at(spark: SparkSession, root: str, schema: StructType, page: int, size: int) -> DataFrame:
    """Page `page` (from 1) of the rows stored by `create`, in their order; none beyond the end.

    No range is empty, so a page lies in `size` ranges at most, which is what the driver holds.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"size must be one of {PAGE_SIZES}")
    if page < 1:
        raise ValueError("pages are numbered from 1")
    first = (page - 1) * size
    held = (F.col("start") < first + size) & (F.col("start") + F.col("n_rows") > first)
    parts = _counts(spark, root).where(held).collect()
    wanted = F.lit(False)
    for part in parts:
        low = first - part.start
        wanted = wanted | ((F.col("_part") == part["_part"]) & F.col("_at").between(low, low + size - 1))
    opened = _rows(spark, root, schema).where(F.col("_part").isin([part["_part"] for part in parts]))
    return opened.where(wanted).orderBy("_part", "_at").drop("_part", "_at")
