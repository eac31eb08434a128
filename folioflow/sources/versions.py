"""Tables in versions: a change rewrites only the files that hold changed rows.

A table is a folder with data files and, for each version, a list of the files it consists of.
Files never change: a version that drops rows lists the untouched files of the one before under
their old names and new files in place of those that held such rows. Listing the files comes
last, so a version exists as a whole or not at all; readers of older versions are not disturbed.
What the driver holds are file names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _write_data(rows: DataFrame, root: str) -> list[str]:
    """Write rows as new data files and return their names."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    return stored.select(F.col("_metadata.file_path").alias("path")).distinct().toPandas()["path"].tolist()


def _commit(spark: SparkSession, root: str, version: int, paths: list[str]) -> int:
    """List the files of a version; fails if another writer has made it already. A row without a
    path stands for the version itself, which may have no files."""
    listing = spark.createDataFrame([(None,), *[(path,) for path in sorted(paths)]], "path string")
    listing.coalesce(1).write.mode("errorifexists").parquet(f"{root}/versions/version={version}")
    return version


def create(rows: DataFrame, root: str, keys: list[str], parts: int | None = None) -> int:
    """Write rows as version 1, in ranges of the keys, so that rows changed together lie together.
    With `parts` there are about as many files, else Spark decides."""
    order = [F.col(key) for key in keys]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    return _commit(rows.sparkSession, root, 1, _write_data(ranged, root))


def latest(spark: SparkSession, root: str) -> int:
    return spark.read.schema("path string, version int").parquet(f"{root}/versions").agg(F.max("version")).first()[0]


def files(spark: SparkSession, root: str, version: int) -> list[str]:
    listing = spark.read.schema("path string").parquet(f"{root}/versions/version={version}")
    return listing.where(F.col("path").isNotNull()).toPandas()["path"].tolist()


def read(spark: SparkSession, root: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the latest."""
    paths = files(spark, root, latest(spark, root) if version is None else version)
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def delete_rows(spark: SparkSession, root: str, schema: StructType, keys: DataFrame) -> int:
    """Make a version without the rows that the keys (distinct, named as columns of the table) match.

    The first pass reads the key columns only and names the files that hold such rows; the
    second reads and rewrites just those.
    """
    version = latest(spark, root)
    before = files(spark, root, version)
    if not before:
        return _commit(spark, root, version + 1, before)
    table = read(spark, root, schema, version)
    names = keys.columns
    found = table.select(*names, F.col("_metadata.file_path").alias("path")).join(keys, names, "left_semi")
    hit = set(found.select("path").distinct().toPandas()["path"])
    kept = [path for path in before if path not in hit]
    if hit:
        rows = spark.read.schema(schema).parquet(*sorted(hit)).join(keys, names, "left_anti")
        kept += _write_data(rows.select(*schema.names), root)
    return _commit(spark, root, version + 1, kept)
