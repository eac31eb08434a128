"""Starting streams and reading what they wrote."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

# Fixed value: how often status is looked up.
POLL_INTERVAL = "10 seconds"


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, as state with timers has to."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def file_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def _trigger(available_now: bool) -> dict[str, object]:
    return {"availableNow": True} if available_now else {"processingTime": POLL_INTERVAL}


def append_to(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = False,
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Append each row exactly once to Parquet files below `path`."""
    return (
        stream.writeStream.partitionBy(*partition_by)
        .format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(available_now))
        .start()
    )


def each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Hand the changed rows of every micro-batch to `write`, which must be repeatable."""
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(available_now))
        .start()
    )


def updates_to(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Write each micro-batch's changed rows to their own folder `batch_id=n`.

    A micro-batch run again after a failure replaces its own folder, so the table stays
    right. Read it with `read_updates`.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return each_batch(stream, write, checkpoint, available_now)


def read_updates(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str],
    version: Sequence[str] = ("batch_id",), since: int | None = None,
) -> DataFrame:
    """Last version of each key's row written by `updates_to`.

    `version` names the columns that tell which is last; by default the micro-batch. Rows
    that carry their own time name it, so that a late row never wins. `since` reads a
    snapshot, see `compact_updates`, and the micro-batches after it only.
    """
    columns = schema.names
    stored = StructType([*schema.fields, StructField("batch_id", LongType())])
    versions = spark.read.schema(stored).parquet(path)
    if since is not None:
        kept = spark.read.schema(stored).parquet(f"{path}_snapshot/upto={since}")
        versions = kept.unionByName(versions.where(F.col("batch_id") > since))
    latest = versions.groupBy(*keys).agg(
        F.max_by(F.struct(*columns, "batch_id"), F.struct(*version)).alias("_row")
    )
    return latest.select("_row.*").drop("batch_id")


def compact_updates(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str],
    version: Sequence[str] = ("batch_id",), since: int | None = None,
) -> int:
    """Merge all updates so far into one snapshot and return its number, for `read_updates`.

    Pass the number of the snapshot before as `since`; only the micro-batches after it are
    read. Older snapshots and folders up to the number may be dropped once readers use it.
    """
    stored = StructType([*schema.fields, StructField("batch_id", LongType())])
    upto = spark.read.schema(stored).parquet(path).select(F.max("batch_id")).first()[0]
    rows = read_updates(spark, path, schema, keys, version, since)
    number = F.lit(upto).cast("bigint").alias("batch_id")
    rows.select("*", number).write.mode("overwrite").parquet(f"{path}_snapshot/upto={upto}")
    return upto
