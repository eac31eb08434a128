"""Chunked uploads as a stream: assembly in any arrival order, and expiry.

A chunk row has upload_id, chunk_index, total_chunks, body and `started_at`, the time its
upload began, which is the same for all its chunks. An upload has 24 hours from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, DateType, StringType, StructField, StructType

from folioflow.operators.ingest import (
    SEGMENT_CHUNKS, assemble_segments, check_chunks, upload_files,
)
from folioflow.sources.storage import written
from folioflow.streaming import sinks

# Fixed value: the time an upload may take.
UPLOAD_TTL = "24 hours"


def landed_chunks(chunks: DataFrame) -> DataFrame:
    """Every chunk that arrives, marked (`accepted`, `reject_reason`), with its upload's day."""
    return check_chunks(chunks).withColumn("day", F.to_date("started_at"))


def parts_schema(chunks: DataFrame) -> StructType:
    """Schema of the table that `start_parts` writes."""
    marks = [
        StructField("accepted", BooleanType()), StructField("reject_reason", StringType()),
        StructField("day", DateType()),
    ]
    return StructType([*chunks.schema.fields, *marks])


def upload_counts(parts: DataFrame, ttl: str = UPLOAD_TTL) -> DataFrame:
    """Chunks received per upload, from the stream of the table that `start_parts` writes.

    A chunk sent twice counts once; an upload with a rejected chunk is not complete. State
    holds one key per chunk and one count per upload until the upload is out of time: grouping
    by the start time lets it be dropped when the watermark passes. In update mode a row is
    `complete` in exactly one micro-batch; in append mode each upload comes out once, when its
    time is up.
    """
    index = F.when(F.col("accepted"), F.col("chunk_index")).alias("chunk_index")
    once = (
        parts.select("upload_id", index, "started_at", "total_chunks")
        .withWatermark("started_at", ttl)
        .dropDuplicatesWithinWatermark(["upload_id", "chunk_index"])
    )
    whole = (F.col("n_chunks") == F.col("total_chunks")) & (F.col("n_rejected") == 0)
    return (
        once.groupBy("upload_id", "started_at")
        .agg(
            F.count("chunk_index").alias("n_chunks"),
            F.max("total_chunks").alias("total_chunks"),
            F.count_if(F.col("chunk_index").isNull()).alias("n_rejected"),
        )
        .withColumn("complete", whole)
    )


def start_parts(
    chunks: DataFrame, parts_path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Land all chunks in a table, rejects too; nothing is kept in state or dropped as late.

    The table is partitioned by the day the upload began, so that readers of finished
    uploads skip the other days, and days out of use can be dropped.
    """
    return sinks.append_to(landed_chunks(chunks), parts_path, checkpoint, available_now, ["day"])


def start_completions(
    parts: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Write each upload once, in the micro-batch in which its last chunk arrived."""
    complete = upload_counts(parts).where("complete")
    return sinks.updates_to(complete, path, checkpoint, available_now)


def start_expiry(
    parts: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Write each upload that was still incomplete when its time was up."""
    expired = upload_counts(parts).where(~F.col("complete")).drop("complete")
    return sinks.append_to(expired, path, checkpoint, available_now)


def parts_of(parts: DataFrame, complete: DataFrame) -> DataFrame:
    """Landed chunks of the given complete uploads, read from the streams' tables.

    `complete` may be all of `start_completions` or the folder of one micro-batch; only the
    days it spans are read. Uploads that got a rejected chunk later are left out.
    """
    done = complete.select("upload_id", F.to_date("started_at").alias("day"))
    first, last = done.select(F.min("day")).scalar(), done.select(F.max("day")).scalar()
    near = parts.where(F.col("day").between(first, last))
    rejected = near.where(~F.col("accepted")).select("day", "upload_id").distinct()
    sound = done.join(rejected, ["day", "upload_id"], "left_anti")
    return near.join(sound, ["day", "upload_id"], "left_semi")


def assembled(
    parts: DataFrame, complete: DataFrame, order: str | None, segment_chunks: int = SEGMENT_CHUNKS
) -> DataFrame:
    """Segments of the given complete uploads; of a chunk sent again the last copy by `order`,
    as in batch form."""
    return assemble_segments(parts_of(parts, complete), order, segment_chunks)


def start_files(
    parts: DataFrame, landed: DataFrame, projects: DataFrame, order: str, path: str,
    checkpoint: str, available_now: bool = False,
) -> StreamingQuery:
    """Mark each upload as a file to take in, in the micro-batch that completes it.

    `parts` is the stream of the table `landed`. Accepted and rejected files go to the same
    folder of the micro-batch, which is replaced if it runs again.
    """

    def write(done: DataFrame, batch_id: int) -> None:
        # The stateful plan runs once; what it found is read as often as needed.
        known = written(done, f"{path}_completed/batch_id={batch_id}")
        whole = parts_of(landed, known)
        marked = upload_files(whole, projects, order)
        marked.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sinks.each_batch(
        upload_counts(parts).where("complete"), write, checkpoint, available_now
    )
