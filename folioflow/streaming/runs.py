"""Status and batch completion as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.functions import rules
from folioflow.streaming.sinks import POLL_INTERVAL, append_to

# Fixed value: the time a document run may take.
RUN_TTL = "24 hours"


def stream_status(events: DataFrame, ttl: str = RUN_TTL) -> DataFrame:
    """Latest status per file and day of event time, for update mode.

    State is one row per file and day, dropped when the watermark has passed the day; so files
    that stay quiet cost nothing. Event time decides: read the written updates with
    `read_updates(..., keys=["file_id"], version=STATUS_VERSION)`, by which a late event never
    wins, whatever micro-batch it came in.
    """
    return (
        events.withWatermark("ts", ttl)
        .groupBy("file_id", F.window("ts", "1 day"))
        .agg(F.max(F.struct("ts", "event_id", "status")).alias("_last"))
        .select("file_id", "_last.status", F.col("_last.ts").alias("updated_at"), "_last.event_id")
        .withColumn("completed_at", F.when(
            F.col("status").isin(rules.PROCESSED, rules.FAILED), F.col("updated_at")
        ))
    )


# Columns that order the versions of a file's status.
STATUS_VERSION = ("updated_at", "event_id")


def status_windows(
    events: DataFrame, interval: str = POLL_INTERVAL, late: str = RUN_TTL
) -> DataFrame:
    """Status counts per tumbling interval of event time; later than `late` is dropped."""
    counted = (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", interval), "status")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
    return counted.select(
        F.col("window.start").alias("window_start"), "status", "n_events"
    )


def run_counts(results: DataFrame, ttl: str = RUN_TTL) -> DataFrame:
    """Batches reported per run, once each, with success or error.

    A result has doc_id, batch_no, n_batches, status and `started_at` of its run; a document run
    again has another start, so its runs are told apart. Only counts are kept: a
    document with very many batches is combined before the shuffle.
    """
    once = results.select("doc_id", "batch_no", "n_batches", "status", "started_at").withWatermark(
        "started_at", ttl
    ).dropDuplicatesWithinWatermark(["doc_id", "started_at", "batch_no"])
    return once.groupBy("doc_id", "started_at").agg(
        F.count(F.lit(1)).alias("n_reported"),
        F.max("n_batches").alias("n_batches"),
        F.count_if(F.col("status") == rules.FAILED).alias("n_failed"),
    )


def stream_gather(results: DataFrame, ttl: str = RUN_TTL) -> DataFrame:
    """Documents whose batches have all reported, for update mode: each comes out in exactly
    one micro-batch."""
    return run_counts(results, ttl).where(F.col("n_reported") == F.col("n_batches"))


def stream_expire_runs(results: DataFrame, ttl: str = RUN_TTL) -> DataFrame:
    """Documents whose run was out of time before all batches had reported, for append mode.

    A run of which no batch ever reported is in no stream of results; `run_outcomes` finds it
    from the stream of starts.
    """
    return run_counts(results, ttl).where(F.col("n_reported") < F.col("n_batches"))


# How a run ended once its time is up.
FINISHED, UNFINISHED, SILENT = "finished", "unfinished", "never reported"


def run_outcomes(
    starts: DataFrame, results: DataFrame, ttl: str = RUN_TTL, late: str = "1 hour"
) -> DataFrame:
    """One row for each started run when its time is up, for append mode.

    `starts` has doc_id, started_at and n_batches, `results` doc_id, started_at of the run,
    batch_no, status and `reported_at`. The streams are joined on the run, and a result counts
    if it came within `ttl` of the start. The join is an outer one with a time bound: a start
    leaves the state once the results' watermark is past its time, and comes out alone if no
    batch ever reported. Rows may come in up to `late` out of order on either side; their batches are
    counted once each, however often they report.
    """
    # The run's start as a plain number: with an event time among the join's keys, its state
    # would be dropped as soon as the watermark passes the start.
    start = F.unix_micros("started_at")
    begun = starts.select("doc_id", "started_at", "n_batches", start.alias("_run"))
    begun = begun.withWatermark("started_at", late)
    reports = results.select(
        F.col("doc_id").alias("_doc"), start.alias("_start"), "batch_no", "status", "reported_at"
    ).withWatermark("reported_at", late)
    bound = F.expr(f"reported_at >= started_at AND reported_at <= started_at + INTERVAL {ttl}")
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("_run") == F.col("_start"))
    met = begun.join(reports, same & bound, "left_outer")
    failed = F.when(F.col("status") == rules.FAILED, F.col("batch_no"))
    counted = met.groupBy("doc_id", "started_at", "n_batches").agg(
        F.size(F.collect_set("batch_no")).cast("bigint").alias("n_reported"),
        F.size(F.collect_set(failed)).cast("bigint").alias("n_failed"),
        F.max("reported_at").alias("last_report"),
    )
    outcome = (
        F.when(F.col("n_reported") == 0, SILENT)
        .when(F.col("n_reported") < F.col("n_batches"), UNFINISHED).otherwise(FINISHED)
    )
    return counted.withColumn("outcome", outcome)


def start_outcomes(
    starts: DataFrame, results: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append each run's outcome once to Parquet files below `path`."""
    return append_to(run_outcomes(starts, results), path, checkpoint, available_now)
