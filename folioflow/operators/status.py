"""File status from an append-only table of status events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.operators.ingest import accept_if


def status_latest(events: DataFrame) -> DataFrame:
    """Last status per file, by event time and then event id, whatever the row order.

    `updated_at` is the time of that last event; `completed_at` is set for final states
    only. One shuffle of at most one row per file and map task.
    """
    latest = events.groupBy("file_id").agg(
        F.max(F.struct("ts", "event_id", "status")).alias("_last")
    )
    final = F.col("_last.status").isin(rules.PROCESSED, rules.FAILED)
    return latest.select(
        "file_id",
        F.col("_last.status").alias("status"),
        F.col("_last.ts").alias("updated_at"),
        F.when(final, F.col("_last.ts")).alias("completed_at"),
    )


def apply_status(files: DataFrame, latest: DataFrame) -> DataFrame:
    """File rows brought up to date with `status_latest`; files without events stay as they are.

    Both sides have one row per file, so no key is crowded. Events of unknown files drop out.
    """
    news = latest.select(
        F.col("file_id").alias("id"),
        F.col("status").alias("_status"),
        F.col("completed_at").alias("_completed_at"),
    )
    known = files if "completed_at" in files.columns else files.withColumn(
        "completed_at", F.lit(None).cast("timestamp")
    )
    changed = F.col("_status").isNotNull()
    return known.join(news, "id", "left").withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "completed_at": F.when(changed, F.col("_completed_at")).otherwise(
                F.col("completed_at")
            ),
        }
    ).select(*known.columns)


def start_runs(requests: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Requests (file_id, option) to start a run, marked, with the `Processing` event to append.

    Unknown files and invalid options are rejected. An option left out means `basic`.
    """
    known = files.select(F.col("id").alias("file_id"), F.lit(True).alias("_known"))
    found = requests.join(known, "file_id", "left").withColumn(
        "option", rules.run_option(F.col("option"))
    )
    valid = rules.is_valid_option(F.col("option"))
    reason = F.when(F.col("_known").isNull(), rules.NO_FILE).otherwise(rules.INVALID_OPTION)
    marked = accept_if(found, F.col("_known") & valid, reason)
    return marked.withColumns(
        {
            "status": F.when(F.col("accepted"), rules.PROCESSING),
            "ts": F.when(F.col("accepted"), now),
        }
    ).select("file_id", "option", "accepted", "reject_reason", "status", "ts")


def results_to_file(results: DataFrame, files: DataFrame) -> DataFrame:
    """Batch results joined to the file that owns them; results of unknown files drop out."""
    owners = files.select(
        F.col("id").alias("doc_id"), "project_id", "file_name"
    )
    return results.join(owners, "doc_id")
