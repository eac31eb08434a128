"""A summary of projects kept up to date while files change their status.

The state holds the latest status of each file. When a later event changes it, the file is taken
from the old count and added to the new one: two rows, -1 and +1, and none where nothing
changes. The counts are the sums of these rows, so a micro-batch costs what it changes, however many
files a project has. Needs the RocksDB state store, see `session.SETTINGS`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioflow.operators.catalog import STATUS_COUNTS, named_summary
from folioflow.streaming import sinks

CHANGES = "project_id long, status string, change long"


class FileStatus(StatefulProcessor):
    """State of one file: when it got its status, and where it counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", "at long, event_id long, project_id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            last = frame.sort_values(["at", "event_id"]).iloc[-1]
            found = (int(last["at"]), int(last["event_id"]), int(last["project_id"]), last["status"])
            if best is None or found[:2] > best[:2]:
                best = found
        old = self.file.get() if self.file.exists() else None
        if old is not None and tuple(old[:2]) >= best[:2]:
            return
        self.file.update(best)
        moved = [(*best[2:], 1)] if old is None else [(*old[2:], -1), (*best[2:], 1)]
        if old is None or tuple(old[2:]) != best[2:]:
            yield pd.DataFrame(moved, columns=["project_id", "status", "change"])

    def close(self) -> None:
        pass


def summary_changes(events: DataFrame) -> DataFrame:
    """project_id, status and change of the counts, for append mode.

    Events have file_id, project_id, status, ts and event_id. Event time decides, ties go to the larger
    event_id, and an event that comes late never wins. An event that lacks any of the five is left out.
    """
    columns = ["file_id", "project_id", "status", "ts", "event_id"]
    narrow = events.dropna(subset=columns).select(
        "file_id", F.col("project_id").cast("long"), "status", F.unix_micros("ts").alias("at"),
        F.col("event_id").cast("long"),
    )
    return narrow.groupBy("file_id").transformWithStateInPandas(FileStatus(), CHANGES, "Append", "None")


def start_changes(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append the changes of each micro-batch to Parquet files below `path`, each once."""
    return sinks.append_to(summary_changes(events), path, checkpoint, available_now)


def live_summary(clients: DataFrame, projects: DataFrame, changes: DataFrame) -> DataFrame:
    """What `project_summary` gives for the files as they are after the written changes."""
    counts = changes.groupBy("project_id").agg(
        F.sum("change").alias("n_files"),
        *[
            F.sum(F.when(F.col("status") == status, F.col("change")).otherwise(0)).alias(name)
            for name, status in STATUS_COUNTS.items()
        ],
    )
    return named_summary(clients, projects, counts)
