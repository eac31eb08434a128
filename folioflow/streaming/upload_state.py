"""Chunked uploads with state of their own: each ends as complete or expired, and what comes
later is told.

Of an upload the state holds which chunks are there, as ranges of indices: chunks sent in order
are one range, however many they are, and a chunk sent twice changes nothing. An event-time timer
ends the upload when its time is up, without a chunk having to arrive; a second one clears the state.
A chunk that comes in between is late and comes out as such instead of being lost without a word.

Time is that of the chunks: an upload is out of time when another began `ttl` after it. The
watermark trails by twice that, so Spark drops a chunk only when its upload has been over for
the same time again. Needs the RocksDB state store, see `session.SETTINGS`.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioflow.operators.ingest import in_range
from folioflow.streaming import sinks
from folioflow.streaming.uploads import UPLOAD_TTL

# What is said of an upload.
COMPLETE, EXPIRED, LATE = "complete", "expired", "late"
OUTCOMES = (
    "upload_id {key}, started_at timestamp, outcome string, n_chunks long, total_chunks long,"
    " n_rejected long, n_late long"
)
_STATE = "ranges binary, started long, total long, rejected long, outcome string"


def merged(ranges: np.ndarray, indices: np.ndarray) -> np.ndarray:
    """Ranges (first, last), apart from each other and sorted, with more indices in them."""
    new = np.unique(indices)
    every = np.concatenate((ranges, np.stack((new, new), axis=1)))
    every = every[np.argsort(every[:, 0], kind="stable")]
    if not len(every):
        return every
    reach = np.maximum.accumulate(every[:, 1])
    begins = np.concatenate(([True], every[1:, 0] > reach[:-1] + 1))
    ends = np.concatenate((begins[1:], [True]))
    return np.stack((every[begins, 0], reach[ends]), axis=1)


class UploadState(StatefulProcessor):
    """State of one upload; `ttl` in milliseconds."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.upload = handle.getValueState("upload", _STATE)

    def _row(self, key, started, outcome, ranges, total, rejected, late) -> pd.DataFrame:
        held = int((ranges[:, 1] - ranges[:, 0] + 1).sum())
        return pd.DataFrame(
            [(key[0], pd.Timestamp(started, unit="ms"), outcome, held, total, rejected, late)],
            columns=["upload_id", "started_at", "outcome", "n_chunks", "total_chunks", "n_rejected", "n_late"],
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Frames of indices alone; -1 stands for a rejected chunk.
        parts = [frame[["place", "total_chunks", "started_ms"]] for frame in rows]
        frame = pd.concat(parts, ignore_index=True)
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.upload.exists():
            raw, started, total, rejected, outcome = self.upload.get()
            ranges = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
        else:
            ranges, rejected, outcome = np.zeros((0, 2), dtype="<i8"), 0, None
            started, total = int(frame["started_ms"].min()), None
            if watermark >= started - self.ttl:
                outcome = EXPIRED
                self.handle.registerTimer(started)
            else:
                self.handle.registerTimer(started - self.ttl)
        totals = frame["total_chunks"].dropna()
        if len(totals):
            total = max(int(totals.max()), total or 0)
        late = 0
        if outcome == EXPIRED:
            late = len(frame)
        else:
            place = frame["place"].to_numpy("int64")
            ranges = merged(ranges, place[place >= 0])
            rejected += int((place < 0).sum())
        whole = rejected == 0 and total is not None and len(ranges) == 1 and (
            ranges[0, 0] == 0 and ranges[0, 1] == total - 1
        )
        now = COMPLETE if outcome is None and whole else outcome
        self.upload.update((ranges.astype("<i8").tobytes(), started, total, rejected, now))
        if late:
            yield self._row(key, started, LATE, ranges, total, rejected, late)
        elif now != outcome:
            yield self._row(key, started, now, ranges, total, rejected, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        raw, started, total, rejected, outcome = self.upload.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= started:
            self.upload.clear()
            return
        self.handle.registerTimer(started)
        if outcome is None:
            ranges = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
            self.upload.update((raw, started, total, rejected, EXPIRED))
            yield self._row(key, started, EXPIRED, ranges, total, rejected, 0)

    def close(self) -> None:
        pass


def upload_outcomes(chunks: DataFrame, ttl: str = UPLOAD_TTL) -> DataFrame:
    """upload_id, started_at, outcome and counts, for append mode: a row when an upload is complete,
    one when its time is up before that, and one for each micro-batch that brings late chunks.

    Only numbers reach the state, no bodies. `started_at` is the same for all chunks of an upload.
    """
    span = pd.Timedelta(ttl) // timedelta(milliseconds=1)
    place = F.when(in_range(), F.col("chunk_index")).otherwise(-1).cast("long")
    narrow = chunks.select(
        "upload_id", place.alias("place"), F.col("total_chunks").cast("long").alias("total_chunks"),
        F.unix_millis("started_at").alias("started_ms"), "started_at",
    ).withWatermark("started_at", f"{2 * span} milliseconds")
    key = narrow.schema["upload_id"].dataType.simpleString()
    return narrow.groupBy("upload_id").transformWithStateInPandas(
        UploadState(span), OUTCOMES.format(key=key), "Append", "EventTime"
    )


def start_outcomes(
    chunks: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append what becomes of each upload to Parquet files below `path`."""
    return sinks.append_to(upload_outcomes(chunks), path, checkpoint, available_now)
