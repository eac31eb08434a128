import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioflow.operators import ingest, status
from folioflow.streaming import runs, sinks, upload_state, uploads

START = 1_700_000_000
HOUR = 3600


class Feed:
    """A folder read as a stream; each write adds files in order of time."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def add(self, data):
        self.spark.createDataFrame(data, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self, per_trigger=1):
        return sinks.file_stream(self.spark, self.folder, self.frame_schema(), per_trigger)

    def frame_schema(self):
        return self.spark.createDataFrame([], self.schema).schema

    def batch(self):
        return self.spark.read.schema(self.frame_schema()).parquet(self.folder)


CHUNK = "upload_id string, chunk_index int, total_chunks int, body string, started_at timestamp"


def times(spark, second):
    return spark.sql(f"select timestamp_seconds({START + second}) t").first().t


def chunk(spark, upload, index, total, body, second=0):
    return (upload, index, total, body, times(spark, second))


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "in", CHUNK)


def run_uploads(spark, feed, folder):
    """Drive both upload streams over whatever has arrived, from their checkpoints."""
    uploads.start_parts(feed.stream(), f"{folder}/parts", f"{folder}/log1", True).awaitTermination()
    parts = sinks.file_stream(spark, f"{folder}/parts", uploads.parts_schema(feed.batch()))
    uploads.start_completions(parts, f"{folder}/done", f"{folder}/log2", True).awaitTermination()
    landed = spark.read.parquet(f"{folder}/parts")
    segments = uploads.assembled(landed, spark.read.parquet(f"{folder}/done"), None, segment_chunks=4)
    whole = {}
    for r in sorted(segments.collect()):
        whole[r.upload_id] = whole.get(r.upload_id, "") + r.body
    return whole


def test_chunks_in_any_order_with_restart(spark, feed, tmp_path):
    rng = random.Random(2)
    texts = {f"u{i}": [f"{i}.{k};" for k in range(rng.randint(1, 9))] for i in range(12)}
    data = [chunk(spark, u, k, len(t), b, i) for i, (u, t) in enumerate(texts.items()) for k, b in enumerate(t)]
    data += rng.sample(data, 8)
    rng.shuffle(data)
    half = len(data) // 2
    feed.add(data[:half // 2])
    feed.add(data[half // 2:half])
    early = run_uploads(spark, feed, tmp_path)
    assert all(early[u] == "".join(texts[u]) for u in early) and len(early) < 12
    feed.add(data[half:])
    assert run_uploads(spark, feed, tmp_path) == {u: "".join(t) for u, t in texts.items()}
    # Each upload was announced once, and a run without new data changes nothing.
    done = spark.read.parquet(f"{tmp_path}/done")
    assert done.count() == done.select("upload_id").distinct().count() == 12
    assert len(run_uploads(spark, feed, tmp_path)) == 12
    batch = ingest.assemble_chunks(feed.batch(), segment_chunks=4)
    landed = spark.read.parquet(f"{tmp_path}/parts")
    streamed = uploads.assembled(landed, done, None, segment_chunks=4)
    assert batch.exceptAll(streamed).count() == streamed.exceptAll(batch).count() == 0


def test_incomplete_uploads_expire_and_late_chunks_count_no_more(spark, feed, tmp_path):
    feed.add([chunk(spark, "stuck", 0, 2, "a", 0), chunk(spark, "fine", 0, 1, "b", 0)])
    feed.add([chunk(spark, "later", 0, 1, "c", 30 * HOUR)])
    feed.add([chunk(spark, "last", 0, 2, "d", 31 * HOUR)])
    feed.add([chunk(spark, "stuck", 1, 2, "too late", 0)])

    def run():
        uploads.start_parts(feed.stream(), f"{tmp_path}/parts", f"{tmp_path}/l1", True).awaitTermination()
        parts = sinks.file_stream(
            spark, f"{tmp_path}/parts", uploads.parts_schema(feed.batch()), 1)
        uploads.start_expiry(parts, f"{tmp_path}/gone", f"{tmp_path}/l2", True).awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/gone").select("upload_id", "n_chunks", "total_chunks"))

    assert run() == [("stuck", 1, 2)]
    assert spark.read.parquet(f"{tmp_path}/parts").where("body = 'too late'").count() == 1
    feed.add([chunk(spark, "next", 0, 1, "e", 60 * HOUR)])
    assert run() == [("last", 1, 2), ("stuck", 1, 2)]


def test_status_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    feed = Feed(spark, tmp_path / "in", "file_id int, status string, ts timestamp, event_id int")
    states = ["Not processed", "Processing", "Processed", "Failed"]
    data = [(rng.randint(0, 9), rng.choice(states), times(spark, rng.randint(0, 50)), i) for i in range(120)]

    def run():
        latest = runs.stream_status(feed.stream())
        sinks.updates_to(latest, f"{tmp_path}/s", f"{tmp_path}/l", True).awaitTermination()
        stored = (spark, f"{tmp_path}/s", latest.schema, ["file_id"], runs.STATUS_VERSION)
        now = sinks.read_updates(*stored).drop("event_id")
        batch = status.status_latest(feed.batch())
        upto = sinks.compact_updates(*stored)
        assert sinks.read_updates(*stored, since=upto).drop("event_id").exceptAll(batch).count() == 0
        assert now.exceptAll(batch).count() == batch.exceptAll(now).count() == 0

    feed.add(data[:40])
    feed.add(data[40:60])
    run()
    feed.add(data[60:])
    run()


def test_a_late_event_after_its_state_is_gone_never_wins(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "file_id int, status string, ts timestamp, event_id int")
    feed.add([(1, "Processed", times(spark, 1000), 5)])
    feed.add([(2, "Processing", times(spark, 90 * HOUR), 6)])
    feed.add([(3, "Processing", times(spark, 91 * HOUR), 7)])
    feed.add([(1, "Processing", times(spark, 500), 4), (1, "Failed", times(spark, 92 * HOUR), 8)])
    feed.add([(1, "Processing", times(spark, 91 * HOUR), 9)])
    latest = runs.stream_status(feed.stream())
    sinks.updates_to(latest, f"{tmp_path}/s", f"{tmp_path}/l", True).awaitTermination()
    stored = (spark, f"{tmp_path}/s", latest.schema, ["file_id"], runs.STATUS_VERSION)
    now = {r.file_id: r.status for r in sinks.read_updates(*stored).collect()}
    assert now == {1: "Failed", 2: "Processing", 3: "Processing"}


def test_unfinished_runs_are_reported(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in",
                "doc_id int, batch_no int, n_batches int, status string, started_at timestamp")
    row = lambda d, b, n, hours: (d, b, n, "Processed", times(spark, hours * HOUR))
    feed.add([row(1, 0, 2, 0), row(2, 0, 1, 0)])
    feed.add([row(3, 0, 2, 30)])
    feed.add([row(4, 0, 1, 31)])
    gone = runs.stream_expire_runs(feed.stream())
    sinks.append_to(gone, f"{tmp_path}/gone", f"{tmp_path}/log", True).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/gone").select("doc_id", "n_reported", "n_batches")
    assert rows(found) == [(1, 1, 2)]


def test_windows_count_every_event_in_time(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "file_id int, status string, ts timestamp, event_id int")
    feed.add([(1, "Processing", times(spark, s), s) for s in (0, 9, 10, 11)])
    feed.add([(1, "Processing", times(spark, 5), 9), (2, "Failed", times(spark, 5), 10)])
    counted = runs.status_windows(feed.stream())
    sinks.updates_to(counted, f"{tmp_path}/w", f"{tmp_path}/l", True).awaitTermination()
    now = sinks.read_updates(spark, f"{tmp_path}/w", counted.schema, ["window_start", "status"])
    batch = feed.batch().groupBy(F.window("ts", "10 seconds").start, "status").count()
    assert rows(now) == rows(batch) and now.agg(F.sum("n_events")).first()[0] == 6


def test_gather_stream_fires_once_when_all_reported(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in",
                "doc_id int, batch_no int, n_batches int, status string, started_at timestamp")
    row = lambda d, b, n, s="Processed": (d, b, n, s, times(spark, d))
    finished = {}

    def run():
        done = runs.stream_gather(feed.stream())
        sinks.updates_to(done, f"{tmp_path}/g", f"{tmp_path}/l", True).awaitTermination()
        found = spark.read.schema(done.schema).parquet(f"{tmp_path}/g")
        finished["rows"] = rows(found.select("doc_id", "n_reported", "n_failed"))

    feed.add([row(1, 0, 3), row(1, 2, 3), row(2, 0, 1, "Failed")])
    feed.add([row(1, 0, 3), row(1, 0, 3)])  # repeats must not complete the document
    run()
    assert finished["rows"] == [(2, 1, 1)]
    feed.add([row(1, 1, 3, "Failed"), row(3, 0, 2)])
    feed.add([row(1, 1, 3, "Failed"), row(2, 0, 1, "Failed")])
    run()
    assert finished["rows"] == [(1, 3, 1), (2, 1, 1)]


def test_a_second_run_of_a_document_is_finished_too(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", RESULT)
    row = lambda b, n, hours: (1, b, n, "Processed", times(spark, hours * HOUR))
    feed.add([row(0, 2, 0), row(1, 2, 0)])
    feed.add([row(0, 2, 1), row(0, 2, 1)])
    feed.add([row(1, 2, 1)])
    done = runs.stream_gather(feed.stream())
    sinks.updates_to(done, f"{tmp_path}/g", f"{tmp_path}/l", True).awaitTermination()
    found = spark.read.schema(done.schema).parquet(f"{tmp_path}/g").select("started_at", "n_reported")
    assert rows(found) == [(times(spark, 0), 2), (times(spark, HOUR), 2)]


RESULT = "doc_id int, batch_no int, n_batches int, status string, started_at timestamp"
RUN = "doc_id int, started_at timestamp, n_batches int"
REPORT = "doc_id int, started_at timestamp, batch_no int, status string, reported_at timestamp"


def test_every_run_ends_once_also_over_restarts(spark, tmp_path):
    starts, reports = Feed(spark, tmp_path / "s", RUN), Feed(spark, tmp_path / "r", REPORT)
    begun = lambda doc, hour, n: (doc, times(spark, hour * HOUR), n)

    def report(doc, hour, batch, after, status="Processed"):
        return (doc, times(spark, hour * HOUR), batch, status, times(spark, (hour + after) * HOUR))

    def run():
        runs.start_outcomes(
            starts.stream(), reports.stream(), f"{tmp_path}/out", f"{tmp_path}/log", True
        ).awaitTermination()
        found = spark.read.parquet(f"{tmp_path}/out")
        return [tuple(r)[:1] + tuple(r)[1:] for r in rows(found.select("doc_id", "n_reported", "n_failed", "outcome"))]

    starts.add([begun(1, 0, 2), begun(2, 0, 1), begun(3, 0, 2), begun(4, 0, 1)])
    reports.add([report(1, 0, 0, 1), report(1, 0, 1, 2), report(1, 0, 1, 2)])
    reports.add([report(3, 0, 0, 3, "Failed"), report(1, 0, 1, 9, "Failed")])
    assert run() == []
    # Time goes on: document 2 never reports, 4 does so too late.
    reports.add([report(4, 0, 0, 25)])
    starts.add([begun(1, 30, 1)])
    reports.add([report(1, 30, 0, 1)])
    assert run() == [(1, 2, 1, "finished"), (2, 0, 0, "never reported"), (3, 1, 1, "unfinished"),
                     (4, 0, 0, "never reported")]
    starts.add([begun(5, 70, 1)])
    reports.add([report(5, 70, 0, 1)])
    assert run()[1] == (1, 2, 1, "finished") and len(run()) == 5


def ends(spark, feed, folder):
    with sinks.rocksdb_state(spark):
        upload_state.start_outcomes(
            feed.stream(), f"{folder}/ends", f"{folder}/log", True
        ).awaitTermination()
    return rows(spark.read.parquet(f"{folder}/ends").select("upload_id", "outcome", "n_chunks", "n_rejected", "n_late"))


def test_uploads_with_state_end_as_complete_expired_or_late(spark, feed, tmp_path):
    feed.add([chunk(spark, "fine", 2, 3, ""), chunk(spark, "fine", 0, 3, ""), chunk(spark, "stuck", 0, 2, "")])
    feed.add([chunk(spark, "fine", 0, 3, ""), chunk(spark, "bad", 5, 2, ""), chunk(spark, "bad", 0, 2, "")])
    assert ends(spark, feed, tmp_path) == []
    feed.add([chunk(spark, "fine", 1, 3, ""), chunk(spark, "bad", 1, 2, ""), chunk(spark, "bad", None, 2, "")])
    assert ends(spark, feed, tmp_path) == [("fine", "complete", 3, 0, 0)]
    feed.add([chunk(spark, "fine", 1, 3, ""), chunk(spark, "later", 0, 2, "", 25 * HOUR)])
    now = [("bad", "expired", 2, 2, 0), ("fine", "complete", 3, 0, 0), ("stuck", "expired", 1, 0, 0)]
    assert ends(spark, feed, tmp_path) == now
    # What comes after the end is told, until the state is gone.
    feed.add([chunk(spark, "stuck", 1, 2, ""), chunk(spark, "new", 0, 2, "", 0)])
    now = sorted([*now, ("stuck", "late", 1, 0, 1), ("new", "late", 0, 0, 1)])
    assert ends(spark, feed, tmp_path) == now
    feed.add([chunk(spark, "last", 0, 2, "", 90 * HOUR)])
    now = sorted([*now, ("later", "expired", 1, 0, 0)])
    assert ends(spark, feed, tmp_path) == now
    feed.add([chunk(spark, "stuck", 1, 2, "")])
    assert ends(spark, feed, tmp_path) == now


def test_ranges_of_chunk_indices():
    rng = random.Random(4)
    for _ in range(200):
        held, ranges = set(), np.zeros((0, 2), dtype="<i8")
        for _ in range(rng.randint(1, 6)):
            new = [rng.randint(0, 30) for _ in range(rng.randint(0, 8))]
            held |= set(new)
            ranges = upload_state.merged(ranges, np.array(new, dtype="<i8"))
            listed = [i for a, b in ranges for i in range(a, b + 1)]
            assert listed == sorted(held)
            assert all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("name", ["stream_assemble", "stream_upload_to_files"])
def test_stateful_upload_queries_take_several_batches(spark, name, monkeypatch):
    from folioflow.plans import queries

    batches = []
    for starter in ("start_completions", "start_files"):
        inner = getattr(uploads, starter)

        def started(*args, _inner=inner, **kwargs):
            query = _inner(*args, **kwargs)
            query.awaitTermination()
            batches.append(sum(p.numInputRows > 0 for p in query.recentProgress))
            return query

        monkeypatch.setattr(uploads, starter, started)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert batches and batches[0] >= 4
