"""The live summary of projects against the batch one, after each micro-batch."""

from conftest import rows
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.operators import catalog
from folioflow.streaming import sinks, summary

SCHEMA = "file_id long, project_id long, status string, ts timestamp, event_id long"


def test_equals_the_batch_summary_after_each_micro_batch(spark, tmp_path):
    clients = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    projects = spark.createDataFrame(
        [(1, "x", 1, 0), (2, "y", 2, 0), (3, "none", 2, 0)],
        "id int, name string, client_id int, user_id int")
    new, busy, done, bad = rules.NOT_PROCESSED, rules.PROCESSING, rules.PROCESSED, rules.FAILED
    batches = [
        [(1, 1, new, 10, 1), (2, 1, new, 10, 2), (3, 2, busy, 10, 3), (3, 2, new, 9, 4)],
        [(1, 1, busy, 20, 5), (1, 1, done, 30, 6), (4, 2, new, 20, 7)],
        # Late, repeated, a tie that the larger event wins, and events that lack something.
        [(1, 1, bad, 25, 8), (1, 1, done, 30, 6), (2, 1, bad, 10, 9), (5, None, new, 30, 10),
         (None, 1, new, 30, 11), (6, 1, None, 30, 12)],
        # Moved to another project in the same state.
        [(2, 2, bad, 40, 13), (3, 2, busy, 50, 14)],
    ]
    seen = []
    for batch in batches:
        frame = spark.createDataFrame(
            [(f, p, s, None, e) for f, p, s, _, e in batch], SCHEMA).drop("ts")
        times = spark.createDataFrame([(e, t) for _, _, _, t, e in batch], "event_id long, t long").distinct()
        timed = frame.join(times, "event_id").select(
            "file_id", "project_id", "status", F.timestamp_seconds("t").alias("ts"), "event_id")
        timed.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with sinks.rocksdb_state(spark):
            stream = sinks.file_stream(spark, f"{tmp_path}/in", timed.schema)
            summary.start_changes(stream, f"{tmp_path}/out", f"{tmp_path}/log", True).awaitTermination()
        seen += batch
        # In plain Python: the last whole event of each file.
        last = {}
        for file_id, project, state, at, event in seen:
            if None not in (file_id, project, state) and (at, event) > last.get(file_id, ((-1, -1),))[0]:
                last[file_id] = ((at, event), project, state)
        files = spark.createDataFrame(
            [(f, p, s) for f, (_, p, s) in last.items()], "id long, project_id long, status string")
        changes = spark.read.parquet(f"{tmp_path}/out")
        assert rows(summary.live_summary(clients, projects, changes)) == rows(
            catalog.project_summary(clients, projects, files))
    # Only what changed was written: 3 new; 1 moved and 1 new; 1 moved; 1 moved.
    assert changes.count() == 3 + 3 + 2 + 2
