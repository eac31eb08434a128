import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from folioflow.functions import names, rules
from folioflow.operators import ingest, status

BATCHES = {
    "ok": ["a.pdf", "b.PDF"],
    "stop": ["a.pdf", "b.txt", "c.pdf", "d.doc"],
    "none": ["a.txt"],
}


@pytest.fixture(scope="module")
def uploads(spark):
    data = [(b, i, n) for b, files in BATCHES.items() for i, n in enumerate(files)]
    return spark.createDataFrame(data, "batch string, pos int, file_name string").repartition(4)


@pytest.mark.parametrize("mode,want", [
    ("prefix", {("ok", 0), ("ok", 1), ("stop", 0)}),
    ("all_or_nothing", {("ok", 0), ("ok", 1)}),
    ("skip_bad", {("ok", 0), ("ok", 1), ("stop", 0), ("stop", 2)}),
])
def test_bulk_modes(uploads, mode, want):
    marked = ingest.ingest_bulk(uploads, mode)
    accepted = ingest.accepted_rows(marked)
    rejected = ingest.rejected_rows(marked)
    assert {(r.batch, r.pos) for r in accepted.collect()} == want
    assert accepted.count() + rejected.count() == uploads.count()
    assert all(r.reject_reason for r in rejected.collect())
    with pytest.raises(ValueError):
        ingest.ingest_bulk(uploads, "other")


def test_checks_split_every_row(spark, uploads):
    users = spark.createDataFrame([(1, "x@a.example"), (2, "x@b.example"), (3, None)], "id int, email string")
    marked = ingest.filter_domain(users, ["@a.example"])
    assert rows(marked.select("id", "accepted")) == [(1, True), (2, False), (3, False)]
    blanks = spark.createDataFrame([("a", "b"), (" ", "b"), (None, "")], "client string, project string")
    needed = ingest.require_fields(blanks, "client", "project")
    assert rows(needed.select("accepted", "reject_reason")) == [
        (False, "client is required"), (False, "client is required; project is required"), (True, None)]
    assert ingest.accepted_rows(ingest.filter_extension(uploads)).count() == 4


def test_orphans(spark):
    files = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, project_id int")
    projects = spark.createDataFrame([(7,)], "id int")
    marked = ingest.orphan_check(files, projects)
    assert rows(marked) == [(1, 7, True, None), (2, 8, False, rules.NO_PROJECT),
                            (3, None, False, rules.NO_PROJECT)]


def test_unique_first(spark):
    rng = random.Random(1)
    keys = [None if rng.random() < .1 else "hot" if rng.random() < .4 else f"k{rng.randint(0, 40)}"
            for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(keys)), "id int, email string").repartition(5)
    marked = ingest.unique_first(frame, F.col("email"), "id")
    want = {keys.index(k) for k in set(keys)}
    assert {r.id for r in marked.where("accepted").collect()} == want
    assert marked.count() == 500


def test_upsert_gives_new_names_ids_in_order_of_use(spark):
    clients = spark.createDataFrame([(3, "old"), (7, "other")], "id int, name string")
    asked = ["new b", "old", "new a", "new b", "old", "new c"] + ["new a"] * 50
    requests = spark.createDataFrame(
        [(i, c, f"p{i % 3}", 1) for i, c in enumerate(asked)],
        "pos long, client_name string, project_name string, user_id int").repartition(5)
    after = ingest.upsert_clients(clients, requests)
    assert rows(after) == [(10, "new c"), (3, "old"), (7, "other"), (8, "new b"), (9, "new a")]
    projects = spark.createDataFrame([(100, "p0", 3, 1)], "id int, name string, client_id int, user_id int")
    added = ingest.upsert_projects(projects, after, requests)
    ids = {"old": 3, "new b": 8, "new a": 9, "new c": 10}
    assert rows(added) == rows(spark.createDataFrame(
        [(101 + i, f"p{i % 3}", ids[c], 1) for i, c in enumerate(asked)],
        "id long, name string, client_id long, user_id int"))


def test_new_files_defaults(spark):
    existing = spark.createDataFrame([(5, 1, "x.pdf", "keep")], "id long, project_id int, file_name string, option string")
    uploads = spark.createDataFrame(
        [(20, 1, "b.pdf", 10, "uploads/b.pdf"), (10, 2, "a.pdf", 3_000_000_000, "uploads/a.pdf")],
        "pos long, project_id int, file_name string, file_size long, file_path string")
    made = F.lit("2024-05-01 10:00:00").cast("timestamp")
    added = ingest.new_files(uploads, existing, made)
    got = {r.id: r for r in added.collect()}
    assert (got[6].file_name, got[7].file_name) == ("a.pdf", "b.pdf")
    assert got[6].file_size == 3_000_000_000 and got[6].status == "Not processed"
    assert got[6].completed_at is None and got[6].uuid != got[7].uuid
    assert rows(added) == rows(ingest.new_files(uploads, existing, made))
    union = ingest.bulk_union(existing, added)
    assert union.count() == 3 and union.where("option = 'keep'").count() == 1
    assert ingest.next_ids(uploads, existing.limit(0), "pos").agg(F.min("id")).first()[0] == 1


def cut(text, size):
    return [text[i:i + size] for i in range(0, len(text), size)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abcé\n", min_size=1, max_size=60), min_size=1, max_size=5), st.randoms())
def test_assembly_does_not_depend_on_order_or_repeats(spark, texts, rng):
    data = [(u, i, len(cut(t, 3)), body) for u, t in enumerate(texts) for i, body in enumerate(cut(t, 3))]
    data += rng.choices(data, k=5)
    rng.shuffle(data)
    chunks = spark.createDataFrame(data, "upload_id int, chunk_index int, total_chunks int, body string")
    segments = ingest.assemble_chunks(chunks.repartition(3), segment_chunks=4)
    got = {}
    for r in sorted(segments.collect()):
        assert r.n_chunks <= 4
        got[r.upload_id] = got.get(r.upload_id, "") + r.body
    assert got == dict(enumerate(texts))


@pytest.fixture(scope="module")
def chunks(spark):
    data = [("whole", i, 3, 1, bytes([65 + i])) for i in (2, 0, 1)]
    data += [("open", i, 3, 1, b"x") for i in (0, 2)]  # the middle chunk is missing
    data += [("single", 0, 1, 1, b"one")]
    data += [("again", 0, 2, 1, b"old"), ("again", 0, 2, 2, b"new"), ("again", 1, 2, 1, b"!")]
    data += [("stray", 5, 2, 1, b"?"), ("stray", 0, 2, 1, b"?")]  # an index beyond the total
    return spark.createDataFrame(
        data, "upload_id string, chunk_index int, total_chunks int, seq int, body binary")


def test_only_complete_uploads_are_assembled(chunks):
    segments = ingest.assemble_chunks(chunks, "seq")
    assert {r.upload_id: bytes(r.body) for r in segments.collect()} == {
        "whole": b"ABC", "single": b"one", "again": b"new!"}
    assert rows(ingest.upload_sizes(chunks, "seq").select("upload_id", "n_chunks", "file_size")) == [("again", 2, 4), ("single", 1, 3), ("whole", 3, 3)]
    manifest = {r.upload_id: r.complete for r in ingest.upload_manifest(chunks).collect()}
    assert manifest == {"whole": True, "open": False, "single": True, "again": True, "stray": False}


def test_unusable_chunks_are_kept_as_rejects(spark):
    """An upload with a chunk that has no place is not complete, even if the others are all there."""
    data = [("u", 0, 1, "a"), ("u", 1, 1, "b"), ("v", None, 2, "c"), ("w", 0, None, "d"), ("x", 0, 1, "e")]
    chunks = spark.createDataFrame(data, "upload_id string, chunk_index int, total_chunks int, body string")
    manifest = {r.upload_id: (r.n_chunks, r.n_rejected, r.complete) for r in ingest.upload_manifest(chunks).collect()}
    assert manifest == {"u": (1, 1, False), "v": (0, 1, False), "w": (0, 1, False), "x": (1, 0, True)}
    rejects = ingest.rejected_rows(ingest.check_chunks(chunks))
    assert sorted(r.body for r in rejects.collect()) == ["b", "c", "d"]
    assert {r.upload_id for r in ingest.assemble_chunks(chunks).collect()} == {"x"}


def test_uploads_become_files(spark):
    data = [(1, 0, 2, 1, "ab", "a b.pdf", 5), (1, 1, 2, 1, "é", "a b.pdf", 5), (1, 1, 2, 2, "ée", "a b.pdf", 5),
            (2, 0, 1, 1, "x", "n.txt", 5), (3, 0, 1, 1, "x", "n.pdf", 9), (4, 0, 2, 1, "x", "open.pdf", 5)]
    chunks = spark.createDataFrame(
        data, "upload_id long, chunk_index int, total_chunks int, seq int, body string, file_name string, project_id int")
    projects = spark.createDataFrame([(5,)], "id int")
    files = {r.pos: r for r in ingest.upload_files(chunks, projects, "seq").collect()}
    assert set(files) == {1, 2, 3}
    assert (files[1].file_name, files[1].file_size, files[1].accepted) == ("a_b.pdf", 5, True)
    assert files[1].file_path == "uploads/5/1/a_b.pdf"
    assert files[2].reject_reason.startswith("Invalid file type") and files[3].reject_reason == "Project not found"


def test_progress(spark):
    frame = spark.createDataFrame([(1, i) for i in range(3)], "upload_id int, chunk_index int")
    assert [r.percent for r in ingest.upload_progress(frame).orderBy("chunk_index").collect()] == [33, 66, 100]


def test_latest_status_does_not_depend_on_order(spark):
    rng = random.Random(4)
    states = ["Not processed", "Processing", "Processed", "Failed"]
    data = [(rng.choice([1, 1, 1, 2, 3]), rng.choice(states), 1_700_000_000 + rng.randint(0, 20), e)
            for e in range(300)]
    want = {}
    for f, s, t, e in data:
        want[f] = max(want.get(f, (0, 0, "")), (t, e, s))
    for seed in (1, 2):
        random.Random(seed).shuffle(data)
        events = spark.createDataFrame(data, "file_id int, status string, t long, event_id int")
        events = events.withColumn("ts", F.timestamp_seconds("t")).repartition(4)
        got = status.status_latest(events).collect()
        assert {r.file_id: r.status for r in got} == {f: w[2] for f, w in want.items()}
        for r in got:
            assert (r.completed_at == r.updated_at) == (r.status in ("Processed", "Failed"))


def test_results_of_unknown_files_drop_out(spark):
    files = spark.createDataFrame([(1, 4, "a.pdf")], "id long, project_id int, file_name string")
    results = spark.createDataFrame([(1, 0, "Failed"), (2, 0, "Processed")], "doc_id long, batch_no int, status string")
    assert rows(status.results_to_file(results, files)) == [(1, 0, "Failed", 4, "a.pdf")]


def test_outputs_resolve_for_upper_case_names(spark):
    from folioflow.sources.storage import resolve_outputs
    files = spark.createDataFrame(
        [(1, "a.PDF", "uploads/1/a.PDF"), (2, "b.pdf", "uploads/2/b.pdf")],
        "id int, file_name string, file_path string")
    outputs = spark.createDataFrame([("uploads/1/a_OCRed_with_bookmarks.pdf",)], "path string")
    got = resolve_outputs(files, outputs)
    assert rows(got.select("id", "state")) == [(1, "found"), (2, "missing")]
    name = files.select(names.outlined_name(F.col("file_name")).alias("n")).first().n
    assert got.where("id = 1").first().output_name == name


def test_status_reaches_the_files(spark):
    files = spark.createDataFrame([(1, "Not processed"), (2, "Processing"), (3, "Processed")],
                                  "id long, status string")
    at = spark.sql("select timestamp'2024-01-01 00:00:00' t").first().t
    latest = spark.createDataFrame([(1, "Failed", at), (2, "Processing", None), (9, "Failed", at)],
                                   "file_id long, status string, completed_at timestamp")
    got = status.apply_status(files, latest)
    assert got.columns == ["id", "status", "completed_at"]
    assert rows(got) == [(1, "Failed", at), (2, "Processing", None), (3, "Processed", None)]


def test_runs_start_for_known_files_with_a_valid_option(spark):
    files = spark.createDataFrame([(1,), (2,)], "id long")
    requests = spark.createDataFrame([(1, None), (2, "FAST"), (3, "basic")], "file_id long, option string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = rows(status.start_runs(requests, files, now).drop("ts"))
    assert got == [(1, "basic", True, None, "Processing"),
                   (2, "fast", False, "Invalid OCR option provided.", None),
                   (3, "basic", False, "File not found", None)]


def test_chunks_without_a_time_are_kept(spark):
    """A missing order is the lowest; it loses no chunk."""
    chunks = spark.createDataFrame(
        [(1, 0, 2, "aa", 0), (1, 1, 2, "bb", None), (2, 0, 1, "old", None), (2, 0, 1, "new", 3)],
        "upload_id int, chunk_index int, total_chunks int, body string, sent int",
    )
    found = ingest.assemble_chunks(chunks, "sent").select("upload_id", "body").collect()
    assert {r.upload_id: r.body for r in found} == {1: "aabb", 2: "new"}
    sizes = {r.upload_id: (r.n_chunks, r.file_size) for r in ingest.upload_sizes(chunks, "sent").collect()}
    assert sizes == {1: (2, 4), 2: (1, 3)}


def test_bodies_are_shuffled_once(spark):
    chunks = spark.range(100).selectExpr(
        "id div 10 upload_id", "id % 10 chunk_index", "10L total_chunks", "string(id) body", "id sent")
    plan = ingest.assemble_segments(chunks, "sent")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_names_in_other_scripts_are_taken(spark):
    names_sent = ["文档.pdf", "文档.txt", "plan b.PDF", "...", "pdf"]
    chunks = spark.createDataFrame(
        [(i, 0, 1, "x", 0, name, 1) for i, name in enumerate(names_sent)],
        "upload_id int, chunk_index int, total_chunks int, body string, sent int, file_name string, project_id int",
    )
    projects = spark.createDataFrame([(1,)], "id int")
    found = {r.pos: (r.file_name, r.accepted) for r in ingest.upload_files(chunks, projects, "sent").collect()}
    assert found[0] == ("0.pdf", True) and not found[1][1] and found[2] == ("plan_b.PDF", True)
    assert found[3] == ("3", False) and not found[4][1]
