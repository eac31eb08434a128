import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioflow.operators import catalog, maintenance


@pytest.fixture(scope="module")
def clients(spark):
    return spark.createDataFrame([(1, "Big Co"), (2, "a::b"), (3, "big co"), (4, "Idle")],
                                 "id int, name string")


@pytest.fixture(scope="module")
def projects(spark):
    data = [(10, "Alpha", 1, 1), (11, "Alpha", 1, 2), (12, "x::y", 2, 1), (13, "Empty", 3, 1)]
    return spark.createDataFrame(data, "id int, name string, client_id int, user_id int")


STATES = ["Processed", "Not processed", "Processing", "Failed"]


@pytest.fixture(scope="module")
def files(spark):
    # Project 10 owns most of all files.
    data = [(i, 10 if i % 4 else 11 + i % 3 % 2, f"File {i % 7}.pdf", STATES[i % 4]) for i in range(200)]
    frame = spark.createDataFrame(data, "id long, project_id int, file_name string, status string")
    return frame.withColumn(
        "created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 50 * 60))


def test_projects_with_files_keeps_everything_in_order(clients, projects, files):
    listing = catalog.projects_with_files(projects, clients, files, part_files=16)
    parts = sorted(listing.collect(), key=lambda r: (r.project_id, r.part_no))
    assert max(len(r.files) for r in parts) <= 16
    got = {}
    for r in parts:
        got.setdefault(r.project_id, []).extend(f.id for f in r.files)
    want = {p.id: [] for p in projects.collect()}
    for f in sorted(files.collect()):
        want[f.project_id].append(f.id)
    assert got == want and got[13] == []
    empty = next(r for r in parts if r.project_id == 13)
    assert (empty.part_no, empty.client_name) == (0, "big co")


def test_json_keeps_nulls(clients, projects, files):
    listing = catalog.project_json(catalog.projects_with_files(projects, clients, files))
    bodies = [json.loads(r.body) for r in listing.collect()]
    for body in bodies:
        assert list(body) == ["name", "client_name", "files"]
        for f in body["files"]:
            assert (f["download_url"] is not None) == (f["status"] == "Processed")
            assert (f["error_url"] is not None) == (f["status"] == "Failed")


def test_catalog_drops_empty_projects_and_summary_keeps_them(clients, projects, files):
    flat = catalog.catalog(clients, projects, files)
    assert flat.count() == 200 and "Empty" not in {r.project_name for r in flat.collect()}
    summary = {(r.client_name, r.project_name): r for r in
               catalog.project_summary(clients, projects, files).collect()}
    # Two projects named Alpha count together; names with :: stay whole.
    assert set(summary) == {("Big Co", "Alpha"), ("a::b", "x::y"), ("big co", "Empty")}
    assert sum(r.n_files for r in summary.values()) == 200
    assert summary["big co", "Empty"].n_files == 0
    for r in summary.values():
        assert r.n_files == r.n_not_processed + r.n_processing + r.n_processed + r.n_failed


def test_lookups(clients, projects):
    assert rows(catalog.name_lookup(clients, projects, "BIG_CO")) == [(10, "Alpha"), (11, "Alpha")]
    assert rows(catalog.name_lookup(clients, projects, "nobody")) == []
    assert rows(catalog.first_match(clients, F.lower("name"))) == [
        (1, "Big Co"), (2, "a::b"), (4, "Idle")]
    owners, named = catalog.distinct_names(projects, clients)
    assert rows(owners) == [("Big Co",), ("a::b",), ("big co",)]
    assert rows(named) == [("Alpha",), ("Empty",), ("x::y",)]
    assert rows(catalog.scan_clients(clients)) == rows(clients)


def test_filters(spark, projects, files):
    assert catalog.eq_filter(projects, {"client_id": 1, "user_id": 2}).first().id == 11
    short = catalog.in_filter(files, "project_id", [11, 12])
    table = catalog.in_filter(files, "project_id", spark.createDataFrame([(11,), (12,), (11,)], "k int"))
    assert rows(short) == rows(table) and short.count() > 0


def test_search_covers_all_cells(clients, projects, files):
    flat = catalog.with_action(catalog.catalog(clients, projects, files))
    assert catalog.search_rows(flat, "BIG co alpha FILE 3").count() == files.where(
        (F.col("project_id") < 12) & (F.col("file_name") == "File 3.pdf")).count()
    assert catalog.search_rows(flat, "show error").count() == 50
    assert catalog.search_rows(flat, "").count() == 200


@pytest.mark.parametrize("column", ["file_name", "created_at", "status", "client_name"])
@pytest.mark.parametrize("descending", [False, True])
def test_pages_tile_the_sorted_rows(clients, projects, files, column, descending):
    flat = catalog.catalog(clients, projects, files).cache()
    fold = (lambda v: v.lower()) if column != "created_at" else (lambda v: v)
    want = sorted(flat.collect(), key=lambda r: r.file_id)
    want = sorted(want, key=lambda r: fold(r[column]), reverse=descending)
    ids = [r.file_id for r in want]
    assert [r.file_id for r in catalog.sort_rows(flat, column, descending=descending).collect()] == ids
    by_number = [r.file_id for p in (1, 2, 4, 5)
                 for r in catalog.paginate(flat, p, 50, column, descending=descending).collect()]
    assert by_number == ids[:100] + ids[150:]
    seen, last = [], None
    page = catalog.paginate(flat, 1, 50, column, descending=descending).collect()
    while page:
        seen += [r.file_id for r in page]
        last = (page[-1][column], page[-1].file_id)
        page = catalog.next_page(flat, last, 50, column, descending=descending).collect()
    assert seen == ids
    flat.unpersist()


def test_page_arguments_and_total(clients, projects, files):
    flat = catalog.catalog(clients, projects, files)
    for page, size in ((1, 25), (0, 20)):
        with pytest.raises(ValueError):
            catalog.paginate(flat, page, size, "status")
    assert tuple(catalog.page_total(flat, 30).first()) == (200, 7)
    assert tuple(catalog.page_total(flat.limit(0), 30).first()) == (0, 0)


def test_order_by_id(files):
    got = [(r.project_id, r.id) for r in catalog.order_by_id(files, "project_id").collect()]
    assert got == sorted(got)


def test_deletion_counts_before_equal_kept_plus_removed(spark, projects, files):
    ids = spark.createDataFrame([(11,), (13,), (11,), (99,)], "id int")
    done = maintenance.delete_projects(projects, files, maintenance.require_ids(ids))
    removed = {r.table_name: r.n_rows for r in done.removed.collect()}
    assert done.projects.count() + removed["projects"] == 4 and removed["projects"] == 2
    assert done.files.count() + removed["files"] == 200
    assert done.files.columns == files.columns and done.projects.columns == projects.columns
    assert {r.project_id for r in done.files.collect()} == {10, 12}
    with pytest.raises(ValueError):
        maintenance.require_ids(ids.limit(0))


def test_retention_uses_the_time_given(spark):
    frame = spark.sql("""SELECT 1 AS id, timestamp'2024-01-01 00:00:00' AS t
        UNION ALL SELECT 2, timestamp'2024-01-01 12:00:00' UNION ALL SELECT 3, NULL""")
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert rows(maintenance.keep_recent(frame, "t", now).select("id")) == [(2,), (3,)]
    marked = maintenance.mark_expired(frame, "t", now, hours=2)
    assert rows(marked.select("id", "expired")) == [(1, True), (2, True), (3, False)]
