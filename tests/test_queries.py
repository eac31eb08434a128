"""Every named query against its SQL twin, and the plans of the large ones."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

from folioflow.plans import oracle, queries  # noqa: E402
from folioflow.sources import storage  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, TWINS = queries.QUERIES, oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    found = duck.execute(TWINS[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(
        columns, found.fetchall())
    text = plan(frame)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


def test_file_listing_reads_sizes(spark):
    found = storage.scan_documents(spark, FOLDER, "*.parquet", content=False).collect()
    assert {(r.file_name, r.file_size) for r in found} == {
        (p.name, p.stat().st_size) for p in Path(FOLDER).iterdir()}


def test_stored_documents_come_back_whole(spark):
    """Every document, empty and null ones included."""
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert QUERIES["scan_documents"](spark, FOLDER).count() == documents.count()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_pushed_down(spark):
    assert "ReadSchema: struct<n_nationkey:int,n_name:string,n_regionkey:int>" in plan(
        QUERIES["eq_filter"](spark, FOLDER))
    assert "EqualTo(n_regionkey,3)" in plan(QUERIES["eq_filter"](spark, FOLDER))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint" in plan(
        QUERIES["upload_progress"](spark, FOLDER))
    assert "text" not in plan(QUERIES["upload_progress"](spark, FOLDER))


@pytest.mark.parametrize("name", ["burst", "document_run", "output_path", "require_fields"])
def test_narrow_queries_do_not_shuffle(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    joins = text.count("BroadcastExchange")
    assert text.count("Exchange") == joins
