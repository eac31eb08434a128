"""Tables in versions: deletions rewrite only the files that hold deleted rows."""

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folioflow.operators import maintenance
from folioflow.sources import versions


@pytest.fixture
def table(spark, tmp_path):
    data = spark.range(4000).select("id", (F.col("id") / 100).cast("int").alias("project_id"))
    root = f"{tmp_path}/files"
    versions.create(data, root, ["project_id", "id"], 8)
    return root, data.schema


def wanted(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "project_id int")


def test_untouched_files_keep_their_names(spark, table):
    root, schema = table
    before = versions.files(spark, root, 1)
    assert len(before) >= 4
    assert versions.delete_rows(spark, root, schema, wanted(spark, 3)) == 2
    after = versions.files(spark, root, 2)
    assert len(set(before) & set(after)) >= len(before) - 2 and set(after) != set(before)
    assert versions.read(spark, root, schema).count() == 3900
    assert versions.read(spark, root, schema, 1).count() == 4000


def test_whole_files_and_whole_tables_go(spark, table):
    root, schema = table
    versions.delete_rows(spark, root, schema, wanted(spark, *range(30)))
    assert rows(versions.read(spark, root, schema).agg(F.min("project_id"), F.count("*"))) == [(30, 1000)]
    versions.delete_rows(spark, root, schema, wanted(spark, *range(40)))
    assert versions.read(spark, root, schema).count() == 0
    assert versions.delete_rows(spark, root, schema, wanted(spark, 1)) == 4


def test_nothing_to_delete_rewrites_nothing(spark, table):
    root, schema = table
    versions.delete_rows(spark, root, schema, wanted(spark, 77))
    assert versions.files(spark, root, 2) == versions.files(spark, root, 1)


def test_a_version_is_made_once(spark, table):
    root, _ = table
    versions._commit(spark, root, 2, [])
    with pytest.raises(AnalysisException):
        versions._commit(spark, root, 2, [])


def test_paths_to_remove(spark):
    files = spark.createDataFrame(
        [(1, 7, "a.PDF", "up/7/1/a.PDF"), (2, 7, "b.pdf", "up/shared/b.pdf"), (3, 8, "b.pdf", "up/shared/b.pdf"),
         (4, 7, "c.pdf", None)],
        "id int, project_id int, file_name string, file_path string",
    )
    gone = maintenance.deleted_paths(files, spark.createDataFrame([(7,), (7,), (9,)], "id int"))
    assert rows(gone) == [
        ("up/7/1/a.PDF", "upload"), ("up/7/1/a_OCRed.pdf", "merged"),
        ("up/7/1/a_OCRed_with_bookmarks.pdf", "final"),
    ]
    with pytest.raises(ValueError):
        maintenance.delete_written(spark, {}, spark.createDataFrame([], "id int"))
