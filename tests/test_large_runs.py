"""Steps that must not grow with the number of documents or with the rows of a task."""

from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioflow.llm import substrings
from folioflow.operators import batching, recognise
from folioflow.plans.document_run import merged_sections
from folioflow.plans.queries import QUERIES
from folioflow.sources import storage


def test_documents_share_folders_and_files_share_tasks(spark, tmp_path):
    n = 2 * storage.FOLDER_FILES + 3
    source = tmp_path / "in"
    documents = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("é\nline "), "id")).alias("text"),
    )
    documents.coalesce(1).write.parquet(str(source / "documents.parquet"))
    found = QUERIES["scan_documents"](spark, str(source))
    expected = documents.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    assert rows(found) == rows(expected)
    folders = {Path(r.file.removeprefix("file:")).parent for r in found.select(F.input_file_name().alias("file")).distinct().collect()}
    assert len(folders) == 3 and not any(list(f.glob(".*")) for f in folders)
    assert found.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism


def test_written_documents_with_repeated_and_null_keys(spark, tmp_path):
    documents = spark.createDataFrame(
        [(7, "a"), (7, "b"), (None, "c"), (8, None)], "doc_id long, text string").coalesce(1)
    storage.write_documents(documents, str(tmp_path / "out"))
    found = {p.name: sorted(p.read_text().splitlines()) for p in (tmp_path / "out").rglob("*.txt")}
    assert found == {
        "doc_id=7.txt": ["a", "b"], "doc_id=8.txt": [""], "doc_id=__HIVE_DEFAULT_PARTITION__.txt": ["c"]}


def bytes_of_call(pages):
    return pa.array([str(pc.sum(pc.binary_length(pages)).as_py())] * len(pages))


@pytest.mark.parametrize("kind", ["documents", "pages", "options"])
def test_a_call_takes_a_bounded_part_of_an_arrow_batch(spark, kind):
    """Of 3,000 rows that come in one Arrow batch of 12 MB, and one row of 2 MB."""
    text = F.concat_ws("\n", *[F.repeat(F.lit("x"), 400)] * 10)
    documents = spark.range(0, 3000, 1, 1).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") == 5, F.repeat(F.lit("y"), 2 << 20)).otherwise(text).alias("text"),
        F.when(F.col("id") % 7 > 0, "Basic").otherwise("fast").alias("option"),
    )
    if kind == "pages":
        documents = batching.pages_long(documents)
    merged = merged_sections(documents, bytes_of_call, vectorised=True, option="option" if kind == "options" else None)
    calls = merged.select("doc_id", "n_pages", "n_failed", F.col("pages")[0].alias("size")).collect()
    assert len(calls) == 3000 and sum(r.n_pages for r in calls) == 29_991
    sizes = [int(r.size) for r in calls if not r.n_failed]
    assert (2 << 20) <= max(sizes) < (3 << 20) + 4000
    assert sorted(sizes)[len(sizes) // 2] <= (1 << 20) + 4000
    assert sum(r.n_failed for r in calls) == (429 if kind == "options" else 0)


def test_blocks_of_rows_without_pages_and_of_slices():
    kind = pa.list_(pa.list_(pa.string()))
    assert list(recognise.blocks(pa.array([[], []], kind))) == [slice(0, 2)]
    assert list(recognise.blocks(pa.array([], kind))) == [slice(0, 0)]
    big = "z" * recognise.BLOCK_BYTES
    found = pa.array([[["a"]], [], [["b", None], [big]], [["c"]], []], kind)
    assert list(recognise.blocks(found)) == [slice(0, 3), slice(3, 5)]
    assert list(recognise.blocks(found.slice(2, 2))) == [slice(0, 1), slice(1, 2)]


def test_texts_are_compressed_in_small_parts():
    import zstandard

    texts = [f"text {i} é" for i in range(1000)]
    numbers = pa.array(range(1000), pa.int64())
    whole = pa.record_batch([numbers, numbers, numbers.cast(pa.int32()), pa.array(texts)],
                            names=["doc_id", "row", "tag", "text"])
    parts = list(substrings.squeezed([whole, whole.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= 64
    back = [(x["doc_id"], zstandard.decompress(x["packed"]).decode()) for p in parts for x in p.to_pylist()]
    assert back == list(enumerate(texts))


def test_a_large_tree_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver's plan names no file, and the rows are those of Spark's reader."""
    root = tmp_path / "in"
    for folder in ("", "deep", "deep/er", "sp ace%20é", "_hidden", "_a=1", ".hidden", "empty"):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for name in ("a.pdf", "b.PDF", "ü#?%41.pdf", "x{1}.pdf", "_u.pdf", "_u=1.pdf", ".d.pdf", "c.txt", "e.pdf._COPYING_"):
            if folder != "empty":
                (root / folder / name).write_bytes(f"{folder} {name}".encode())
    (root / "none.pdf").write_bytes(b"")
    (root / "broken.pdf").symlink_to(root / "gone")
    (root / "big.pdf").write_bytes(b"x" * (5 << 20))
    (root / "linked").symlink_to(root / "deep")
    for pattern in (storage.DOCUMENT_GLOB, "*.{pdf,txt}", "[!b]*"):
        for content in (True, False):
            monkeypatch.setattr(storage, "DRIVER_FILES", 1000)
            small = storage.scan_documents(spark, f"file://{root}", pattern, content)
            monkeypatch.setattr(storage, "DRIVER_FILES", 10)
            large = storage.scan_documents(spark, f"file://{root}", pattern, content)
            assert large.dtypes == small.dtypes and rows(large) == rows(small), (pattern, content)
            assert "binaryFile" not in large._jdf.queryExecution().toString()
    assert storage.scan_documents(spark, str(root)).count() == 36


def test_a_large_tree_checks_the_sums_of_hadoop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "DRIVER_FILES", 1)
    spark.createDataFrame([("a" * 1300,)], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    assert list((tmp_path / "in").glob(".part-*.crc"))
    scan = storage.scan_documents(spark, str(tmp_path / "in"), "*.txt")
    assert [bytes(r.content) for r in scan.collect()] == [b"a" * 1300 + b"\n"]
    next((tmp_path / "in").glob("part-*")).write_text("b" * 1301)
    with pytest.raises(Exception, match="checksum error"):
        scan.collect()


def test_all_documents_of_many_files_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "DRIVER_FILES", 20)
    documents = spark.range(90).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é\n"), "id")).alias("text"))
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["scan_documents"](spark, str(tmp_path))
    assert rows(found) == rows(documents.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")))
    assert "binaryFile" not in found._jdf.queryExecution().toString()
