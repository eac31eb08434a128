"""Batches spread by cost, rows opened by page number, and search by trigrams."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioflow.operators import balance, catalog, recognise
from folioflow.sources import sorted_pages, text_index


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def batches(spark, sizes):
    data = [(d, 0, 1, 1, ["x" * size]) for d, size in enumerate(sizes)]
    schema = "doc_id long, batch_no int, start_page int, end_page int, pages array<string>"
    return spark.createDataFrame(data, schema)


def loads(dealt):
    found = dealt.groupBy(F.spark_partition_id().alias("task")).agg(
        F.sum(balance.text_cost()).alias("cost"), F.max(balance.text_cost()).alias("dearest"))
    return {r.task: (r.cost, r.dearest) for r in found.collect()}


def test_tasks_cost_about_the_same(spark):
    rng = random.Random(3)
    sizes = [int(20 * rng.paretovariate(1.1)) for _ in range(3000)]
    sizes = [min(size, 2000) for size in sizes]
    found = loads(balance.spread_by_cost(batches(spark, sizes), 12))
    mean = sum(sizes) / 12
    assert set(found) == set(range(12))
    assert max(cost for cost, _ in found.values()) <= 1.3 * mean
    assert sum(cost for cost, _ in found.values()) == sum(sizes)
    # The dearest come first.
    dearest = [found[task][1] for task in range(12)]
    assert dearest == sorted(dearest, reverse=True)


def test_equal_and_free_batches_are_spread(spark):
    for sizes in ([7] * 400, [0] * 400):
        dealt = balance.spread_by_cost(batches(spark, sizes), 4)
        counts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 400 and len(counts) == 4 and max(counts) <= 101


def test_one_batch_with_most_of_the_cost(spark):
    found = loads(balance.spread_by_cost(batches(spark, [100_000, *[10] * 300]), 3))
    assert sum(cost for cost, _ in found.values()) == 103_000


def test_nothing_to_spread_and_wrong_numbers(spark):
    none = batches(spark, [5]).limit(0)
    assert balance.spread_by_cost(none, 4).count() == 0
    with pytest.raises(ValueError):
        balance.task_numbers(none.select("doc_id", "batch_no", F.lit(1).alias("cost")), 0)


def test_null_pages_cost_nothing(spark):
    schema = "doc_id long, batch_no int, pages array<string>"
    data = [(1, 0, None), (2, 0, [None, "ab"]), (3, 0, [])]
    costs = spark.createDataFrame(data, schema).select("doc_id", balance.text_cost(page_cost=10).alias("c"))
    assert rows(costs) == [(1, 0), (2, 22), (3, 0)]
    dealt = balance.spread_by_cost(spark.createDataFrame(data, schema), 2)
    assert sorted(r.doc_id for r in dealt.collect()) == [1, 2, 3]


def test_spread_batches_are_recognised_alike(spark):
    made = batches(spark, [3, 50, 0, 9, 9])

    def upper(pages):
        return [page.as_py().upper() for page in pages]

    dealt = recognise.recognise_batches(balance.spread_by_cost(made, 3), upper)
    assert rows(dealt) == rows(recognise.recognise_batches(made, upper))


NAMES = ["Asia", "asia", None, "Europe", "a", "", "Äsia"]


def listing(spark, n=503):
    data = [(i, NAMES[i * i % len(NAMES)], f"file {i}.pdf") for i in range(n)]
    return spark.createDataFrame(data, "file_id long, client_name string, file_name string")


@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_number_equal_sorted_pages(spark, tmp_path, descending):
    table = listing(spark)
    sorted_pages.create(table, f"{tmp_path}/s", "client_name", descending=descending, parts=9)
    assert sorted_pages.page_total(spark, f"{tmp_path}/s", 20) == 26
    for page in (1, 2, 13, 25, 26, 27):
        opened = sorted_pages.page_at(spark, f"{tmp_path}/s", table.schema, page, 20)
        assert opened.columns == table.columns
        # In order, ties by key.
        assert opened.collect() == catalog.paginate(table, page, 20, "client_name", descending=descending).collect()


def test_a_page_reads_only_the_ranges_that_hold_it(spark, tmp_path):
    table = listing(spark)
    sorted_pages.create(table, f"{tmp_path}/s", "client_name", parts=9)
    opened = sorted_pages.page_at(spark, f"{tmp_path}/s", table.schema, 26, 20)
    assert "TakeOrdered" not in plan(opened) and "Limit" not in plan(opened)
    assert "PartitionFilters: [_part" in plan(opened) or "PartitionFilters: [isnotnull(_part" in plan(opened)
    files = opened.select(F.col("file_id"), F.input_file_name().alias("f")).select("f").distinct().count()
    assert files <= 2


def test_pages_of_no_rows(spark, tmp_path):
    table = listing(spark).limit(0)
    sorted_pages.create(table, f"{tmp_path}/s", "client_name")
    assert sorted_pages.page_total(spark, f"{tmp_path}/s", 20) == 0
    assert sorted_pages.page_at(spark, f"{tmp_path}/s", table.schema, 1, 20).count() == 0
    for page, size in ((0, 20), (1, 7)):
        with pytest.raises(ValueError):
            sorted_pages.page_at(spark, f"{tmp_path}/s", table.schema, page, size)


TEXTS = ["a", "as", "asia", "ASIA FILE 1", "file 49", ".pdf", "e 30", "europe file 100.pdf", "Äs",
         "Äsia file", "xyz", "aaa", "  ", "pdf pdf", "%", "file _.pdf", "sia file 10.pdf xxxxx"]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    table = listing(spark)
    columns = ["client_name", "file_name"]
    for part in range(3):
        text_index.append(table.where(F.col("file_id") % 3 == part), f"{tmp_path}/i", columns=columns)
    for text in TEXTS:
        found = text_index.search(table, f"{tmp_path}/i", text, columns=columns)
        assert rows(found) == rows(catalog.search_rows(table, text, columns)), text


def test_rarest_trigrams_come_first(spark, tmp_path):
    table = listing(spark)
    text_index.append(table, f"{tmp_path}/i", columns=["client_name", "file_name"])
    grams = text_index.rarest_grams(spark, f"{tmp_path}/i", "file 499.pdf")
    assert grams[0] == "499" and len(grams) == text_index.RAREST
    assert text_index.rarest_grams(spark, f"{tmp_path}/i", "file zz") is None


def test_index_of_short_and_missing_cells(spark, tmp_path):
    table = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "abc")], "file_id long, file_name string")
    text_index.append(table, f"{tmp_path}/i", columns=["file_name"])
    for text in ("ab", "abc", "abcd", ""):
        found = text_index.search(table, f"{tmp_path}/i", text, columns=["file_name"])
        assert rows(found) == rows(catalog.search_rows(table, text, ["file_name"]))


def brute_postings(texts):
    found = {}
    for at, text in enumerate(texts):
        for gram in {text[i : i + 3] for i in range(len(text) - 2)}:
            found.setdefault(gram, []).append(at)
    return found


@pytest.mark.parametrize("letters", ["ab", "abc 0123456é", "\U0001f600文档a", "".join(map(chr, range(0x4E00, 0x6E00)))])
def test_postings_hold_the_places_of_their_trigram(letters):
    rng = random.Random(5)
    for sizes in ([0], [1, 2], [3], [0, 1, 2, 3, 5, 30]):
        for n in (1, 2, 9, 2000):
            texts = ["".join(rng.choices(letters, k=rng.choice(sizes))) for _ in range(n)]
            found = {g: (size, text_index.hits_of([(size, p)], n).nonzero()[0].tolist(), len(p))
                     for g, size, p in text_index.postings_of(texts)}
            assert {g: places for g, (_, places, _) in found.items()} == brute_postings(texts)
            assert all(size == len(places) and held <= -(-n // 8) or held == 2 * size for size, places, held in found.values())


def test_an_index_holds_a_posting_for_a_chunk_and_trigram(spark, tmp_path, monkeypatch):
    """Not one for each row and trigram, which for 54 million rows are billions."""
    texts = [f"some words in all rows {i % 7}" for i in range(4000)]
    table = spark.createDataFrame(list(enumerate(texts)), "file_id long, file_name string").coalesce(1)
    for rows_of_chunk, chunks in ((1 << 16, 1), (1500, 3)):
        monkeypatch.setattr(text_index, "CHUNK_ROWS", rows_of_chunk)
        root = f"{tmp_path}/{chunks}"
        text_index.append(table, root, columns=["file_name"])
        postings = spark.read.parquet(f"{root}/postings")
        assert postings.count() == chunks * len(brute_postings(texts))
        assert postings.agg(F.sum("n_rows")).first()[0] == sum(map(len, brute_postings(texts).values()))
        assert postings.agg(F.max(F.length("places"))).first()[0] <= 500
        for text in ("rows 3", "words", "s 7", "zzz"):
            found = text_index.search(table, root, text, columns=["file_name"])
            assert rows(found) == rows(catalog.search_rows(table, text, ["file_name"])), text


@pytest.mark.parametrize("limit", ["CHUNK_ROWS", "CHUNK_CHARACTERS"])
def test_chunks_across_arrow_batches_and_text_keys(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(text_index, limit, 37)
    table = listing(spark).withColumn("file_id", F.concat(F.lit("k"), "file_id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        text_index.append(table, f"{tmp_path}/i", columns=["client_name", "file_name"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for text in ("asia file 1", "file 49", "äsia", "499"):
        found = text_index.search(table, f"{tmp_path}/i", text, columns=["client_name", "file_name"])
        assert rows(found) == rows(catalog.search_rows(table, text, ["client_name", "file_name"])), text
