import random

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.operators import batching, merge, ordering, outline, recognise
from folioflow.plans.document_run import merged_sections, run_documents
from folioflow.sources import storage

EDGE_SIZES = [1, 9, 10, 11, 20, 21, 105]


def document(n):
    return "\n".join(f"page {i} e" for i in range(1, n + 1))


@pytest.fixture(scope="module")
def documents(spark):
    data = [(n, document(n)) for n in EDGE_SIZES] + [(1000, ""), (1001, None)]
    return spark.createDataFrame(data, "doc_id long, text string")


def flaky(pages):
    if pc.any(pc.match_substring_regex(pages, "page 1[2-4] ")).as_py():
        raise ValueError("cannot read")
    return pc.replace_substring(pages, "e", "E")


def test_ranges_tile_every_document(documents):
    found = {}
    for r in batching.burst(documents).collect():
        found.setdefault(r.doc_id, []).append((r.batch_no, r.start_page, r.end_page, len(r.pages)))
    assert sorted(found) == EDGE_SIZES
    for n, ranges in found.items():
        ranges.sort()
        want = [(b, b * 10 + 1, min(b * 10 + 10, n)) for b in range((n + 9) // 10)]
        assert [r[:3] for r in ranges] == want
        assert [r[3] for r in ranges] == [e - s + 1 for _, s, e in want]


def test_long_input_and_ranges_agree_with_whole_text(documents):
    whole = rows(batching.burst(documents))
    assert rows(batching.burst_pages(batching.pages_long(documents).repartition(5))) == whole
    counts = batching.source_page_counts(documents)
    assert {(r.doc_id, r.n_pages) for r in counts.collect()} == {
        *((n, n) for n in EDGE_SIZES), (1000, 0), (1001, 0)}
    assert rows(batching.batch_ranges(counts)) == [r[:4] for r in whole]


def test_separators_are_literal(spark):
    one = spark.createDataFrame([(1, "a|b|c")], "doc_id long, text string")
    assert [r.text for r in batching.pages_long(one, "|").orderBy("page_no").collect()] == ["a", "b", "c"]
    assert batching.source_page_counts(one, "|").first().n_pages == 3


@pytest.mark.parametrize("section_pages", [10, 20, 1000])
def test_gather_undoes_burst(documents, section_pages):
    shuffled = batching.burst(documents).orderBy(F.rand(3)).repartition(7)
    merged = merge.gather(shuffled, section_pages)
    assert merged.agg(F.max("n_pages")).first()[0] <= section_pages
    for part in (merge.merged_pages(merged), merge.merged_pages(merged, complete=True)):
        texts = part.groupBy("doc_id").agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("page_no", "text"))).text, "\n"))
        assert rows(texts) == sorted(((n, document(n)) for n in EDGE_SIZES), key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.text("ab é", max_size=4), min_size=1, max_size=35), min_size=1, max_size=4))
def test_burst_and_gather_is_the_identity(spark, texts):
    data = [(i, "\n".join(pages)) for i, pages in enumerate(texts)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    merged = merge.gather(batching.burst(frame))
    got = {r.doc_id: "\n".join(r.pages) for r in merged.collect()}
    assert got == {i: text for i, text in data if text}


def expected_results(option="basic"):
    """Brute force: status and pages by (doc_id, batch_no)."""
    found = {}
    for n in EDGE_SIZES:
        pages = document(n).split("\n")
        for b in range((n + 9) // 10):
            batch = pages[b * 10:b * 10 + 10]
            bad = any(p in {f"page {k} e" for k in (12, 13, 14)} for p in batch)
            found[n, b] = ("Failed", None) if bad else (
                "Processed", [p.replace("e", "E") for p in batch])
    return found


def test_failing_batches_are_found_in_few_calls():
    calls = []

    def function(pages):
        calls.append(len(pages))
        if "bad" in pages.to_pylist():
            raise ValueError("bad page")
        return pages

    rows_in = [[["x"] * 3 for _ in range(20)] for _ in range(10)] + [[]]
    rows_in[4][7] = ["x", "bad"]
    block = pa.array(rows_in, pa.list_(pa.list_(pa.string())))
    by_page = pa.array([False] * len(rows_in))
    stepwise = recognise.recognise_block(function, False, block, by_page)
    assert len(calls) == 200
    calls.clear()
    halved = recognise.recognise_block(function, True, block, by_page)
    assert len(calls) <= 2 * 8 + 1
    assert halved.equals(stepwise)
    out = halved.to_pylist()
    assert out[4][7] == {"pages": None, "error": "bad page"} and out[10] == []
    assert sum(r["error"] is not None for row in out for r in row) == 1
    empty = recognise.recognise_block(function, True, block.slice(10), by_page.slice(10))
    assert empty.to_pylist() == [[]]
    # A slice of a larger array keeps its own rows.
    part = recognise.recognise_block(function, True, block.slice(4, 2), by_page.slice(4, 2))
    assert part.to_pylist() == out[4:6]


@pytest.mark.parametrize("vectorised", [False, True])
@pytest.mark.parametrize("spread", [None, 3])
@pytest.mark.parametrize("option", ["basic", "advanced"])
def test_failures_are_data(documents, vectorised, spread, option):
    batches = batching.burst(documents).withColumn("option", F.lit(option))
    done = recognise.recognise_batches(batches, flaky, "option", spread, vectorised).collect()
    assert {(r.doc_id, r.batch_no): (r.status, r.pages) for r in done} == expected_results()
    for r in done:
        assert (r.error == "cannot read") == (r.status == "Failed")
        assert (r.source_pages is not None) == (r.status == "Failed")


def test_advanced_calls_once_per_page(spark):
    calls = lambda pages: pa.array([str(len(pages))] * len(pages))
    frame = spark.createDataFrame([(1, document(12))], "doc_id long, text string")
    batches = batching.burst(frame)
    seen = {}
    for option in ("basic", "ADVANCED"):
        done = recognise.recognise_batches(batches.withColumn("o", F.lit(option)), calls, "o")
        seen[option] = [r.pages for r in done.orderBy("batch_no").collect()]
    assert seen == {"basic": [["10"] * 10, ["2"] * 2], "ADVANCED": [["1"] * 10, ["1"] * 2]}


def test_invalid_option_and_wrong_length(documents):
    batches = batching.burst(documents).withColumn("option", F.lit("fast"))
    refused = recognise.recognise_batches(batches, flaky, "option")
    assert {(r.status, r.error) for r in refused.collect()} == {("Failed", rules.INVALID_OPTION)}
    short = recognise.recognise_batches(batching.burst(documents), lambda p: p.slice(0, 0))
    assert {r.status for r in short.collect()} == {"Failed"}
    marked = recognise.option_rejects(batches.limit(1)).first()
    assert (marked.accepted, marked.reject_reason) == (False, rules.INVALID_OPTION)


def test_options_travel_with_the_document(documents):
    chosen = documents.withColumn(
        "option", F.when(F.col("doc_id") < 10, "basic").when(F.col("doc_id") < 20, "fast"))
    pages = batching.pages_long(documents).join(chosen.select("doc_id", "option"), "doc_id")
    for given_ in (chosen, pages):
        done = merged_sections(given_, lambda p: p, section_pages=20, option="option")
        failed = done.groupBy("doc_id").agg(F.sum("n_failed").alias("n")).collect()
        assert {r.doc_id: r.n for r in failed} == {
            n: (n + 9) // 10 if 10 <= n < 20 else 0 for n in EDGE_SIZES}
    assert batching.burst(chosen, carry=["option"]).columns[-1] == "option"


def test_pandas_functions_can_be_used(documents):
    upper = recognise.from_pandas(lambda s: s.str.upper())
    done = recognise.recognise_batches(batching.burst(documents), upper)
    assert all(p == p.upper() for r in done.collect() for p in r.pages)
    assert isinstance(upper(pa.array(["a"])), pd.Series)


def test_three_policies(spark, documents):
    results = recognise.recognise_batches(batching.burst(documents), flaky)
    want = expected_results()
    failed = {n for (n, b), (status, _) in want.items() if status == "Failed"}
    totals = {}
    for policy in recognise.ON_ERROR:
        kept = recognise.apply_policy(results, policy)
        merged = merge.gather(kept)
        totals[policy] = {r.doc_id: r.n_pages for r in merge.page_counts(merged).collect()}
    skipped = {n: sum(len(p or []) for (d, _), (_, p) in want.items() if d == n) for n in EDGE_SIZES}
    assert totals["fallback"] == {n: n for n in EDGE_SIZES}
    assert totals["skip"] == {n: c for n, c in skipped.items() if c}
    assert totals["abort"] == {n: n for n in EDGE_SIZES if n not in failed}
    with pytest.raises(ValueError):
        recognise.apply_policy(results, "ignore")


@pytest.mark.parametrize("policy", ["fallback", "skip"])
@pytest.mark.parametrize("spread", [None, 4])
def test_sections_equal_batches(documents, policy, spread):
    fused = merge.merged_pages(
        merged_sections(documents, flaky, policy, section_pages=20, spread=spread))
    results = recognise.recognise_batches(batching.burst(documents), flaky)
    stepwise = merge.merged_pages(merge.gather(recognise.apply_policy(results, policy), 20))
    assert rows(fused) == rows(stepwise)
    from_pages = merge.merged_pages(merged_sections(
        batching.pages_long(documents), flaky, policy, section_pages=20, spread=spread))
    assert rows(from_pages) == rows(stepwise)


def test_document_run_has_no_shuffle(documents):
    plan = merged_sections(documents, flaky)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_a_filter_on_the_outcome_does_not_call_the_function_again(documents):
    results = recognise.recognise_batches(batching.burst(documents), flaky)
    for policy in ("fallback", "skip"):
        kept = merge.gather(recognise.apply_policy(results, policy))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_status_rollup(spark):
    data = [(1, 0, "Processed"), (1, 1, "Failed"), (2, 0, "Processed"), (2, 1, "Processed"),
            (2, 1, "Processed"), (3, 0, "Processed"), (3, 0, "Processed")]
    expected = spark.createDataFrame([(1, 3), (2, 2), (3, 2), (4, 1)], "doc_id long, n_batches long")
    results = spark.createDataFrame(data, "doc_id long, batch_no int, status string")
    done = recognise.status_rollup(results, expected)
    assert rows(done.select("doc_id", "status")) == [
        (1, "Failed"), (2, "Processed"), (3, "Processing"), (4, "Processing")]


def test_a_batch_reported_twice_counts_once(spark):
    data = [(1, 1, ["a", "b"]), (1, 3, ["c"]), (1, 1, ["a", "b"]), (1, 3, ["d"])]
    merged = merge.gather(spark.createDataFrame(data, "doc_id long, start_page int, pages array<string>"))
    assert [r.pages for r in merged.collect()] == [["a", "b", "c"]]


def test_sections_refuse_to_abort(spark, documents):
    with pytest.raises(ValueError, match="abort"):
        merged_sections(documents, flaky, "abort")


def test_whole_run(spark, documents):
    entries = batching.pages_long(documents).select(
        "doc_id", (F.col("page_no") - 1).alias("page"), (F.col("page_no") - 1).alias("pos"),
        F.lit(1).alias("line"), F.col("text").alias("bookmark"))
    for policy in recognise.ON_ERROR:
        run = run_documents(documents, entries, flaky, storage.shared_folder(spark), policy)
        lost = {r.doc_id: r.pages_lost for r in run.page_counts.collect()}
        states = {r.doc_id: r for r in run.status.collect()}
        assert states[1000].error == states[1001].error == "Document has no pages"
        assert states.pop(1000).status == states.pop(1001).status == "Failed"
        failed = {n for n, r in states.items() if r.status == "Failed"}
        assert failed == {n for n in EDGE_SIZES if n >= 12} and set(states) == set(EDGE_SIZES)
        if policy == "fallback":
            assert set(lost.values()) == {0}
            assert run.outline.count() == sum(EDGE_SIZES)
        elif policy == "skip":
            assert {n for n, c in lost.items() if c} == failed
            # Entries follow their pages: each names the text of the page it points to.
            pages = {(r.doc_id, r.page_no): r.text for r in merge.merged_pages(run.sections).collect()}
            found = {(r.doc_id, r.page): r.bookmark for r in run.outline.collect()}
            assert len(found) == len(pages) > 0
            assert all(found[key].lower() == text.lower() for key, text in pages.items())
        else:
            assert {n: c for n, c in lost.items() if c} == {n: n for n in failed}


def test_running_total_against_brute_force(spark):
    rng = random.Random(5)
    # One group holds a third of all rows and spans many partitions.
    data = [("hot", p, rng.randint(0, 9)) for p in rng.sample(range(100_000), 2000)]
    data += [(f"g{i % 40}", 7 * i, rng.randint(0, 9)) for i in range(4000)]
    frame = spark.createDataFrame(data, "g string, p long, v long").repartition(6)
    got = ordering.running_total(frame, ["g"], "p", F.col("v"), "before")
    want, sums = {}, {}
    for g, p, v in sorted(data):
        want[g, p] = sums.get(g, 0)
        sums[g] = want[g, p] + v
    assert {(r.g, r.p): r.before for r in got.collect()} == want
    ranks = ordering.rank_from_zero(frame.select("p").distinct(), [], "p", "n")
    assert [r.n for r in ranks.orderBy("p").collect()] == list(range(ranks.count()))


def test_ranks_of_sparse_numbers_and_of_nulls(spark):
    """Wide ids, one hot group and rows without a place; no row-sized window in one task."""
    wide = [(None if i % 50 == 0 else i * 9_007_199_254_740 - 2**62, "hot" if i % 3 else f"g{i}") for i in range(3000)]
    frame = spark.createDataFrame(wide, "p long, g string").repartition(5)
    ranked = ordering.rank_from_zero(frame, [], "p", "n")
    placed = ranked.where("p is not null").orderBy("p").collect()
    assert [r.n for r in placed] == list(range(len(placed))) and ranked.where("n is null").count() == 60
    hot = ordering.rank_from_zero(frame, ["g"], "p", "n").where("g = 'hot' and p is not null").orderBy("p")
    assert [r.n for r in hot.collect()] == list(range(hot.count()))


def test_offsets_skip_missing_inputs(spark):
    inputs = spark.createDataFrame(
        [("t", 0, 1), ("t", 1, 99), ("t", 2, 3), ("u", 0, 2)], "target string, pos long, doc_id long")
    texts = spark.createDataFrame([(1, "a\nb"), (2, "c"), (3, "d\ne")], "doc_id long, text string")
    offsets = merge.page_offsets(inputs, batching.source_page_counts(texts))
    assert rows(offsets.select("target", "doc_id", "page_offset", "missing")) == [
        ("t", 1, 0, False), ("t", 3, 2, False), ("t", 99, 2, True), ("u", 2, 0, False)]
    pages = merge.concat_pages(batching.pages_long(texts), offsets)
    assert rows(pages.select("target", "page_no", "text")) == [
        ("t", 1, "a"), ("t", 2, "b"), ("t", 3, "d"), ("t", 4, "e"), ("u", 1, "c")]


def test_outline_range_against_brute_force(spark):
    rng = random.Random(9)
    entries = [(d, rng.randint(0, 60), k) for d in range(3) for k in range(50)]
    ranges = [(d, s, s + rng.randint(-1, 40), i) for i, (d, s) in
              enumerate((rng.randint(0, 3), rng.randint(1, 50)) for _ in range(30))]
    outlines = spark.createDataFrame(entries, "doc_id long, page int, pos int")
    wanted = spark.createDataFrame(ranges, "doc_id long, start_page int, end_page int, label int")
    got = outline.outline_range(outlines, wanted, width=7)
    want = [(d, p - (s - 1) + 1, k, i) for d, p, k in entries for e, s, t, i in ranges
            if d == e and s - 1 <= p < t]
    assert rows(got.select("doc_id", "page", "pos", "label")) == sorted(
        want, key=lambda r: tuple(map(str, r)))


def test_outline_of_whole_document_keeps_numbers(spark):
    outlines = spark.createDataFrame(
        [(1, 0, 0, 1, "a"), (1, 4, 1, 2, "b"), (1, 5, 2, 1, "beyond"), (2, 0, 0, 1, "none")],
        "doc_id long, page int, pos int, line int, bookmark string")
    kept = spark.createDataFrame([(1, 1, 5)], "doc_id long, start_page int, end_page int")
    assert rows(outline.reattach_outline(outlines, kept)) == [(1, 0, 1, "a", 1), (1, 1, 2, "b", 5)]


def test_outline_follows_its_pages_past_a_dropped_batch(spark):
    entries = [(1, p, p, 1, f"page {p}") for p in range(30)]
    outlines = spark.createDataFrame(entries, "doc_id long, page int, pos int, line int, bookmark string")
    kept = spark.createDataFrame([(1, 1, 10), (1, 21, 30)], "doc_id long, start_page int, end_page int")
    want = [(p + 1, f"page {p}") for p in range(10)] + [(p - 9, f"page {p}") for p in range(20, 30)]
    got = outline.reattach_outline(outlines, kept).select("page", "bookmark")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_extract_outline(spark):
    html = '<H1 class="x">One <b>bold</b></H1><p>h1</p><h3>Three\nlines</h3><h2>open<h2>'
    pages = spark.createDataFrame([("d", 0, html), ("d", 1, "<p>none</p>"), ("e", 0, None)],
                                  "doc_id string, page int, html string")
    assert rows(outline.extract_outline(pages, "doc_id", "page")) == [
        ("d", 0, 0, 1, "One bold"), ("d", 0, 1, 3, "Three\nlines")]


def test_strip_and_order(spark):
    pages = spark.createDataFrame([(1, 10, "j", "en"), (1, 9, "i", "en")],
                                  "doc_id long, page_no int, text string, lang string")
    plain = merge.strip_document_fields(pages)
    assert plain.columns == ["doc_id", "page_no", "text"]
    assert [r.page_no for r in merge.order_pages(plain).collect()] == [9, 10]


def test_files_to_pages_and_back(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_text(document(12))
    (tmp_path / "in" / "deep" / "b.PDF").write_text(document(3))
    (tmp_path / "in" / "c.txt").write_text("no")
    files = storage.scan_documents(spark, str(tmp_path / "in"))
    assert sorted(r.file_name for r in files.select("file_name").collect()) == ["a.pdf", "b.PDF"]
    texts = storage.text_documents(files)
    pages = merge.merged_pages(merged_sections(texts, flaky), complete=True)
    storage.write_merged(pages, str(tmp_path / "out"), partitions=3)
    back = storage.read_table(spark, str(tmp_path / "out"))
    assert rows(back) == rows(pages)
    storage.append_rows(back.limit(2), str(tmp_path / "out"))
    assert storage.read_table(spark, str(tmp_path / "out")).count() == pages.count() + 2


def test_shared_folder_is_read_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = storage.shared_folder(spark), storage.shared_folder(spark)
    assert first != second
    if base:
        assert first.startswith(base.rstrip("/") + "/")
