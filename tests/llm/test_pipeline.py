"""The pipeline's stages against brute force, each on what the stage before kept."""

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import folioflow  # noqa: E402
from folioflow.llm.tables import written  # noqa: E402

cloudpickle.register_pickle_by_value(folioflow)
FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], FOLDER), "test"))
    return out


def test_stages_keep_the_columns_of_documents(results):
    for frame in results[1:-1]:
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, results):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = texts(results[0]), texts(results[1])
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.97 * len(clean)
    assert all(after[i] == before[i] for i in after)


def test_lines(results):
    before = sorted(texts(results[1]).items())
    assert texts(results[2]) == {i: t for (i, _), (_, _, t) in zip(before, brute.kept_lines(before))}


def test_near_duplicates(results):
    before, after = texts(results[2]), texts(results[3])
    roots = brute.components(list(before.items()), 80)
    assert set(after) == {i for i in before if roots[i] == i}


def test_benchmark(spark, results):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before, after = texts(results[3]), texts(results[4])
    assert set(before) - set(after) >= {i for i, t in before.items() if any(u in t for u in items)}
    assert len(after) >= 0.9 * len(before)


def test_packing(results):
    before, rows = texts(results[4]), results[5].toPandas()
    assert set(rows.doc_id) == set(before)
    sizes = rows.groupby("doc_id").length.sum()
    ids = brute.encode("word_bpe_49k.json", list(before.values()), 1)
    assert sizes.to_dict() == {i: len(x) for i, x in zip(before, ids)}


def test_run_is_all_stages(spark, results):
    found = corpus_pipeline.run(spark, FOLDER)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(
        map(tuple, results[5].select(columns).collect())
    )


def test_stages_on_an_empty_table(spark, results):
    docs = results[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_near_copies_below_op7s_limit(spark):
    """Copies at similarity 0.80 to 0.85, which op7 keeps, go in the pipeline."""
    rows, low, high = [], 0.80, 0.85
    for n in range(12):
        base = [f"w{n}x{k}" for k in range(200)]
        copy = list(base)
        for k in (30, 80, 130, 180):
            copy[k] = f"new{n}x{k}"
        a, b = brute.shingles(" ".join(base)), brute.shingles(" ".join(copy))
        assert low <= len(a & b) / len(a | b) < high
        rows += [(2 * n, " ".join(base), "en", "s", 1), (2 * n + 1, " ".join(copy), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, FOLDER).collect()}
    roots = brute.components([r[:2] for r in rows], 80)
    assert kept == {i for i in roots if roots[i] == i} == set(range(0, 24, 2))
