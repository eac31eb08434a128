"""Nearest neighbours and ranked search against brute force, on odd rows and given tables."""

import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import folioflow  # noqa: E402
from folioflow.llm import neighbours, ranked_search  # noqa: E402
from folioflow.llm.queries import QUERIES  # noqa: E402

cloudpickle.register_pickle_by_value(folioflow)
FOLDER = "/root/testdata/sf0.01"
FEW = "/root/testdata/sf0.001"

# --- nearest neighbours ---------------------------------------------------------------------


def brute_neighbours(rows, asked, best=5):
    """{query id: [(vec_id, score)]} over all usable rows; ids are unique."""
    rows = [
        (i, np.array(v, dtype=float)) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for i, q in rows:
        if asked(i):
            found = [
                (-(q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum())), j)
                for j, v in rows if j != i
            ]
            out[i] = [(j, -far) for far, j in sorted(found)[:best]]
    return out


def answers(frame):
    out = defaultdict(list)
    for row in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[row.query_id].append((row.vec_id, row.score))
        assert row["rank"] == len(out[row.query_id])
    return dict(out)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, RANK string, key int, list int").select(
        "*", F.lit(1).alias("score")
    )


def full(rows):
    return [(*row, "a", 1, 2) for row in rows]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_of_odd_rows(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(rng.normal(size=8)).tolist()) for i in range(0, 60)]
    rows += [(100 + i, rows[50][1]) for i in range(12)]  # copies of a query
    rows += [(50 * i, None if i == 3 else [0.0] * 8) for i in range(3, 5)]
    rows += [(250, [1.0] * 7 + [None]), (300, [float("nan")] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [(350, [float("inf")] * 8), (400, []), (450, [1.0, 2.0]), (7, rows[7][1])]
    got = answers(neighbours.nearest(vectors(spark, full(rows), kind), F.col("vec_id") % 50 == 0))
    distinct = [(i, v) for i, v in dict(rows).items() if v is None or len(v) != 2]
    want = brute_neighbours(distinct, lambda i: i % 50 == 0)
    assert got.keys() == want.keys()
    for i, own in want.items():
        assert [j for j, _ in got[i]] == [j for j, _ in own]
        assert np.allclose([s for _, s in got[i]], [s for _, s in own], atol=1e-12)


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [3.0, 3.0]), (3, [-1.0, 0.5])]
    got = answers(neighbours.nearest(vectors(spark, full(rows), "double"), F.col("vec_id") == 0))
    assert [j for j, _ in got[0]] == [2, 1, 3]
    assert got[0][0][1] == pytest.approx(1.0) and got[0][1][1] == pytest.approx(math.sqrt(0.5))


def test_neighbours_without_rows(spark):
    assert neighbours.nearest(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    one = vectors(spark, full([(0, [1.0, 2.0])]))
    assert neighbours.nearest(one, F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_parted_lists(spark):
    """Lists in several parts, and one that holds nearly all vectors."""
    rng = np.random.default_rng(6)
    rows = [(i, (np.array([9.0] + [0] * 15) + rng.normal(size=16)).tolist()) for i in range(1500)]
    settings = neighbours.Settings(part=40, queries=7, promising=8, columns=4, lists=8, target=1.0)
    got = answers(neighbours.nearest(vectors(spark, full(rows)), F.col("vec_id") % 50 == 0, settings))
    want = brute_neighbours([(i, np.float32(v).tolist()) for i, v in rows], lambda i: i % 50 == 0)
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("folder", [FEW, FOLDER])
def test_neighbours_of_given_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute_neighbours([(r[0], r[1]) for r in rows], lambda i: i % 50 == 0)
    got = answers(QUERIES["op11_neighbours"](spark, folder))
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))
    for i, own in got.items():
        known = dict(want[i])
        assert all(score == pytest.approx(known[j], abs=1e-12) for j, score in own if j in known)


def test_scan_abandons_only_what_is_far():
    """Without doubt's margin wide open the scan returns the same as full distances."""
    rng = np.random.default_rng(9)
    rows = np.float32(rng.normal(size=(600, 32)))
    rows[300:340] = rows[:40] + np.float32(0.05 * rng.normal(size=(40, 32)))
    rotation = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    values = [r.tobytes() for r in rows]
    part = neighbours.Part([[i] for i in range(600)], values, "<f4", rotation)
    found = part.scan(values[:40], rotation, neighbours.Settings(columns=8))
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    for q, (places, _) in enumerate(found):
        assert places[0] == q and places[1] == np.argsort(-(unit @ unit[q]))[1]


# --- ranked search --------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def own_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, best=10):
    """Rows (item, rank, doc, score); docs and items are lists of (id, text)."""
    counted = [(i, Counter(own_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    many, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(own_terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * many) // total
            score = sum(
                math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in wanted if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, at + 1, doc, -s) for at, (s, _, doc) in enumerate(scores[:best])]
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def tables(spark, docs, items):
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, N int")
    return docs, spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")


WORDS = [f"w{i}" for i in range(40)] + ["Größe", "ÄB", "a_b", "x-y", "it's", "CAFÉ", "été la", "\x85"]


def made(rng, many, longest):
    return " ".join(rng.choices(WORDS, weights=[60 // (i + 1) + 1 for i in range(len(WORDS))], k=rng.randint(0, longest))) if many else None


def test_search_of_odd_rows(spark):
    rng = random.Random(2)
    docs = [(i, made(rng, i % 17, 30)) for i in range(300)]
    docs += [(5, docs[5][1]), (6, "w1 w2"), (None, "w39 w39"), (None, None), (7, "w1 " * 9000), (8, ""), (9, "... \n\t")]
    docs += [(1000 + i, "w38 w37") for i in range(30)]
    items = [(i, made(rng, 1, 25)) for i in range(30)] + [(3, "w38 unknown"), (None, "w39 W1"), (40, None), (41, "w38"), (42, "?"), (41, "w38")]
    got = found(ranked_search.search(*tables(spark, docs, items)))
    assert got == brute_search(docs, items)


def test_search_in_small_blocks_and_packs(spark):
    """More than 64 terms in an item, several packs, and blocks of a few documents."""
    rng = random.Random(8)
    docs = [(i, " ".join(f"v{rng.randint(0, 99)}" for _ in range(rng.randint(1, 90)))) for i in range(200)]
    items = [(0, " ".join(f"v{i}" for i in range(90)))] + [(i, made(rng, 1, 9) + f" v{i}") for i in range(1, 9)]
    settings = ranked_search.Settings(block=16, step=3, pack_terms=40)
    got = found(ranked_search.search(*tables(spark, docs, items), settings))
    assert got == brute_search(docs, items)


def test_search_without_rows(spark):
    some = [(1, "w1")]
    for docs, items in (([], some), (some, []), ([], []), ([(1, None)], some), (some, [(1, "none")])):
        frame = ranked_search.search(*tables(spark, docs, items))
        assert frame.columns == ["item_id", "rank", "doc_id", "score"] and frame.count() == 0


def test_search_of_given_table(spark):
    docs, items = (
        [tuple(r) for r in spark.read.parquet(f"{FEW}/{name}.parquet").select(key, "text").collect()]
        for name, key in (("documents", "doc_id"), ("benchmark", "item_id"))
    )
    assert found(QUERIES["op12_ranked_search"](spark, FEW)) == brute_search(docs, items)


def test_few_masks_are_evaluated():
    """Groups that can't reach the best are left alone."""
    rng = np.random.default_rng(1)
    tf = rng.integers(1, 3, size=4000)
    of, term = np.repeat(np.arange(2000), 2), np.tile([0, 1], 2000)
    keep = (term == 0) | (of % 100 == 0)
    block = ranked_search.Block(np.full(2000, 50), of[keep], term[keep], tf[keep])
    looked = []
    counts = block.counts
    block.counts = lambda local, chosen: looked.extend(chosen) or counts(local, chosen)
    numbers, weights = np.array([0, 1]), np.array([5, 900])
    block.best(numbers, weights, np.arange(2000), ranked_search.Settings(step=1))
    assert len(looked) == 20 and all(doc % 100 == 0 for doc in looked)
