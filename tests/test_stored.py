"""Keys against stored ones, and outlines as trees."""

import random
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioflow.operators import ingest, outline_tree, stored_keys


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def keyed(spark, data):
    return spark.createDataFrame(data, "pos int, key string, extra string")


@pytest.fixture
def store(spark, tmp_path):
    class Store:
        table, blocks, filters, n = f"keys_{uuid.uuid4().hex}", 3, None, 0

        def take(self, data):
            batch = keyed(spark, data)
            if self.filters is None:
                marked = ingest.unique_first(batch, F.col("key"), "pos")
            else:
                marked = stored_keys.unique_against_stored(
                    batch, F.col("key"), "pos", spark.table(self.table), self.filters, self.blocks)
            found = {r.pos: r.accepted for r in marked.collect()}
            self.n += 1
            self.filters = stored_keys.take_in(
                spark, marked.where("accepted"), self.table, self.filters, self.blocks, f"{tmp_path}/{self.n}")
            return found

    yield Store()
    spark.sql(f"DROP TABLE IF EXISTS {Store.table}")


def test_keys_are_unique_over_all_appends(store):
    rng = random.Random(5)
    known, pos = set(), 0
    for _ in range(4):
        data, want = [], {}
        for _ in range(150):
            key = None if rng.random() < 0.02 else f"k{rng.randint(0, 250)}"
            data.append((pos, key, "x"))
            want[pos] = key not in {k for _, k, _ in data[:-1]} and (key is None or key not in known)
            pos += 1
        rng.shuffle(data)
        assert store.take(data) == want
        known |= {k for _, k, _ in data}


def test_stored_side_is_not_moved(spark, store):
    store.take([(i, f"k{i}", "x") for i in range(500)])
    batch = keyed(spark, [(i, f"k{i * 3}", "y") for i in range(400)])
    stored = spark.table(store.table).hint("merge")
    marked = stored_keys.unique_against_stored(batch, F.col("key"), "pos", stored, store.filters, store.blocks)
    lines = plan(marked).splitlines()
    scan = next(i for i, line in enumerate(lines) if store.table in line)
    assert "Bucketed: true" in lines[scan]
    # From the scan up to its join, the stored side has no exchange.
    join = next(i for i in range(scan, -1, -1) if "SortMergeJoin" in lines[i] and "LeftSemi" in lines[i])
    depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :+-*(0123456789)"))
    side = [lines[i] for i in range(join + 1, scan) if depth(i) < depth(scan)]
    last = max((i for i in range(join + 1, scan) if "Exchange" in lines[i]), default=join)
    assert side and all("Exchange" not in line for line in lines[last + 1 : scan])
    assert plan(marked.sparkSession.table(store.table)).count("Exchange") == 0


def test_filter_lets_most_new_keys_by(spark, store):
    store.take([(i, f"k{i}", "x") for i in range(3000)])
    asked = spark.range(4000).select(F.concat(F.lit("n"), "id").alias("key"))
    seen = stored_keys.maybe_known(asked, store.filters, store.blocks)
    assert seen.count() == 4000 and seen.where("maybe").count() < 400
    own = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    assert stored_keys.maybe_known(own, store.filters, store.blocks).where("maybe").count() == 3000


def brute_tree(entries):
    """(doc, pos, parent, depth, path) of (doc, pos, line)."""
    out, stacks = [], {}
    for doc, pos, line in sorted(entries):
        stack = stacks.setdefault(doc, [])
        while stack and stack[-1][1] >= line:
            stack.pop()
        parent = stack[-1][0] if stack else None
        stack.append((pos, line))
        out.append((doc, pos, parent, len(stack), "/".join(str(p) for p, _ in stack)))
    return sorted(out, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_outline_tree_over_many_tasks(spark, parts):
    rng = random.Random(parts)
    entries = [(d, p, rng.choice([1, 2, 2, 3, 3, 4, 6])) for d in range(20) for p in range(rng.randint(1, 12))]
    # One document holds most entries; long stretches of it have no entry of level 1.
    entries += [(99, p, 1 if p in (0, 400) else rng.randint(2, 6)) for p in range(900)]
    rng.shuffle(entries)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        outline = spark.createDataFrame(entries, "doc_id long, pos int, line int")
        found = outline_tree.outline_tree(outline).select("doc_id", "pos", "parent_pos", "depth", "path")
        assert rows(found) == brute_tree(entries)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_levels_never_rise_by_more_than_one(spark):
    entries = [(1, 0, 3), (1, 1, 6), (1, 2, 2), (1, 3, 5), (1, 4, 1), (1, 5, 4), (None, 0, 1), (1, 9, None)]
    found = outline_tree.outline_tree(spark.createDataFrame(entries, "doc_id int, pos int, line int"))
    depths = [r.depth for r in found.orderBy("pos").collect()]
    assert depths == [1, 2, 1, 2, 1, 2] and found.schema["doc_id"].dataType.simpleString() == "int"
    none = spark.createDataFrame([], "doc_id int, pos int, line int")
    assert outline_tree.outline_tree(none).count() == 0
