"""Outlines as trees: each entry's parent, depth and path, however long the outline is.

The entries of a document, in order, are a table of contents where an entry belongs to the
nearest one before it of a lower level. Entries of lost pages leave gaps in the levels, so a level
may rise by more than one or begin above one; the depth in the tree is the repaired level, which
begins at 1 and never rises by more than one.

Entries are range-partitioned by document and place, so one document with very many is many
tasks' work. Each task passes over its entries with a stack of open ancestors. What it can't know
are the ancestors in earlier tasks; of those only the open ones at its end matter, at most
one for each level, so a task leaves a summary of its stack, and the summaries of a
document, a few rows a task, are merged in order. Entries without an ancestor in their own task then take
theirs from the merged stack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.storage import shared_folder, written


def _passed(ordered: DataFrame, key: str) -> DataFrame:
    """Entries with their nearest ancestor in the same task and what the path there looks like.

    parent_pos is null where no earlier entry of the task has a lower level; local_depth and
    local_path count from the outermost ancestor in the task, whose level is root_line. Stacks rows
    (entry false) hold what is open at the end of a document's stretch.
    """

    def climb(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["doc", "part", "entry", "pos", "line", "parent_pos", "local_path", "lowest"]
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
                 pa.list_(pa.int64()), pa.int64()]
        now, stack, lowest, out = None, [], None, []

        def frame(rows):
            return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

        def close():
            path = []
            for line, pos in stack:
                path.append(pos)
                out.append((now, part, False, pos, line, None, list(path), lowest))

        for batch in batches:
            for doc, pos, line in zip(*(c.to_pylist() for c in batch.columns)):
                if doc != now:
                    close()
                    now, stack, lowest = doc, [], None
                while stack and stack[-1][0] >= line:
                    stack.pop()
                parent = stack[-1][1] if stack else None
                stack.append((line, pos))
                lowest = line if lowest is None else min(lowest, line)
                out.append((doc, part, True, pos, line, parent, [p for _, p in stack], lowest))
            if out:
                yield frame(out)
                out.clear()
        close()
        if out:
            yield frame(out)

    schema = (
        "doc string, part int, entry boolean, pos long, line long, parent_pos long,"
        " local_path array<long>, lowest long"
    )
    return ordered.select(F.col(key).cast("string").alias("doc"), "pos", "line").mapInArrow(climb, schema)


def _merged(stacks: DataFrame) -> DataFrame:
    """Open ancestors (pos, line) before each task's stretch of a document that begun earlier.

    A document has a row for each task that holds some of it and each level open there.
    """

    def merge(frame):
        import pandas as pd

        frame = frame.sort_values(["part", "line"])
        open_, out = [], []
        for part, own in frame.groupby("part"):
            if open_:
                lines, places = zip(*open_)
                out.append((frame["doc"].iloc[0], part, list(places), list(lines)))
            # Whatever was open at or above the lowest level met in the stretch is closed by it.
            lowest = own["lowest"].iloc[0]
            open_ = [(line, pos) for line, pos in open_ if line < lowest]
            open_ += list(zip(own["line"].tolist(), own["pos"].tolist()))
        return pd.DataFrame(out, columns=["doc", "part", "places", "lines"])

    return stacks.groupBy("doc").applyInPandas(
        merge, "doc string, part int, places array<long>, lines array<long>"
    )


def outline_tree(outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add to each entry (`key`, pos, line): parent_pos (null for a root), depth from 1, and path,
    the places of all its ancestors and its own joined by `/`.

    `pos` is unique within a document. Entries without a document, place or level are left out.
    """
    known = outline.where(F.col(key).isNotNull() & F.col("pos").isNotNull() & F.col("line").isNotNull())
    narrow = known.select(key, F.col("pos").cast("bigint").alias("pos"), F.col("line").cast("bigint").alias("line"))
    order = [F.col(key).cast("string").alias("doc"), F.col("pos")]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(_passed(ranged, key), shared_folder(outline.sparkSession))
    stacks = table.where(~F.col("entry")).select("doc", "part", "pos", "line", "lowest")
    # Only documents that lie in several tasks have anything to merge: fewer than there are tasks.
    spread = stacks.groupBy("doc").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b")
    before = _merged(stacks.join(spread.select("doc"), "doc", "left_semi"))
    entries = table.where("entry").drop("entry").join(before, ["doc", "part"], "left")
    # Ancestors in earlier tasks are those of a level below the lowest met in the stretch so far.
    outer = F.size(F.filter("lines", lambda line: line < F.col("lowest")))
    above = F.when(F.col("places").isNull(), F.array().cast("array<long>")).otherwise(
        F.slice("places", 1, F.greatest(outer, F.lit(0)))
    )
    path = F.concat(above, "local_path")
    placed = entries.withColumn("_path", path).select(
        "doc", "pos", F.get("_path", F.size("_path") - 2).alias("parent_pos"),
        F.size("_path").alias("depth"),
        F.array_join(F.col("_path").cast("array<string>"), "/").alias("path"),
    )
    kind = outline.schema[key].dataType
    return placed.withColumn(key, F.col("doc").cast(kind)).drop("doc")
