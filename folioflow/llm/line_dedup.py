"""Line dedup over a corpus, with keep bitmaps instead of texts; DataFrame functions only.

A line's key is the line without blanks at its ends and with A-Z lowered; keys travel as two
64-bit hashes. The hashes are range-partitioned and sorted by document and position, so that
a frequent key lies in many partitions and the occurrences of a key follow each other. Counts
per key come from partial sums over that table. Positions to drop are packed 64 to a number,
one bitmap a document; documents without dropped lines have none.

A key of at least `least_chars` code points in at least `least_docs` documents loses its lines
in all documents but the one with the largest doc_id. Null or empty texts are one empty line.
Rows with a null doc_id are left as they are and don't count. Rows with the same doc_id count
as one document. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.tables import BLANKS, ascii_lower, fresh_name, row_key, whole_text, written

BITS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, text_key, position and hashes (h1, h2) of the lines that can be dropped."""
    keys = _lines(ascii_lower(whole_text()))
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select(*row_key(), F.posexplode(keys).alias("position", "line"))
        .select("doc_id", "text_key", "position", F.btrim("line", F.lit(BLANKS)).alias("key"))
        .where(F.length("key") >= least_chars)
        .select(
            "doc_id",
            "text_key",
            "position",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
        )
    )


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, text_key, dropped (array of 64-bit words, a set bit for a dropped line) and
    n_dropped of every document that loses lines."""
    order = ["h1", "h2", "doc_id", "text_key", "position"]
    sorted_hashes = written(
        line_hashes(docs, least_chars).repartitionByRange(*order).sortWithinPartitions(*order),
        "line-hashes",
    )
    keys = (
        sorted_hashes.select("h1", "h2", "doc_id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= least_docs)
        .select("h1", "h2", "keeper")
    )
    dropped = sorted_hashes.join(keys, ["h1", "h2"]).where(F.col("doc_id") < F.col("keeper"))
    bit = F.expr(f"shiftleft(1L, position % {BITS})")
    words = dropped.groupBy(
        "doc_id", "text_key", F.expr(f"cast(position div {BITS} as int)").alias("word")
    ).agg(F.bit_or(bit).alias("bits"))
    packed = words.groupBy("doc_id", "text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"),
        F.max("word").alias("last"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
    )
    return packed.select(
        "doc_id",
        "text_key",
        F.expr("transform(sequence(0, last), w -> coalesce(set[w], 0L))").alias("dropped"),
        "n_dropped",
    )


def drop_lines(docs: DataFrame, bitmaps: DataFrame, count: str | None = None) -> DataFrame:
    """The documents with the lines of the bitmaps left out; `count` names a column to add for
    their number."""
    mark = fresh_name(docs, "mark")
    marks = bitmaps.select(F.struct("doc_id", "text_key", "dropped", "n_dropped").alias(mark))
    kept = F.expr(
        "array_join(filter(split(coalesce(text, ''), '\\n', -1), (line, at) ->"
        f" (shiftright(coalesce(get({mark}.dropped, cast(at div {BITS} as int)), 0L), at % {BITS})"
        " & 1L) = 0L), '\\n')"
    )
    on = (F.col("doc_id") == F.col(f"{mark}.doc_id")) & (
        F.xxhash64(whole_text()) == F.col(f"{mark}.text_key")
    )
    out = docs.join(marks, on, "left").withColumn(
        "text", F.when(F.col(mark).isNull(), F.col("text")).otherwise(kept)
    )
    if count:
        out = out.withColumn(count, F.coalesce(f"{mark}.n_dropped", F.lit(0).cast("long")))
    return out.drop(mark)


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    return drop_lines(docs, keep_bitmaps(docs, least_chars, least_docs))
