"""Search for a piece of text without reading all rows: an index of trigrams.

Rows are taken in chunks of up to 65,536. For each trigram of a chunk, one posting holds the places in
the chunk of the rows whose searched text has it: 2 bytes a place, or a bitmap where that is shorter.
The keys of a chunk's rows lie beside the postings, in order. Postings are written in ranges of trigram
and chunk, so that those of one trigram lie together and a frequent one is spread over files; so is the
number of rows of each trigram. A search takes the rarest trigrams of its text, brings together the
places that have them all, and checks only their rows. Texts shorter than a trigram need a scan. New
rows are appended with chunks, postings and counts of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.catalog import SEARCH_COLUMNS, search_rows, searched_text
from folioflow.sources.storage import shared_folder, written

GRAM = 3
RAREST = 4  # trigrams of the searched text that are looked up
# A chunk ends with the row or character that reaches these; places fit in 2 bytes.
CHUNK_ROWS, CHUNK_CHARACTERS = 1 << 16, 1 << 21
KEY_ROWS = 10_000  # keys that a task hands on at once
TABLE = 1 << 22  # numbers up to this are told apart by a table, larger ones by sorting
POINTS = 0x110000


def _numbered(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and for each value its place among them; all are below `most`."""
    if most > TABLE:
        return np.unique(values, return_inverse=True)
    held = np.zeros(most, bool)
    held[values] = True
    distinct = np.flatnonzero(held)
    place = np.empty(most, np.int32)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[values]


def postings_of(texts: Sequence[str]) -> Iterator[tuple[str, int, bytes]]:
    """The trigrams of a chunk's texts, sorted: trigram, number of texts that have it, their places."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(points) < GRAM:
        return
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts), dtype=np.uint16), lengths)
    letters, letter = _numbered(points, POINTS)
    base = len(letters)
    if base**GRAM > TABLE:
        letter = letter.astype(np.int64)
    code = (letter[:-2] * base + letter[1:-1]) * base + letter[2:]
    # Of each text: its last two characters begin no trigram.
    within = np.ones(len(code), bool)
    ends = np.cumsum(lengths)
    for back in range(1, GRAM):
        at = ends[lengths >= back] - back
        within[at[at < len(code)]] = False
    grams, gram = _numbered(code[within], base**GRAM)
    if not len(grams):
        return
    # Trigram and place in one number: sorted once, equal ones beside each other.
    both = gram.astype(np.uint32 if len(grams) <= 1 << 16 else np.uint64) << 16 | text[: 1 - GRAM][within]
    both.sort()
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    both = both[first]
    place = both.astype("<u2")  # the low half
    cuts = np.searchsorted(both >> 16, np.arange(len(grams) + 1))
    points = [letters[grams // base**2], letters[grams // base % base], letters[grams % base]]
    names = np.stack(points, 1).astype("<u4").tobytes().decode("utf-32-le")
    bitmap = -(-len(texts) // 8)
    for number, (start, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        places = place[start:end]
        if bitmap < 2 * len(places):
            held = np.zeros(len(texts), bool)
            held[places] = True
            places = np.packbits(held)
        yield names[GRAM * number : GRAM * (number + 1)], end - start, places.tobytes()


def hits_of(postings: Sequence[tuple[int, bytes]], n_rows: int) -> np.ndarray:
    """For each place of a chunk, how many of some postings (number of rows, places) have it."""
    hits = np.zeros(n_rows, np.int64)
    for n, places in postings:
        if len(places) == 2 * n:
            hits[np.frombuffer(places, "<u2")] += 1
        else:
            hits += np.unpackbits(np.frombuffer(places, np.uint8), count=n_rows)
    return hits


def append(
    rows: DataFrame, root: str, key: str = "file_id", columns: Sequence[str] = SEARCH_COLUMNS
) -> None:
    """Index rows that are new; the first call makes the index. `key` is unique over all rows."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    texts = rows.select(searched_text(columns).alias("text"), F.col(key).alias("key"))
    kind = texts.schema["key"].dataType
    schema = T.StructType(
        [
            T.StructField("gram", T.StringType()),
            T.StructField("chunk", T.StringType()),
            T.StructField("n_rows", T.LongType()),
            T.StructField("places", T.BinaryType()),
            T.StructField("keys", T.ArrayType(kind)),
        ]
    )

    def chunks(batches):
        import pyarrow as pa

        task, number = TaskContext.get().partitionId(), 0

        def packed(texts, keys):
            nonlocal number
            chunk = f"{name}-{task:06d}-{number:06d}"
            number += 1
            keys = pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            none = pa.nulls(1, pa.string())
            values = [none, pa.array([chunk]), pa.array([len(keys)], pa.int64()), pa.nulls(1, pa.binary()), lists]
            yield pa.record_batch(values, names=schema.names)
            grams, sizes, places = [], [], []

            def batch():
                values = [pa.array(grams, pa.string()), pa.array([chunk] * len(grams)), pa.array(sizes, pa.int64()),
                          pa.array(places, pa.binary()), pa.nulls(len(grams), lists.type)]
                return pa.record_batch(values, names=schema.names)

            for gram, size, held in postings_of(texts):
                grams.append(gram)
                sizes.append(size)
                places.append(held)
                if len(grams) == KEY_ROWS:
                    yield batch()
                    grams, sizes, places = [], [], []
            if grams:
                yield batch()

        texts, keys, characters = [], [], 0
        for batch in batches:
            start = 0
            for at, text in enumerate(batch.column(0).to_pylist()):
                texts.append(text)
                characters += len(text)
                if len(texts) == CHUNK_ROWS or characters >= CHUNK_CHARACTERS:
                    keys.append(batch.column(1).slice(start, at + 1 - start))
                    yield from packed(texts, keys)
                    texts, keys, characters, start = [], [], 0, at + 1
            keys.append(batch.column(1).slice(start))
        if texts:
            yield from packed(texts, keys)

    # Read four times. Postings and keys of a chunk come from one run of its task.
    staged = written(texts.mapInArrow(chunks, schema), shared_folder(spark))
    postings = staged.where("gram IS NOT NULL").select("gram", "chunk", "n_rows", "places")
    ranged = postings.repartitionByRange("gram", "chunk").sortWithinPartitions("gram", "chunk")
    ranged.write.mode("append").parquet(f"{root}/postings")
    staged.where("gram IS NULL").select("chunk", "n_rows", "keys").write.mode("append").parquet(f"{root}/keys")
    counts = postings.groupBy("gram").agg(F.sum("n_rows").alias("n_rows"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("append").parquet(f"{root}/counts")


def rarest_grams(spark: SparkSession, root: str, text: str) -> list[str] | None:
    """The trigrams to look up, rarest first; None if one of the text's is in no row.

    The driver gets one count for each trigram of the text searched for.
    """
    grams = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    counts = spark.read.schema("gram string, n_rows bigint").parquet(f"{root}/counts")
    found = counts.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n_rows").alias("n_rows"))
    sizes = {row.gram: row.n_rows for row in found.collect()}
    if len(sizes) < len(grams):
        return None
    return sorted(grams, key=lambda gram: (sizes[gram], gram))[:RAREST]


def _candidates(spark: SparkSession, root: str, grams: list[str], kind: T.DataType) -> DataFrame:
    """Keys (key) of the rows that have all the trigrams."""
    schema = "gram string, chunk string, n_rows bigint, places binary"
    postings = spark.read.schema(schema).parquet(f"{root}/postings").where(F.col("gram").isin(grams))
    lists = postings.groupBy("chunk").agg(F.collect_list(F.struct("n_rows", "places")).alias("postings"))
    keys = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("keys", T.ArrayType(kind))])
    met = lists.join(spark.read.schema(keys).parquet(f"{root}/keys"), "chunk").select("postings", "keys")

    def hits(batches):
        import pyarrow as pa

        for batch in batches:
            for lists, keys in zip(batch.column(0), batch.column(1), strict=True):
                keys = keys.values
                found = hits_of([(p["n_rows"], p["places"]) for p in lists.as_py()], len(keys))
                places = np.flatnonzero(found)
                for start in range(0, len(places), KEY_ROWS):
                    part = places[start : start + KEY_ROWS]
                    yield pa.record_batch([keys.take(pa.array(part)), pa.array(found[part])], names=["key", "n"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("n", T.LongType())])
    held = met.mapInArrow(hits, schema)
    return held.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") == len(grams)).select("key")


def search(
    rows: DataFrame, root: str, text: str, key: str = "file_id", columns: Sequence[str] = SEARCH_COLUMNS
) -> DataFrame:
    """The rows that `search_rows` finds, by way of the index of all of them."""
    spark, lowered = rows.sparkSession, text.lower()
    if len(lowered) < GRAM:
        return search_rows(rows, text, columns)
    grams = rarest_grams(spark, root, lowered)
    if grams is None:
        return rows.where(F.lit(False))
    found = _candidates(spark, root, grams, rows.schema[key].dataType)
    held = rows.join(found.select(F.col("key").alias(key)), key, "left_semi").select(*rows.columns)
    return search_rows(held, text, columns)
