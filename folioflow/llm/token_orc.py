"""Token ids as ORC: sorted files with integer run-length encoding, row indexes and Bloom filters.

`write_tokens` sorts documents by id over all files, so that the files one after another hold
the ids of the corpus in order. Each row is a document; ORC keeps its ids with run-length
encoding, stripes that are read in parallel, minimum and maximum of doc_id for every
`row_index_stride` rows, and a Bloom filter on doc_id, so `find_tokens` opens few stripes.

Null texts count as empty and give the end id alone. Rows with the same doc_id are kept and
come in the order of a hash of their text; a null doc_id comes first. An empty table gives an
empty set of files. Columns besides doc_id and text are not used.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.encoding import Encoder, blocks, values
from folioflow.llm.tables import whole_text

FILE_SCHEMA = "part int, start_in_part long, doc_id long, n_tokens int, ids array<int>"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, word_level: bool):
    """Rows of FILE_SCHEMA in the order of each partition's rows (doc_id, text)."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder(tokenizer, word_level)
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in blocks(batch, 1):
                ids, bounds = values(encoder.encode_column(rows.column(1)))
                ids = np.insert(ids, bounds[1:], end_id).astype(np.int32)
                offsets = bounds + np.arange(len(bounds))
                sizes = np.diff(offsets)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(sizes), part, dtype=np.int32)),
                        pa.array(total + offsets[:-1]),
                        rows.column(0),
                        pa.array(sizes.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["part", "start_in_part", "doc_id", "n_tokens", "ids"],
                )
                total += len(ids)

    return docs.mapInArrow(encode, FILE_SCHEMA)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    word_level: bool = False,
    row_index_stride: int = 1000,
    stripe_bytes: int = 16 * 1024 * 1024,
) -> None:
    """Encode every text and write the ids as ORC files in ascending order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        encoded(ordered, tokenizer, end_id, word_level)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents; the filter reaches the files' indexes and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def token_digest(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the ids in the files.

    The starts add up the sizes of the files before (one row a file) and the ids before a
    document in its own file.
    """

    def digest(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [
                zlib.crc32(ids[begin:end].tobytes())
                for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist())
            ]
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(crc, type=pa.int64()),
                ],
                names=["part", "start_in_part", "doc_id", "n_tokens", "ids_crc32"],
            )

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        files.groupBy("part")
        .agg(F.sum("n_tokens").alias("size"))
        .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    )
    return (
        files.select("part", "start_in_part", "doc_id", "ids")
        .mapInArrow(
            digest, "part int, start_in_part long, doc_id long, n_tokens long, ids_crc32 long"
        )
        .join(parts, "part")
        .select(
            "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
        )
    )
