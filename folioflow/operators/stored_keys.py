"""Unique keys against all that is stored, without moving what is stored.

Stored keys are a bucketed table: its files are grouped by a hash of the key, so a join brings
the new keys to the buckets and leaves the table where it is. In front of it stands a Bloom filter
in blocks of 32,768 bits: a key sets three bits of one block. Blocks are rows, built and merged by
bitmap aggregates, so the filter grows with the keys and is spread like any table. Keys that the
filter does not know are new for certain and pass the join by; only the others meet the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.ingest import DUPLICATE, accept_if
from folioflow.sources.storage import written

# Bits of a block, which the bitmap functions set, and bits set for a key.
BLOCK_BITS, HASHES = 32_768, 3
BUCKETS = 16


def _places(key: Column) -> list[Column]:
    """The bits of a key within its block."""
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BLOCK_BITS)) for k in range(HASHES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def store_keys(keys: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Append the keys (column `key`) to a table bucketed by them; the first call makes it.

    All calls for a table name the same number of buckets. Keys are brought to their buckets
    first, so that a call writes one file for each.
    """
    rows = keys.select("key").repartition(buckets, "key")
    rows.write.format("parquet").mode("append").bucketBy(buckets, "key").sortBy("key").saveAsTable(table)


def key_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Bloom filter of the keys: block and bits. About 2,000 keys a block are right; more keys
    let more of them through to the join and change no result."""
    bits = F.explode(F.array(*_places(F.col("key")))).alias("place")
    return keys.where(F.col("key").isNotNull()).select(_block(F.col("key"), blocks), bits).groupBy("block").agg(
        F.bitmap_construct_agg("place").alias("bits")
    )


def merge_filters(first: DataFrame, second: DataFrame) -> DataFrame:
    """Filter of the keys of both, which have the same number of blocks."""
    return first.unionByName(second).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def maybe_known(rows: DataFrame, filters: DataFrame, blocks: int) -> DataFrame:
    """Add `maybe`: false where the key is certainly none of the filter's."""

    def bit(place: Column) -> Column:
        byte = F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), place % 8) == 1

    every = F.lit(True)
    for place in _places(F.col("key")):
        every = every & bit(place)
    joined = rows.withColumn("block", _block(F.col("key"), blocks)).join(filters, "block", "left")
    return joined.withColumn("maybe", F.coalesce(every, F.lit(False))).drop("block", "bits")


def unique_against_stored(
    rows: DataFrame, key: Column, order: str, stored: DataFrame, filters: DataFrame, blocks: int
) -> DataFrame:
    """Mark the first row of each key that is not stored yet as accepted, all others as rejected.

    `order` is unique over all rows; `stored` is the table of `store_keys`, `filters` its
    `key_filter`. A key is reduced to one row on the map side before anything is looked up. A null key is
    never stored.
    """
    firsts = rows.groupBy(key.alias("key")).agg(F.min(order).alias(order))
    asked = maybe_known(firsts, filters, blocks)
    known = asked.where("maybe").select("key", order).join(stored, "key", "left_semi").select(
        order, F.lit(True).alias("_known")
    )
    winners = firsts.select(order, F.lit(True).alias("_first"))
    found = rows.join(winners, order, "left").join(known, order, "left")
    new = F.col("_first") & F.col("_known").isNull()
    return accept_if(found, new, DUPLICATE).select(*rows.columns, "accepted", "reject_reason")


def take_in(
    spark: SparkSession, accepted: DataFrame, table: str, filters: DataFrame | None, blocks: int, path: str
) -> DataFrame:
    """Store the accepted keys (column `key`) and return the filter that knows them too, written at `path`."""
    store_keys(accepted, table)
    new = key_filter(accepted, blocks)
    return written(new if filters is None else merge_filters(filters, new), path)
