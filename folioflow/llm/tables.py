"""Given tables, and tables written between the steps of an operator."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources import storage

# Fixed value: the white space that the word and line rules name.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach, see `storage.shared_folder`."""
    return f"{storage.shared_folder(spark)}/{name}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: later steps read it however often, and
    a lost executor costs no more than the tasks that ran on it."""
    spark = rows.sparkSession
    path = shared_folder(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, other letters as they are."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def row_key() -> list[Column]:
    """Key of a row of documents: rows with the same id and text get equal results, and
    rows with the same id but other texts stay apart."""
    return [F.col("doc_id"), F.xxhash64(whole_text()).alias("text_key")]


def fresh_name(rows: DataFrame, name: str) -> str:
    """A column name that the rows don't have in any spelling."""
    taken = {column.lower() for column in rows.columns}
    while name in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted now. Spark deletes them when the plans
    that made them are collected as garbage, which it asks for only twice an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys come from the left side."""
    other = right.select(*[F.col(name).alias(f"_other_{name}" if name in keys else name) for name in right.columns])
    on = None
    for name in keys:
        equal = left[name].eqNullSafe(other[f"_other_{name}"])
        on = equal if on is None else on & equal
    return left.join(other, on, how).drop(*[f"_other_{name}" for name in keys])
