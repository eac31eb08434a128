"""The catalogue, upload and document tables, each a view over the given Parquet tables."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.operators import batching, ordering, recognise

# The fault set: a batch with a page that holds this letter fails.
FAULT = "\u00df"
FAULT_TEXT = "page holds a letter that is not known"


def sample_page_function(pages: pa.Array) -> pa.Array:
    """Stands in for a real recogniser: rewrites each page and refuses those of the fault set."""
    if pc.any(pc.match_substring(pages, FAULT)).as_py():
        raise ValueError(FAULT_TEXT)
    return pc.replace_substring(pages, "e", "E")


def text_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS")


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def clients(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")
        )

    def users(self) -> DataFrame:
        even = F.col("s_nationkey") % 2 == 0
        domain = F.when(even, "@a.example").otherwise("@b.example")
        name = F.lower(F.translate("s_name", "#", "."))
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("fullname"),
            F.concat(name, domain).alias("email"),
        )

    def projects(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("id"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").alias("client_id"),
            (F.col("n_nationkey") % 5).alias("user_id"),
        )

    def files(self) -> DataFrame:
        orders = self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        name = F.concat(F.lit("order_"), F.col("o_orderkey"), F.lit(".pdf"))
        status = (
            F.when(F.col("o_orderstatus") == "F", rules.PROCESSED)
            .when(F.col("o_orderstatus") == "P", rules.PROCESSING)
            .otherwise(rules.NOT_PROCESSED)
        )
        kind = F.col("o_orderkey") % 4
        option = F.when(kind == 0, "Basic").when(kind == 1, "ADVANCED").when(kind == 3, "fast")
        project = F.col("c_nationkey")
        return orders.select(
            F.col("o_orderkey").alias("id"),
            project.alias("project_id"),
            name.alias("file_name"),
            F.floor("o_totalprice").alias("file_size"),
            status.alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            option.alias("option"),
            F.concat_ws(
                "/", F.lit("uploads"), project % 5, project, F.col("o_orderkey"), name
            ).alias("file_path"),
        )

    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text")

    def documents_with_option(self) -> DataFrame:
        """Documents with the run option by language; Spanish ones ask for an unknown one."""
        lang = F.col("lang")
        option = F.when(lang == "en", "Basic").when(lang == "de", "ADVANCED").when(
            lang == "es", "fast"
        )
        return self.table("documents").select("doc_id", "text", option.alias("option"))

    def uploads(self) -> DataFrame:
        key = F.col("doc_id")
        suffix = F.when(key % 7 == 0, ".PDF").when(key % 11 == 0, ".txt").otherwise(".pdf")
        name = F.concat(F.col("source"), F.lit(" doc "), key, suffix)
        return self.table("documents").select(
            F.col("source").alias("batch"),
            key.alias("pos"),
            name.alias("file_name"),
            (key % 28).cast("int").alias("project_id"),
            F.octet_length("text").cast("bigint").alias("file_size"),
        )

    def chunks(self) -> DataFrame:
        """Conversations as uploads: one that stops at a user turn lacks its last chunk.

        Every fifth upload sends its first chunk again with another body; every eleventh
        sends one without an index, and every thirteenth one that is out of range. Some chunks
        lack the time they were sent, and some names are in another script.
        """
        turns = self.table("conversations")
        totals = turns.groupBy("conv_id").agg(
            (F.max("turn") + 1).alias("_seen"), F.max(F.struct("turn", "role")).alias("_last")
        )
        waiting = F.when(F.col("_last.role") == "user", 1).otherwise(0)
        key = F.col("conv_id")
        sent = turns.join(totals, "conv_id").select(
            key.alias("upload_id"),
            F.col("turn").alias("chunk_index"),
            (F.col("_seen") + waiting).alias("total_chunks"),
            F.col("text").alias("body"),
            F.timestamp_seconds(F.lit(1_704_067_200) + key).alias("started_at"),
            F.when((key + F.col("turn")) % 3 != 0, F.col("turn")).alias("sent"),
            F.when(key % 19 == 4, "\u6587\u6863.pdf")
            .otherwise(F.concat(F.lit("talk "), key, F.when(key % 17 == 3, ".txt").otherwise(".pdf")))
            .alias("file_name"),
            (key % 28).cast("int").alias("project_id"),
        )
        first = sent.where(F.col("chunk_index") == 0)
        again = first.where(F.col("upload_id") % 5 == 0).withColumns(
            {"body": F.concat(F.col("body"), F.lit(" again")), "sent": F.lit(1_000_000).cast("bigint")}
        )
        nowhere = first.where(F.col("upload_id") % 11 == 0).withColumn(
            "chunk_index", F.lit(None).cast("bigint")
        )
        beyond = first.where(F.col("upload_id") % 13 == 0).withColumn(
            "chunk_index", F.col("total_chunks")
        )
        return sent.unionByName(again).unionByName(nowhere).unionByName(beyond)

    def raw_chunks(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("upload_id"),
            F.col("turn").alias("chunk_index"),
            F.col("text").alias("body"),
        )

    def pages_long(self) -> DataFrame:
        return batching.pages_long(self.documents())

    def batches(self) -> DataFrame:
        return batching.burst(self.documents())

    def batch_results(self) -> DataFrame:
        return recognise.recognise_batches(self.batches(), sample_page_function)

    def outline(self) -> DataFrame:
        """One entry per page: its whole text."""
        page = F.col("page_no")
        return self.pages_long().select(
            "doc_id",
            (page - 1).alias("page"),
            (page - 1).alias("pos"),
            (page % 3 + 1).alias("line"),
            F.col("text").alias("bookmark"),
        )

    def hosted_pages(self) -> DataFrame:
        """Web pages with their host as the document."""
        return self.table("pages").select(
            F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("doc_id"), "page_id", "html"
        )

    def page_numbers(self) -> DataFrame:
        """Place of each web page in the document of its host."""
        hosted = self.hosted_pages().drop("html")
        return ordering.rank_from_zero(hosted, ["doc_id"], "page_id", "page").select(
            "page_id", "page"
        )

    def status_events(self) -> DataFrame:
        return status_events(self.table("events"))

    def requests(self) -> DataFrame:
        """Requests to create a project, one per customer."""
        customers = self.table("customer").withColumnRenamed("c_nationkey", "n_nationkey")
        client = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise(F.col("r_name"))
        nations = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return customers.join(nations.select("n_nationkey", "r_name"), "n_nationkey").select(
            F.col("c_custkey").alias("pos"),
            client.alias("client_name"),
            F.col("c_name").alias("project_name"),
            (F.col("n_nationkey") % 5).alias("user_id"),
        )


def status_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", rules.NOT_PROCESSED)
        .when(kind.isin("click", "view"), rules.PROCESSING)
        .when(kind == "purchase", rules.PROCESSED)
        .when(kind == "error", rules.FAILED)
    )
    return events.select(
        F.col("user_id").alias("file_id"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )
