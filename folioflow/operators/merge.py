"""Gathering batches and concatenating documents, in page order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.batching import SECTION_PAGES
from folioflow.operators.ordering import running_total


def gather(batches: DataFrame, section_pages: int = SECTION_PAGES) -> DataFrame:
    """Put the pages of the batches back in page order.

    The merged document is one or more section rows (doc_id, section_no, start_page,
    n_pages, pages). A section holds at most `section_pages` pages (not bytes), so no
    document is ever collected whole into one task; a shorter document is exactly one row. A
    batch reported more than once counts once, the least of differing reports: equal ones are
    combined on the map side.
    """
    section_no = F.floor((F.col("start_page") - 1) / section_pages).cast("int")
    gathered = (
        batches.withColumn("section_no", section_no)
        .groupBy("doc_id", "section_no")
        .agg(F.sort_array(F.collect_set(F.struct("start_page", "pages"))).alias("_all"))
    )
    repeated = lambda b, i: (i > 0) & (b["start_page"] == F.get("_all", i - 1)["start_page"])
    gathered = gathered.withColumn("_batches", F.filter("_all", lambda b, i: ~repeated(b, i)))
    merged = gathered.select(
        "doc_id",
        "section_no",
        F.col("_batches")[0]["start_page"].alias("start_page"),
        F.flatten("_batches.pages").alias("pages"),
    )
    return merged.withColumn("n_pages", F.size("pages"))


def merged_pages(merged: DataFrame, complete: bool = False) -> DataFrame:
    """Long form of merged sections: doc_id, page_no from 1 in the merged document, text.

    Pages are renumbered without gaps where failed batches were left out. With `complete`
    (no page is missing, as under `fallback`) the numbers follow from `start_page`, and
    nothing is joined or shuffled.
    """
    if complete:
        placed = merged.withColumn("_offset", F.col("start_page").cast("bigint") - 1)
    else:
        sizes = running_total(
            merged.select("doc_id", "section_no", "n_pages"),
            ["doc_id"], "section_no", F.col("n_pages").cast("bigint"), "_offset",
        ).drop("n_pages")
        placed = merged.join(sizes, ["doc_id", "section_no"])
    return placed.select("doc_id", "_offset", F.posexplode("pages").alias("_pos", "text")).select(
        "doc_id", (F.col("_offset") + F.col("_pos") + 1).alias("page_no"), "text"
    )


def page_counts(merged: DataFrame) -> DataFrame:
    """Total pages per document, from rows that carry `n_pages`."""
    return merged.groupBy("doc_id").agg(F.sum("n_pages").alias("n_pages"))


def compare_page_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages before and after the merge for each source document, and how many were lost."""
    merged = after.select("doc_id", F.col("n_pages").alias("_after"))
    counted = before.join(merged, "doc_id", "left")
    pages_after = F.coalesce(F.col("_after"), F.lit(0)).cast("bigint")
    pages_before = F.col("n_pages").cast("bigint")
    return counted.select(
        "doc_id",
        pages_before.alias("pages_before"),
        pages_after.alias("pages_after"),
        (pages_before - pages_after).alias("pages_lost"),
    )


def page_offsets(inputs: DataFrame, counts: DataFrame) -> DataFrame:
    """Where each input starts in its concatenated target.

    `inputs` lists (target, pos, doc_id) in the wanted order, `counts` gives (doc_id,
    n_pages). An input that does not exist takes no pages, so later ones move up; it is
    reported with `missing` true.
    """
    known = counts.select("doc_id", F.col("n_pages").cast("bigint").alias("n_pages"))
    listed = inputs.join(known, "doc_id", "left")
    listed = listed.withColumns(
        {
            "missing": F.col("n_pages").isNull(),
            "n_pages": F.coalesce("n_pages", F.lit(0).cast("bigint")),
        }
    )
    return running_total(listed, ["target"], "pos", F.col("n_pages"), "page_offset")


def concat_pages(pages: DataFrame, offsets: DataFrame) -> DataFrame:
    """Pages of all inputs, numbered through their target: target, page_no, doc_id, text.

    Always a shuffled join: pages made from documents are larger than Spark expects.
    """
    starts = offsets.where(~F.col("missing")).select("doc_id", "target", "page_offset")
    return pages.join(starts.hint("merge"), "doc_id").select(
        "target",
        (F.col("page_offset") + F.col("page_no")).alias("page_no"),
        "doc_id",
        F.col("page_no").alias("source_page"),
        "text",
    )


def order_pages(pages: DataFrame) -> DataFrame:
    """Rows in (document, page number) order. The number sorts as a number, never as text."""
    return pages.orderBy("doc_id", "page_no")


def strip_document_fields(pages: DataFrame) -> DataFrame:
    """Keep the pages only; every document-level column is dropped."""
    return pages.select("doc_id", "page_no", "text")
