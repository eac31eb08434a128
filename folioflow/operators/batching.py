"""Cutting documents into pages, page batches and sections. All steps here are narrow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.ordering import explode_range

# Fixed value: pages handed to one call of the page function.
BATCH_PAGES = 10
# Pages kept together in one row of a merged document.
SECTION_PAGES = 1000


def _pattern(separator: str) -> str:
    return separator if separator.isspace() else rf"\Q{separator}\E"


def _with_pages(documents: DataFrame, separator: str, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, carried columns, _all): the pages of each document that has any.

    Null or empty text has no pages. The test is on the text, so that it is split once only.
    """
    return documents.where(F.length("text") > 0).select(
        "doc_id", *carry, F.split("text", _pattern(separator)).alias("_all")
    )


def _runs(pages: Column, length: int) -> Column:
    """Cut an array that is not empty into consecutive runs of `length` items."""
    last = F.floor((F.size(pages) - 1) / length).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice(pages, i * length + 1, F.lit(length))
    )


def pages_long(
    documents: DataFrame, separator: str = "\n", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per page: doc_id, page_no from 1, text, and the columns named in `carry`.

    The arrays are never empty, so the outer form gives the same rows; for the plain form
    Spark would add a filter that splits every text twice more.
    """
    return _with_pages(documents, separator, carry).select(
        "doc_id", *carry, F.posexplode_outer("_all").alias("_pos", "text")
    ).select("doc_id", (F.col("_pos") + 1).alias("page_no"), "text", *carry)


def burst(
    documents: DataFrame,
    batch_pages: int = BATCH_PAGES,
    separator: str = "\n",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Split each document into batches: 1-based inclusive ranges, the last one short.

    Columns named in `carry`, such as the run option, are kept on every batch.
    """
    batches = _with_pages(documents, separator, carry).select(
        "doc_id",
        *carry,
        F.posexplode(_runs(F.col("_all"), batch_pages)).alias("batch_no", "pages"),
    )
    start = F.col("batch_no") * batch_pages + 1
    return batches.select(
        "doc_id",
        "batch_no",
        start.alias("start_page"),
        (start + F.size("pages") - 1).alias("end_page"),
        "pages",
        *carry,
    )


def burst_pages(pages: DataFrame, batch_pages: int = BATCH_PAGES) -> DataFrame:
    """The same batches from a table that already has one row per page.

    One shuffle on (doc_id, batch_no): a group never holds more than one batch, so a
    document of any length is spread over the cluster.
    """
    batch_no = F.floor((F.col("page_no") - 1) / batch_pages).cast("int")
    grouped = (
        pages.withColumn("batch_no", batch_no)
        .groupBy("doc_id", "batch_no")
        .agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("_pages"))
    )
    return grouped.select(
        "doc_id",
        "batch_no",
        F.col("_pages")[0]["page_no"].alias("start_page"),
        F.element_at("_pages", -1)["page_no"].alias("end_page"),
        F.col("_pages.text").alias("pages"),
    )


def batch_ranges(page_counts: DataFrame, batch_pages: int = BATCH_PAGES) -> DataFrame:
    """Page ranges of the batches from (doc_id, n_pages) alone, without the pages."""
    last = F.floor((F.col("n_pages") - 1) / batch_pages)
    counted = page_counts.where(F.col("n_pages") > 0).select("doc_id", "n_pages")
    batches = explode_range(counted, F.lit(0), last, "batch_no").withColumn(
        "batch_no", F.col("batch_no").cast("int")
    )
    start = F.col("batch_no") * batch_pages + 1
    end = F.least(start + batch_pages - 1, F.col("n_pages"))
    return batches.select(
        "doc_id", "batch_no", start.alias("start_page"), end.cast("int").alias("end_page")
    )


def sections(
    documents: DataFrame,
    section_pages: int = SECTION_PAGES,
    batch_pages: int = BATCH_PAGES,
    separator: str = "\n",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Split each document into sections, each holding its batches as arrays.

    A section is a whole number of batches, so batches are the same as `burst` makes. A row
    holds at most `section_pages` pages; the batches of a section are merged again without
    a shuffle.
    """
    if section_pages % batch_pages:
        raise ValueError("section_pages must be a multiple of batch_pages")
    cut = _with_pages(documents, separator, carry).select(
        "doc_id",
        *carry,
        F.posexplode(_runs(F.col("_all"), section_pages)).alias("section_no", "_pages"),
    )
    return cut.select(
        "doc_id",
        "section_no",
        (F.col("section_no") * section_pages + 1).alias("start_page"),
        _runs(F.col("_pages"), batch_pages).alias("batches"),
        *carry,
    )


def sections_of_pages(
    pages: DataFrame,
    section_pages: int = SECTION_PAGES,
    batch_pages: int = BATCH_PAGES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The same sections from a table that already has one row per page, without gaps.

    One shuffle on (doc_id, section_no), whose groups are bounded; it is the only one of a
    document run over such a table, however long a document is.
    """
    if section_pages % batch_pages:
        raise ValueError("section_pages must be a multiple of batch_pages")
    section_no = F.floor((F.col("page_no") - 1) / section_pages).cast("int")
    grouped = (
        pages.withColumn("section_no", section_no)
        .groupBy("doc_id", "section_no")
        .agg(
            F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("_pages"),
            *[F.max(name).alias(name) for name in carry],
        )
    )
    return grouped.select(
        "doc_id",
        "section_no",
        F.col("_pages")[0]["page_no"].alias("start_page"),
        _runs(F.col("_pages.text"), batch_pages).alias("batches"),
        *carry,
    )


def source_page_counts(documents: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, n_pages) of the documents as they came in; documents without pages count 0.

    Separators are counted, no page is built. The rows of a page table are counted.
    """
    if "page_no" in documents.columns:
        return documents.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_pages"))
    marks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit(separator), F.lit("")))
    pages = F.floor(marks / len(separator.encode())).cast("int") + 1
    return documents.select(
        "doc_id", F.when(F.length("text") > 0, pages).otherwise(0).alias("n_pages")
    )
