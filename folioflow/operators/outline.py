"""Document outlines (bookmarks), always one row per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.batching import BATCH_PAGES
from folioflow.operators.ordering import explode_range, running_total

# A heading element: its level and its inner HTML.
_HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>"


def extract_outline(html_pages: DataFrame, *keys: str) -> DataFrame:
    """Headings of HTML pages (key columns, html) as outline rows.

    One row per heading: the keys, pos (order within the page), line (level), bookmark
    (title). A page without headings gives no rows. Stays a narrow projection: each page is
    searched once, and the headings found are taken apart.
    """
    headings = F.regexp_extract_all("html", F.lit(_HEADING), F.lit(0))
    entries = html_pages.select(*keys, F.posexplode(headings).alias("pos", "_heading"))
    title = F.regexp_extract("_heading", _HEADING, 2)
    return entries.select(
        *keys,
        "pos",
        F.substring("_heading", 3, 1).cast("int").alias("line"),
        F.trim(F.regexp_replace(title, r"<[^>]*>", "")).alias("bookmark"),
    )


def outline_range(
    outline: DataFrame, ranges: DataFrame, width: int = BATCH_PAGES
) -> DataFrame:
    """Outline entries that fall in page ranges of their document, renumbered from 1.

    `ranges` has doc_id, start_page, end_page (1-based, inclusive) and any label columns.
    Both sides meet on (doc_id, page div width): a range is listed once for each stretch of
    `width` pages it touches, so an entry meets only ranges near it, never all ranges of a
    long document. Set `width` to the usual range length. The join is always shuffled:
    Spark takes the size of the listed ranges from before they are listed.
    """
    first = F.floor((F.col("start_page") - 1) / width)
    last = F.floor((F.col("end_page") - 1) / width)
    whole = ranges.where(F.col("end_page") >= F.col("start_page"))
    spread = explode_range(whole, first, last, "_stretch")
    entries = outline.withColumn("_stretch", F.floor(F.col("page") / width))
    zero_based_start = F.col("start_page") - 1
    inside = (F.col("page") >= zero_based_start) & (F.col("page") < F.col("end_page"))
    return (
        entries.join(spread.hint("merge"), ["doc_id", "_stretch"])
        .where(inside)
        .withColumn("page", (F.col("page") - zero_based_start + 1))
        .drop("_stretch")
    )


def reattach_outline(outline: DataFrame, kept: DataFrame, width: int = BATCH_PAGES) -> DataFrame:
    """Outline of the merged documents: each entry follows its page, pages from 1.

    `kept` lists the page ranges of the source documents that are in the merged ones
    (doc_id, start_page, end_page). Entries of pages that are gone go too; the others move up
    by the pages that are missing before them. Needs `pos`, the entry's place in the source
    outline; the rows of a document sorted by it are its table of contents.
    """
    size = (F.col("end_page") - F.col("start_page") + 1).cast("bigint")
    placed = running_total(
        kept.select("doc_id", "start_page", "end_page"), ["doc_id"], "start_page", size, "_before"
    )
    return outline_range(outline, placed, width).select(
        "doc_id", "pos", "line", "bookmark", (F.col("_before") + F.col("page")).alias("page")
    )
