"""The document run: split, recognise in parallel, merge in page order, outline, status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.operators import batching, merge, outline, recognise
from folioflow.sources.storage import written

NO_PAGES = "Document has no pages"


def merged_sections(
    documents: DataFrame,
    function: recognise.PageFunction,
    on_error: str = "fallback",
    section_pages: int = batching.SECTION_PAGES,
    spread: int | None = None,
    vectorised: bool = False,
    option: str | None = None,
) -> DataFrame:
    """Documents (doc_id, text) to merged sections without any shuffle.

    Sections carry their batches as arrays through the page function, so the fan-in of a
    section is a local array merge. `spread` adds one repartition for slow page functions.
    A table of pages (doc_id, page_no, text) is taken as well, with one shuffle. `option`
    names the column with each document's run option.
    """
    carry = [option] if option else []
    if "page_no" in documents.columns:
        cut = batching.sections_of_pages(documents, section_pages, carry=carry)
    else:
        cut = batching.sections(documents, section_pages, carry=carry)
    done = recognise.recognise_sections(cut, function, option, spread, vectorised)
    return recognise.merge_sections(done, on_error)


@dataclass(frozen=True)
class Run:
    """Tables written by a run."""

    sections: DataFrame
    outline: DataFrame
    status: DataFrame
    page_counts: DataFrame


def run_documents(
    documents: DataFrame,
    outlines: DataFrame,
    function: recognise.PageFunction,
    folder: str,
    on_error: str = "fallback",
    spread: int | None = None,
    option: str | None = None,
) -> Run:
    """The whole run, written below `folder`; status is set after the merge.

    The page function runs once: its result is a written table from which the outline,
    the status and the page counts are taken without the pages being read again.
    """
    policy = "skip" if on_error == "abort" else on_error
    merged = written(
        merged_sections(documents, function, policy, spread=spread, option=option),
        f"{folder}/sections",
    )
    if on_error == "abort":
        kept = merged.join(recognise.failed_documents(merged), "doc_id", "left_anti")
    else:
        kept = merged
    source = batching.source_page_counts(documents)
    lengths = merge.page_counts(kept)
    failed = merged.groupBy("doc_id").agg(F.sum("n_failed").alias("n_failed"))
    outcome = source.join(failed, "doc_id", "left")
    processed = F.coalesce(F.col("n_failed") == 0, F.lit(False))
    status = outcome.select(
        "doc_id",
        F.when(processed, rules.PROCESSED).otherwise(rules.FAILED).alias("status"),
        "n_failed",
        F.when(F.col("n_pages") == 0, NO_PAGES).alias("error"),
    )
    counts = merge.compare_page_counts(source, lengths)
    attached = outline.reattach_outline(outlines, recognise.kept_ranges(kept))
    return Run(
        kept,
        written(attached, f"{folder}/outline"),
        written(status, f"{folder}/status"),
        written(counts, f"{folder}/page_counts"),
    )
