"""Applying a page function to batches, with failures kept as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from folioflow.functions import rules

# A page function takes the page texts of one call and returns as many texts.
PageFunction = Callable[[pa.Array], object]

# Page texts that a task works on at once; a row with more is a block of its own.
BLOCK_BYTES = 1 << 20

_RESULT = "array<struct<pages:array<string>,error:string>>"
_ARROW_RESULT = pa.list_(
    pa.struct([("pages", pa.list_(pa.string())), ("error", pa.string())])
)


def from_pandas(function: Callable[[pd.Series], pd.Series]) -> PageFunction:
    """Use a function over a pandas Series of page texts as a page function."""
    return lambda pages: function(pages.to_pandas())


def _call(function: PageFunction, pages: pa.Array) -> pa.Array:
    result = function(pages)
    if isinstance(result, pa.ChunkedArray):
        result = result.combine_chunks()
    if not isinstance(result, pa.Array):
        result = pa.array(result, pa.string(), from_pandas=True)
    if len(result) != len(pages):
        raise ValueError(f"page function returned {len(result)} pages for {len(pages)}")
    return result if result.type == pa.string() else result.cast(pa.string())


def _one_batch(function: PageFunction, pages: pa.Array, by_page: bool) -> list[pa.Array]:
    if not by_page:
        return [_call(function, pages)]
    return [_call(function, pages.slice(i, 1)) for i in range(len(pages))]


def _run(function: PageFunction, texts: pa.Array, ends: np.ndarray, by_page: np.ndarray,
         vectorised: bool):
    """Page texts of all batches that went well, and the error of each that did not.

    Vectorised, a stretch of batches is one call; a stretch that fails is halved until the
    failing batches stand alone.
    """
    errors: list[str | None] = [None] * len(ends)
    parts: list[pa.Array] = []
    stretches = [(0, len(ends))] if vectorised else [(i, i + 1) for i in range(len(ends))]
    stretches.reverse()
    while stretches:
        low, high = stretches.pop()
        start = ends[low - 1] if low else 0
        pages = texts.slice(start, ends[high - 1] - start)
        try:
            if high - low > 1:
                parts.append(_call(function, pages))
            else:
                parts += _one_batch(function, pages, bool(by_page[low]) and not vectorised)
        except Exception as problem:
            if high - low > 1:
                middle = (low + high) // 2
                stretches += [(middle, high), (low, middle)]
            else:
                errors[low] = str(problem) or type(problem).__name__
    done = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    return done, errors


def recognise_block(
    function: PageFunction, vectorised: bool, rows: pa.Array, by_page: pa.Array
) -> pa.Array:
    """One Arrow block: rows of batches of page texts to one {pages, error} per batch."""
    batches = rows.flatten()
    if not len(batches):
        return pa.array([[]] * len(rows), _ARROW_RESULT)
    per_row = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(batches).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    single = np.repeat(by_page.to_numpy(zero_copy_only=False), per_row)
    done, errors = _run(function, batches.flatten(), ends, single, vectorised)
    failed = np.array([error is not None for error in errors])
    offsets = np.concatenate([[0], np.cumsum(np.where(failed, 0, sizes))]).astype(np.int32)
    pages = pa.ListArray.from_arrays(pa.array(offsets), done, mask=pa.array(failed))
    results = pa.StructArray.from_arrays(
        [pages, pa.array(errors, pa.string())], ["pages", "error"]
    )
    row_ends = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(row_ends), results)


def blocks(rows: pa.Array) -> Iterator[slice]:
    """Cuts rows of batches of page texts where their texts pass a multiple of `BLOCK_BYTES`."""
    texts = rows.values.values
    if not len(rows) or not len(texts):
        yield slice(0, len(rows))
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], width)[texts.offset :]
    first = rows.values.offsets.to_numpy()[rows.offsets.to_numpy()]
    _, starts = np.unique(ends[first[:-1]] // BLOCK_BYTES, return_index=True)
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
        yield slice(start, end)


def _batch_udf(function: PageFunction, vectorised: bool):
    # The results of a block go back before the next one is worked on, so a task holds one
    # Arrow batch of input, but not its results.
    @arrow_udf(_RESULT)
    def recognise_rows(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows, by_page in parts:
            for block in blocks(rows):
                yield recognise_block(function, vectorised, rows[block], by_page[block])

    # Otherwise a filter on the outcome is moved below and calls the function once more.
    return recognise_rows.asNondeterministic()


def _results(rows: DataFrame, batches, function: PageFunction, option, vectorised: bool):
    """Add `_results`, one {pages, error} per batch; invalid options fail every batch."""
    valid = rules.is_valid_option(option)
    udf = _batch_udf(function, vectorised)
    # A row with an invalid option hands no batches to Python.
    sent = F.when(valid, batches).otherwise(F.array().cast("array<array<string>>"))
    refused = F.transform(
        batches,
        lambda b: F.struct(
            F.lit(None).cast("array<string>").alias("pages"),
            F.lit(rules.INVALID_OPTION).alias("error"),
        ),
    )
    answered = rows.withColumn("_answer", udf(sent, rules.run_option(option) == rules.ADVANCED))
    return answered.withColumn(
        "_results", F.when(valid, F.col("_answer")).otherwise(refused)
    ).drop("_answer")


def recognise_batches(
    batches: DataFrame,
    function: PageFunction,
    option: str | None = None,
    spread: int | None = None,
    vectorised: bool = False,
) -> DataFrame:
    """Apply a page function to every batch of `burst`, in parallel.

    An exception becomes a row with status `Failed`, the error text and null pages; the
    batch's own pages stay in `source_pages` for the failure policy. `option` names a
    column holding `basic` (one call per batch, the default) or `advanced` (one call per
    page). With `vectorised`, for cheap functions that treat each page on its own, one call
    takes the pages of many batches whatever the option; stretches that fail are halved
    until the failing batches are found.

    `spread` repartitions by (doc_id, batch_no) into that many partitions first. It costs a
    shuffle of the pages and pays when the function is slow and documents are long; a fixed
    number is used so that adaptive execution does not merge the partitions again because
    their bytes are few.
    """
    rows = batches.repartition(spread, "doc_id", "batch_no") if spread else batches
    choice = F.col(option) if option else F.lit(rules.BASIC)
    done = _results(rows, F.array("pages"), function, choice, vectorised)
    result = F.col("_results")[0]
    return done.select(
        "doc_id",
        "batch_no",
        "start_page",
        "end_page",
        F.when(result["error"].isNull(), rules.PROCESSED).otherwise(rules.FAILED).alias("status"),
        result["pages"].alias("pages"),
        result["error"].alias("error"),
        F.when(result["error"].isNotNull(), F.col("pages")).alias("source_pages"),
    )


def recognise_sections(
    sections: DataFrame,
    function: PageFunction,
    option: str | None = None,
    spread: int | None = None,
    vectorised: bool = False,
) -> DataFrame:
    """The same on the rows of `sections`: adds `results`, one {pages, error} per batch.

    The batches of a row stay together, so merging them needs no shuffle afterwards.
    """
    rows = sections.repartition(spread, "doc_id", "section_no") if spread else sections
    choice = F.col(option) if option else F.lit(rules.BASIC)
    return _results(rows, F.col("batches"), function, choice, vectorised).withColumnRenamed(
        "_results", "results"
    )


ON_ERROR = ("fallback", "skip", "abort")


def _check_policy(on_error: str) -> None:
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")


def apply_policy(results: DataFrame, on_error: str = "fallback") -> DataFrame:
    """Batches that go into the merge, from `recognise_batches`.

    fallback: a failed batch keeps its original pages.
    skip:     a failed batch is left out; its pages are missing from the document.
    abort:    a document with any failed batch is left out. The results are read twice, so
              pass a written table, or the page function runs twice.
    """
    _check_policy(on_error)
    if on_error == "fallback":
        return results.withColumn("pages", F.coalesce("pages", "source_pages"))
    good = results.where(F.col("status") == rules.PROCESSED)
    if on_error == "skip":
        return good
    failed = results.where(F.col("status") == rules.FAILED).select("doc_id").distinct()
    return good.join(failed, "doc_id", "left_anti").select(*results.columns)


def merge_sections(results: DataFrame, on_error: str = "fallback") -> DataFrame:
    """Merged pages of each section, from `recognise_sections`; no shuffle.

    Adds `n_pages`, `n_failed` (failed batches) and `kept`, the page ranges of the source that
    are in the section. `abort` concerns whole documents, which a section can't see: it is
    refused here; `run_documents` does it on the written sections.
    """
    _check_policy(on_error)
    if on_error == "abort":
        raise ValueError("sections can't abort a document; see run_documents")
    if on_error == "fallback":
        kept = F.zip_with("results", "batches", lambda r, b: F.coalesce(r["pages"], b))
    else:
        kept = F.array_compact(F.transform("results", lambda r: r["pages"]))
    failures = F.size(F.filter("results", lambda r: r["error"].isNotNull()))
    # All batches of a section but the last are as long as the first.
    first = lambda i: F.col("start_page") + i * F.size(F.col("batches")[0])
    ranges = F.transform(
        F.arrays_zip("results", "batches"),
        lambda b, i: F.struct(
            first(i).alias("start_page"),
            (first(i) + F.size(b["batches"]) - 1).alias("end_page"),
            b["results"]["error"].isNull().alias("good"),
        ),
    )
    if on_error != "fallback":
        ranges = F.filter(ranges, lambda r: r["good"])
    ranges = F.transform(ranges, lambda r: F.struct(r["start_page"].alias("start_page"),
                                                    r["end_page"].alias("end_page")))
    merged = results.select(
        "doc_id", "section_no", "start_page", F.flatten(kept).alias("pages"),
        failures.alias("n_failed"), ranges.alias("kept"),
    )
    return merged.withColumn("n_pages", F.size("pages"))


def kept_ranges(merged: DataFrame) -> DataFrame:
    """(doc_id, start_page, end_page) of the source pages in the result of `merge_sections`."""
    return merged.select("doc_id", F.explode("kept").alias("_range")).select("doc_id", "_range.*")


def failed_documents(merged: DataFrame) -> DataFrame:
    """Ids of documents with a failed batch, from the written result of `merge_sections`."""
    return merged.where(F.col("n_failed") > 0).select("doc_id").distinct()


def status_rollup(
    results: DataFrame, expected: DataFrame, document: str = "doc_id"
) -> DataFrame:
    """One status per document of `expected` (document, n_batches) over all its batch results.

    Failed if any batch failed, Processed if all expected batches were processed, else
    Processing, also where none has reported yet. Only counts are shuffled, combined on the
    map side; a batch reported twice counts once.
    """
    failed = F.count_if(F.col("status") == rules.FAILED)
    processed = F.count_if(F.col("status") == rules.PROCESSED)
    once = results.groupBy(document, "batch_no").agg(F.min("status").alias("status"))
    seen = once.groupBy(document).agg(failed.alias("n_failed"), processed.alias("n_done"))
    counts = expected.select(document, "n_batches").join(seen, document, "left").fillna(
        0, ["n_failed", "n_done"]
    )
    status = (
        F.when(F.col("n_failed") > 0, rules.FAILED)
        .when(F.col("n_done") == F.col("n_batches"), rules.PROCESSED)
        .otherwise(rules.PROCESSING)
    )
    return counts.select(document, "n_batches", "n_failed", status.alias("status"))


def option_rejects(files: DataFrame, option: str = "option") -> DataFrame:
    """Split on the run option: adds `run_option`, `accepted` and `reject_reason`."""
    valid = rules.is_valid_option(F.col(option))
    return files.withColumns(
        {
            "run_option": rules.run_option(F.col(option)),
            "accepted": valid,
            "reject_reason": F.when(~valid, rules.INVALID_OPTION),
        }
    )
