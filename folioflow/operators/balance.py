"""Spreading batches over tasks by what they cost.

A hash of the document deals out as many batches to each task, whatever they cost; one task with
long batches then holds up the run. Here batches are put in order of falling cost and cut into
ranges of equal running cost, one for each task. Tasks with a low number hold few dear batches and
start first, those with a high number many cheap ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.ordering import running_total
from folioflow.sources.storage import shared_folder, written

BATCH = ("doc_id", "batch_no")


def text_cost(pages: str = "pages", page_cost: int = 0) -> Column:
    """Bytes of the pages, and `page_cost` more for each; what is null costs nothing."""
    sizes = F.transform(pages, lambda page: F.coalesce(F.octet_length(page), F.lit(0)).cast("bigint") + page_cost)
    return F.coalesce(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, size: total + size), F.lit(0))


def task_numbers(costs: DataFrame, tasks: int, key: Sequence[str] = BATCH) -> DataFrame:
    """The key columns and `task`, from 0, of rows with a `cost` of 0 or more.

    The key is unique and not null. A task's cost differs from the mean by the cost of one row at
    most, as a row goes where the middle of its stretch of the running cost lies. Rows of equal cost are
    spread, and only sums, one row a partition, meet in one task.
    """
    if tasks < 1:
        raise ValueError("tasks must be at least 1")
    place = F.struct((-F.col("cost")).alias("dear"), *key)
    # A row weighs one at least, so that rows without cost are spread too.
    weighed = costs.select(*key, place.alias("_place"), F.greatest("cost", F.lit(1)).alias("_cost"))
    running = running_total(weighed, [], "_place", F.col("_cost"), "_before")
    folder = shared_folder(costs.sparkSession)
    table = written(running.select(*key, "_cost", "_before"), folder)
    total = table.agg(F.sum("_cost")).first()[0] or 1
    # Doubled costs, so that the middle is a whole number.
    middle = 2 * F.col("_before") + F.col("_cost")
    return table.select(*key, F.floor(middle * tasks / F.lit(2.0 * total)).cast("int").alias("task"))


def spread_by_cost(
    batches: DataFrame, tasks: int, cost: Column | None = None, key: Sequence[str] = BATCH
) -> DataFrame:
    """The batches in `tasks` partitions of about equal cost (by default bytes of text), dearest first.

    The batches are read twice: for their costs, and to be moved. Pass the result to
    `recognise_batches` without `spread`.
    """
    costs = batches.select(*key, (text_cost() if cost is None else cost).alias("cost"))
    numbered = batches.join(task_numbers(costs, tasks, key), list(key))
    dealt = numbered.repartitionById(tasks, F.least("task", F.lit(tasks - 1)))
    return dealt.select(*batches.columns)
