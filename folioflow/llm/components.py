"""Connected components of links, by alternating large-star and small-star steps.

Each step hangs neighbours on the smallest id around them, so long chains shrink by a factor
at every step and the result is one star for each component. Smallest neighbours are found
with partial sums and joined back, so a node with very many links is split like any hot key.
Every step is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.tables import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")
    ).first()
    return row.n, row.x


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").where(F.col("v") != F.col("least"))
    return (
        moved.select(F.col("v").alias("u"), F.col("least").alias("v"))
        .union(least.select("u", F.col("least").alias("v")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of the links (u, v) that is not the smallest of its component;
    root is the smallest."""
    edges = written(links.where("u != v").select("u", "v").distinct(), "links")
    state, last = _state(edges), None
    while state != last:
        edges = written(_small_star(written(_large_star(edges), "large-star")), "small-star")
        last, state = state, _state(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
