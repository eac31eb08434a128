"""Catalogue queries over clients, projects and files.

Joins carry no broadcast hint. Spark broadcasts a side only when its size, known from the
files or measured at run time, is below `spark.sql.autoBroadcastJoinThreshold`; above it
the join is shuffled, and adaptive execution splits the partitions of hot projects.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import rules
from folioflow.operators.ordering import rank_from_zero

# Fixed value: rows of a result page that a reader may choose.
PAGE_SIZES = (10, 20, 30, 50, 100)


def scan_clients(clients: DataFrame) -> DataFrame:
    return clients.select("id", "name")


def eq_filter(rows: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows equal to every given value; the conditions reach the file scan."""
    for name, value in values.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def in_filter(rows: DataFrame, column: str, wanted: Sequence | DataFrame) -> DataFrame:
    """Rows whose column is in a short list, or in the one column of another table."""
    if isinstance(wanted, DataFrame):
        keys = wanted.select(F.col(wanted.columns[0]).alias(column))
        return rows.join(keys, column, "left_semi").select(*rows.columns)
    return rows.where(F.col(column).isin(list(wanted)))


def first_match(rows: DataFrame, key: Column, order: str = "id") -> DataFrame:
    """One row per key, always the one with the lowest `order`.

    The ids found are unique, so the join back spreads evenly however often a key occurs.
    """
    firsts = rows.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)
    return rows.join(firsts, order, "left_semi").select(*rows.columns)


def name_lookup(clients: DataFrame, projects: DataFrame, query: str) -> DataFrame:
    """Projects (id, name) of the first client whose name equals the query.

    Case is ignored and `_` in the query stands for a space.
    """
    wanted = query.replace("_", " ")
    client = clients.where(F.lower("name") == F.lower(F.lit(wanted))).agg(
        F.min("id").alias("client_id")
    )
    return projects.join(client, "client_id", "left_semi").select("id", "name")


def project_client(projects: DataFrame, clients: DataFrame) -> DataFrame:
    """Projects with their client's name."""
    names = clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    return projects.join(names, "client_id").select(
        "id", "name", "client_id", "client_name", "user_id"
    )


def file_listing(files: DataFrame) -> DataFrame:
    """What a reader sees of a file: links by state and the upload time as text."""
    status, key = F.col("status"), F.col("id")
    return files.select(
        "project_id",
        "id",
        F.col("file_name").alias("name"),
        "status",
        rules.download_url(status, key).alias("download_url"),
        rules.error_url(status, key).alias("error_url"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def projects_with_files(
    projects: DataFrame,
    clients: DataFrame,
    files: DataFrame,
    part_files: int = 1000,
) -> DataFrame:
    """Every project with its listed files in id order; a project without files has [].

    A project of up to `part_files` files is one row. A larger one continues in further
    rows numbered by `part_no`, so that no project is collected whole into one row.
    """
    ranked = rank_from_zero(file_listing(files), ["project_id"], "id", "_rank")
    fields = ["id", "name", "status", "download_url", "error_url", "created_at"]
    parts = (
        ranked.withColumn("part_no", F.floor(F.col("_rank") / part_files).cast("int"))
        .groupBy("project_id", "part_no")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("files"))
    )
    named = project_client(projects, clients).select(
        F.col("id").alias("project_id"), "name", "client_name", "user_id"
    )
    # An outer join could not be split at a project with very many parts; an inner one can.
    idle = named.join(files.select("project_id").distinct(), "project_id", "left_anti")
    empty = idle.withColumns(
        {
            "part_no": F.lit(0),
            "files": F.array().cast(parts.schema["files"].dataType),
        }
    )
    return parts.join(named, "project_id").select(*empty.columns).unionByName(empty)


def project_json(listing: DataFrame) -> DataFrame:
    """Add `body`: the row of `projects_with_files` as JSON text, nulls written out."""
    body = F.to_json(F.struct("name", "client_name", "files"), {"ignoreNullFields": "false"})
    return listing.withColumn("body", body)


def catalog(clients: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file with its project and client; projects without files vanish."""
    named = project_client(projects, clients).select(
        F.col("id").alias("project_id"), F.col("name").alias("project_name"), "client_name"
    )
    return files.join(named, "project_id").select(
        "client_name",
        "project_name",
        F.col("id").alias("file_id"),
        "file_name",
        "created_at",
        "status",
    )


def with_action(rows: DataFrame) -> DataFrame:
    return rows.withColumn("action", rules.status_action(F.col("status")))


SEARCH_COLUMNS = ("client_name", "project_name", "file_name", "created_at", "status", "action")


def searched_text(columns: Sequence[str] = SEARCH_COLUMNS) -> Column:
    """What a search looks into: the cells joined by a space, lowered."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))


def search_rows(
    rows: DataFrame, text: str, columns: Sequence[str] = SEARCH_COLUMNS
) -> DataFrame:
    """Rows whose cells, joined by a space, hold the text in any case.

    Plain text search: paging the result pages the filtered rows.
    """
    return rows.where(searched_text(columns).contains(text.lower()))


def sort_keys(column: str, dtype: str, key: str, descending: bool) -> list[Column]:
    """Case-folded for text, by value for all else, ties by key."""
    value = F.lower(column) if dtype == "string" else F.col(column)
    return [value.desc() if descending else value.asc(), F.col(key).asc()]


def sort_rows(
    rows: DataFrame, column: str, key: str = "file_id", descending: bool = False
) -> DataFrame:
    """All rows sorted by the named column. The key keeps equal values from one task."""
    return rows.orderBy(*sort_keys(column, dict(rows.dtypes)[column], key, descending))


def order_by_id(rows: DataFrame, parent: str, key: str = "id") -> DataFrame:
    """Children in id order within their parent."""
    return rows.orderBy(parent, key)


def paginate(
    rows: DataFrame,
    page: int,
    size: int,
    column: str,
    key: str = "file_id",
    descending: bool = False,
) -> DataFrame:
    """Page `page` (from 1) of the sorted rows.

    Planned as a top-k: each task keeps page*size rows at most and only those meet. For
    pages far down a large result use `next_page` or stored `sorted_pages`, whose cost does
    not grow with depth.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"size must be one of {PAGE_SIZES}")
    if page < 1:
        raise ValueError("pages are numbered from 1")
    return sort_rows(rows, column, key, descending).offset((page - 1) * size).limit(size)


def next_page(
    rows: DataFrame,
    after: tuple[object, object],
    size: int,
    column: str,
    key: str = "file_id",
    descending: bool = False,
) -> DataFrame:
    """The page that follows the row with sort value and key `after`.

    A filter and a top-k of `size` rows at any depth. For text columns the sort value is
    compared without case. The sort column must not be null in the row given.
    """
    last_value, last_key = F.lit(after[0]), F.lit(after[1])
    text = dict(rows.dtypes)[column] == "string"
    value = F.lower(column) if text else F.col(column)
    last = F.lower(last_value) if text else last_value
    beyond = value < last if descending else value > last
    # Spark sorts nulls first going up and last going down.
    if descending:
        beyond = beyond | value.isNull()
    rest = rows.where(beyond | ((value == last) & (F.col(key) > last_key)))
    return sort_rows(rest, column, key, descending).limit(size)


def page_total(rows: DataFrame, size: int) -> DataFrame:
    """Number of rows and of result pages."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.ceil(F.col("n_rows") / size).alias("n_pages")
    )


STATUSES = (rules.NOT_PROCESSED, rules.PROCESSING, rules.PROCESSED, rules.FAILED)


# Columns that count the files in each state.
STATUS_COUNTS = {
    "n_not_processed": rules.NOT_PROCESSED,
    "n_processing": rules.PROCESSING,
    "n_processed": rules.PROCESSED,
    "n_failed": rules.FAILED,
}


def named_summary(clients: DataFrame, projects: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts by project_id summed by client and project name; projects without any count zero."""
    owners = project_client(projects, clients).select(
        F.col("id").alias("project_id"), F.col("name").alias("project_name"), "client_name"
    )
    zero = F.lit(0).cast("bigint")
    return (
        owners.join(counts, "project_id", "left")
        .groupBy("client_name", "project_name")
        .agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in ["n_files", *STATUS_COUNTS]])
    )


def project_summary(clients: DataFrame, projects: DataFrame, files: DataFrame) -> DataFrame:
    """File counts by client and project name, in total and by status.

    Projects with the same names count together; projects without files count zero. Files
    are counted per project id before any join, so only one row per project travels on.
    """
    counts = files.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        *[F.count_if(F.col("status") == s).alias(n) for n, s in STATUS_COUNTS.items()],
    )
    return named_summary(clients, projects, counts)


def distinct_names(projects: DataFrame, clients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct names of clients that have a project, and distinct project names."""
    named = project_client(projects, clients)
    return named.select("client_name").distinct(), named.select("name").distinct()
