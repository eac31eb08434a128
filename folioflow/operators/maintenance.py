"""Removing projects and expiring old uploads. Nothing is changed in place: a deletion from stored
tables makes a new version of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.functions import names, rules
from folioflow.sources import versions

# Fixed value: hours an upload is kept.
RETENTION_HOURS = 24


@dataclass(frozen=True)
class Deletion:
    """Tables after a deletion, to be written as new versions, and what was removed."""

    projects: DataFrame
    files: DataFrame
    removed: DataFrame


def delete_projects(projects: DataFrame, files: DataFrame, ids: DataFrame) -> Deletion:
    """Delete the projects with the given ids (column `id`) and all their files.

    Clients stay. `removed` counts the rows taken out of both tables. An empty id list is
    refused by `require_ids`.
    """
    wanted = ids.select("id").distinct()
    owned = wanted.withColumnRenamed("id", "project_id")
    removed_files = files.join(owned, "project_id", "left_semi")
    removed_projects = projects.join(wanted, "id", "left_semi")
    counts = removed_projects.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("projects").alias("table_name"), "n_rows"
    )
    counts = counts.unionByName(
        removed_files.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit("files").alias("table_name"), "n_rows"
        )
    )
    return Deletion(
        projects.join(wanted, "id", "left_anti").select(*projects.columns),
        files.join(owned, "project_id", "left_anti").select(*files.columns),
        counts,
    )


def deleted_paths(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored paths to remove with the projects: path and kind, each once.

    Of every file the document as it was uploaded and, in the same folder, the merged one and the final one;
    which of them exist is told by a listing, see `storage.resolve_outputs`. A path that a kept
    file uses as well stays.
    """
    folder, name = names.parent_folder(F.col("file_path")), F.col("file_name")
    beside = lambda made: F.concat(folder, F.lit("/"), made)
    path = lambda value, kind: F.struct(value.alias("path"), F.lit(kind).alias("kind"))
    stored = F.inline(F.array(
        path(F.col("file_path"), "upload"), path(beside(names.merged_name(name)), "merged"),
        path(beside(names.outlined_name(name)), "final"),
    ))
    owned = ids.select(F.col("id").alias("project_id")).distinct()
    gone = files.join(owned, "project_id", "left_semi").select(stored).distinct()
    kept = files.join(owned, "project_id", "left_anti").select("file_path", "file_name").select(stored)
    return gone.join(kept.select("path"), "path", "left_anti").where(F.col("path").isNotNull())


def delete_written(spark: SparkSession, tables: dict[str, tuple[str, StructType]], ids: DataFrame) -> dict[str, int]:
    """Delete projects from tables stored by `versions` (name: folder and schema) and return the
    version that each has now. Files go first, so no file is ever without its project."""
    wanted = require_ids(ids).select("id").distinct()
    keys = {"files": wanted.withColumnRenamed("id", "project_id"), "projects": wanted}
    return {name: versions.delete_rows(spark, *tables[name], key) for name, key in keys.items()}


def require_ids(ids: DataFrame) -> DataFrame:
    if ids.isEmpty():
        raise ValueError(rules.NO_IDS)
    return ids


def mark_expired(
    rows: DataFrame, time: str, now: Column, hours: int = RETENTION_HOURS
) -> DataFrame:
    """Mark rows older than the retention; `now` is an argument. Rows of no time are kept."""
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    return rows.withColumn("expired", F.coalesce(F.col(time) < cutoff, F.lit(False)))


def keep_recent(rows: DataFrame, time: str, now: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    return mark_expired(rows, time, now, hours).where(~F.col("expired")).drop("expired")


def expired_uploads(
    chunks: DataFrame, manifest: DataFrame, time: str, now: Column, hours: int = RETENTION_HOURS
) -> DataFrame:
    """Incomplete uploads whose last chunk is older than the retention."""
    last = chunks.groupBy("upload_id").agg(F.max(time).alias("last_seen"))
    stale = mark_expired(last, "last_seen", now, hours).where("expired")
    return stale.join(manifest.where(~F.col("complete")), "upload_id").select(
        "upload_id", "n_chunks", "total_chunks", "last_seen"
    )
