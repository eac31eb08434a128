"""Sources and sinks on files and tables."""

from __future__ import annotations

import os
import re
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import names

# Fixed value: stored documents, in either case of the extension.
DOCUMENT_GLOB = "*.[pP][dD][fF]"
# Files written to one folder, which is listed at once.
FOLDER_FILES = 1000
# Entries of a tree that Spark's reader may list: it holds every file in the driver.
DRIVER_FILES = 100_000
# Of larger trees: rows of a listing and bytes of content that a task hands on at once, and bytes it reads.
LISTED_ROWS, BATCH_BYTES, TASK_BYTES = 10_000, 4 << 20, 128 << 20


def scan_documents(
    spark: SparkSession, root: str, pattern: str = DOCUMENT_GLOB, content: bool = True
) -> DataFrame:
    """Files of an upload tree: path, file_name, modified_at, file_size and content.

    The reads are distributed. Of a large tree on shared disks the listing is so too, and the
    driver holds neither files nor folders. Elsewhere, and for a `root` with wildcards, Spark's
    reader lists them in the driver. Empty files are left out. Without `content` no file is opened. A file is one
    value, so it must be below 2 GiB; larger ones belong in a page table.
    """
    local = _local_path(spark, root)
    if local is not None and _holds_more(local, DRIVER_FILES):
        files = _files_of_tasks(spark, local, pattern, content)
    else:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern)
            .load(root)
        )
        # Spark plans a task for each 32 small files, however many there are; they go on in fewer.
        tasks = max(3 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // 32)
        files = files.coalesce(tasks)
    columns = [
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("modificationTime").alias("modified_at"),
        F.col("length").alias("file_size"),
    ]
    return files.select(*columns, *(["content"] if content else []))


def _holds_more(folder: str, most: int) -> bool:
    """Whether a tree has more entries than `most`; no others are looked at."""
    seen, below = 0, [folder]
    try:
        while below:
            with os.scandir(below.pop()) as entries:
                for entry in entries:
                    seen += 1
                    if seen > most:
                        return True
                    if entry.is_dir():
                        below.append(entry.path)
    except OSError:  # Spark's reader tells what is wrong
        pass
    return False


def _batch(rows: list[tuple], last: str, kind: str):
    import pyarrow as pa

    kinds = {"path": "string", "modified_us": "int64", "length": "int64", last: kind}
    schema = pa.schema([(name, pa.type_for_alias(kind)) for name, kind in kinds.items()])
    return pa.record_batch(list(zip(*rows, strict=True)), schema=schema)


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files of a tree on shared disks (path, modified_us, length), listed by tasks a level at a
    time and written. Names are judged as by Spark's reader: hidden and empty files are left out.
    """
    rule = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().toString()
    schema = "path string, modified_us bigint, length bigint, is_folder boolean"

    def entries_of(batches):
        wanted, rows = re.compile(rule, re.DOTALL), []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with os.scandir(folder) as entries:
                    for entry in entries:
                        name = entry.name
                        if name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name:
                            continue
                        if entry.is_dir():
                            rows.append((entry.path, None, None, True))
                        elif wanted.fullmatch(name):
                            try:
                                stat = entry.stat()
                            except FileNotFoundError:  # gone, or a link to nothing
                                continue
                            if stat.st_size:
                                rows.append((entry.path, stat.st_mtime_ns // 1_000_000 * 1000, stat.st_size, False))
                        if len(rows) >= LISTED_ROWS:
                            yield _batch(rows, "is_folder", "bool")
                            rows = []
        if rows:
            yield _batch(rows, "is_folder", "bool")

    written_to, level = shared_folder(spark), 0
    folders = spark.createDataFrame([(root,)], "path string")
    while True:
        found = written(folders.mapInArrow(entries_of, schema), f"{written_to}/{level}")
        folders = found.where("is_folder").select("path")
        n_folders = folders.count()
        if not n_folders:
            break
        folders = folders.repartition(min(n_folders, 3 * spark.sparkContext.defaultParallelism))
        level += 1
    levels = [f"{written_to}/{number}" for number in range(level + 1)]
    return spark.read.schema(schema).parquet(*levels).where("NOT is_folder").drop("is_folder")


def _checked(path: str, body: bytes) -> bytes:
    """The content of a file; where Hadoop left its checksums beside it, they must agree."""
    folder, name = os.path.split(path)
    try:
        with open(f"{folder}/.{name}.crc", "rb") as file:
            sums = file.read()
    except OSError:
        return body
    if sums[:4] == b"crc\0":
        step = int.from_bytes(sums[4:8], "big")
        starts = range(0, len(body), step)
        if b"".join(zlib.crc32(body[at : at + step]).to_bytes(4, "big") for at in starts) != sums[8:]:
            raise OSError(f"checksum error in {path}")
    return body


def _files_of_tasks(spark: SparkSession, root: str, pattern: str, content: bool) -> DataFrame:
    """What Spark's reader of binary files returns, listed and read by tasks."""
    files = _listed(spark, root, pattern)
    if content:
        n_files, n_bytes = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        tasks = max(3 * spark.sparkContext.defaultParallelism, n_bytes // TASK_BYTES)
        schema = "path string, modified_us bigint, length bigint, content binary"

        def contents(batches):
            rows, held = [], 0
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    with open(path, "rb") as file:
                        stat, body = os.fstat(file.fileno()), _checked(path, file.read())
                    rows.append((path, stat.st_mtime_ns // 1_000_000 * 1000, len(body), body))
                    held += len(body)
                    if held >= BATCH_BYTES or len(rows) >= LISTED_ROWS:
                        yield _batch(rows, "content", "binary")
                        rows, held = [], 0
            if rows:
                yield _batch(rows, "content", "binary")

        files = files.repartition(max(1, min(tasks, n_files))).mapInArrow(contents, schema)
    return files.withColumns(
        {"path": F.concat(F.lit("file:"), "path"), "modificationTime": F.timestamp_micros("modified_us")}
    )


def text_documents(files: DataFrame) -> DataFrame:
    """Scanned text files as documents: doc_id is the path, text the decoded content."""
    return files.select(
        F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text")
    )


def _local_path(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that tasks reach by itself, or None where only Hadoop opens it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path)
    return whole.toUri().getPath() if whole.toUri().getScheme() == "file" else None


def write_documents(documents: DataFrame, folder: str) -> None:
    """Documents (doc_id, text) as text files of one document each, their id in the path, each
    row ended by a line end. Rows of one task with the same id share a file.

    Hadoop's local file system starts two processes for each file it makes, so on shared disks
    the tasks write the files themselves, some to a folder. A file gets its name when it is
    whole, and a task run again writes the same ones. Elsewhere Spark's writer makes a folder
    for each document.
    """
    rows = documents.select("doc_id", "text")
    root = _local_path(documents.sparkSession, folder)
    if root is None:
        rows.write.partitionBy("doc_id").option("lineSep", "\n").text(folder)
        return

    def write(batches):
        import pyarrow as pa

        task = TaskContext.get()
        count, current, out, whole = 0, None, None, ""

        def close():
            if out:
                out.close()
                os.replace(out.name, whole)

        for batch in batches:
            for number, text in zip(batch.column(0), batch.column(1)):
                number = "__HIVE_DEFAULT_PARTITION__" if number.as_py() is None else str(number)
                if number != current:
                    close()
                    below = f"{root}/{task.partitionId():06d}-{count // FOLDER_FILES:06d}"
                    if count % FOLDER_FILES == 0:
                        os.makedirs(below, exist_ok=True)
                    whole = f"{below}/doc_id={number}.txt"
                    out = open(f"{below}/.{number}.{task.taskAttemptId()}", "wb")
                    current, count = number, count + 1
                out.write((text.as_py() or "").encode() + b"\n")
        close()
        yield pa.record_batch([pa.array([count], pa.int64())], names=["n_files"])

    os.makedirs(root, exist_ok=True)
    rows.sortWithinPartitions("doc_id").mapInArrow(write, "n_files long").agg(F.sum("n_files")).first()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str = "id",
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A catalogue table kept in a relational database, read in parallel key ranges.

    With one partition, the default, one task reads the whole table: fit for small dimension
    tables only. More partitions need both bounds of the key; they only place the cuts, rows
    outside them are read by the first and last task.
    """
    if partitions > 1 and (lower is None or upper is None):
        raise ValueError("more than one partition needs lower and upper bounds")
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partitions > 1:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
        )
    return reader.load()


def append_rows(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_merged(pages: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write merged pages (doc_id, page_no, text) sorted by document and page.

    Ranges are cut on both columns, so a long document is written by many tasks, and a
    reader of one document or page range skips the other files by their statistics.
    """
    keys = ["doc_id", "page_no"]
    ranged = (
        pages.repartitionByRange(partitions, *keys) if partitions
        else pages.repartitionByRange(*keys)
    )
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def resolve_outputs(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Expected final document of each file and whether the listing `outputs` (path) has it."""
    folder, name = names.parent_folder(F.col("file_path")), names.outlined_name(F.col("file_name"))
    expected = files.select(
        "id", name.alias("output_name"), F.concat(folder, F.lit("/"), name).alias("path")
    )
    found = outputs.select("path", F.lit(True).alias("_found"))
    return expected.join(found, "path", "left").select(
        "id",
        "output_name",
        "path",
        F.when(F.col("_found"), "found").otherwise("missing").alias("state"),
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir` for written intermediates and checkpoints.

    That setting names a folder that all executors reach. Where it is unset, a folder in the
    warehouse, which they share as well, takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediates"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(rows: DataFrame, path: str) -> DataFrame:
    """Write rows and read them back: later readers neither recompute them nor lose them
    with an executor, and still prune columns."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
