"""Named queries: every operator over the whole given tables.

Long text is returned as its MD5 and arrays are flattened or rendered as text, so that the
results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import names, rules
from folioflow.operators import (
    balance, batching, catalog, ingest, maintenance, merge, outline, recognise, status, stored_keys,
)
from folioflow.operators import outline_tree as trees
from folioflow.plans.document_run import Run, merged_sections, run_documents
from folioflow.plans.views import Views, sample_page_function, text_time
from folioflow.sources import sorted_pages, storage, text_index, versions
from folioflow.streaming import runs, sinks, summary, upload_state, uploads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DOMAINS = ("@a.example",)
SEARCH = "asia nation_1"
LOOKUP = "middle_east"
DELETED_CLIENT = "ASIA"


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    name = build.__name__.removesuffix("_")
    QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
    return build


def digest(pages: Column) -> Column:
    return F.md5(F.array_join(pages, "\n"))


def shown_files(files: DataFrame) -> DataFrame:
    return files.withColumn("created_at", text_time(F.col("created_at")))


# Sources and sinks


@query
def scan_documents(v: Views) -> DataFrame:
    """Documents stored as one file each, found in their folders and read with content.

    Files of one document each are what this scan is for; larger stores are read by
    byte ranges, see `scan_ranges`.
    """
    folder = storage.shared_folder(v.spark)
    documents = v.documents().select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    storage.write_documents(documents, folder)
    found = storage.text_documents(storage.scan_documents(v.spark, folder, "*.txt"))
    # The writer ends each row with a line end.
    text = F.substring("text", F.lit(1), F.length("text") - 1)
    number = F.regexp_extract("doc_id", "doc_id=([0-9]+)[/.]", 1).cast("bigint")
    return found.select(number.alias("doc_id"), F.md5(text).alias("text_md5"))


@query
def scan_clients(v: Views) -> DataFrame:
    return catalog.scan_clients(v.clients())


def taken_uploads(v: Views) -> DataFrame:
    """Uploads that pass all checks, with their cleaned name and place in the upload tree."""
    good = ingest.accepted_rows(ingest.filter_extension(v.uploads()))
    known = ingest.accepted_rows(ingest.orphan_check(good, v.projects()))
    named = known.withColumn("file_name", names.safe_filename(F.col("file_name")))
    return named.withColumn(
        "file_path", F.concat_ws("/", F.lit("uploads"), "project_id", "pos", "file_name")
    )


@query
def append_files(v: Views) -> DataFrame:
    created = F.lit("2024-01-01 00:00:00").cast("timestamp")
    added = ingest.new_files(taken_uploads(v), v.files(), created)
    folder = storage.shared_folder(v.spark)
    storage.append_rows(v.files(), folder)
    storage.append_rows(added, folder)
    stored = v.spark.read.schema(added.schema).parquet(folder)
    return shown_files(stored.where(F.col("uuid").isNotNull())).drop("completed_at")


@query
def bulk_union(v: Views) -> DataFrame:
    created = F.lit("2024-01-01 00:00:00").cast("timestamp")
    added = ingest.new_files(taken_uploads(v), v.files(), created)
    return shown_files(
        ingest.bulk_union(v.files(), added).select(
            "id", "project_id", "file_name", "file_size", "status", "created_at", "option", "uuid"
        )
    )


@query
def upsert_clients(v: Views) -> DataFrame:
    return ingest.upsert_clients(v.clients(), v.requests())


@query
def upsert_projects(v: Views) -> DataFrame:
    after = ingest.upsert_clients(v.clients(), v.requests())
    return ingest.upsert_projects(v.projects(), after, v.requests())


@query
def merged_pages(v: Views) -> DataFrame:
    """Pages that are left when failed batches are skipped, numbered without gaps."""
    folder = storage.shared_folder(v.spark)
    sections = storage.written(
        merged_sections(v.documents(), sample_page_function, "skip", section_pages=50),
        f"{folder}/sections",
    )
    return merge.merged_pages(sections).select("doc_id", "page_no", F.md5("text").alias("text_md5"))


@query
def write_merged(v: Views) -> DataFrame:
    folder = storage.shared_folder(v.spark)
    sections = storage.written(
        merged_sections(v.documents(), sample_page_function, vectorised=True), f"{folder}/sections"
    )
    storage.write_merged(merge.merged_pages(sections, complete=True), f"{folder}/pages")
    pages = storage.read_table(v.spark, f"{folder}/pages")
    return pages.select("doc_id", "page_no", F.md5("text").alias("text_md5"))


@query
def resolve_outputs(v: Views) -> DataFrame:
    """Against a stored listing from which some outputs of processed files are gone."""
    done = v.files().where((F.col("status") == rules.PROCESSED) & (F.col("id") % 10 != 0))
    outputs = done.select(
        F.concat(
            names.parent_folder(F.col("file_path")), F.lit("/"),
            names.outlined_name(F.col("file_name")),
        ).alias("path")
    )
    listing = storage.written(outputs, storage.shared_folder(v.spark))
    return storage.resolve_outputs(v.files(), listing)


@query
def ingest_bulk(v: Views) -> DataFrame:
    marked = ingest.ingest_bulk(v.uploads(), "prefix")
    return marked.select("batch", "pos", "accepted", "reject_reason")


@query
def ingest_bulk_all_or_nothing(v: Views) -> DataFrame:
    marked = ingest.ingest_bulk(v.uploads(), "all_or_nothing")
    return marked.select("batch", "pos", "accepted")


@query
def ingest_bulk_skip_bad(v: Views) -> DataFrame:
    marked = ingest.ingest_bulk(v.uploads(), "skip_bad")
    return marked.select("batch", "pos", "accepted")


# Projections, filters and predicates


@query
def filter_extension(v: Views) -> DataFrame:
    return ingest.accepted_rows(ingest.filter_extension(v.uploads())).select(
        "batch", "pos", "file_name"
    )


@query
def filter_domain(v: Views) -> DataFrame:
    return ingest.filter_domain(v.users(), DOMAINS)


@query
def require_fields(v: Views) -> DataFrame:
    marked = ingest.require_fields(v.files(), "file_name", "project_id", "option")
    return marked.select("id", "accepted", "reject_reason")


@query
def eq_filter(v: Views) -> DataFrame:
    return catalog.eq_filter(v.projects(), {"client_id": 3})


@query
def in_filter(v: Views) -> DataFrame:
    wanted = catalog.eq_filter(v.projects(), {"client_id": 3}).select("id")
    return catalog.in_filter(v.files(), "project_id", wanted).select(
        "id", "project_id", "file_name", "file_size"
    )


@query
def name_lookup(v: Views) -> DataFrame:
    return catalog.name_lookup(v.clients(), v.projects(), LOOKUP)


@query
def search_rows(v: Views) -> DataFrame:
    rows = catalog.with_action(catalog.catalog(v.clients(), v.projects(), v.files()))
    return shown_files(catalog.search_rows(rows, SEARCH))


SEARCHES = (SEARCH, "1", "PR", "bro", "F.pdf", "1995-03-1", "processing...", "start ocr", "no such text")


@query
def search_index(v: Views) -> DataFrame:
    """Several searches through the index, which is made of every other row and then of the rest."""
    folder = storage.shared_folder(v.spark)
    listed = catalog.with_action(catalog.catalog(v.clients(), v.projects(), v.files()))
    rows = storage.written(listed, f"{folder}/rows")
    for half in (0, 1):
        text_index.append(rows.where(F.col("file_id") % 2 == half), f"{folder}/index")
    found = None
    for text in SEARCHES:
        hits = text_index.search(rows, f"{folder}/index", text)
        hits = hits.select(F.lit(text).alias("search"), "file_id", "project_name")
        found = hits if found is None else found.unionByName(hits)
    return found


@query
def project_listing(v: Views) -> DataFrame:
    return catalog.file_listing(v.files())


@query
def status_action(v: Views) -> DataFrame:
    latest = status.status_latest(v.status_events())
    return catalog.with_action(latest.select("file_id", "status"))


@query
def output_names(v: Views) -> DataFrame:
    counts = batching.source_page_counts(v.documents())
    ranges = batching.batch_ranges(counts)
    uploaded = v.uploads().select(F.col("pos").alias("doc_id"), "file_name")
    name = F.col("file_name")
    return ranges.join(uploaded.hint("merge"), "doc_id").select(
        "doc_id",
        "batch_no",
        names.batch_name(name, F.col("start_page"), F.col("end_page")).alias("batch_file"),
        names.merged_name(name).alias("merged_file"),
        names.outlined_name(name).alias("outlined_file"),
    )


@query
def safe_filename(v: Views) -> DataFrame:
    titled = F.concat(F.lit("../"), F.col("bookmark"), F.lit(".pdf"))
    return v.outline().select(
        "doc_id", "page", names.safe_filename(titled).alias("file_name")
    )


@query
def output_path(v: Views) -> DataFrame:
    return v.files().select("id", names.output_path(F.col("file_path")).alias("path"))


@query
def option_dispatch(v: Views) -> DataFrame:
    marked = recognise.option_rejects(v.files())
    return marked.groupBy("run_option", "accepted").agg(F.count(F.lit(1)).alias("n_files"))


# Joins


@query
def project_client(v: Views) -> DataFrame:
    return catalog.project_client(v.projects(), v.clients())


@query
def projects_with_files(v: Views) -> DataFrame:
    listing = catalog.projects_with_files(v.projects(), v.clients(), v.files(), part_files=100)
    files = F.col("files")
    return catalog.project_json(listing).select(
        "project_id", "part_no", "name", "client_name", F.size(files).alias("n_files"),
        F.array_min("files.id").alias("first_id"), F.array_max("files.id").alias("last_id"),
        F.md5("body").alias("body_md5"),
    )


@query
def catalog_(v: Views) -> DataFrame:
    return shown_files(catalog.catalog(v.clients(), v.projects(), v.files()))


@query
def orphan_check(v: Views) -> DataFrame:
    moved = v.files().withColumn("project_id", F.col("project_id") + 3)
    return ingest.orphan_check(moved, v.projects()).select(
        "id", "project_id", "accepted", "reject_reason"
    )


@query
def outline_range(v: Views) -> DataFrame:
    ranges = batching.batch_ranges(batching.source_page_counts(v.documents()))
    return outline.outline_range(v.outline(), ranges).select(
        "doc_id", "batch_no", "pos", "line", F.md5("bookmark").alias("bookmark_md5"),
        F.col("page").cast("bigint").alias("page"),
    )


def deletion(v: Views) -> maintenance.Deletion:
    client = v.clients().where(F.col("name") == DELETED_CLIENT)
    ids = catalog.in_filter(v.projects(), "client_id", client.select("id")).select("id")
    return maintenance.delete_projects(v.projects(), v.files(), ids)


@query
def delete_projects(v: Views) -> DataFrame:
    return deletion(v).files.select("id", "project_id", "file_name")


@query
def delete_projects_counts(v: Views) -> DataFrame:
    done = deletion(v)
    kept = done.projects.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("projects kept").alias("table_name"), "n_rows"
    )
    return done.removed.unionByName(kept)


def doomed_projects(v: Views) -> DataFrame:
    gone = v.clients().where(F.col("name") == DELETED_CLIENT).select(F.col("id").alias("client_id"))
    return v.projects().join(gone, "client_id", "left_semi").select("id")


@query
def delete_projects_written(v: Views) -> DataFrame:
    """Both tables stored, the projects of a client deleted, and the new versions read back."""
    folder = storage.shared_folder(v.spark)
    tables = {}
    for name, rows, keys in (
        ("projects", v.projects(), ["client_id", "id"]), ("files", v.files(), ["project_id", "id"])
    ):
        versions.create(rows, f"{folder}/{name}", keys)
        tables[name] = (f"{folder}/{name}", rows.schema)
    maintenance.delete_written(v.spark, tables, doomed_projects(v))
    rows = {name: versions.read(v.spark, *place) for name, place in tables.items()}
    projects = rows["projects"].select(
        F.lit("projects").alias("table_name"), F.col("id").cast("bigint").alias("id"), "name"
    )
    return projects.unionByName(
        rows["files"].select(F.lit("files").alias("table_name"), "id", F.col("file_name").alias("name"))
    )


@query
def deleted_paths(v: Views) -> DataFrame:
    return maintenance.deleted_paths(v.files(), doomed_projects(v))


@query
def results_to_file(v: Views) -> DataFrame:
    # Orders with the documents' keys own the results; the others belong to no document.
    joined = status.results_to_file(v.batch_results(), v.files())
    return joined.select("doc_id", "batch_no", "project_id", "file_name", "status", "error")


# Aggregations


@query
def project_summary(v: Views) -> DataFrame:
    return catalog.project_summary(v.clients(), v.projects(), v.files())


@query
def distinct_names(v: Views) -> DataFrame:
    owners, named = catalog.distinct_names(v.projects(), v.clients())
    return owners.select(F.lit("client").alias("kind"), F.col("client_name").alias("name")).union(
        named.select(F.lit("project"), "name")
    )


def segment_rows(segments: DataFrame) -> DataFrame:
    return segments.select(
        "upload_id", "segment_no", "n_chunks", F.md5("body").alias("body_md5"),
        F.octet_length("body").cast("bigint").alias("n_bytes"),
    )


@query
def assemble_chunks(v: Views) -> DataFrame:
    return segment_rows(ingest.assemble_chunks(v.chunks(), "sent"))


@query
def assemble_segments(v: Views) -> DataFrame:
    return segment_rows(ingest.assemble_segments(v.chunks(), "sent", segment_chunks=4))


@query
def upload_manifest(v: Views) -> DataFrame:
    return ingest.upload_manifest(v.chunks())


@query
def upload_sizes(v: Views) -> DataFrame:
    return ingest.upload_sizes(v.chunks(), "sent")


@query
def upload_to_files(v: Views) -> DataFrame:
    """Complete uploads checked and named as files, accepted or rejected."""
    return ingest.upload_files(v.chunks(), v.projects(), "sent")


@query
def rejected_chunks(v: Views) -> DataFrame:
    rejects = ingest.rejected_rows(ingest.check_chunks(v.chunks()))
    return rejects.select("upload_id", "chunk_index", "total_chunks", "reject_reason")


@query
def gather_batches(v: Views) -> DataFrame:
    """Every fifth document's batches are reported twice."""
    twice = v.batches().where(F.col("doc_id") % 5 == 0)
    merged = merge.gather(v.batches().unionByName(twice), section_pages=50)
    return merged.select(
        "doc_id", "section_no", "start_page", "n_pages", digest(F.col("pages")).alias("text_md5")
    )


@query
def gather_lines(v: Views) -> DataFrame:
    """The lines of every order, put in line order like the batches of a document.

    Some line numbers occur more than once in an order; the least of their lines counts.
    """
    text = F.concat_ws("|", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    lines = v.table("lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("start_page"),
        F.array(text).alias("pages"),
    )
    return merge.gather(lines).select(
        "doc_id", "section_no", "n_pages", digest(F.col("pages")).alias("text_md5")
    )


@query
def page_counts(v: Views) -> DataFrame:
    kept = recognise.apply_policy(v.batch_results(), "skip")
    after = kept.withColumn("n_pages", F.size("pages"))
    return merge.compare_page_counts(
        batching.source_page_counts(v.documents()), merge.page_counts(after)
    )


@query
def status_latest(v: Views) -> DataFrame:
    latest = status.status_latest(v.status_events())
    return latest.withColumns(
        {c: text_time(F.col(c)) for c in ("updated_at", "completed_at")}
    )


@query
def apply_status(v: Views) -> DataFrame:
    updated = status.apply_status(v.files(), status.status_latest(v.status_events()))
    return updated.select(
        "id", "file_name", "status", text_time(F.col("completed_at")).alias("completed_at")
    )


@query
def start_runs(v: Views) -> DataFrame:
    # Every customer asks for one file; the later keys have none.
    requests = v.table("customer").select(
        (F.col("c_custkey") * 20).alias("file_id"), F.col("c_mktsegment").alias("_segment")
    ).select(
        "file_id", F.when(F.col("_segment") == "BUILDING", "Advanced")
        .when(F.col("_segment") == "MACHINERY", "fast").alias("option"),
    )
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    marked = status.start_runs(requests, v.files(), now)
    return marked.withColumn("ts", text_time(F.col("ts")))


@query
def status_rollup(v: Views) -> DataFrame:
    """With some first batches that have not reported yet."""
    late = (F.col("doc_id") % 13 == 5) & (F.col("batch_no") == 0)
    results = v.batch_results().select("doc_id", "batch_no", "status").where(~late)
    return recognise.status_rollup(results, expected_batches(v))


@query
def unique_first(v: Views) -> DataFrame:
    marked = ingest.unique_first(v.documents(), F.md5("text"), "doc_id")
    return marked.select("doc_id", "accepted", "reject_reason")


@query
def unique_against_stored(v: Views) -> DataFrame:
    """Every third document's text is taken in first; the others are held against those."""
    documents = v.documents().select("doc_id", F.md5("text").alias("key"))
    blocks = 1 + documents.count() // 2000
    earlier = documents.where(F.col("doc_id") % 3 == 0)
    begun = ingest.unique_first(earlier, F.col("key"), "doc_id")
    folder = storage.shared_folder(v.spark)
    table = f"stored_keys_{folder.rsplit('/', 1)[1]}"
    filters = stored_keys.take_in(v.spark, begun.where("accepted"), table, None, blocks, folder)
    later = stored_keys.unique_against_stored(
        documents.where(F.col("doc_id") % 3 != 0), F.col("key"), "doc_id", v.spark.table(table), filters, blocks
    )
    return begun.unionByName(later).select("doc_id", "accepted", "reject_reason")


@query
def page_total(v: Views) -> DataFrame:
    return catalog.page_total(catalog.catalog(v.clients(), v.projects(), v.files()), 20)


# Windows, sorts and limits


def batch_rows(batches: DataFrame) -> DataFrame:
    return batches.select(
        "doc_id", "batch_no", "start_page", "end_page", digest(F.col("pages")).alias("pages_md5")
    )


@query
def burst(v: Views) -> DataFrame:
    return batch_rows(v.batches())


@query
def burst_pages(v: Views) -> DataFrame:
    return batch_rows(batching.burst_pages(v.pages_long()))


@query
def upload_progress(v: Views) -> DataFrame:
    return ingest.upload_progress(v.raw_chunks()).drop("body")


@query
def paginate(v: Views) -> DataFrame:
    rows = catalog.catalog(v.clients(), v.projects(), v.files())
    return shown_files(catalog.paginate(rows, 3, 20, "client_name", descending=True))


@query
def page_at(v: Views) -> DataFrame:
    """First, middle and last page, opened by number."""
    rows = catalog.catalog(v.clients(), v.projects(), v.files())
    folder = storage.shared_folder(v.spark)
    sorted_pages.create(rows, folder, "client_name", descending=True)
    last = sorted_pages.page_total(v.spark, folder, 20)
    found = None
    for page in sorted({1, (last + 1) // 2, last} - {0}):
        opened = sorted_pages.page_at(v.spark, folder, rows.schema, page, 20)
        opened = opened.withColumn("page", F.lit(page))
        found = opened if found is None else found.unionByName(opened)
    return shown_files(found if found is not None else rows.limit(0).withColumn("page", F.lit(0)))


@query
def next_page(v: Views) -> DataFrame:
    rows = catalog.catalog(v.clients(), v.projects(), v.files())
    return shown_files(catalog.next_page(rows, ("Asia", 1000), 50, "client_name"))


@query
def sort_rows(v: Views) -> DataFrame:
    rows = catalog.catalog(v.clients(), v.projects(), v.files())
    return shown_files(catalog.sort_rows(rows, "created_at", descending=True))


@query
def order_by_id(v: Views) -> DataFrame:
    return catalog.order_by_id(v.files(), "project_id").select("project_id", "id", "file_name")


@query
def first_match(v: Views) -> DataFrame:
    return catalog.first_match(v.uploads(), F.lower("batch"), "pos").select(
        "batch", "pos", "file_name"
    )


@query
def page_order(v: Views) -> DataFrame:
    image = names.page_image_name(F.concat(F.col("doc_id"), F.lit(".pdf")), F.col("page_no"))
    images = v.pages_long().select("doc_id", image.alias("image"), "text")
    numbered = images.withColumn("page_no", names.page_number(F.col("image")))
    ordered = merge.gather(batching.burst_pages(numbered))
    return ordered.select(
        "doc_id", "section_no", "n_pages", digest(F.col("pages")).alias("text_md5")
    )


# Set operations


def source_inputs(v: Views) -> DataFrame:
    return v.table("documents").select(
        F.col("source").alias("target"), F.col("doc_id").alias("pos"), "doc_id"
    )


@query
def page_offsets(v: Views) -> DataFrame:
    counts = batching.source_page_counts(v.documents())
    return merge.page_offsets(source_inputs(v), counts).select(
        "target", "doc_id", "n_pages", "page_offset", "missing"
    )


@query
def concat_pages(v: Views) -> DataFrame:
    counts = batching.source_page_counts(v.documents())
    joined = merge.concat_pages(v.pages_long(), merge.page_offsets(source_inputs(v), counts))
    return joined.select(
        "target", "page_no", "doc_id", "source_page", F.md5("text").alias("text_md5")
    )


# Outlines and document level


@query
def extract_outline(v: Views) -> DataFrame:
    entries = outline.extract_outline(v.hosted_pages(), "doc_id", "page_id")
    return entries.join(v.page_numbers(), "page_id").select(
        "doc_id", "page", "pos", "line", "bookmark"
    )


@query
def reattach_outline(v: Views) -> DataFrame:
    return outline.reattach_outline(v.outline(), kept_ranges(v)).select(
        "doc_id", "pos", "line", "page", F.md5("bookmark").alias("bookmark_md5")
    )


def kept_ranges(v: Views) -> DataFrame:
    """Page ranges of the batches that did not fail, written, as they are read more than once."""
    kept = recognise.apply_policy(v.batch_results(), "skip").select("doc_id", "start_page", "end_page")
    return storage.written(kept, storage.shared_folder(v.spark))


@query
def outline_tree(v: Views) -> DataFrame:
    """Trees of the outlines after failed batches are left out, and one of every third document's
    entries together."""
    entries = outline.reattach_outline(v.outline(), kept_ranges(v)).select("doc_id", "pos", "line")
    together = entries.where(F.col("doc_id") % 3 == 0).select(
        F.lit(-1).cast("bigint").alias("doc_id"),
        (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("pos"), "line",
    )
    return trees.outline_tree(entries.unionByName(together))


@query
def strip_document_fields(v: Views) -> DataFrame:
    pages = batching.pages_long(v.table("documents"), carry=["lang", "source", "n_chars"])
    return merge.strip_document_fields(pages).select(
        "doc_id", "page_no", F.md5("text").alias("text_md5")
    )


# Page functions


@query
def recognise_batches(v: Views) -> DataFrame:
    return v.batch_results().select(
        "doc_id", "batch_no", "start_page", "end_page", "status", "error",
        digest(F.col("pages")).alias("pages_md5"),
    )


@query
def recognise_balanced(v: Views) -> DataFrame:
    """All batches, in tasks of about equal bytes of text."""
    dealt = balance.spread_by_cost(v.batches(), 16)
    return recognise.recognise_batches(dealt, sample_page_function).select(
        "doc_id", "batch_no", "start_page", "end_page", "status", "error",
        digest(F.col("pages")).alias("pages_md5"),
    )


@query
def failure_policy(v: Views) -> DataFrame:
    """Pages left in each document under each policy."""
    sizes = v.batch_results().select(
        "doc_id", "status", F.size("pages").alias("pages"), F.size("source_pages").alias("source_pages")
    )
    results = storage.written(sizes, storage.shared_folder(v.spark))
    outcomes = [
        merge.page_counts(
            recognise.apply_policy(results, on_error).withColumnRenamed("pages", "n_pages")
        ).select(F.lit(on_error).alias("on_error"), "doc_id", "n_pages")
        for on_error in recognise.ON_ERROR
    ]
    return outcomes[0].unionByName(outcomes[1]).unionByName(outcomes[2])


def run_rows(merged: DataFrame) -> DataFrame:
    return merged.select(
        "doc_id", "section_no", "start_page", "n_pages", "n_failed",
        digest(F.col("pages")).alias("text_md5"),
    )


@query
def document_run(v: Views) -> DataFrame:
    """Flagship: split, recognise and merge whole documents without a shuffle."""
    return run_rows(
        merged_sections(v.documents(), sample_page_function, "fallback", vectorised=True)
    )


@query
def document_run_pages(v: Views) -> DataFrame:
    """The same from a table of pages, with one shuffle."""
    return run_rows(
        merged_sections(v.pages_long(), sample_page_function, "fallback", vectorised=True)
    )


@query
def document_run_options(v: Views) -> DataFrame:
    """The run with each document's own option; invalid ones fail every batch."""
    return run_rows(
        merged_sections(v.documents_with_option(), sample_page_function, option="option")
    )


def whole_run(v: Views, on_error: str) -> Run:
    folder = storage.shared_folder(v.spark)
    return run_documents(v.documents(), v.outline(), sample_page_function, folder, on_error)


@query
def run_status(v: Views) -> DataFrame:
    return whole_run(v, "skip").status


@query
def run_outline(v: Views) -> DataFrame:
    return whole_run(v, "skip").outline.select(
        "doc_id", "pos", "line", "page", F.md5("bookmark").alias("bookmark_md5")
    )


@query
def run_page_counts(v: Views) -> DataFrame:
    return whole_run(v, "skip").page_counts


@query
def run_abort(v: Views) -> DataFrame:
    """Sections of the documents without a failed batch; the others are left out whole."""
    return run_rows(whole_run(v, "abort").sections)


# Streams: each run is driven to its end and compares with its batch twin


MICRO_BATCHES = 4


def _streamed(v: Views, rows: DataFrame, time: str | None = None) -> tuple[DataFrame, str]:
    """Write rows as files and open them as a stream of at least four micro-batches.

    The files are written by as many tasks as the rows have. With `time`, four stretches of
    it are written one after the other, so that no file is late for another.
    """
    folder = storage.shared_folder(v.spark)
    source = f"{folder}/source"
    if time:
        rows = storage.written(rows, f"{folder}/rows")  # read once for each stretch
        ends = rows.agg(F.min(time).cast("double").alias("a"), F.max(time).cast("double").alias("b")).first()
        width = (ends.b - ends.a) / MICRO_BATCHES or 1.0
        place = F.floor((F.col(time).cast("double") - ends.a) / width)
        for k in range(MICRO_BATCHES):
            storage.append_rows(rows.where(F.least(place, F.lit(MICRO_BATCHES - 1)) == k), source)
    else:
        each = rows.count() // MICRO_BATCHES or 1
        rows.write.option("maxRecordsPerFile", each).parquet(source)
    files = len(v.spark.read.schema(rows.schema).parquet(source).inputFiles())
    return sinks.file_stream(v.spark, source, rows.schema, files // MICRO_BATCHES or 1), folder


def _landed_parts(
    v: Views, chunks: DataFrame, time: str | None = None
) -> tuple[DataFrame, str]:
    stream, folder = _streamed(v, chunks, time)
    uploads.start_parts(
        stream, f"{folder}/parts", f"{folder}/parts_log", available_now=True
    ).awaitTermination()
    files = len(storage.read_table(v.spark, f"{folder}/parts").inputFiles())
    each = files // MICRO_BATCHES or 1
    return sinks.file_stream(v.spark, f"{folder}/parts", uploads.parts_schema(chunks), each), folder


def _driven(v: Views, streams: list[tuple[DataFrame, str]], start) -> str:
    """Run a stream four times from its checkpoint, each time over a further stretch of its
    sources (rows, column of the time they come in), and return its folder.

    All sources share the stretches, so what comes in together is read together.
    `start` takes the opened sources and the folder.
    """
    folder = storage.shared_folder(v.spark)
    tables = [storage.written(rows, f"{folder}/rows{i}") for i, (rows, _) in enumerate(streams)]
    spans = [
        table.agg(F.min(time).cast("double").alias("a"), F.max(time).cast("double").alias("b")).first()
        for table, (_, time) in zip(tables, streams)
    ]
    low = min(span.a for span in spans if span.a is not None)
    width = (max(span.b for span in spans if span.b is not None) - low) / MICRO_BATCHES or 1.0
    for k in range(MICRO_BATCHES):
        opened = []
        for i, (table, (_, time)) in enumerate(zip(tables, streams)):
            place = F.floor((F.col(time).cast("double") - low) / width)
            storage.append_rows(table.where(F.least(place, F.lit(MICRO_BATCHES - 1)) == k), f"{folder}/in{i}")
            opened.append(sinks.file_stream(v.spark, f"{folder}/in{i}", table.schema))
        start(*opened, folder).awaitTermination()
    return folder


@query
def stream_assemble(v: Views) -> DataFrame:
    parts, folder = _landed_parts(v, v.chunks())
    uploads.start_completions(
        parts, f"{folder}/complete", f"{folder}/complete_log", available_now=True
    ).awaitTermination()
    landed = storage.read_table(v.spark, f"{folder}/parts")
    complete = storage.read_table(v.spark, f"{folder}/complete")
    return segment_rows(uploads.assembled(landed, complete, "sent"))


@query
def stream_upload_to_files(v: Views) -> DataFrame:
    parts, folder = _landed_parts(v, v.chunks())
    landed = storage.read_table(v.spark, f"{folder}/parts")
    uploads.start_files(
        parts, landed, v.projects(), "sent", f"{folder}/files", f"{folder}/files_log",
        available_now=True,
    ).awaitTermination()
    return storage.read_table(v.spark, f"{folder}/files").drop("batch_id")


@query
def stream_status(v: Views) -> DataFrame:
    stream, folder = _streamed(v, v.status_events(), "ts")
    latest = runs.stream_status(stream)
    sinks.updates_to(
        latest, f"{folder}/status", f"{folder}/status_log", available_now=True
    ).awaitTermination()
    stored = (v.spark, f"{folder}/status", latest.schema, ["file_id"], runs.STATUS_VERSION)
    now = sinks.read_updates(*stored, since=sinks.compact_updates(*stored)).drop("event_id")
    return now.withColumns({c: text_time(F.col(c)) for c in ("updated_at", "completed_at")})


def project_events(v: Views) -> DataFrame:
    return v.status_events().withColumn("project_id", F.col("file_id") % 28)


@query
def stream_project_summary(v: Views) -> DataFrame:
    """The summary after four micro-batches of status changes."""
    with sinks.rocksdb_state(v.spark):
        folder = _driven(v, [(project_events(v), "ts")], lambda events, folder: summary.start_changes(
            events, f"{folder}/changes", f"{folder}/changes_log", True))
    changes = storage.read_table(v.spark, f"{folder}/changes")
    return summary.live_summary(v.clients(), v.projects(), changes)


def expected_batches(v: Views) -> DataFrame:
    counts = batching.source_page_counts(v.documents()).where(F.col("n_pages") > 0)
    return counts.select(
        "doc_id", F.ceil(F.col("n_pages") / batching.BATCH_PAGES).alias("n_batches")
    )


def reported(v: Views, started_at: Column) -> DataFrame:
    results = v.batch_results().select("doc_id", "batch_no", "status")
    return results.join(expected_batches(v), "doc_id").withColumn("started_at", started_at)


@query
def stream_gather(v: Views) -> DataFrame:
    results = reported(v, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    again = results.where(F.col("doc_id") % 4 == 0).withColumn(
        "started_at", F.col("started_at") + F.make_dt_interval(hours=F.lit(1))
    )
    stream, folder = _streamed(v, results.unionByName(again))
    finished = runs.stream_gather(stream)
    sinks.updates_to(
        finished, f"{folder}/finished", f"{folder}/finished_log", available_now=True
    ).awaitTermination()
    return storage.read_table(v.spark, f"{folder}/finished").select(
        "doc_id", text_time(F.col("started_at")).alias("started_at"), "n_batches", "n_failed"
    )


def started_runs(v: Views) -> DataFrame:
    """Runs of the documents, one hour apart; every fourth document is run again two days later."""
    hour = F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    begun = F.lit("2024-01-01 00:00:00").cast("timestamp") + hour
    runs_of = expected_batches(v).withColumn("started_at", begun)
    again = runs_of.where(F.col("doc_id") % 4 == 0).withColumn(
        "started_at", F.col("started_at") + F.make_dt_interval(days=F.lit(2))
    )
    return runs_of.unionByName(again)


@query
def stream_runs(v: Views) -> DataFrame:
    """What became of each run: some documents never report, some runs lack a batch or get it
    too late, some batches report twice."""
    starts = started_runs(v)
    results = v.batch_results().select("doc_id", "batch_no", "status")
    later = F.when((F.col("doc_id") % 5 == 1) & (F.col("batch_no") == 0), 30 * 60).otherwise(
        10 + F.col("doc_id") % 7
    )
    reports = results.join(starts.drop("n_batches"), "doc_id").withColumn(
        "reported_at", F.col("started_at") + F.make_dt_interval(mins=later.cast("int"))
    )
    reports = reports.where((F.col("doc_id") % 7 != 3) & ~((F.col("doc_id") % 3 == 0) & (F.col("batch_no") == 0)))
    twice = reports.where(F.col("doc_id") % 2 == 0).withColumn(
        "reported_at", F.col("reported_at") + F.make_dt_interval(mins=F.lit(5))
    )

    def start(begun, reported_rows, folder):
        return runs.start_outcomes(begun, reported_rows, f"{folder}/runs", f"{folder}/runs_log", True)

    folder = _driven(v, [(starts, "started_at"), (reports.unionByName(twice), "reported_at")], start)
    return storage.read_table(v.spark, f"{folder}/runs").select(
        "doc_id", text_time(F.col("started_at")).alias("started_at"), "n_batches", "n_reported",
        "n_failed", "outcome",
    )


@query
def stream_expire_runs(v: Views) -> DataFrame:
    """Runs started one hour apart, of which some lack a batch."""
    hour = F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    results = reported(v, F.lit("2024-01-01 00:00:00").cast("timestamp") + hour)
    missing = (F.col("doc_id") % 3 == 0) & (F.col("batch_no") == 0)
    stream, folder = _streamed(v, results.where(~missing), "started_at")
    sinks.append_to(
        runs.stream_expire_runs(stream), f"{folder}/expired", f"{folder}/expired_log",
        available_now=True,
    ).awaitTermination()
    return storage.read_table(v.spark, f"{folder}/expired").select(
        "doc_id", "n_batches", "n_reported", "n_failed"
    )


@query
def status_windows(v: Views) -> DataFrame:
    stream, folder = _streamed(v, v.status_events(), "ts")
    counted = runs.status_windows(stream)
    sinks.updates_to(
        counted, f"{folder}/windows", f"{folder}/windows_log", available_now=True
    ).awaitTermination()
    windows = sinks.read_updates(
        v.spark, f"{folder}/windows", counted.schema, ["window_start", "status"]
    )
    return windows.withColumn("window_start", text_time(F.col("window_start")))


@query
def expire_uploads(v: Views) -> DataFrame:
    events = v.status_events()
    now = events.select(F.max("ts")).scalar()
    kept = maintenance.keep_recent(events, "ts", now)
    return kept.select("event_id", "file_id", "status", text_time(F.col("ts")).alias("ts"))


def daily_chunks(v: Views) -> DataFrame:
    """Uploads started one hour apart, so that the older ones run out of time."""
    hour = F.make_dt_interval(hours=F.col("upload_id").cast("int"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp") + hour
    return v.chunks().withColumn("started_at", start)


@query
def stream_upload_state(v: Views) -> DataFrame:
    """What becomes of uploads started one hour apart: complete, expired, or late chunks. Every third upload
    sends its first chunk once more 30 hours after its start, every seventh 20 minutes after."""
    chunks = daily_chunks(v).drop("body").withColumn("arrived", F.col("started_at"))
    first = chunks.where(F.col("chunk_index") == 0)
    late = first.where(F.col("upload_id") % 3 == 0).withColumn(
        "arrived", F.col("arrived") + F.make_dt_interval(hours=F.lit(30))
    )
    again = first.where(F.col("upload_id") % 7 == 0).withColumn(
        "arrived", F.col("arrived") + F.make_dt_interval(mins=F.lit(20))
    )

    def start(arriving, folder):
        return upload_state.start_outcomes(arriving, f"{folder}/ends", f"{folder}/ends_log", True)

    with sinks.rocksdb_state(v.spark):
        folder = _driven(v, [(chunks.unionByName(late).unionByName(again), "arrived")], start)
    return storage.read_table(v.spark, f"{folder}/ends").withColumn(
        "started_at", text_time(F.col("started_at"))
    )


@query
def expired_uploads(v: Views) -> DataFrame:
    chunks = daily_chunks(v)
    now = chunks.select(F.max("started_at")).scalar()
    gone = maintenance.expired_uploads(
        chunks, ingest.upload_manifest(chunks), "started_at", now
    )
    return gone.select("upload_id", "n_chunks", "total_chunks")


@query
def stream_expire(v: Views) -> DataFrame:
    parts, folder = _landed_parts(v, daily_chunks(v), "started_at")
    uploads.start_expiry(
        parts, f"{folder}/expired", f"{folder}/expired_log", available_now=True
    ).awaitTermination()
    return storage.read_table(v.spark, f"{folder}/expired").select(
        "upload_id", "n_chunks", "total_chunks"
    )
