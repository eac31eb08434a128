"""Taking in uploads: checks with rejects, defaults, ids and chunk assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import names, rules
from folioflow.operators.ordering import rank_from_zero

WRONG_DOMAIN = "Email domain is not allowed"
DUPLICATE = "already registered"
BAD_CHUNK = "Chunk index is missing or out of range"

# Fixed value: bytes of one upload chunk.
CHUNK_BYTES = 5 * 1024 * 1024
# Chunks put together in one row of an assembled file (80 MiB of full chunks).
SEGMENT_CHUNKS = 16


def accept_if(rows: DataFrame, accepted: Column, reason: str | Column) -> DataFrame:
    """Mark every row: `accepted`, and `reject_reason` for those that are not."""
    ok = F.coalesce(accepted, F.lit(False))
    text = reason if isinstance(reason, Column) else F.lit(reason)
    return rows.withColumns({"accepted": ok, "reject_reason": F.when(~ok, text)})


def accepted_rows(marked: DataFrame) -> DataFrame:
    return marked.where("accepted").drop("accepted", "reject_reason")


def rejected_rows(marked: DataFrame) -> DataFrame:
    return marked.where(~F.col("accepted")).drop("accepted")


def filter_extension(uploads: DataFrame, name: str = "file_name") -> DataFrame:
    return accept_if(uploads, names.is_pdf(F.col(name)), rules.NOT_A_PDF)


def filter_domain(users: DataFrame, domains: Sequence[str], email: str = "email") -> DataFrame:
    return accept_if(users, rules.has_domain(F.col(email), domains), WRONG_DOMAIN)


def require_fields(rows: DataFrame, *required: str) -> DataFrame:
    """Mark rows with a null or blank required column; `reject_reason` names them all."""
    errors = rules.missing_fields(*required)
    marked = accept_if(rows.withColumn("errors", errors), F.size("errors") == 0, "")
    return marked.withColumn(
        "reject_reason", F.when(~F.col("accepted"), F.array_join("errors", "; "))
    )


def orphan_check(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Mark rows whose project does not exist. One join serves both outcomes."""
    known = projects.select(F.col("id").alias("project_id"), F.lit(True).alias("_known"))
    marked = accept_if(rows.join(known, "project_id", "left"), F.col("_known"), rules.NO_PROJECT)
    return marked.select(*rows.columns, "accepted", "reject_reason")


def ingest_bulk(
    uploads: DataFrame,
    mode: str = "prefix",
    batch: str = "batch",
    position: str = "pos",
    name: str = "file_name",
) -> DataFrame:
    """Mark the files of multi-file uploads that are taken in.

    prefix:         files before the first one that is no PDF.
    all_or_nothing: only batches in which every file is a PDF.
    skip_bad:       every PDF.

    The first bad position is one number per batch, found with a map-side combine; no batch
    is ever sorted in one task.
    """
    good = names.is_pdf(F.col(name))
    if mode == "skip_bad":
        return accept_if(uploads, good, rules.NOT_A_PDF)
    firsts = uploads.where(~good).groupBy(batch).agg(F.min(position).alias("_first_bad"))
    joined = uploads.join(firsts, batch, "left")
    if mode == "prefix":
        taken = F.col("_first_bad").isNull() | (F.col(position) < F.col("_first_bad"))
    elif mode == "all_or_nothing":
        taken = F.col("_first_bad").isNull()
    else:
        raise ValueError("mode must be prefix, all_or_nothing or skip_bad")
    reason = F.when(good, "Upload stopped at an earlier file.").otherwise(rules.NOT_A_PDF)
    if mode == "all_or_nothing":
        reason = F.when(good, "Another file of the upload is invalid.").otherwise(rules.NOT_A_PDF)
    return accept_if(joined, taken, reason).select(*uploads.columns, "accepted", "reject_reason")


def unique_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Mark the first row of each key as accepted and all later ones as rejected.

    `order` is unique over all rows. The winners' `order` values are found with a map-side
    combine and joined back on that unique column, so a key held by many rows is no hot
    spot.
    """
    firsts = rows.groupBy(key.alias("_key")).agg(F.min(order).alias(order))
    winners = firsts.select(order, F.lit(True).alias("_first"))
    marked = accept_if(rows.join(winners, order, "left"), F.col("_first"), DUPLICATE)
    return marked.select(*rows.columns, "accepted", "reject_reason")


def next_ids(rows: DataFrame, existing: DataFrame, position: str) -> DataFrame:
    """Give new rows an `id` that continues the existing ids, in `position` order."""
    last = existing.select(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    ranked = rank_from_zero(rows, [], position, "_rank")
    return ranked.withColumn("id", last + F.col("_rank") + 1).drop("_rank")


def new_files(
    uploads: DataFrame, existing: DataFrame, created_at: Column | None = None
) -> DataFrame:
    """File rows to append for accepted uploads (pos, project_id, file_name, file_size, file_path).

    Defaults: status `Not processed`, `created_at` from the input or the given column, and
    an id made from the path, so that a task run twice writes the same row. Write the
    result in append mode.
    """
    numbered = next_ids(uploads, existing, "pos")

    def given(column: str, default: Column) -> Column:
        return F.coalesce(F.col(column), default) if column in uploads.columns else default

    no_time = F.lit(None).cast("timestamp") if created_at is None else created_at
    return numbered.select(
        "id",
        "project_id",
        "file_name",
        F.col("file_size").cast("bigint").alias("file_size"),
        "file_path",
        given("status", F.lit(rules.NOT_PROCESSED)).alias("status"),
        given("created_at", no_time).alias("created_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        given("uuid", rules.key_uuid(F.col("file_path"), F.col("id"))).alias("uuid"),
    )


def bulk_union(files: DataFrame, added: DataFrame) -> DataFrame:
    """Existing file rows followed by new ones; columns only one side has become null."""
    return files.unionByName(added, allowMissingColumns=True)


def upsert_clients(
    clients: DataFrame, requests: DataFrame
) -> DataFrame:
    """Clients after the requests (pos, client_name, ...): known names kept, new ones added.

    New names get ids in order of first use. Every name is reduced to one row on the map
    side before anything is shuffled.
    """
    wanted = requests.groupBy(F.col("client_name").alias("name")).agg(F.min("pos").alias("_pos"))
    fresh = wanted.join(clients.select("name"), "name", "left_anti")
    numbered = next_ids(fresh, clients, "_pos").select("id", "name")
    return clients.select(F.col("id").cast("bigint").alias("id"), "name").unionByName(numbered)


def upsert_projects(
    projects: DataFrame, clients: DataFrame, requests: DataFrame
) -> DataFrame:
    """Projects to append for the requests, one each, also where the name exists already.

    `clients` is the result of `upsert_clients`.
    """
    owners = clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    numbered = next_ids(requests, projects, "pos")
    return numbered.join(owners, "client_name").select(
        "id", F.col("project_name").alias("name"), "client_id", "user_id"
    )


def with_total_chunks(chunks: DataFrame) -> DataFrame:
    """Add `total_chunks` = highest index + 1, for sources that do not send it."""
    totals = chunks.groupBy("upload_id").agg(
        (F.max("chunk_index") + 1).alias("total_chunks")
    )
    return chunks.join(totals, "upload_id")


def upload_progress(chunks: DataFrame) -> DataFrame:
    """Add `percent`: whole per cent reached once this chunk has arrived in order."""
    sent = chunks if "total_chunks" in chunks.columns else with_total_chunks(chunks)
    percent = F.floor((F.col("chunk_index") + 1) * 100 / F.col("total_chunks"))
    return sent.withColumn("percent", percent)


def in_range() -> Column:
    """Whether a chunk says where it belongs; false where a number is missing."""
    index = F.col("chunk_index")
    return F.coalesce((index >= 0) & (index < F.col("total_chunks")), F.lit(False))


def check_chunks(chunks: DataFrame) -> DataFrame:
    """Mark chunks without a usable index as rejected; none is dropped."""
    return accept_if(chunks, in_range(), BAD_CHUNK)


def upload_manifest(chunks: DataFrame) -> DataFrame:
    """Per upload: chunks seen (repeats count once), expected and rejected, and `complete`.

    Reads no bodies. Repeats are removed on (upload_id, chunk_index) and the rest are
    counted with a map-side combine. An upload with a rejected chunk is not complete.
    """
    placed = F.when(in_range(), F.col("chunk_index")).alias("_index")
    seen = chunks.groupBy("upload_id", placed).agg(
        F.max("total_chunks").alias("total_chunks"), F.count(F.lit(1)).alias("_rows")
    )
    rejected = F.sum(F.when(F.col("_index").isNull(), F.col("_rows")).otherwise(0))
    counted = seen.groupBy("upload_id").agg(
        F.count("_index").alias("n_chunks"),
        F.max("total_chunks").alias("total_chunks"),
        rejected.alias("n_rejected"),
    )
    whole = F.col("n_chunks") == F.col("total_chunks")
    return counted.withColumn(
        "complete", F.coalesce(whole & (F.col("n_rejected") == 0), F.lit(False))
    )


def assemble_segments(
    chunks: DataFrame, order: str | None = None, segment_chunks: int = SEGMENT_CHUNKS
) -> DataFrame:
    """Concatenate chunks in index order, whatever order they arrived in.

    A file is one or more segment rows of up to `segment_chunks` chunks each, so a file of
    any size is spread over many tasks; a file of up to that many chunks is one row. A chunk
    sent again replaces the earlier one: the row with the highest `order` wins, or the
    greatest body where no order is known. Rejected chunks belong to no place and are left
    out; see `check_chunks`. Uploads with missing chunks are included; see
    `assemble_chunks`.

    A missing order is lower than any; of equals the longest body wins, then the greatest.
    Each body is shuffled once, to the others of its segment, where repeats are reduced
    one at a time, so a chunk may be sent very often.
    """
    segment_no = F.floor(F.col("chunk_index") / segment_chunks)
    placed = chunks.where(in_range()).withColumn("segment_no", segment_no)
    known = [] if order is None else [order]
    last = F.max(F.struct(*known, F.octet_length("body").alias("_bytes"), "body"))
    # Both groupings find their rows together already.
    once = (
        placed.repartition("upload_id", "segment_no")
        .groupBy("upload_id", "segment_no", "chunk_index")
        .agg(F.max("total_chunks").alias("total_chunks"), last["body"].alias("body"))
    )
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "body")))
    packed = once.groupBy("upload_id", "segment_no").agg(
        F.max("total_chunks").alias("total_chunks"), parts.alias("_single")
    )
    bodies = F.col("_single.body")
    if dict(chunks.dtypes)["body"] == "binary":
        empty = F.lit(b"")
        body = F.aggregate(bodies, empty, lambda whole, part: F.concat(whole, part))
    else:
        body = F.array_join(bodies, "")
    return packed.select(
        "upload_id", "segment_no", "total_chunks", F.size("_single").alias("n_chunks"),
        body.alias("body"),
    )


def complete_uploads(chunks: DataFrame) -> DataFrame:
    return upload_manifest(chunks).where("complete").select("upload_id")


def assemble_chunks(
    chunks: DataFrame, order: str | None = None, segment_chunks: int = SEGMENT_CHUNKS
) -> DataFrame:
    """The segments of complete uploads only; others are left out before any body moves."""
    whole = chunks.join(complete_uploads(chunks), "upload_id", "left_semi")
    return assemble_segments(whole, order, segment_chunks)


def upload_sizes(chunks: DataFrame, order: str) -> DataFrame:
    """Bytes and chunks of each complete upload, from the lengths of its chunks alone."""
    lengths = chunks.where(in_range()).select(
        "upload_id", "chunk_index", order, F.octet_length("body").cast("bigint").alias("_bytes")
    )
    latest = lengths.groupBy("upload_id", "chunk_index").agg(
        F.max(F.struct(order, "_bytes"))["_bytes"].alias("_bytes")
    )
    sizes = latest.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("_bytes").alias("file_size")
    )
    return sizes.join(complete_uploads(chunks), "upload_id", "left_semi")


def upload_files(chunks: DataFrame, projects: DataFrame, order: str) -> DataFrame:
    """Complete uploads as files to take in: pos, project_id, file_name, file_size, file_path.

    Marks every upload (`accepted`, `reject_reason`): the name as it was sent must be a PDF's and the
    project known. Names are made safe; one of which too little is left, as of one in another
    script, is replaced by the upload's id. `pos` is the upload.
    """
    named = chunks.groupBy("upload_id").agg(
        F.max("file_name").alias("file_name"), F.max("project_id").alias("project_id")
    )
    sized = upload_sizes(chunks, order).select(F.col("upload_id"), "file_size").join(named, "upload_id")
    pdf, cleaned = names.is_pdf(F.col("_sent_name")), names.safe_filename(F.col("_sent_name"))
    number = F.col("upload_id").cast("string")
    name = (
        F.when(pdf & ~names.is_pdf(cleaned), F.concat(number, F.lit(".pdf")))
        .when(cleaned == "", number).otherwise(cleaned)
    )
    safe = sized.withColumnRenamed("file_name", "_sent_name").select(
        F.col("upload_id").alias("pos"), "project_id", name.alias("file_name"), "file_size",
        pdf.alias("_pdf"),
    )
    placed = safe.withColumn(
        "file_path", F.concat_ws("/", F.lit("uploads"), "project_id", "pos", "file_name")
    )
    known = orphan_check(placed, projects).drop("reject_reason").withColumnRenamed("accepted", "_known")
    reason = F.when(~F.col("_pdf"), rules.NOT_A_PDF).otherwise(rules.NO_PROJECT)
    return accept_if(known, F.col("_pdf") & F.col("_known"), reason).drop("_known", "_pdf")
