"""The same queries as DuckDB SQL over the given tables, written on their own."""

from __future__ import annotations

import re

from folioflow.plans.views import FAULT, FAULT_TEXT

# Shared views; each may use those above it.
_VIEWS = {
    "clients": "SELECT r_regionkey AS id, r_name AS name FROM region",
    "users": """
        SELECT s_suppkey AS id, s_name AS fullname,
               lower(replace(s_name, '#', '.'))
                 || CASE WHEN s_nationkey % 2 = 0 THEN '@a.example' ELSE '@b.example' END AS email
        FROM supplier""",
    "projects": """
        SELECT n_nationkey AS id, n_name AS name, n_regionkey AS client_id,
               n_nationkey % 5 AS user_id
        FROM nation""",
    "files": """
        SELECT o_orderkey AS id, c_nationkey AS project_id,
               'order_' || o_orderkey || '.pdf' AS file_name,
               CAST(floor(o_totalprice) AS BIGINT) AS file_size,
               CASE o_orderstatus WHEN 'F' THEN 'Processed' WHEN 'P' THEN 'Processing'
                    ELSE 'Not processed' END AS status,
               o_orderdate AS created_at,
               CASE o_orderkey % 4 WHEN 0 THEN 'Basic' WHEN 1 THEN 'ADVANCED'
                    WHEN 3 THEN 'fast' END AS option,
               'uploads/' || (c_nationkey % 5) || '/' || c_nationkey || '/' || o_orderkey
                 || '/order_' || o_orderkey || '.pdf' AS file_path
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "uploads": """
        SELECT source AS batch, doc_id AS pos,
               source || ' doc ' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.PDF'
                 WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.pdf' END AS file_name,
               CAST(doc_id % 28 AS INTEGER) AS project_id,
               CAST(octet_length(encode(text)) AS BIGINT) AS file_size
        FROM documents""",
    "sent_chunks": """
        SELECT conv_id AS upload_id, turn AS chunk_index, text AS body,
               max(turn) OVER w + 1
                 + CASE WHEN max_by(role, turn) OVER w = 'user' THEN 1 ELSE 0 END AS total_chunks
        FROM conversations WINDOW w AS (PARTITION BY conv_id)""",
    "bad_chunks": """
        SELECT upload_id, CAST(NULL AS BIGINT) AS chunk_index, total_chunks FROM sent_chunks
        WHERE chunk_index = 0 AND upload_id % 11 = 0
        UNION ALL
        SELECT upload_id, total_chunks, total_chunks FROM sent_chunks
        WHERE chunk_index = 0 AND upload_id % 13 = 0""",
    "chunks": """
        SELECT * REPLACE (body || CASE WHEN chunk_index = 0 AND upload_id % 5 = 0
                                       THEN ' again' ELSE '' END AS body)
        FROM sent_chunks""",
    "manifest": """
        SELECT c.upload_id, n_chunks, total_chunks, coalesce(n_rejected, 0) AS n_rejected,
               n_chunks = total_chunks AND n_rejected IS NULL AS complete
        FROM (SELECT upload_id, count(*) AS n_chunks, max(total_chunks) AS total_chunks
              FROM chunks GROUP BY upload_id) c
        LEFT JOIN (SELECT upload_id, count(*) AS n_rejected FROM bad_chunks GROUP BY 1) r
          ON c.upload_id = r.upload_id""",
    "upload_file": """
        SELECT upload_id AS pos, CAST(upload_id % 28 AS INTEGER) AS project_id,
               CASE WHEN upload_id % 19 = 4 THEN upload_id || '.pdf'
                    ELSE 'talk_' || upload_id || CASE WHEN upload_id % 17 = 3 THEN '.txt' ELSE '.pdf' END
               END AS file_name,
               CAST(sum(octet_length(encode(body))) AS BIGINT) AS file_size
        FROM chunks WHERE upload_id IN (SELECT upload_id FROM manifest WHERE complete)
        GROUP BY upload_id""",
    "pages_long": """
        SELECT doc_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS page_no, unnest(p) AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> '')""",
    "counts": "SELECT doc_id, count(*) AS n_pages FROM pages_long GROUP BY doc_id",
    "batches": """
        SELECT doc_id, CAST((page_no - 1) // 10 AS INTEGER) AS batch_no,
               CAST(min(page_no) AS INTEGER) AS start_page,
               CAST(max(page_no) AS INTEGER) AS end_page,
               string_agg(text, chr(10) ORDER BY page_no) AS pages,
               bool_or(contains(text, '{fault}')) AS bad
        FROM pages_long GROUP BY ALL""",
    "outline": """
        SELECT doc_id, page_no - 1 AS page, page_no - 1 AS pos, page_no % 3 + 1 AS line,
               text AS bookmark
        FROM pages_long""",
    "status_events": """
        SELECT user_id AS file_id, event_id, ts,
               CASE event_type WHEN 'signup' THEN 'Not processed' WHEN 'purchase' THEN 'Processed'
                    WHEN 'error' THEN 'Failed' ELSE 'Processing' END AS status
        FROM events""",
    "requests": """
        SELECT c_custkey AS pos,
               CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE r_name END AS client_name,
               c_name AS project_name, n_nationkey % 5 AS user_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey""",
    "all_clients": """
        SELECT CAST(id AS BIGINT) AS id, name FROM clients
        UNION ALL
        SELECT (SELECT max(id) FROM clients) + row_number() OVER (ORDER BY pos), name
        FROM (SELECT client_name AS name, min(pos) AS pos FROM requests
              WHERE client_name NOT IN (SELECT name FROM clients) GROUP BY 1)""",
    "catalog": """
        SELECT c.name AS client_name, p.name AS project_name, f.id AS file_id, f.file_name,
               f.created_at, f.status
        FROM files f JOIN projects p ON f.project_id = p.id JOIN clients c ON p.client_id = c.id""",
    "added": r"""
        SELECT (SELECT max(id) FROM files) + row_number() OVER (ORDER BY pos) AS id,
               project_id, file_name, file_size,
               'uploads/' || project_id || '/' || pos || '/' || file_name AS file_path
        FROM (SELECT * REPLACE (replace(file_name, ' ', '_') AS file_name) FROM uploads
              WHERE lower(file_name) LIKE '%.pdf' AND project_id IN (SELECT id FROM projects))""",
    "added_files": r"""
        SELECT id, project_id, file_name, file_size, file_path, 'Not processed' AS status,
               '2024-01-01 00:00:00.000000' AS created_at,
               regexp_replace(md5(file_path || chr(1) || id),
                 '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') AS uuid
        FROM added""",
    "bad_positions": """
        SELECT batch, min(pos) AS first_bad FROM uploads
        WHERE lower(file_name) NOT LIKE '%.pdf' GROUP BY batch""",
    "latest": """
        SELECT file_id, max_by(status, (ts, event_id)) AS status, max(ts) AS updated_at
        FROM status_events GROUP BY file_id""",
    "source_offsets": """
        SELECT source AS target, doc_id, n_pages,
               CAST(coalesce(sum(n_pages) OVER (PARTITION BY source ORDER BY doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_offset
        FROM documents JOIN counts USING (doc_id)""",
    "kept": """
        SELECT doc_id, CAST(sum(end_page - start_page + 1) AS BIGINT) AS n_pages
        FROM batches WHERE NOT bad GROUP BY doc_id""",
    "kept_map": """
        SELECT doc_id, start_page, end_page,
               coalesce(sum(end_page - start_page + 1) OVER (PARTITION BY doc_id
                 ORDER BY start_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM batches WHERE NOT bad""",
    "headings": r"""
        SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS doc_id,
               CAST(row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1)
                 ORDER BY page_id) - 1 AS BIGINT) AS page,
               regexp_extract_all(html, '(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>', 1) AS levels,
               regexp_extract_all(html, '(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>', 2) AS titles
        FROM pages""",
}

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def _time(column: str) -> str:
    return _TIME.format(column) + f" AS {column}"


_CATALOG = f"""client_name, project_name, file_id, file_name, {_time('created_at')}, status"""

_ACTION = """CASE status WHEN 'Processed' THEN 'Download' WHEN 'Not processed' THEN 'Start OCR'
    WHEN 'Processing' THEN 'Processing...' WHEN 'Failed' THEN 'Show Error' ELSE '' END"""

_SEGMENTS = """
    SELECT upload_id, chunk_index // {size} AS segment_no, CAST(count(*) AS INTEGER) AS n_chunks,
           md5(string_agg(body, '' ORDER BY chunk_index)) AS body_md5,
           CAST(sum(octet_length(encode(body))) AS BIGINT) AS n_bytes
    FROM chunks {where} GROUP BY ALL"""

_COMPLETE = "WHERE upload_id IN (SELECT upload_id FROM manifest WHERE complete)"

_UPLOAD_FILES = """
    SELECT pos, project_id, file_name, file_size,
           'uploads/' || project_id || '/' || pos || '/' || file_name AS file_path,
           file_name LIKE '%.pdf' AND project_id < 25 AS accepted,
           CASE WHEN file_name NOT LIKE '%.pdf' THEN 'Invalid file type. Only PDFs are allowed.'
                WHEN project_id >= 25 THEN 'Project not found' END AS reject_reason
    FROM upload_file"""

_REATTACHED = """
    SELECT o.doc_id, pos, line, CAST(before + page + 1 - (start_page - 1) AS BIGINT) AS page,
           md5(bookmark) AS bookmark_md5
    FROM outline o JOIN kept_map k
      ON o.doc_id = k.doc_id AND page + 1 BETWEEN start_page AND end_page"""

_PAGE_COUNTS = """
    SELECT doc_id, counts.n_pages AS pages_before, coalesce(kept.n_pages, 0) AS pages_after,
           counts.n_pages - coalesce(kept.n_pages, 0) AS pages_lost
    FROM counts LEFT JOIN kept USING (doc_id)"""

_SECTION = """
    SELECT doc_id, CAST((page_no - 1) // {size} AS INTEGER) AS section_no,
           CAST(min(page_no) AS INTEGER) AS start_page, CAST(count(*) AS INTEGER) AS n_pages,
           md5(string_agg(text, chr(10) ORDER BY page_no)) AS text_md5
    FROM pages_long GROUP BY ALL"""

_RUN_PAGES = """
    SELECT p.doc_id, p.page_no, b.bad,
           CASE WHEN b.bad THEN p.text ELSE replace(p.text, 'e', 'E') END AS text
    FROM pages_long p JOIN batches b
      ON p.doc_id = b.doc_id AND p.page_no BETWEEN b.start_page AND b.end_page"""

_RUN = f"""
    SELECT doc_id, CAST((page_no - 1) // 1000 AS INTEGER) AS section_no,
           CAST(min(page_no) AS INTEGER) AS start_page, CAST(count(*) AS INTEGER) AS n_pages,
           CAST(count(DISTINCT CASE WHEN bad THEN (page_no - 1) // 10 END) AS INTEGER)
             AS n_failed,
           md5(string_agg(text, chr(10) ORDER BY page_no)) AS text_md5
    FROM ({_RUN_PAGES}) GROUP BY ALL"""

_STATUS = f"""
    SELECT file_id, status, {_time('updated_at')},
           CASE WHEN status IN ('Processed', 'Failed')
                THEN {_TIME.format('updated_at')} END AS completed_at
    FROM latest"""

_BURST = "SELECT doc_id, batch_no, start_page, end_page, md5(pages) AS pages_md5 FROM batches"

_EXPIRED = """
    SELECT upload_id, n_chunks, total_chunks FROM manifest
    WHERE NOT complete AND upload_id < (SELECT max(upload_id) FROM manifest) - 24"""

_QUERIES = {
    "scan_documents": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "scan_clients": "SELECT id, name FROM clients",
    "append_files": "SELECT * FROM added_files",
    "bulk_union": f"""
        SELECT id, project_id, file_name, file_size, status, {_time('created_at')}, option,
               NULL AS uuid FROM files
        UNION ALL
        SELECT id, project_id, file_name, file_size, status, created_at, NULL, uuid
        FROM added_files""",
    "upsert_clients": "SELECT id, name FROM all_clients",
    "upsert_projects": """
        SELECT (SELECT max(id) FROM projects) + row_number() OVER (ORDER BY pos) AS id,
               project_name AS name, c.id AS client_id, user_id
        FROM requests JOIN all_clients c ON client_name = c.name""",
    "write_merged": f"""
        SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, md5(text) AS text_md5
        FROM ({_RUN_PAGES})""",
    "merged_pages": f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_no,
               md5(text) AS text_md5
        FROM ({_RUN_PAGES}) WHERE NOT bad""",
    "resolve_outputs": """
        SELECT id, 'order_' || id || '_OCRed_with_bookmarks.pdf' AS output_name,
               replace(file_path, '.pdf', '_OCRed_with_bookmarks.pdf') AS path,
               CASE WHEN status = 'Processed' AND id % 10 <> 0 THEN 'found' ELSE 'missing' END
                 AS state
        FROM files""",
    "ingest_bulk": """
        SELECT u.batch, pos, first_bad IS NULL OR pos < first_bad AS accepted,
               CASE WHEN first_bad IS NULL OR pos < first_bad THEN NULL
                    WHEN lower(file_name) LIKE '%.pdf' THEN 'Upload stopped at an earlier file.'
                    ELSE 'Invalid file type. Only PDFs are allowed.' END AS reject_reason
        FROM uploads u LEFT JOIN bad_positions b ON u.batch = b.batch""",
    "ingest_bulk_all_or_nothing": """
        SELECT u.batch, pos, first_bad IS NULL AS accepted
        FROM uploads u LEFT JOIN bad_positions b ON u.batch = b.batch""",
    "ingest_bulk_skip_bad": """
        SELECT batch, pos, lower(file_name) LIKE '%.pdf' AS accepted FROM uploads""",
    "filter_extension": """
        SELECT batch, pos, file_name FROM uploads WHERE lower(file_name) LIKE '%.pdf'""",
    "filter_domain": """
        SELECT id, fullname, email, email LIKE '%@a.example' AS accepted,
               CASE WHEN email NOT LIKE '%@a.example' THEN 'Email domain is not allowed' END
                 AS reject_reason
        FROM users""",
    "require_fields": """
        SELECT id, option IS NOT NULL AS accepted,
               CASE WHEN option IS NULL THEN 'option is required' END AS reject_reason
        FROM files""",
    "eq_filter": "SELECT id, name, client_id, user_id FROM projects WHERE client_id = 3",
    "in_filter": """
        SELECT id, project_id, file_name, file_size FROM files
        WHERE project_id IN (SELECT id FROM projects WHERE client_id = 3)""",
    "name_lookup": """
        SELECT id, name FROM projects WHERE client_id =
          (SELECT min(id) FROM clients WHERE lower(name) = 'middle east')""",
    "search_rows": f"""
        SELECT {_CATALOG}, {_ACTION} AS action FROM catalog
        WHERE contains(lower(concat_ws(' ', client_name, project_name, file_name,
          strftime(created_at, '%Y-%m-%d %H:%M:%S'), status, {_ACTION})), 'asia nation_1')""",
    "search_index": f"""
        SELECT search, file_id, project_name
        FROM catalog, (SELECT unnest(['asia nation_1', '1', 'PR', 'bro', 'F.pdf', '1995-03-1',
                              'processing...', 'start ocr', 'no such text']) AS search)
        WHERE contains(lower(concat_ws(' ', client_name, project_name, file_name,
          strftime(created_at, '%Y-%m-%d %H:%M:%S'), status, {_ACTION})), lower(search))""",
    "project_listing": """
        SELECT project_id, id, file_name AS name, status,
               CASE WHEN status = 'Processed' THEN '/download/' || id END AS download_url,
               CASE WHEN status = 'Failed' THEN '/error/' || id END AS error_url,
               strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
        FROM files""",
    "status_action": f"SELECT file_id, status, {_ACTION} AS action FROM latest",
    "output_names": """
        SELECT doc_id, batch_no,
               stem || '_pages_' || start_page || '_to_' || end_page || '.pdf' AS batch_file,
               stem || '_OCRed.pdf' AS merged_file,
               stem || '_OCRed_with_bookmarks.pdf' AS outlined_file
        FROM batches JOIN (SELECT pos, file_name[:-5] AS stem FROM uploads) ON doc_id = pos""",
    "safe_filename": r"""
        SELECT doc_id, page,
               regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(
                 regexp_replace(strip_accents('../' || bookmark || '.pdf'), '[/\s]+', ' ', 'g')),
                 ' ', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+', ''), '[._]+$', '')
                 AS file_name
        FROM outline""",
    "output_path": "SELECT id, 'ocr_output' || file_path[8:] AS path FROM files",
    "option_dispatch": """
        SELECT coalesce(lower(option), 'basic') AS run_option,
               coalesce(lower(option), 'basic') IN ('basic', 'advanced') AS accepted,
               count(*) AS n_files
        FROM files GROUP BY ALL""",
    "project_client": """
        SELECT p.id, p.name, client_id, c.name AS client_name, user_id
        FROM projects p JOIN clients c ON client_id = c.id""",
    "projects_with_files": """
        SELECT p.id AS project_id, CAST(part AS INTEGER) AS part_no, p.name,
               c.name AS client_name, CAST(count(*) AS INTEGER) AS n_files,
               min(f.id) AS first_id, max(f.id) AS last_id,
               md5('{{"name":"' || p.name || '","client_name":"' || c.name || '","files":['
                 || string_agg('{{"id":' || f.id || ',"name":"' || file_name || '","status":"'
                   || status || '","download_url":' || CASE WHEN status = 'Processed'
                   THEN '"/download/' || f.id || '"' ELSE 'null' END
                   || ',"error_url":null,"created_at":"'
                   || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '"}}', ',' ORDER BY f.id)
                 || ']}}') AS body_md5
        FROM (SELECT *, (row_number() OVER (PARTITION BY project_id ORDER BY id) - 1) // 100 AS part
              FROM files) f
        JOIN projects p ON f.project_id = p.id JOIN clients c ON p.client_id = c.id
        GROUP BY p.id, part, p.name, c.name""",
    "catalog": f"SELECT {_CATALOG} FROM catalog",
    "orphan_check": """
        SELECT f.id, f.project_id + 3 AS project_id, p.id IS NOT NULL AS accepted,
               CASE WHEN p.id IS NULL THEN 'Project not found' END AS reject_reason
        FROM files f LEFT JOIN projects p ON f.project_id + 3 = p.id""",
    "outline_range": """
        SELECT o.doc_id, batch_no, pos, line, md5(bookmark) AS bookmark_md5,
               CAST(page - (start_page - 1) + 1 AS BIGINT) AS page
        FROM outline o JOIN batches b
          ON o.doc_id = b.doc_id AND page >= start_page - 1 AND page < end_page""",
    "delete_projects": """
        SELECT id, project_id, file_name FROM files WHERE project_id NOT IN
          (SELECT p.id FROM projects p JOIN clients c ON client_id = c.id WHERE c.name = 'ASIA')""",
    "delete_projects_written": """
        SELECT 'projects' AS table_name, CAST(p.id AS BIGINT) AS id, p.name
        FROM projects p JOIN clients c ON client_id = c.id WHERE c.name <> 'ASIA'
        UNION ALL
        SELECT 'files', f.id, file_name FROM files f JOIN projects p ON project_id = p.id
          JOIN clients c ON client_id = c.id WHERE c.name <> 'ASIA'""",
    "deleted_paths": """
        SELECT unnest(['upload', 'merged', 'final']) AS kind,
               unnest([file_path, file_path[:-5] || '_OCRed.pdf',
                       file_path[:-5] || '_OCRed_with_bookmarks.pdf']) AS path
        FROM files f JOIN projects p ON project_id = p.id JOIN clients c ON client_id = c.id
        WHERE c.name = 'ASIA'""",
    "delete_projects_counts": """
        SELECT 'projects' AS table_name, count(*) AS n_rows
        FROM projects p JOIN clients c ON client_id = c.id WHERE c.name = 'ASIA'
        UNION ALL
        SELECT 'files', count(*) FROM files f JOIN projects p ON project_id = p.id
          JOIN clients c ON client_id = c.id WHERE c.name = 'ASIA'
        UNION ALL
        SELECT 'projects kept', count(*)
        FROM projects p JOIN clients c ON client_id = c.id WHERE c.name <> 'ASIA'""",
    "results_to_file": f"""
        SELECT doc_id, batch_no, project_id, file_name,
               CASE WHEN bad THEN 'Failed' ELSE 'Processed' END AS status,
               CASE WHEN bad THEN '{FAULT_TEXT}' END AS error
        FROM batches JOIN files ON doc_id = id""",
    "project_summary": """
        SELECT c.name AS client_name, p.name AS project_name, count(f.id) AS n_files,
               count(*) FILTER (status = 'Not processed') AS n_not_processed,
               count(*) FILTER (status = 'Processing') AS n_processing,
               count(*) FILTER (status = 'Processed') AS n_processed,
               count(*) FILTER (status = 'Failed') AS n_failed
        FROM projects p JOIN clients c ON p.client_id = c.id LEFT JOIN files f ON project_id = p.id
        GROUP BY ALL""",
    "distinct_names": """
        SELECT DISTINCT 'client' AS kind, c.name
        FROM projects p JOIN clients c ON client_id = c.id
        UNION ALL SELECT DISTINCT 'project', name FROM projects""",
    "assemble_chunks": _SEGMENTS.format(size=16, where=_COMPLETE),
    "assemble_segments": _SEGMENTS.format(size=4, where=""),
    "upload_manifest": """
        SELECT upload_id, n_chunks, total_chunks, n_rejected, complete FROM manifest""",
    "upload_to_files": _UPLOAD_FILES,
    "stream_upload_to_files": _UPLOAD_FILES,
    "rejected_chunks": """
        SELECT *, 'Chunk index is missing or out of range' AS reject_reason FROM bad_chunks""",
    "upload_sizes": f"""
        SELECT upload_id, count(*) AS n_chunks,
               CAST(sum(octet_length(encode(body))) AS BIGINT) AS file_size
        FROM chunks {_COMPLETE} GROUP BY ALL""",
    "gather_batches": _SECTION.format(size=50),
    "gather_lines": """
        SELECT l_orderkey AS doc_id, CAST(0 AS INTEGER) AS section_no,
               CAST(count(*) AS INTEGER) AS n_pages,
               md5(string_agg(line, chr(10) ORDER BY l_linenumber)) AS text_md5
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey || '|' || l_suppkey || '|'
                || l_returnflag || '|' || l_linestatus) AS line FROM lineitem GROUP BY 1, 2)
        GROUP BY l_orderkey""",
    "page_counts": _PAGE_COUNTS,
    "run_page_counts": _PAGE_COUNTS,
    "run_outline": _REATTACHED,
    "run_status": """
        SELECT doc_id, CASE WHEN bool_or(bad) THEN 'Failed' ELSE 'Processed' END AS status,
               count(*) FILTER (bad) AS n_failed, CAST(NULL AS VARCHAR) AS error
        FROM batches GROUP BY doc_id
        UNION ALL
        SELECT doc_id, 'Failed', CAST(NULL AS BIGINT), 'Document has no pages'
        FROM documents WHERE text = ''""",
    "run_abort": f"SELECT * FROM ({_RUN}) WHERE doc_id NOT IN (SELECT doc_id FROM batches WHERE bad)",
    "status_latest": _STATUS,
    "apply_status": f"""
        SELECT id, file_name, coalesce(l.status, f.status) AS status,
               CASE WHEN l.status IN ('Processed', 'Failed')
                    THEN {_TIME.format('updated_at')} END AS completed_at
        FROM files f LEFT JOIN latest l ON id = file_id""",
    "start_runs": """
        SELECT file_id, option, known AND option <> 'fast' AS accepted,
               CASE WHEN NOT known THEN 'File not found'
                    WHEN option = 'fast' THEN 'Invalid OCR option provided.' END AS reject_reason,
               CASE WHEN known AND option <> 'fast' THEN 'Processing' END AS status,
               CASE WHEN known AND option <> 'fast' THEN '2024-01-01 00:00:00.000000' END AS ts
        FROM (SELECT c_custkey * 20 AS file_id,
                     CASE c_mktsegment WHEN 'BUILDING' THEN 'advanced' WHEN 'MACHINERY' THEN 'fast'
                          ELSE 'basic' END AS option,
                     c_custkey * 20 IN (SELECT id FROM files) AS known
              FROM customer)""",
    "status_rollup": """
        SELECT doc_id, count(*) AS n_batches, count(*) FILTER (bad AND NOT late) AS n_failed,
               CASE WHEN bool_or(bad AND NOT late) THEN 'Failed' WHEN bool_or(late)
                    THEN 'Processing' ELSE 'Processed' END AS status
        FROM (SELECT *, doc_id % 13 = 5 AND batch_no = 0 AS late FROM batches) GROUP BY doc_id""",
    "unique_first": """
        SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS accepted,
               CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text)
                    THEN 'already registered' END AS reject_reason
        FROM documents""",
    "page_total": """
        SELECT count(*) AS n_rows, CAST(ceil(count(*) / 20) AS BIGINT) AS n_pages FROM catalog""",
    "burst": _BURST,
    "burst_pages": _BURST,
    "upload_progress": """
        SELECT conv_id AS upload_id, turn AS chunk_index,
               max(turn) OVER w + 1 AS total_chunks,
               (turn + 1) * 100 // (max(turn) OVER w + 1) AS percent
        FROM conversations WINDOW w AS (PARTITION BY conv_id)""",
    "paginate": f"""
        SELECT {_CATALOG} FROM (SELECT * FROM catalog
        ORDER BY lower(client_name) DESC, file_id LIMIT 20 OFFSET 40)""",
    "page_at": f"""
        SELECT {_CATALOG}, CAST((place - 1) // 20 + 1 AS INTEGER) AS page
        FROM (SELECT *, row_number() OVER (ORDER BY lower(client_name) DESC, file_id) AS place,
                     (count(*) OVER () + 19) // 20 AS last_page FROM catalog) catalog
        WHERE (place - 1) // 20 + 1 IN (1, (last_page + 1) // 2, last_page)""",
    "next_page": f"""
        SELECT {_CATALOG} FROM (SELECT * FROM catalog
        WHERE lower(client_name) > 'asia' OR (lower(client_name) = 'asia' AND file_id > 1000)
        ORDER BY lower(client_name), file_id LIMIT 50)""",
    "sort_rows": f"SELECT {_CATALOG} FROM catalog ORDER BY catalog.created_at DESC, file_id",
    "order_by_id": "SELECT project_id, id, file_name FROM files ORDER BY project_id, id",
    "first_match": """
        SELECT batch, pos, file_name FROM uploads
        WHERE pos IN (SELECT min(pos) FROM uploads GROUP BY lower(batch))""",
    "page_order": f"SELECT * EXCLUDE (start_page) FROM ({_SECTION.format(size=1000)})",
    "page_offsets": """
        SELECT target, doc_id, n_pages, page_offset, false AS missing FROM source_offsets""",
    "concat_pages": """
        SELECT target, page_offset + page_no AS page_no, doc_id,
               CAST(page_no AS INTEGER) AS source_page, md5(text) AS text_md5
        FROM pages_long JOIN source_offsets USING (doc_id)""",
    "extract_outline": r"""
        SELECT doc_id, page, CAST(pos - 1 AS INTEGER) AS pos, CAST(level AS INTEGER) AS line,
               trim(regexp_replace(title, '<[^>]*>', '', 'g')) AS bookmark
        FROM (SELECT doc_id, page, generate_subscripts(levels, 1) AS pos,
                     unnest(levels) AS level, unnest(titles) AS title FROM headings)""",
    "reattach_outline": _REATTACHED,
    "outline_tree": f"""
        WITH entries AS (
            SELECT doc_id, pos, line FROM ({_REATTACHED.replace("pos, line,", "pos, o.line,")})
        ), every AS (
            FROM entries UNION ALL
            SELECT -1, doc_id * 1000000 + pos, line FROM entries WHERE doc_id % 3 = 0
        ), above AS (
            SELECT *, max(CASE WHEN line = 1 THEN pos END) OVER w AS first,
                   max(CASE WHEN line = 2 THEN pos END) OVER w AS second
            FROM every
            WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), placed AS (
            SELECT doc_id, pos,
                   list_concat(
                     CASE WHEN line > 1 AND first IS NOT NULL THEN [first] ELSE [] END,
                     list_concat(CASE WHEN line > 2 AND second IS NOT NULL
                                           AND (first IS NULL OR second > first) THEN [second] ELSE [] END,
                                 [pos])) AS way
            FROM above
        )
        SELECT doc_id, pos, way[-2] AS parent_pos, CAST(len(way) AS INTEGER) AS depth,
               array_to_string(way, '/') AS path
        FROM placed""",
    "unique_against_stored": """
        SELECT doc_id, accepted,
               CASE WHEN NOT accepted THEN 'already registered' END AS reject_reason
        FROM (SELECT doc_id,
                     doc_id = min(doc_id) OVER (PARTITION BY md5(text), doc_id % 3 = 0)
                     AND (doc_id % 3 = 0 OR md5(text) IS NULL OR md5(text) NOT IN
                          (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL))
                       AS accepted
              FROM documents)""",
    "strip_document_fields": "SELECT doc_id, page_no, md5(text) AS text_md5 FROM pages_long",
    "recognise_batches": f"""
        SELECT doc_id, batch_no, start_page, end_page,
               CASE WHEN bad THEN 'Failed' ELSE 'Processed' END AS status,
               CASE WHEN bad THEN '{FAULT_TEXT}' END AS error,
               CASE WHEN NOT bad THEN md5(replace(pages, 'e', 'E')) END AS pages_md5
        FROM batches""",
    "recognise_balanced": f"""
        SELECT doc_id, batch_no, start_page, end_page,
               CASE WHEN bad THEN 'Failed' ELSE 'Processed' END AS status,
               CASE WHEN bad THEN '{FAULT_TEXT}' END AS error,
               CASE WHEN NOT bad THEN md5(replace(pages, 'e', 'E')) END AS pages_md5
        FROM batches""",
    "failure_policy": """
        SELECT 'fallback' AS on_error, doc_id, n_pages FROM counts
        UNION ALL SELECT 'skip', doc_id, n_pages FROM kept
        UNION ALL SELECT 'abort', doc_id, n_pages FROM counts
          WHERE doc_id NOT IN (SELECT doc_id FROM batches WHERE bad)""",
    "document_run": _RUN,
    "document_run_pages": _RUN,
    "document_run_options": _RUN.replace(
        _RUN_PAGES,
        """
    SELECT r.doc_id, page_no, bad OR lang = 'es' AS bad,
           CASE WHEN lang = 'es' THEN p.text ELSE r.text END AS text
    FROM (""" + _RUN_PAGES + """) r
    JOIN pages_long p USING (doc_id, page_no) JOIN documents d ON r.doc_id = d.doc_id""",
    ),
    "stream_assemble": _SEGMENTS.format(size=16, where=_COMPLETE),
    "stream_status": _STATUS,
    "stream_project_summary": """
        SELECT c.name AS client_name, p.name AS project_name, count(l.file_id) AS n_files,
               count(*) FILTER (status = 'Not processed') AS n_not_processed,
               count(*) FILTER (status = 'Processing') AS n_processing,
               count(*) FILTER (status = 'Processed') AS n_processed,
               count(*) FILTER (status = 'Failed') AS n_failed
        FROM projects p JOIN clients c ON p.client_id = c.id LEFT JOIN latest l ON l.file_id % 28 = p.id
        GROUP BY ALL""",
    "stream_gather": """
        SELECT doc_id, '2024-01-01 0' || again || ':00:00.000000' AS started_at,
               count(*) AS n_batches, count(*) FILTER (bad) AS n_failed
        FROM batches, (SELECT unnest([0, 1]) AS again)
        WHERE again = 0 OR doc_id % 4 = 0 GROUP BY doc_id, again""",
    "stream_runs": """
        WITH run AS (
            SELECT doc_id, batch_no, bad, TIMESTAMP '2024-01-01' + to_hours(doc_id + 48 * again) AS start,
                   CASE WHEN doc_id % 5 = 1 AND batch_no = 0 THEN 1800 ELSE 10 + doc_id % 7 END AS wait,
                   doc_id % 7 <> 3 AND NOT (doc_id % 3 = 0 AND batch_no = 0) AS sent
            FROM batches, (SELECT unnest([0, 1]) AS again) WHERE again = 0 OR doc_id % 4 = 0
        ), ends AS (
            SELECT least((SELECT max(start) FROM run),
                         (SELECT max(start + to_minutes(wait + CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END))
                          FROM run WHERE sent)) - INTERVAL 1 HOUR AS mark
        ), counted AS (
            SELECT doc_id, start, count(*) AS n_batches,
                   count(*) FILTER (sent AND wait <= 1440) AS n_reported,
                   count(*) FILTER (sent AND wait <= 1440 AND bad) AS n_failed
            FROM run GROUP BY ALL
        )
        SELECT doc_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS started_at, n_batches, n_reported,
               n_failed,
               CASE WHEN n_reported = 0 THEN 'never reported' WHEN n_reported < n_batches
                    THEN 'unfinished' ELSE 'finished' END AS outcome
        FROM counted, ends WHERE start + INTERVAL 24 HOUR < mark""",
    "stream_upload_state": """
        WITH sent AS (
            SELECT upload_id, chunk_index, total_chunks,
                   unnest(CASE WHEN chunk_index = 0 THEN
                     list_concat([0], list_concat(CASE WHEN upload_id % 3 = 0 THEN [1800] ELSE [] END,
                                                  CASE WHEN upload_id % 7 = 0 THEN [20] ELSE [] END))
                     ELSE [0] END) AS wait
            FROM chunks
            UNION ALL
            SELECT upload_id, NULL, total_chunks, 0 FROM bad_chunks
            UNION ALL
            SELECT upload_id, chunk_index, total_chunks,
                   unnest(list_concat([0], list_concat(CASE WHEN upload_id % 3 = 0 THEN [1800] ELSE [] END,
                                                       CASE WHEN upload_id % 7 = 0 THEN [20] ELSE [] END)))
            FROM chunks WHERE chunk_index = 0 AND upload_id % 5 = 0
        ), timed AS (
            SELECT *, TIMESTAMP '2024-01-01' + to_hours(upload_id) AS start,
                   epoch(TIMESTAMP '2024-01-01' + to_hours(upload_id) + to_minutes(wait)) AS arrived
            FROM sent
        ), staged AS (
            SELECT *, least(floor((arrived - min(arrived) OVER ())
                                    / ((max(arrived) OVER () - min(arrived) OVER ()) / 4.0)), 3) AS stage
            FROM timed
        ), marks AS (
            SELECT s.stage, (SELECT max(start) FROM staged t WHERE t.stage < s.stage) AS mark
            FROM (SELECT DISTINCT stage FROM staged) s
        ), seen AS (
            SELECT *, coalesce(mark >= start + INTERVAL 24 HOUR, false) AS late,
                   coalesce(mark > start + INTERVAL 48 HOUR, false) AS gone
            FROM staged JOIN marks USING (stage)
        ), counted AS (
            SELECT upload_id, start, max(total_chunks) AS total_chunks,
                   count(DISTINCT chunk_index) AS n_chunks,
                   count(*) FILTER (chunk_index IS NULL) AS n_rejected
            FROM seen WHERE NOT late GROUP BY ALL
        )
        SELECT upload_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
               CASE WHEN n_chunks = total_chunks AND n_rejected = 0 THEN 'complete' ELSE 'expired' END
                 AS outcome, n_chunks, total_chunks, n_rejected, 0 AS n_late
        FROM counted
        WHERE (n_chunks = total_chunks AND n_rejected = 0)
           OR start + INTERVAL 24 HOUR <= (SELECT max(start) FROM staged)
        UNION ALL
        SELECT upload_id, strftime(s.start, '%Y-%m-%d %H:%M:%S.%f'), 'late', n_chunks,
               c.total_chunks, c.n_rejected, count(*)
        FROM seen s JOIN counted c USING (upload_id)
        WHERE late AND NOT gone AND NOT (n_chunks = c.total_chunks AND c.n_rejected = 0)
        GROUP BY ALL""",
    "stream_expire_runs": """
        SELECT doc_id, count(*) AS n_batches, count(*) - 1 AS n_reported,
               count(*) FILTER (bad AND batch_no > 0) AS n_failed
        FROM batches GROUP BY doc_id
        HAVING doc_id % 3 = 0 AND count(*) > 1 AND doc_id + 24 <
          (SELECT max(doc_id) FROM batches WHERE NOT (doc_id % 3 = 0 AND batch_no = 0))""",
    "status_windows": """
        SELECT strftime(time_bucket(INTERVAL '10 seconds', ts), '%Y-%m-%d %H:%M:%S.%f')
                 AS window_start, status, count(*) AS n_events
        FROM status_events GROUP BY ALL""",
    "expire_uploads": f"""
        SELECT event_id, file_id, status, {_time('ts')} FROM status_events
        WHERE status_events.ts >= (SELECT max(e.ts) FROM status_events e) - INTERVAL 24 HOUR""",
    "expired_uploads": _EXPIRED,
    "stream_expire": _EXPIRED,
}


def _needed(sql: str) -> list[str]:
    """Views the SQL names, directly or through other views, in order of definition."""
    wanted: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        fresh = (words & _VIEWS.keys()) - wanted
        wanted |= fresh
        pending += [_VIEWS[name] for name in fresh]
    return [name for name in _VIEWS if name in wanted]


def _statement(sql: str) -> str:
    views = ",\n".join(
        f"{name} AS ({_VIEWS[name].format(fault=FAULT).strip()})" for name in _needed(sql)
    )
    body = sql.replace("{{", "{").replace("}}", "}").strip()
    if body.startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return f"WITH {views}\n{body}" if views else body


def oracle_sql() -> dict[str, str]:
    return {name: _statement(sql) for name, sql in _QUERIES.items()}
