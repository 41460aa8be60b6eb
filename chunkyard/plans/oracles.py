"""DuckDB equivalents of the registered queries, computed independently from the same tables."""

from __future__ import annotations

BODY = "encode(coalesce(text, ''))"
FIXED = f"""fixed AS (
  SELECT doc_id, s AS seq, sha256(unhex(substr(hex({BODY}), s * 1024 + 1, 1024))) AS hash, least(512, octet_length({BODY}) - s * 512) AS length
  FROM documents, unnest(range(0, CAST(ceil(octet_length({BODY}) / 512.0) AS BIGINT))) AS t(s)
)"""

TERMS = """terms AS (
  SELECT l_orderkey AS file, l_linenumber * 10000000 + l_partkey AS ord, l_partkey AS object, sum(CAST(l_quantity AS BIGINT) * 100) AS unpacked,
    min(l_linenumber) AS cs, max(l_linenumber + 1 + l_suppkey % 3) AS ce FROM lineitem GROUP BY ALL
), spans AS (
  SELECT *, coalesce(sum(unpacked) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ts FROM terms
), sizes AS (SELECT file, sum(unpacked) AS size FROM terms GROUP BY file
), asked AS (
  SELECT o_orderkey AS request, CASE WHEN o_orderkey % 41 = 0 THEN -o_orderkey ELSE o_orderkey END AS file, o_orderkey % 5 AS kind, 1000 + o_orderkey % 7 * 1500 AS hi FROM orders
), bounds AS (
  SELECT request, a.file, size, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 500 WHEN 3 THEN 100000 WHEN 4 THEN 1000 END AS lo,
    CASE kind WHEN 0 THEN size - 1 WHEN 1 THEN least(2499, size - 1) WHEN 3 THEN least(200000, size - 1) WHEN 4 THEN least(hi, size - 1) END AS up, kind
  FROM asked a LEFT JOIN sizes s ON a.file = s.file
), windows AS (
  SELECT request, file, CASE WHEN size IS NULL THEN 'unknown_file' WHEN kind = 2 OR lo >= size AND kind > 0 THEN 'bad_range' ELSE 'ok' END AS status,
    CASE WHEN kind = 0 THEN 0 WHEN size IS NULL OR kind = 2 OR lo >= size THEN NULL ELSE lo END AS start, CASE WHEN size IS NULL OR kind = 2 OR kind > 0 AND lo >= size THEN NULL ELSE up END AS stop FROM bounds
), clipped AS (
  SELECT w.request, s.ord, s.object, s.unpacked, s.ts, w.start, s.cs, s.ce, p.p_size + 50 AS step,
    CASE WHEN p.p_partkey IS NULL THEN 'missing_footer' WHEN cs > ce OR ce = 0 OR ce > 8 THEN 'bad_chunk_range' END AS fault
  FROM windows w JOIN spans s ON w.file = s.file AND s.ts + s.unpacked > w.start AND s.ts <= w.stop LEFT JOIN part p ON p.p_partkey = s.object AND p.p_size <> 13
  WHERE w.status = 'ok'
), good AS (SELECT request FROM clipped GROUP BY request HAVING count(fault) = 0)"""

USERS = """users AS (SELECT user_id AS key, max(ts) AS last_access, CAST(sum(CAST(floor(abs(value)) AS BIGINT) + 1) AS BIGINT) AS size FROM events GROUP BY user_id),
plan AS (SELECT key, size, freed_before FROM (
  SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY last_access, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS freed_before, sum(size) OVER () AS total FROM users
) WHERE total - freed_before > 20000)"""

FILES = """paths AS (SELECT page_id, regexp_replace(regexp_split_to_array(url, '[?#]')[1], '^https?://', '') AS path, sha256(html) AS sha, CAST(length(html) AS BIGINT) AS size FROM pages),
files AS (SELECT path, arg_max(sha, page_id) AS sha, arg_max(size, page_id) AS size FROM paths GROUP BY path)"""

_SWAP = "concat_ws('', " + ", ".join(f"substr(h, {2 * (8 * (i // 8) + 7 - i % 8) + 1}, 2)" for i in range(32)) + ")"
HEXED = f"hexed AS (SELECT doc_id, h, {_SWAP} AS t, n FROM (SELECT doc_id, sha256({BODY}) AS h, octet_length({BODY}) AS n FROM documents))"



def _gear() -> str:
    """The low ten bits of 256 splitmix64 outputs; the k-th state is (k + 2) golden-ratio steps."""
    mask, out = 2**64 - 1, []
    for k in range(256):
        z = (k + 2) * 0x9E3779B97F4A7C15 & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ z >> shift) * factor & mask
        out.append((z ^ z >> 31) % 1024)
    return ", ".join(map(str, out))


_GEAR = _gear()
CDC = f"""RECURSIVE gear AS (SELECT [{_GEAR}] AS g),
bytes AS (SELECT doc_id, hex({BODY}) AS x, octet_length({BODY}) AS n FROM documents),
pos AS (SELECT doc_id, i, CAST(('0x' || substr(x, 2 * i + 1, 2)) AS INT) AS b FROM bytes, unnest(range(0, n)) AS t(i)),
val AS (SELECT doc_id, i, g[b + 1] AS v FROM pos, gear),
rolled AS (SELECT doc_id, i, v {" ".join(f"+ {2 ** j} * lag(v, {j}) OVER w" for j in range(1, 10))} AS s FROM val WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cand AS (SELECT doc_id, list(i + 1 ORDER BY i) AS c FROM rolled WHERE s % 1024 = 0 GROUP BY doc_id),
base AS (SELECT b.doc_id, n, coalesce(c, []) AS c FROM bytes b LEFT JOIN cand USING (doc_id) WHERE n > 0),
cuts AS (
  SELECT doc_id, 0 AS seq, CAST(0 AS BIGINT) AS a, CAST(least(coalesce(list_min(list_filter(c, lambda p: p >= 256)), n), 4096, n) AS BIGINT) AS e FROM base
  UNION ALL
  SELECT k.doc_id, seq + 1, e, CAST(least(coalesce(list_min(list_filter(c, lambda p: p >= e + 256)), n), e + 4096, n) AS BIGINT) FROM cuts k JOIN base b ON b.doc_id = k.doc_id WHERE e < n
),
chunks AS (SELECT k.doc_id, seq, a, e - a AS length, sha256(unhex(substr(x, 2 * a + 1, 2 * (e - a)))) AS hash FROM cuts k JOIN bytes b ON b.doc_id = k.doc_id)"""

ORACLE_SQL = {
    "cdc_chunks": f"WITH {CDC} SELECT CAST(doc_id AS VARCHAR) AS file_key, CAST(seq AS BIGINT) AS seq, a AS \"offset\", CAST(length AS BIGINT) AS length, hash FROM chunks",
    "cdc_upload_stats": f"""WITH {CDC}, marked AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, seq) = 1 AS fresh FROM chunks)
SELECT (SELECT count(*) FROM documents) AS uploads, (SELECT CAST(sum(octet_length({BODY})) AS BIGINT) FROM documents) AS size, count(*) AS chunks_total, count(*) FILTER (WHERE fresh) AS chunks_new,
  CAST(sum(length) FILTER (WHERE fresh) AS BIGINT) AS bytes_stored FROM marked""",
    "upload_stats": f"""WITH {FIXED}, marked AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, seq) = 1 AS fresh FROM fixed),
per AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE fresh) AS new, coalesce(sum(length) FILTER (WHERE fresh), 0) AS stored FROM marked GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS file_key, substr(sha256(sha256({BODY})), 1, 32) AS file_id, CAST(octet_length({BODY}) AS BIGINT) AS size, coalesce(total, 0) AS chunks_total, coalesce(new, 0) AS chunks_new,
  CAST(coalesce(stored, 0) AS BIGINT) AS bytes_stored, CASE WHEN octet_length({BODY}) > 0 THEN round(100 * (1 - coalesce(stored, 0) / octet_length({BODY})), 6) ELSE 0.0 END AS dedup_percent
FROM documents d LEFT JOIN per USING (doc_id)""",
    "store_stats": f"WITH {FIXED} SELECT count(DISTINCT hash) AS unique_chunks, CAST((SELECT sum(l) FROM (SELECT max(length) AS l FROM fixed GROUP BY hash)) AS BIGINT) AS unique_bytes, (SELECT count(*) FROM documents) AS files_stored FROM fixed",
    "file_ids": f"""SELECT file_key, sha256(c) AS sha256, substr(sha256(sha256(c)), 1, 32) AS file_id, CAST(octet_length(c) AS BIGINT) AS size FROM (
  SELECT CAST(doc_id AS VARCHAR) AS file_key, {BODY} AS c FROM documents UNION ALL SELECT 'page/' || CAST(page_id AS VARCHAR), encode(coalesce(html, '')) FROM pages)""",
    "duplicate_files": f"SELECT sha256({BODY}) AS sha256, count(*) AS copies, CAST(sum(octet_length({BODY})) AS BIGINT) AS bytes FROM documents GROUP BY 1 HAVING count(*) > 1",
    "fixed_chunk_dedup": """WITH f AS (SELECT hex(encode(coalesce(html, ''))) AS x FROM pages UNION ALL SELECT hex(encode(coalesce(text, ''))) FROM conversations),
c AS (SELECT substr(x, s * 1024 + 1, 1024) AS p FROM f, unnest(range(0, CAST(ceil(length(x) / 1024.0) AS BIGINT))) AS t(s))
SELECT sha256(unhex(p)) AS hash, count(*) AS uses, CAST(max(length(p)) // 2 AS BIGINT) AS length FROM c GROUP BY 1 HAVING count(*) > 1""",
    "insert_if_absent": f"WITH {FIXED} SELECT DISTINCT hash AS key, CAST(length AS BIGINT) AS size FROM fixed JOIN documents USING (doc_id) WHERE lang <> 'en' AND hash NOT IN (SELECT hash FROM fixed JOIN documents USING (doc_id) WHERE lang = 'en')",
    "verify_dedup": f"""SELECT CAST(doc_id AS VARCHAR) AS key, CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 2 THEN 'equal' ELSE 'mismatch' END AS status,
  CASE WHEN doc_id % 3 = 1 THEN CAST(octet_length({BODY}) // 1024 * 1024 AS BIGINT) END AS mismatch_round_offset FROM documents""",
    "blob_ranges": f"SELECT CAST(doc_id AS VARCHAR) AS key, sha256(unhex(p)) AS sha256, CAST(length(p) // 2 AS BIGINT) AS length FROM (SELECT doc_id, substr(hex({BODY}), 201, 100) AS p FROM documents)",
    "version_overlap": f"WITH {FIXED}, s AS (SELECT hash, source FROM fixed JOIN documents USING (doc_id)) SELECT DISTINCT hash FROM s WHERE source = 'src0' AND hash IN (SELECT hash FROM s WHERE source <> 'src0')",
    "restore_roundtrip": f"SELECT CAST(doc_id AS VARCHAR) AS file_key, sha256({BODY}) AS sha256, CAST(octet_length({BODY}) AS BIGINT) AS size FROM documents",
    "manifest_offsets": """SELECT conv_id AS file_key, turn AS seq, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS length,
  CAST(coalesce(sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM conversations""",
    "file_sizes": "SELECT l_orderkey AS file, CAST(sum(CAST(l_quantity AS BIGINT) * 100) AS BIGINT) AS size FROM lineitem GROUP BY 1",
    "recon_range_status": f"WITH {TERMS} SELECT request, status, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM windows",
    "recon_v1_terms": f"""WITH {TERMS} SELECT request, CAST(first_value(start - ts) OVER (PARTITION BY request ORDER BY ord) AS BIGINT) AS offset_into_first_range, ord, object, CAST(unpacked AS BIGINT) AS unpacked
FROM clipped WHERE request IN (SELECT request FROM good)""",
    "recon_v1_fetch": f"""WITH {TERMS} SELECT request, object, ord, CAST(cs * step AS BIGINT) AS byte_start, CAST(ce * step - 1 AS BIGINT) AS byte_stop FROM clipped WHERE request IN (SELECT request FROM good)""",
    "recon_v2_groups": f"""WITH {TERMS} SELECT request, object, count(*) AS n_ranges, CAST(min(cs * step) AS BIGINT) AS first_byte FROM clipped WHERE request IN (SELECT request FROM good) GROUP BY request, object""",
    "recon_status": f"""WITH {TERMS}, faults AS (SELECT request, min(fault) AS fault FROM clipped GROUP BY request)
SELECT coalesce(fault, status) AS status, count(*) AS requests FROM windows LEFT JOIN faults USING (request) GROUP BY 1""",
    "cacheable_files": """SELECT l_orderkey AS file, bool_and(p_partkey IS NOT NULL AND p_size <> 13 AND p_size <> 17) AS cacheable FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "eviction_plan": f"WITH {USERS} SELECT key, size, freed_before FROM plan",
    "storage_stats": f"""WITH {USERS} SELECT (SELECT count(*) FROM users) - count(*) AS objects_left, CAST((SELECT sum(size) FROM users) - coalesce(sum(size), 0) AS BIGINT) AS bytes_left,
  count(*) AS objects_evicted, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_evicted FROM plan""",
    "eviction_candidates": """SELECT c_custkey AS key, CAST(coalesce(floor(epoch(max(ts))), 0) AS BIGINT) AS last_access, CAST(100 AS BIGINT) AS size FROM customer LEFT JOIN events ON user_id = c_custkey
GROUP BY c_custkey HAVING coalesce(sum(CASE WHEN event_id IS NULL THEN 0 WHEN event_id % 2 = 0 THEN 1 ELSE -1 END), 0) <= 0""",
    "ttl_freshness": """WITH cache AS (SELECT user_id AS key, max(ts) AS stored_at, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY 1),
j AS (SELECT c_custkey AS key, cache.value AS c, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS l, stored_at IS NOT NULL AND floor(epoch(TIMESTAMP '2024-01-15')) - floor(epoch(stored_at)) <= 259200 AS hit FROM customer LEFT JOIN cache ON key = c_custkey)
SELECT key, CASE WHEN hit THEN c ELSE coalesce(l, c) END AS value, CASE WHEN hit THEN 'cache' WHEN l IS NOT NULL THEN 'live' WHEN c IS NOT NULL THEN 'stale' ELSE 'missing' END AS origin FROM j""",
    "chunk_index_first_writer": f"WITH {FIXED} SELECT hash, min(doc_id) AS file FROM fixed GROUP BY hash",
    "catalog_last_writer": "SELECT user_id AS repo_id, event_type AS path, max(event_id) AS event_id, arg_max(CAST(floor(abs(value)) AS BIGINT), event_id) AS size FROM events GROUP BY 1, 2",
    "tree_listing": f"""WITH {FILES} SELECT split_part(path, '/', 1) AS request, path, sha AS oid, size, CASE WHEN substr(sha, 1, 1) < '8' THEN sha END AS content_hash FROM files""",
    "repo_info": f"""WITH {FILES} SELECT 'org/pages' AS repo_id, 'main' AS sha, count(*) AS n_siblings, sha256(string_agg(path, chr(10) ORDER BY path)) AS siblings_sha256 FROM files""",
    "resolve": f"""WITH {FILES} SELECT path AS request, '"' || sha || '"' AS etag, first_value(size) OVER (PARTITION BY sha) AS linked_size, CASE WHEN substr(sha, 1, 1) < '8' THEN sha ELSE reverse(sha) END AS file_hash,
  repeat('0', 40) AS commit_oid, '/api/models/org/pages/read-token/main' AS refresh_route FROM files""",
    "parse_resolve_path": """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'dataset' WHEN 1 THEN 'model' WHEN 2 THEN 'space' END AS repo_type,
  CASE page_id % 6 WHEN 0 THEN 'o/n' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'alice/m' || CAST(page_id AS VARCHAR) WHEN 2 THEN 'o/s' || CAST(page_id AS VARCHAR) END AS repo_id,
  CASE page_id % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'refs' WHEN 2 THEN 'v1' END AS revision, CASE page_id % 6 WHEN 0 THEN 'data/x.parquet' WHEN 1 THEN 'pr/1/file.bin' WHEN 2 THEN 'a' END AS file FROM pages""",
    "parse_byte_range": f"""WITH d AS (SELECT doc_id, CAST(octet_length({BODY}) AS BIGINT) AS n, doc_id % 11 AS k FROM documents),
r AS (SELECT doc_id, n, k, CASE WHEN k IN (0, 8) THEN 0 WHEN k = 9 THEN 5 END AS lo, CASE WHEN k IN (0, 8) THEN 99 WHEN k = 9 THEN 9 END AS hi FROM d)
SELECT doc_id, CASE WHEN k = 1 THEN 'none' WHEN lo < n THEN 'ok' ELSE 'unsatisfiable' END AS status, CAST(CASE WHEN k = 1 THEN 0 WHEN lo < n THEN lo END AS BIGINT) AS start,
  CAST(CASE WHEN k = 1 THEN n - 1 WHEN lo < n THEN least(hi, n - 1) END AS BIGINT) AS stop FROM r""",
    "lfs_preupload": """SELECT CASE WHEN s = 0 THEN 'regular' ELSE 'lfs' END AS upload_mode, count(*) AS files, CAST(sum(s) AS BIGINT) AS size
FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 0 ELSE length(coalesce(text, '')) END AS s FROM documents) GROUP BY 1""",
    "lfs_batch": """SELECT source AS name, CASE WHEN min(doc_id) % 4 = 3 THEN 'bad_operation' WHEN count(*) > 4096 THEN 'too_many' WHEN min(doc_id) % 4 = 2 THEN 'bad_name' ELSE 'ok' END AS status,
  CASE WHEN min(doc_id) % 4 IN (2, 3) OR count(*) > 4096 THEN 0 ELSE count(*) END AS echoed FROM documents GROUP BY source""",
    "commit_files": """SELECT source || '/f' || CAST(doc_id % 50 AS VARCHAR) AS path, arg_max(sha256(CAST(doc_id AS VARCHAR)), doc_id) AS sha256_hex, arg_max(CAST(length(coalesce(text, '')) AS BIGINT), doc_id) AS size
FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 GROUP BY 1""",
    "dedup_lookup": f"""WITH {FIXED}, idx AS (SELECT hash, min(doc_id) AS shard FROM fixed JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY hash)
SELECT CASE WHEN d.source <> 'src0' THEN 'ok' ELSE 'unknown' END AS status, count(*) AS requests FROM (SELECT DISTINCT hash FROM fixed) LEFT JOIN idx USING (hash) LEFT JOIN documents d ON d.doc_id = shard GROUP BY 1""",
    "hash_hex_transform": f"WITH {HEXED} SELECT doc_id, t AS hex, CAST(('0x' || substr(t, 64, 1)) AS BIGINT) % 4 AS mod4, true AS back FROM hexed",
    "truncated_key_order": f"WITH {HEXED}, k AS (SELECT DISTINCT h, substr(t, 1, 16) AS key, n % 16 AS part FROM hexed) SELECT key, CAST(part AS BIGINT) AS part, rank() OVER (PARTITION BY part ORDER BY key) AS rank FROM k",
    "byte_grouping": f"""WITH b AS (SELECT doc_id, hex({BODY}) AS x, octet_length({BODY}) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS file_key, CAST(n AS BIGINT) AS length, sha256(unhex(array_to_string(list_transform(list_concat(range(0, n, 4), range(1, n, 4), range(2, n, 4), range(3, n, 4)), lambda i: substr(x, 2 * i + 1, 2)), ''))) AS grouped_sha256, true AS back FROM b""",
    "chunk_stream_decode": """SELECT CAST(doc_id // 4 AS VARCHAR) AS object_key, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) - 1 AS chunk_index, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS length
FROM documents WHERE length(text) > 0""",
    "shard_roundtrip": f"""WITH {TERMS} SELECT CAST(file % 16 AS VARCHAR) AS shard_key, count(*) AS terms, CAST(sum(unpacked) AS BIGINT) AS unpacked, CAST(sum(ce) AS BIGINT) AS chunk_ends, count(DISTINCT file) AS files FROM terms GROUP BY 1""",
    "rate_limit_decisions": """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
run AS (
  SELECT key, event_id, k, t, CAST(2.0 AS DOUBLE) AS level, true AS allowed FROM e WHERE k = 1
  UNION ALL
  SELECT n.key, n.event_id, n.k, n.t, CASE WHEN least(3.0, r.level + (n.t - r.t) * (1 / 43200.0)) >= 1 THEN least(3.0, r.level + (n.t - r.t) * (1 / 43200.0)) - 1 ELSE least(3.0, r.level + (n.t - r.t) * (1 / 43200.0)) END,
    least(3.0, r.level + (n.t - r.t) * (1 / 43200.0)) >= 1
  FROM run r JOIN e n ON n.key = r.key AND n.k = r.k + 1
)
SELECT key, event_id, allowed FROM run""",
    "ingest_objects": """SELECT o AS upload, CASE o % 5 WHEN 0 THEN 'inserted' WHEN 1 THEN 'hash_mismatch' WHEN 2 THEN 'malformed' WHEN 3 THEN 'bad_prefix' ELSE 'present' END AS status
FROM (SELECT CAST(doc_id // 4 AS BIGINT) AS o, string_agg(text, chr(0) ORDER BY doc_id) AS body FROM documents WHERE length(text) > 0 GROUP BY 1)""",
    "ingest_shards": f"WITH {TERMS} SELECT CAST(file % 16 AS BIGINT) AS upload, CASE WHEN file % 8 = 7 THEN 'malformed' ELSE 'ok' END AS status FROM terms GROUP BY 1, 2",
    "ingested_terms": f"""WITH {TERMS} SELECT sha256(CAST(file AS VARCHAR)) AS file, CAST(sum(unpacked) AS BIGINT) AS size, count(*) AS terms, CAST(max(ce) AS BIGINT) AS last_chunk, sha256(CAST(-file AS VARCHAR)) AS sha256
FROM terms WHERE file % 8 <> 7 GROUP BY file""",
    "ingested_chunk_index": f"WITH {TERMS} SELECT sha256(CAST(object % 100 AS VARCHAR)) AS chunk, CAST(min(file % 16) AS BIGINT) AS upload FROM terms WHERE file % 8 <> 7 GROUP BY 1",
    "decode_requests": """SELECT doc_id AS request, CASE WHEN doc_id % 7 IN (0, 4, 6) THEN 'ok' ELSE 'malformed' END AS status, CASE WHEN doc_id % 7 IN (0, 4, 6) THEN 'upload' END AS operation,
  CASE WHEN doc_id % 7 IN (0, 4, 6) THEN CAST(doc_id AS VARCHAR) END AS oid, CASE WHEN doc_id % 7 IN (0, 4, 6) THEN CAST(length(coalesce(text, '')) AS BIGINT) END AS size FROM documents""",
    "route_requests": """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'revision' WHEN 1 THEN 'tree' WHEN 2 THEN 'write-token' WHEN 3 THEN 'create' WHEN 4 THEN 'commit' END AS handler,
  CASE WHEN page_id % 8 IN (0, 1) THEN 'read' WHEN page_id % 8 IN (2, 3, 4) THEN 'write' END AS scope,
  CASE page_id % 8 WHEN 0 THEN 'model' WHEN 1 THEN 'dataset' WHEN 2 THEN 'space' WHEN 4 THEN 'model' END AS repo_type,
  CASE WHEN page_id % 8 IN (0, 1, 2, 4) THEN 'o/n' || CAST(page_id AS VARCHAR) END AS repo_id, CASE WHEN page_id % 8 IN (0, 1, 4) THEN 'main' WHEN page_id % 8 = 2 THEN 'v1' END AS revision,
  CASE WHEN page_id % 8 = 1 THEN 'a/b' WHEN page_id % 8 IN (0, 2, 4) THEN '' END AS path FROM pages""",
    "tree_pages": "SELECT CAST(doc_id // 50 AS BIGINT) AS page, 'f/' || CAST(doc_id AS VARCHAR) AS path, sha256(CAST(doc_id AS VARCHAR)) AS oid, doc_id AS size FROM documents WHERE doc_id % 10 <> 0",
    "token_records": """WITH issued AS (SELECT c_custkey AS minted, c_mktsegment AS repo_id, CAST(epoch(TIMESTAMP '2024-01-15') AS BIGINT) + 3600 - c_custkey * 60 AS expires FROM customer ORDER BY expires DESC LIMIT 100)
SELECT o_orderkey AS call, minted, repo_id, expires > CAST(epoch(TIMESTAMP '2024-01-15') AS BIGINT) + 60 AS usable FROM orders LEFT JOIN issued ON minted = o_custkey""",
    "recon_term_fetches": f"""WITH {TERMS} SELECT request, ord, count(*) OVER o AS fetches, CAST(min(cs * step) OVER o AS BIGINT) AS first_byte, min(cs * step) OVER o = 0 AS cited_from_start
FROM clipped WHERE request IN (SELECT request FROM good) WINDOW o AS (PARTITION BY request, object)""",
    "manifest_json": f"""SELECT substr(sha256(sha256({BODY})), 1, 32) AS file_id, CAST(octet_length({BODY}) AS BIGINT) AS size, sha256({BODY}) AS sha256, CAST(ceil(octet_length({BODY}) / 512.0) AS BIGINT) AS chunks,
  CASE WHEN octet_length({BODY}) = 0 THEN -1 ELSE CAST((octet_length({BODY}) - 1) // 512 * 512 AS BIGINT) END AS last_offset FROM documents""",
    "truncated_lookup": f"SELECT a.doc_id AS asked, b.doc_id AS found FROM documents a JOIN (SELECT sha256({BODY}) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1) b ON sha256(encode(coalesce(a.text, ''))) = b.h WHERE a.doc_id % 3 = 0",
    "forget_keys": f"WITH {USERS} SELECT DISTINCT CAST(key % 64 AS BIGINT) AS shard_hash FROM users WHERE key NOT IN (SELECT key FROM plan)",
    "chunk_boundaries": """SELECT CAST(doc_id // 4 AS VARCHAR) AS object_key, row_number() OVER w - 1 AS chunk_index, CAST(sum(octet_length(encode(text))) OVER w AS BIGINT) AS unpacked, true AS ends_where_scanned
FROM documents WHERE length(text) > 0 WINDOW w AS (PARTITION BY doc_id // 4 ORDER BY doc_id)""",
    "stored_footers": """SELECT CAST(doc_id // 4 AS VARCHAR) AS object_key, count(*) AS chunks, CAST(sum(octet_length(encode(text))) AS BIGINT) AS unpacked, true AS as_derived FROM documents WHERE length(text) > 0 GROUP BY 1""",
    "signed_requests": """SELECT page_id, '/a%20b/' || CAST(page_id AS VARCHAR) || '~/%C3%A9%2A' AS uri, 'b%20c=1%2F2&z=' || CAST(page_id AS VARCHAR) AS query, CASE WHEN page_id % 2 = 0 THEN 'env' ELSE 't' END AS token FROM pages""",
    "merkle_leaf_table": f"SELECT min(doc_id) AS first, count(*) AS copies FROM documents WHERE length(text) > 0 GROUP BY {BODY}",
    "request_parts": r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'http://x/n' END AS next, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE '' END AS token,
  '10.0.0.' || CAST(page_id % 250 AS VARCHAR) AS host, 'f' || CAST(page_id AS VARCHAR) AS file, CAST(page_id AS VARCHAR) AS etag, CASE WHEN page_id % 5 <> 0 THEN 'o/n' || CAST(page_id AS VARCHAR) END AS repo_id,
  CASE page_id % 3 WHEN 0 THEN 'o/n:models/o/n' WHEN 1 THEN 'datasets/o/n:datasets/o/n' ELSE 'spaces/o/n:spaces/o/n' END AS addresses,
  'https://cas.example/v1/xorbs/default/' || sha256(CAST(page_id AS VARCHAR)) AS object_url, CASE WHEN page_id % 2 = 0 THEN 'https://h:1' ELSE 'http://h:1' END AS base_url,
  CAST(CASE WHEN page_id % 10 < 4 THEN 5 - page_id % 10 ELSE 0 END AS BIGINT) AS wait, 'dataset' AS split_type, 'o/n' || CAST(page_id AS VARCHAR) || '/tree/main' AS split_path FROM pages""",
    "repositories": """WITH c AS (SELECT c_custkey AS k, 'n' || CAST(c_nationkey AS VARCHAR) AS n FROM customer),
repos AS (SELECT 'model' AS repo_type, 'o/' || n AS repo_id FROM c WHERE k % 3 = 0 UNION SELECT CASE WHEN k % 2 = 0 THEN 'model' ELSE 'dataset' END, CASE WHEN k % 4 = 0 THEN n ELSE 'o/' || n END FROM c)
SELECT repo_type, repo_id, 'main' AS revision, false AS empty FROM repos
UNION ALL SELECT * FROM (SELECT DISTINCT 'dataset' AS repo_type, 'o/' || n AS repo_id, CASE WHEN k % 3 = 0 THEN 'main' ELSE 'v1' END AS revision, true AS empty FROM c) b
WHERE revision <> 'main' OR NOT EXISTS (SELECT 1 FROM repos r WHERE r.repo_type = b.repo_type AND r.repo_id = b.repo_id)""",
    "index_snapshot": """WITH held AS (SELECT CAST(c_custkey AS BIGINT) AS key FROM customer WHERE c_custkey % 2 = 0),
new AS (SELECT CAST(o_custkey AS BIGINT) AS key, CAST(max(o_orderkey) AS BIGINT) AS high, CAST(min(o_orderkey) AS BIGINT) AS low FROM orders GROUP BY o_custkey)
SELECT key, coalesce(high, -1) AS last, CASE WHEN held.key IS NULL THEN low ELSE -1 END AS first FROM held FULL JOIN new USING (key)""",
}
