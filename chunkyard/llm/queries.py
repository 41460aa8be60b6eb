"""The registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard.llm import chat, exact_dedup, html_text, licenses, mixing, near_dedup, packing, token_files, topk, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD_BPE_SIZE = 49_408


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    packing_of = packing.pack(docs, WORD_BPE, end_id, capacity)
    rows = packing_of.pieces.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "task", "rank")
    return packing_of.place(rows.withColumn("length", F.col("length").cast("int"))).select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat.digests(chat.format_windows(turns.unionByName(extra)))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "source", "lang", "copy", "mix_key", "text")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2, vocab_size=WORD_BPE_SIZE)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels), "score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_chat_formatting,
        op3_license_scans,
        op4_poisson_mixing,
        op5_html_extraction,
        op6_exact_topk,
        op7_minhash_near_dedup,
        op8_exact_dedup,
        op9_token_files,
        op10_toxicity,
    )
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ESCAPED = r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"""

_CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 4 + len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) + len(regexp_extract_all(role, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS tokens,
    26 - 6 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) AS shown
  FROM turns
), leads AS (
  SELECT conv_id, CASE WHEN arg_role = 'system' THEN arg_tokens ELSE 0 END AS lead_tokens, arg_tokens FROM (
    SELECT conv_id, role AS arg_role, tokens AS arg_tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM sized) WHERE k = 1
), strided AS (SELECT s.*, greatest(128, (832 - lead_tokens) // 2) AS stride, CAST(arg_tokens > greatest(128, (832 - lead_tokens) // 2) AS INT) AS long_opening FROM sized s JOIN leads l ON s.conv_id IS NOT DISTINCT FROM l.conv_id
), marked AS (SELECT *, CAST(tokens > stride AS INT) AS is_long FROM strided
), summed AS (
  SELECT *, coalesce(sum(tokens) OVER w, 0) AS before, coalesce(sum(is_long) OVER w, 0) AS longs FROM marked
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), dealt AS (SELECT *, before // stride + 2 * longs + is_long - long_opening AS win FROM summed
), ended AS (SELECT *, max(before + tokens) OVER (PARTITION BY conv_id, win) AS ends, sum(tokens) OVER (PARTITION BY conv_id) AS total FROM dealt
), chars AS (
  SELECT conv_id, sum(shown * CASE WHEN ends < total AND ends - before <= 192 AND NOT (before = 0 AND role = 'system') THEN 2 ELSE 1 END) AS own,
    (count(DISTINCT win) - 1) * coalesce(max(CASE WHEN before = 0 AND role = 'system' THEN shown END), 0) AS lead,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY before)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY before) FILTER (WHERE role = 'assistant'), '') AS target
  FROM ended GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(target) AS BIGINT) AS loss_chars, sha256(target) AS loss_sha256, CAST(own + lead AS BIGINT) AS formatted_chars FROM chars
"""


def _license_sql() -> str:
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.TEMPLATES.items())
    words = r"list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    shingles = "SELECT {0}, i, array_to_string(w[i : i + 4], ' ') AS shingle FROM {1}, unnest(range(1, len(w) - 3)) AS r(i)"
    return f"""
WITH templates(license, body) AS (VALUES {rows}),
tw AS (SELECT license, {words.format("body")} AS w FROM templates),
ts AS (SELECT DISTINCT license, shingle FROM ({shingles.format("license", "tw")})),
sizes AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
dw AS (SELECT row_number() OVER () AS r, doc_id, {words.format("text")} AS w FROM documents),
ds AS (SELECT r, doc_id, shingle, min(i) AS i FROM (SELECT r, doc_id, i, array_to_string(w[i : i + 4], ' ') AS shingle FROM dw, unnest(range(1, len(w) - 3)) AS x(i)) GROUP BY r, doc_id, shingle),
pairs(short, long) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.KEPT_APART.items())}),
own AS (SELECT short, long, shingle FROM pairs JOIN ts ON license = long WHERE NOT EXISTS (SELECT 1 FROM ts t WHERE t.license = short AND t.shingle = ts.shingle)),
clause AS (SELECT r, short, long, count(*) * 2 >= any_value(n) AS has FROM ds JOIN own USING (shingle) JOIN (SELECT long, count(*) AS n FROM own GROUP BY long) USING (long) GROUP BY r, short, long),
found AS (SELECT r, doc_id, license, CAST(count(*) AS BIGINT) AS n_matched, CAST(any_value(n) AS BIGINT) AS n_template, CAST(min(i) - 1 AS BIGINT) AS first_word
  FROM ds JOIN ts USING (shingle) JOIN sizes USING (license) GROUP BY r, doc_id, license HAVING count(*) * 100 >= any_value(n) * {licenses.PERCENT})
SELECT doc_id, license, n_matched, n_template, first_word FROM found f
WHERE NOT EXISTS (SELECT 1 FROM clause c WHERE c.r = f.r AND c.short = f.license AND c.has)
  AND (license NOT IN (SELECT long FROM pairs) OR EXISTS (SELECT 1 FROM clause c WHERE c.r = f.r AND c.long = f.license AND c.has))
"""


#: {0}: the table. Mass, weights and draws of mixing.mix with its defaults.
MIX_SQL = """
mass AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS mass FROM {0} GROUP BY source),
rated AS (SELECT source, CASE WHEN mass = 0 THEN 1.0 ELSE pow(mass, 0.5) / (SELECT sum(pow(mass, 0.5)) FROM mass) * (SELECT sum(mass) FROM mass) / mass END AS rate FROM mass),
parted AS (SELECT source, CAST(greatest(ceil(rate / 16.0), 1) AS INT) AS parts, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM rated),
terms AS (SELECT source, parts, k, exp(-mean + k * ln(CASE WHEN mean > 0 THEN mean ELSE 1 END) - lgamma(k + 1)) * CASE WHEN mean > 0 OR k = 0 THEN 1 ELSE 0 END AS p FROM parted, range(0, 81) AS t(k)),
cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
listed AS (SELECT source, any_value(parts) AS parts, list(c) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda c: c <= CAST(('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(j AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0)))) AS n
  FROM {0} d JOIN listed l ON d.source IS NOT DISTINCT FROM l.source
)"""

ORACLE_SQL = {
    "op2_chat_formatting": _CHAT_SQL,
    "op3_license_scans": _license_sql(),
    "op4_poisson_mixing": "WITH "
    + MIX_SQL.format("documents")
    + """
SELECT doc_id, source, lang, CAST(copy AS INT) AS copy, md5('11#' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '#' || CAST(copy AS VARCHAR)) AS mix_key, text
FROM drawn, unnest(range(1, CAST(n AS BIGINT) + 1)) AS c(copy)""",
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (SELECT u AS doc_id, min(v) AS low FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op8_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256 FROM t""",
}
