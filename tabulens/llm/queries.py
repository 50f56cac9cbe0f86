"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def bpe_digests(rows: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded rows, and ``more`` of their columns."""
    return rows.select(
        "doc_id",
        *more,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op3_bpe_automaton")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from . import bpe_automaton

    docs = table(spark, folder, "documents", "doc_id", "text")
    return bpe_digests(bpe_automaton.encode(docs, public_tokenizers.path("word_bpe_49k.json")))


@query("op9_simhash_groups")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from . import simhash_index

    rows = simhash_index.groups(table(spark, folder, "documents", "doc_id", "text"))
    return rows.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query(
    "op2_decontamination",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM iw))),
hit AS (SELECT DISTINCT doc_id, p, dw.size, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from . import decontam

    docs = table(spark, folder, "documents", "doc_id", "text")
    rows = decontam.contamination(docs, table(spark, folder, "benchmark", "item_id", "text"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_id_store")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from . import id_store
    from .common import shared_folder

    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents", "doc_id", "text")
    id_store.write_packs(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    rows = id_store.read_packs(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("data").alias("ids_crc32"))


@query("op5_hash_ring")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from . import hash_ring

    docs = table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = hash_ring.sharded(docs, [F.col("doc_id"), F.col("text_crc32")], 24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op8_chat_format",
    r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, role || text AS joined, CAST(length(replace(replace(replace(replace(replace(role, '&', '&amp;'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]'), '<s>', '&#60;s>'), '</s>', '&#60;/s>'))
    + length(replace(replace(replace(replace(replace(text, '&', '&amp;'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]'), '<s>', '&#60;s>'), '</s>', '&#60;/s>')) AS BIGINT) AS safe,
  regexp_matches(role, '\[/?INST\]|</?s>') OR regexp_matches(text, '\[/?INST\]|</?s>')
    OR regexp_matches(role, '&(amp;|#91;/?INST\]|#60;/?s>)') OR regexp_matches(text, '&(amp;|#91;/?INST\]|#60;/?s>)') AS conflict FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(19 + CASE WHEN conflict THEN safe ELSE length(joined) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from . import chat_format

    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text").unionByName(planted)
    back = chat_format.read_back(chat_format.format_conversations(rows))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query(
    "op10_mtree_topk",
    """WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from . import mtree

    return mtree.top_k(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from . import lang_id

    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    rows = lang_id.predictions(docs, lang_id.fit(docs))
    return rows.select("doc_id", (~lang_id.trained_on(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


@query("op6_html_main_text")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from . import html_main

    pages = table(spark, folder, "pages", "page_id", "url", "html")
    rows = html_main.extract(pages, html_main.learned_weights(pages))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op1_lm_score")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from . import lm_score

    return lm_score.score(table(spark, folder, "documents", "doc_id", "text"))


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from . import token_align

    docs = table(spark, folder, "documents", "doc_id", "text")
    rows = token_align.alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumnRenamed("id", "doc_id")


@query(
    "op12_term_pipeline",
    r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS l FROM d),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, size GROUP BY 1),
gain AS (SELECT tf.r, tf.term, wt.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * n) // l))) AS g FROM tf JOIN d ON d.r = tf.r JOIN wt ON wt.term = tf.term, size),
s AS (SELECT item_id, r, CAST(sum(times * g) AS BIGINT) AS score FROM q JOIN gain ON q.term = gain.term GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s JOIN d ON d.r = s.r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from . import term_pipeline

    docs = table(spark, folder, "documents", "doc_id", "text")
    return term_pipeline.search(docs, table(spark, folder, "benchmark", "item_id", "text"))


#: The rules that op13 applies to the pages: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query(
    "op13_redirect_rules",
    r"""WITH RECURSIVE located AS (SELECT page_id, coalesce(url, '') AS url, html, strpos(coalesce(url, ''), '://') AS p FROM pages),
parts AS (SELECT page_id, url, html, CASE WHEN p > 0 THEN translate(regexp_extract(substr(url, p + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN p > 0 THEN regexp_extract(substr(url, p + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
  CASE WHEN p > 0 THEN lower(substr(url, 1, p + 2)) END AS scheme, CASE WHEN p > 0 THEN regexp_extract(substr(url, p + 3), '^[^/?#]*([^#]*)', 1) END AS tail FROM located),
keyed AS (SELECT *, scheme || host || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END AS page FROM parts),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(verdict, rhost, rpath)),
tags AS (SELECT page, scheme, host, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM keyed WHERE page IS NOT NULL),
hrefs AS (SELECT page, scheme, host, CASE WHEN regexp_matches(tag, '(?i)rel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) END AS href FROM tags),
edges AS (SELECT DISTINCT page AS a, regexp_replace(CASE WHEN starts_with(href, '/') THEN scheme || host || href ELSE href END, '#.*$', '') AS b FROM hrefs WHERE href <> ''),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
linked AS (SELECT DISTINCT a AS page, regexp_extract(a, '://([^/?#]*)', 1) AS host, regexp_extract(a, '://[^/?#]*([^?#]*)', 1) AS path FROM ways),
own AS (SELECT page, arg_max(verdict, len(rhost || rpath)) AS verdict FROM linked JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page),
spread AS (SELECT r.a AS page, min(o.verdict) AS verdict FROM reach r JOIN own o ON r.b = o.page GROUP BY 1),
ruled AS (SELECT page_id, host, path, page, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(verdict, len(rhost || rpath)) AS verdict
  FROM keyed LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(ruled.verdict, spread.verdict, 'allow') AS verdict FROM ruled LEFT JOIN spread ON ruled.page = spread.page""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from . import url_rules

    pages = table(spark, folder, "pages", "page_id", "url", "html")
    return url_rules.verdicts(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")
