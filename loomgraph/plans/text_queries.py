"""Queries of the string and segmentation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import textops as T
from loomgraph.operators import chunking as C
from loomgraph.plans.inputs import sql_article, sql_clip, sql_key, sql_lower, sql_tokens
from loomgraph.session import table


def txt_name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Both keys of every distinct source name."""
    n = table(spark, d, "relation_mention").select(F.col("source").alias("name")).filter("name is not null").distinct()
    return n.select("name", T.name_key_az("name").alias("key_az"), T.name_key_plain("name").alias("key_plain"))


def txt_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document, as a number and a digest."""
    t = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def txt_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clipped forms of every document."""
    return table(spark, d, "documents").select(
        "doc_id", T.clip_words("text", 600).alias("clip_600"), T.clip_words("text", 400).alias("clip_400"), T.clip_hard("text", 150).alias("hard_150"), T.short_title("text").alias("title"), T.truncate("text").alias("log_line")
    )


def txt_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels and articles of chunk ids."""
    ids = table(spark, d, "embeddings_checkpoint").select("id").unionByName(table(spark, d, "entity_mention").select(F.col("chunk_id").alias("id"))).distinct()
    return ids.select("id", T.chunk_label("id").alias("label"), T.article_of("id").alias("article"), T.article_order(T.article_of("id")).alias("article_order"))


def txt_source_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Article suffixes of registry entries; repeated rows once."""
    return table(spark, d, "graph_node").select("id", "registered_at", T.source_suffix(F.col("source_chunks")).alias("suffix")).distinct()


def txt_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Namespaces and namespaced ids of entity names."""
    n = table(spark, d, "entity_mention").select("name").filter("name is not null").distinct()
    return n.select("name", T.slug("name").alias("slug"), F.concat(T.slug("name"), F.lit("__madde_1")).alias("chunk_id"))


def txt_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Content keys, summary hashes and token estimates."""
    return table(spark, d, "documents").select("doc_id", T.vector_key("text").alias("vector_key"), T.summary_hash("source", F.array(F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))).alias("summary_hash"), T.token_estimate("text").alias("n_estimated"))


def txt_masks(spark: SparkSession, d: str) -> DataFrame:
    """Masked names."""
    return table(spark, d, "customer").select("c_custkey", T.mask_key("c_name").alias("masked"))


def txt_errors(spark: SparkSession, d: str) -> DataFrame:
    """What error messages made of events ask for."""
    m = F.concat("event_type", F.lit(' retryDelay: "'), F.col("event_id") % 50, F.lit('.5s" requests per_'), F.when(F.col("event_id") % 2 == 0, "day").otherwise("minute"))
    return table(spark, d, "events").select("event_id", T.retry_delay(m).alias("delay"), T.is_daily_quota(m).alias("daily"))


def txt_content(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks of messages made of events."""
    block = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).alias("text"))
    blocks = F.array(block("text", "event_type"), block("image", "event_type"), block("text", "props"))
    return table(spark, d, "events").select("event_id", T.flatten_content(blocks).alias("lines"), T.flatten_content(blocks, " ").alias("spaced"))


def chunk_headers(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut at article headers."""
    h = C.split_headers(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return h.select("doc_id", "header", "body")


def chunk_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Numbered clauses of checkpoint texts; a text without numbers is one."""
    return table(spark, d, "embeddings_checkpoint").select("ord", F.posexplode(C.clauses(F.col("text"))).alias("pos", "clause")).select("ord", F.col("pos").cast("bigint").alias("pos"), "clause")


def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of checkpoint texts."""
    return table(spark, d, "embeddings_checkpoint").select("ord", F.posexplode(C.sentences(F.col("text"))).alias("pos", "sentence")).select("ord", F.col("pos").cast("bigint").alias("pos"), "sentence")


def chunk_articles(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of all documents."""
    return C.chunk_articles(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "id", "text", F.length("text").alias("n_chars"))


def chunk_whole(spark: SparkSession, d: str) -> DataFrame:
    """Preambles and articles that are one chunk."""
    return chunk_articles(spark, d).filter(~F.col("id").rlike("_p[0-9]+$")).select("doc_id", "id", "text")


QUERIES = {f.__name__: f for f in (txt_name_keys, txt_tokens, txt_clips, txt_labels, txt_source_suffix, txt_slugs, txt_hashes, txt_masks, txt_errors, txt_content, chunk_headers, chunk_clauses, chunk_sentences, chunk_articles, chunk_whole)}

_WS = "[\\s\\p{Z}]+"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"
_ONE_LINE = f"replace({_STRIP('text')}, chr(10), ' ')"
_H = "(?i)Maddə\\s+\\d+[.\\-–]"
_HEADERS = f"""parts AS (SELECT doc_id, regexp_split_to_array(text, '{_H}') AS b, regexp_extract_all(text, '{_H}') AS h FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, CASE WHEN i > 1 THEN {_STRIP('h[i - 1]')} END AS header, {_STRIP('b[i]')} AS body FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM parts)),
head AS (SELECT * FROM cut WHERE header IS NOT NULL OR body <> '')"""
_P = "^(?:.*__)?(madde_(\\d+)|preambula)(?:_p(\\d+))?$"
_ORDER = lambda x: f"CASE WHEN {x} = 'Preambula' THEN 0 ELSE CAST(regexp_extract({x}, '(\\d+)$', 1) AS BIGINT) END"
SQL = {
    "txt_name_keys": f"SELECT DISTINCT source AS name, {sql_key('source')} AS key_az, {sql_key('source', 'entity')} AS key_plain FROM relation_mention WHERE source IS NOT NULL",
    "txt_tokens": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)",
    "txt_clips": f"""SELECT doc_id, {sql_clip('text', 600)} AS clip_600, {sql_clip('text', 400)} AS clip_400, substr(text, 1, 150) AS hard_150,
CASE WHEN length({_ONE_LINE}) <= 40 THEN {_ONE_LINE} ELSE substr({_ONE_LINE}, 1, 39) || '…' END AS title, CASE WHEN length({_ONE_LINE}) <= 200 THEN {_ONE_LINE} ELSE substr({_ONE_LINE}, 1, 200) || '…' END AS log_line FROM documents""",
    "txt_labels": f"""SELECT id, CASE WHEN a IS NULL THEN id WHEN regexp_extract(id, '{_P}', 3) = '' THEN a ELSE a || ', hissə ' || regexp_extract(id, '{_P}', 3) END AS label, a AS article,
CASE WHEN a = 'Preambula' THEN 0 WHEN a IS NOT NULL THEN CAST(regexp_extract(a, '(\\d+)$', 1) AS BIGINT) END AS article_order FROM (SELECT id, {sql_article('id')} AS a FROM (SELECT id FROM embeddings_checkpoint UNION SELECT chunk_id FROM entity_mention))""",
    "txt_source_suffix": f"""WITH n AS (SELECT DISTINCT id, registered_at, source_chunks FROM graph_node), l AS (SELECT DISTINCT id, registered_at, {sql_article('c')} AS a FROM (SELECT id, registered_at, unnest(source_chunks) AS c FROM n)),
g AS (SELECT id, registered_at, count(*) AS k, string_agg(a, ', ' ORDER BY {_ORDER('a')}) AS s FROM l WHERE a IS NOT NULL GROUP BY ALL)
SELECT DISTINCT n.id, n.registered_at, CASE WHEN k BETWEEN 1 AND 3 THEN ' [' || s || ']' ELSE '' END AS suffix FROM n LEFT JOIN g ON n.id = g.id AND n.registered_at IS NOT DISTINCT FROM g.registered_at""",
    "txt_slugs": """SELECT name, CASE WHEN s = '' THEN 'doc' ELSE s END AS slug, CASE WHEN s = '' THEN 'doc' ELSE s END || '__madde_1' AS chunk_id FROM (
SELECT name, lower(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS s FROM (SELECT DISTINCT name FROM entity_mention WHERE name IS NOT NULL))""",
    "txt_hashes": """SELECT doc_id, sha1('gemini-embedding-001|768|RETRIEVAL_DOCUMENT|' || text) AS vector_key, substr(md5('["' || source || '", "' || coalesce(lang, '') || '", "' || doc_id || '"]'), 1, 12) AS summary_hash, greatest(1, length(text) // 4) AS n_estimated FROM documents""",
    "txt_masks": "SELECT c_custkey, CASE WHEN length(c_name) <= 10 THEN '***' ELSE substr(c_name, 1, 6) || '...' || right(c_name, 4) END AS masked FROM customer",
    "txt_errors": "SELECT event_id, event_id % 50 + 0.5::DOUBLE AS delay, event_id % 2 = 0 AS daily FROM events",
    "txt_content": "SELECT event_id, event_type || chr(10) || props AS lines, event_type || ' ' || props AS spaced FROM events",
    "chunk_headers": f"WITH {_HEADERS} SELECT * FROM head",
    "chunk_whole": f"""WITH {_HEADERS}, f AS (SELECT doc_id, CASE WHEN header IS NULL THEN 'preambula' ELSE 'madde_' || regexp_extract(header, '(\\d+)', 1) END AS id, header, CASE WHEN header IS NULL THEN body ELSE {_STRIP("header || ' ' || body")} END AS text FROM head)
SELECT doc_id, id, text FROM f WHERE header IS NULL OR length(text) <= 1500""",
    "chunk_clauses": f"""WITH p AS (SELECT ord, text, string_split(regexp_replace(text, '(?m)^([IVXLCDM]{{1,6}}\\.[\\s\\p{{Z}}])', chr(1) || '\\1', 'g'), chr(1)) AS a FROM embeddings_checkpoint WHERE text IS NOT NULL)
SELECT ord, CAST(i AS BIGINT) AS pos, {_STRIP('c')} AS clause FROM (SELECT ord, unnest(CASE WHEN len(a) > 1 THEN a[2:] WHEN {_STRIP('text')} = '' THEN [] ELSE [text] END) AS c, unnest(range(0, CASE WHEN len(a) > 1 THEN len(a) - 1 WHEN {_STRIP('text')} = '' THEN 0 ELSE 1 END)) AS i FROM p)""",
    "chunk_sentences": f"""WITH p AS (SELECT ord, list_filter(string_split(regexp_replace(text, '([.!?])[\\s\\p{{Z}}]+([A-ZƏÖÜŞÇĞİ0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {_STRIP('x')} <> '') AS a FROM embeddings_checkpoint WHERE text IS NOT NULL)
SELECT ord, CAST(unnest(range(0, len(a))) AS BIGINT) AS pos, unnest(a) AS sentence FROM p""",
}
