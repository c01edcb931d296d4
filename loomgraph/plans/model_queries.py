"""Queries of the steps that call models, with the offline stand-ins, whose rules SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import textops as X
from loomgraph.functions.embed import dot
from loomgraph.operators import models as D
from loomgraph.operators.context import report_inputs
from loomgraph.operators.tables import last_wins, summaries_due, vector_index
from loomgraph.plans.graph_queries import resolved
from loomgraph.plans.inputs import SQL_ITEMS, SQL_MEMBERS, items, members, sql_article, sql_embed, sql_graph, sql_key
from loomgraph.providers import embedder, generator
from loomgraph.session import materialize, table


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = last_wins(table(spark, d, "embeddings_checkpoint").select("id", "ord", "text"), "id", "ord")
    return D.extracted_mentions(materialize(D.extractions(c, generator), "extractions"))


def ext_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities extracted from all chunks with one round of gleaning."""
    return _extracted(spark, d)[0].select("chunk_id", F.col("ord").cast("bigint").alias("ord"), "name")


def ext_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations extracted from all chunks: how many per chunk, and their ends in order."""
    r = _extracted(spark, d)[1].groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source", "target"))).alias("a"))
    return r.select("chunk_id", F.size("a").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("a", lambda x: F.concat_ws(">", x["source"], x["target"])), "|")).alias("digest"))


def emb_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Two components of every chunk's vector, embedded in batches."""
    e = D.embedded(table(spark, d, "embeddings_checkpoint").select("ord", "text"), "text", "vec", embedder)
    return e.select("ord", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.element_at("vec", 16), 6).alias("last"))


def emb_index(spark: SparkSession, d: str) -> DataFrame:
    """Vector index of entity names on a cache of all relation sources: kept vectors, and those of new names."""
    cached = table(spark, d, "relation_mention").filter("source is not null").select(F.col("source").alias("text")).distinct()
    cache = D.embedded(cached.withColumn("key", X.vector_key("text")), "text", "vec", embedder).select("key", "vec", F.lit(True).alias("old"))
    names = table(spark, d, "entity_mention").filter("name is not null").select(F.col("name").alias("text")).distinct()
    return vector_index(names, materialize(cache, "cache"), lambda new: D.embedded(new, "text", "vec", embedder)).select("key", F.round(F.element_at("vec", 1), 6).alias("first"))


def _due(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "entity_mention").filter("name is not null").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("description")), " | ").alias("description"))
    n = materialize(n.select(F.col("name").alias("id"), F.col("name").alias("subject"), "description"), "items")
    none = spark.createDataFrame([], "id string, hash string")
    core = table(spark, d, "core_node").select(F.col("name").alias("id"), F.lit("stale").alias("hash"), F.lit("stale").alias("description"))
    known = summaries_due(n, none).join(table(spark, d, "graph_node").select(F.col("name").alias("id")).distinct(), "id", "left_semi")
    return n, known.select("id", "hash", F.concat(F.lit("cached "), "id").alias("description")).unionByName(core)


def sum_applied(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of all names after summarising: cached ones of the same hash, new ones, and those with nothing to summarise."""
    n, cache = _due(spark, d)
    cache = materialize(cache, "cache")
    new = materialize(D.summaries(n, cache, generator), "summaries")
    return D.summarised(n, cache.unionByName(new)).select("id", F.md5("description").alias("digest"))


def rep_texts(spark: SparkSession, d: str) -> DataFrame:
    """Reports written from the members and relations of all communities of the graph."""
    nodes, edges = resolved(spark, d)
    m = members(spark, d).join(nodes.select("key"), "key", "left_semi")
    r = D.community_reports(report_inputs(m, nodes, edges), generator)
    return r.select("community", "title", F.md5("summary").alias("summary_md5"))


def kw_seeds(spark: SparkSession, d: str) -> DataFrame:
    """How near the keyword vectors of every question are to its own."""
    s = D.seeded(items(spark, d), generator, embedder)
    return s.select("query_id", F.round(dot("local_vec", "query_vec"), 6).alias("local"), F.round(dot("global_vec", "query_vec"), 6).alias("global"))


def route_modes(spark: SparkSession, d: str) -> DataFrame:
    """Search mode per question."""
    return D.routed(items(spark, d), generator)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation items, answered from their last checkpoint article, or the first line that the search says when it finds none."""
    e = F.col("expected_behavior")
    i = table(spark, d, "gruth_dataset").select("id", "question", e["expected_response_elements"].alias("elements"), F.element_at(F.concat(F.array(F.lit("")), e["expected_articles"]), -1).alias("article"))
    c = last_wins(table(spark, d, "embeddings_checkpoint").select("id", "ord", "text"), "id", "ord").select(X.article_of("id").alias("article"), "ord", "text")
    c = c.filter("article is not null").groupBy("article").agg(F.min_by("text", "ord").alias("context"))
    routes = i.select(F.col("id").alias("query_id"), F.lit("local").alias("mode"))
    tool = D.tool_output(routes, i.join(c, "article").select(F.col("id").alias("query_id"), "context"), routes.select("query_id", F.lit("").alias("context")))
    asked = D.asked(i.join(tool.select(F.col("query_id").alias("id"), "context"), "id"), generator)
    return D.experiment(i.drop("article"), asked, generator)


def run_items(spark: SparkSession, d: str) -> DataFrame:
    """One run over all evaluation items: search, answer and the judge's scores."""
    return _runs(spark, d).select("id", F.md5("answer").alias("answer_md5"), "error", "chunks_used_correctly", "answers_question", "overall", F.round("coverage", 6).alias("coverage"))


def run_failures(spark: SparkSession, d: str) -> DataFrame:
    """Items and failed items of that run."""
    return D.failures(_runs(spark, d))


QUERIES = {f.__name__: f for f in (ext_entities, ext_relations, emb_chunks, emb_index, sum_applied, rep_texts, kw_seeds, route_modes, run_items, run_failures)}

_NAMES = "regexp_extract_all(text, '\\p{Lu}[\\p{L}\\p{N}]+(?: \\p{Lu}[\\p{L}\\p{N}]+)*')"
_LAST = "c AS (SELECT id, max(ord) AS ord, arg_max(text, ord) AS text FROM embeddings_checkpoint GROUP BY id)"
_EXT = f"""{_LAST}, m AS (SELECT id, unnest(x) AS name, unnest(range(1, len(x) + 1)) AS i FROM (SELECT id, {_NAMES} AS x FROM c WHERE text IS NOT NULL)),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k, count(*) OVER (PARTITION BY id) AS n FROM (SELECT id, name, min(i) AS i FROM m GROUP BY ALL)),
e AS (SELECT *, {sql_key('name')} AS key, k <= (n + 1) // 2 AS early FROM n)"""
_KW = "regexp_extract_all(query_text, '[\\p{L}\\p{N}_]+')"
_PICK = lambda p: f"array_to_string(list_filter({_KW}, lambda w: regexp_matches(w, '{p}')), ' ')"
_DUE = """g AS (SELECT name, list(DISTINCT description ORDER BY description) FILTER (description IS NOT NULL) AS a FROM entity_mention WHERE name IS NOT NULL GROUP BY name),
t AS (SELECT name, array_to_string(coalesce(a, []), ' | ') AS whole FROM g), s AS (SELECT *, list_filter(list_transform(string_split(whole, ' | '), lambda x: trim(x)), lambda x: x <> '') AS a FROM t)"""
SQL = {
    "ext_entities": f"""WITH {_EXT}, kept AS (SELECT * FROM e WHERE early UNION ALL SELECT l.* FROM e l WHERE NOT l.early AND NOT EXISTS (SELECT 1 FROM e x WHERE x.id = l.id AND x.key = l.key AND x.k < l.k))
SELECT id AS chunk_id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS ord, name FROM kept""",
    "ext_relations": f"""WITH {_EXT}, p AS (SELECT id, name AS source, key AS sk, k, n, lead(name) OVER w AS target, lead(key) OVER w AS tk FROM e WINDOW w AS (PARTITION BY id ORDER BY k)),
r AS (SELECT *, k < (n + 1) // 2 AS early FROM p WHERE target IS NOT NULL),
kept AS (SELECT * FROM r WHERE early UNION ALL SELECT l.* FROM r l WHERE NOT l.early AND NOT EXISTS (SELECT 1 FROM r x WHERE x.id = l.id AND x.sk = l.sk AND x.tk = l.tk AND x.k < l.k))
SELECT id AS chunk_id, count(*) AS n, md5(string_agg(source || '>' || target, '|' ORDER BY k)) AS digest FROM kept GROUP BY id""",
    "emb_chunks": f"SELECT ord, round(vec[1], 6) AS first, round(vec[16], 6) AS last FROM {sql_embed('SELECT ord, text FROM embeddings_checkpoint', 'text')}",
    "emb_index": f"SELECT sha1('gemini-embedding-001|768|RETRIEVAL_DOCUMENT|' || name) AS key, round(vec[1], 6) AS first FROM {sql_embed('SELECT DISTINCT name FROM entity_mention WHERE name IS NOT NULL', 'name')}",
    "sum_applied": f"""WITH {_DUE} SELECT name AS id, md5(CASE WHEN len(a) < 2 THEN whole WHEN name IN (SELECT name FROM graph_node) THEN 'cached ' || name ELSE a[1] || ' (+' || (least(20, len(a)) - 1) || ')' END) AS digest FROM s""",
    "rep_texts": f"""WITH {sql_graph(vectors=False)}, {SQL_MEMBERS}, mem AS (SELECT community, key FROM member WHERE key IN (SELECT key FROM node)), deg AS (SELECT key, count(*) AS degree FROM (SELECT src AS key FROM edge UNION ALL SELECT tgt FROM edge) GROUP BY key),
rk AS (SELECT community, key, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, key) AS rank FROM mem LEFT JOIN deg USING (key)),
body AS (SELECT community, string_agg('- ' || name || ' (' || coalesce(type, '') || '): ' || substr(description, 1, 200), chr(10) ORDER BY rank) AS t FROM rk JOIN node USING (key) WHERE rank <= 40 GROUP BY community),
ln AS (SELECT community, list_transform(string_split(t, chr(10)), lambda x: substr(x, 3)) AS a FROM body)
SELECT community, array_to_string(list_transform(a[1:3], lambda x: string_split(x, ' (')[1]), ', ') AS title, md5(array_to_string(a[1:5], ' ')) AS summary_md5 FROM ln""",
    "kw_seeds": f"""WITH {SQL_ITEMS}, k AS (SELECT *, {_PICK(chr(92) + 'A' + chr(92) + 'p{Lu}')} AS lt, {_PICK(chr(92) + 'A' + chr(92) + 'p{Ll}.{6}')} AS gt FROM item),
l AS (SELECT query_id, vec AS lv FROM {sql_embed('SELECT query_id, lt FROM k', 'lt')}), g AS (SELECT query_id, vec AS gv FROM {sql_embed('SELECT query_id, gt FROM k', 'gt')})
SELECT query_id, round(list_dot_product(coalesce(lv, query_vec), query_vec), 6) AS local, round(list_dot_product(coalesce(gv, query_vec), query_vec), 6) AS global FROM item JOIN l USING (query_id) JOIN g USING (query_id)""",
    "route_modes": "SELECT id AS query_id, CASE WHEN regexp_matches(question, '(?i)ümumi|bütün|overall|обзор|genel') THEN 'global' ELSE 'local' END AS mode FROM gruth_dataset",
    "run_items": f"""WITH {_LAST}, art AS (SELECT article, arg_min(text, ord) AS context FROM (SELECT {sql_article('id')} AS article, ord, text FROM c) WHERE article IS NOT NULL GROUP BY article),
i AS (SELECT id, expected_behavior.expected_response_elements AS el, coalesce(expected_behavior.expected_articles[-1], '') AS article FROM gruth_dataset),
a AS (SELECT id, el, string_split(coalesce(nullif(context, ''), '{D.NO_ARTICLE}'), chr(10))[1] AS answer FROM i LEFT JOIN art USING (article))
SELECT id, md5(answer) AS answer_md5, CAST(NULL AS VARCHAR) AS error, CASE WHEN answer <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS chunks_used_correctly, CASE WHEN answer <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS answers_question,
CASE WHEN answer <> '' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS overall, CASE WHEN len(el) > 0 THEN round(len(list_filter(el, lambda x: contains(answer, x))) / len(el), 6) END AS coverage FROM a""",
    "run_failures": "SELECT count(*) AS n_items, CAST(0 AS BIGINT) AS n_failed FROM gruth_dataset",
}
