"""The tables that queries start from: chunks, query items, graph and reports; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import embed as E
from loomgraph.functions.textops import edge_text, entity_text, report_text
from loomgraph.operators import graph as G
from loomgraph.operators.context import community_articles, member_ranks
from loomgraph.operators.tables import last_wins
from loomgraph.session import materialize, table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """(``id``, ``ord``, ``text``, ``vec``): checkpoint rows as last written, vectors at unit length."""
    c = last_wins(table(spark, d, "embeddings_checkpoint").select("id", "ord", "text", "embedding"), "id", "ord")
    return E.with_unit(c, "embedding", "vec").drop("embedding")


def items(spark: SparkSession, d: str) -> DataFrame:
    """(``query_id``, ``query_text``, ``query_vec``): the evaluation questions as queries."""
    return E.with_embedding(table(spark, d, "gruth_dataset").select(F.col("id").alias("query_id"), F.col("question").alias("query_text")), "query_text", "query_vec")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Entity mentions in the order they were stored."""
    return table(spark, d, "entity_mention").select("chunk_id", F.col("mention_id").alias("ord"), "name", "type", "description")


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Relation mentions in the order they were stored."""
    return table(spark, d, "relation_mention").select("chunk_id", F.col("rel_id").alias("ord"), "source", "target", "relation", "strength")


def graph(spark: SparkSession, d: str, variant: str = "community") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with their vectors."""
    nodes = G.resolve_entities(mentions(spark, d), variant)
    nodes = materialize(E.with_embedding(nodes, entity_text(F.col("name"), F.coalesce("type", F.lit("")), F.col("description"))), "nodes")
    edges = G.aggregate_edges(relations(spark, d), nodes, variant)
    names = nodes.select("key", "name")
    named = edges.join(names.withColumnsRenamed({"key": "src", "name": "_s"}), "src").join(names.withColumnsRenamed({"key": "tgt", "name": "_t"}), "tgt")
    return nodes, materialize(E.with_embedding(named, edge_text(F.col("_s"), F.col("_t"), F.col("description"))).drop("_s", "_t"), "edges")


def communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities by their current rows."""
    return last_wins(table(spark, d, "communities"), "id", "ord")


def members(spark: SparkSession, d: str) -> DataFrame:
    """(``community``, ``key``): registry keys of the lowest communities."""
    return communities(spark, d).select(F.col("id").alias("community"), F.explode("members").alias("key")).distinct()


def reports(spark: SparkSession, d: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``community``, ``title``, ``summary``, ``size``, ``entity_keys``, ``articles``, ``vec``): extractive reports of communities whose members the graph has.

    The title names the three members of highest degree, the summary describes the first five.
    """
    m = members(spark, d).join(nodes.select("key"), "key", "left_semi")
    top = member_ranks(m, edges, most=5).join(nodes.select("key", "name", "description"), "key")
    per = top.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "description"))).alias("a"))
    per = per.select(
        "community", F.array_join(F.transform(F.slice("a", 1, 3), lambda x: x["name"]), ", ").alias("title"),
        F.array_join(F.transform("a", lambda x: F.concat(x["name"], F.lit(": "), F.substring(x["description"], 1, 100))), " ").alias("summary"),
    )
    size = m.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("key")).alias("entity_keys"))
    out = per.join(size, "community").join(community_articles(m, nodes), "community", "left")
    return E.with_embedding(out.withColumn("articles", F.coalesce("articles", F.array().cast("array<string>"))), report_text(F.col("title"), F.col("summary")))


def sql_lower(x: str) -> str:
    """Lower case as Unicode has it, in which İ becomes two characters."""
    return f"lower(replace({x}, 'İ', 'i̇'))"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def sql_key(x: str, variant: str = "community") -> str:
    return sql_squeeze(f"lower(translate(nfc_normalize({x}), 'İI', 'iı'))") if variant == "community" else sql_squeeze(sql_lower(x))


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({sql_lower(x)}, '[\\p{{L}}\\p{{N}}_]+')"


def sql_clip(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substr({x}, 1, {n}), '(?s) [^ ]*$', '') END"


def sql_unit(v: str) -> str:
    return f"(SELECT CASE WHEN n > 0 THEN list_transform(l, lambda x: x / n) END FROM (SELECT l, sqrt(list_sum(list_transform(l, lambda x: x * x))) AS n FROM (SELECT CAST({v} AS DOUBLE[]) AS l)))"


def sql_embed(table_sql: str, text: str, out: str = "vec", dim: int = E.DIM) -> str:
    """The table with a vector column, as a subquery."""
    comps = ", ".join(f"list_sum(list_transform(_h, lambda h: instr('0123456789abcdef', substr(h, {j + 1}, 1)) - 8.5))" for j in range(dim))
    inner = f"SELECT *, list_transform({sql_tokens(text)}, lambda t: md5(t)) AS _h FROM ({table_sql})"
    return f"(SELECT * EXCLUDE (_h, _v, _n), CASE WHEN _n > 0 THEN list_transform(_v, lambda x: x / _n) END AS {out} FROM (SELECT *, sqrt(list_sum(list_transform(_v, lambda x: x * x))) AS _n FROM (SELECT *, CAST([{comps}] AS DOUBLE[]) AS _v FROM ({inner}))))"


def sql_article(x: str) -> str:
    p = "^(?:.*__)?(madde_(\\d+)|preambula)(?:_p(\\d+))?$"
    return f"CASE WHEN NOT regexp_matches({x}, '{p}') THEN NULL WHEN regexp_extract({x}, '{p}', 2) = '' THEN 'Preambula' ELSE 'Maddə ' || regexp_extract({x}, '{p}', 2) END"


SQL_CHUNKS = """chunk AS (SELECT id, ord, text, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) END AS vec FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
SELECT id, max(ord) AS ord, arg_max(text, ord) AS text, CAST(arg_max(struct_pack(e := embedding), ord).e AS DOUBLE[]) AS v FROM embeddings_checkpoint GROUP BY id)))"""
SQL_ITEMS = f"item AS (SELECT * FROM {sql_embed('SELECT id AS query_id, question AS query_text FROM gruth_dataset', 'query_text', 'query_vec')})"


def sql_graph(variant: str = "community", vectors: bool = True) -> str:
    """CTEs ``node`` and ``edge``."""
    key = lambda x: sql_key(x, variant)
    if variant == "community":
        pick = """nname AS (SELECT key, name FROM (SELECT key, name, count(*) AS n, min(o) AS o FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, o) = 1),
ntype AS (SELECT key, type FROM (SELECT key, type, count(*) AS n, min(o) AS o FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY type IS NULL, n DESC, o) = 1)"""
    else:
        pick = """nname AS (SELECT key, name FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY o) = 1), ntype AS (SELECT key, type FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY o) = 1)"""
    node = f"""m AS (SELECT * FROM (SELECT mention_id AS o, chunk_id, name, type, description, {key('name')} AS key FROM entity_mention WHERE name IS NOT NULL) WHERE key <> ''), {pick},
ndesc AS (SELECT key, string_agg(description, ' | ' ORDER BY o) AS d FROM (SELECT key, description, min(o) AS o FROM m WHERE description IS NOT NULL GROUP BY ALL) GROUP BY key),
nchunk AS (SELECT key, list(chunk_id ORDER BY o) AS c FROM (SELECT key, chunk_id, min(o) AS o FROM m WHERE chunk_id IS NOT NULL GROUP BY ALL) GROUP BY key),
node0 AS (SELECT key, name, type, coalesce(d, '') AS description, coalesce(c, []) AS source_chunks, o AS ord FROM (SELECT key, min(o) AS o FROM m GROUP BY key) JOIN nname USING (key) JOIN ntype USING (key) LEFT JOIN ndesc USING (key) LEFT JOIN nchunk USING (key))"""
    loop = "AND src <> tgt" if variant == "community" else ""
    edge = f"""r AS (SELECT * FROM (SELECT rel_id AS o, chunk_id, relation, strength, {key('source')} AS src, {key('target')} AS tgt FROM relation_mention WHERE source IS NOT NULL AND target IS NOT NULL) WHERE src IN (SELECT key FROM node0) AND tgt IN (SELECT key FROM node0) {loop}),
edesc AS (SELECT src, tgt, string_agg(relation, ' | ' ORDER BY o) AS d FROM (SELECT src, tgt, relation, min(o) AS o FROM r WHERE relation IS NOT NULL GROUP BY ALL) GROUP BY ALL),
echunk AS (SELECT src, tgt, list(chunk_id ORDER BY o) AS c FROM (SELECT src, tgt, chunk_id, min(o) AS o FROM r WHERE chunk_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
edge0 AS (SELECT src, tgt, coalesce(d, '') AS description, strength, weight, coalesce(c, []) AS source_chunks, o AS ord FROM (SELECT src, tgt, coalesce(max(strength), 0) AS strength, CAST(coalesce(sum(strength), 0) AS BIGINT) AS weight, min(o) AS o FROM r GROUP BY ALL) LEFT JOIN edesc USING (src, tgt) LEFT JOIN echunk USING (src, tgt))"""
    if not vectors:
        return f"{node}, {edge}, node AS (SELECT * FROM node0), edge AS (SELECT * FROM edge0)"
    ntext = f"SELECT *, name || ' (' || coalesce(type, '') || '): ' || description AS _t FROM node0"
    etext = "SELECT e.*, a.name || ' → ' || b.name || ': ' || e.description AS _t FROM edge0 e JOIN node0 a ON a.key = e.src JOIN node0 b ON b.key = e.tgt"
    return f"{node}, {edge}, node AS MATERIALIZED (SELECT * FROM {sql_embed(ntext, sql_clip('_t', 600))}), edge AS MATERIALIZED (SELECT * FROM {sql_embed(etext, sql_clip('_t', 600))})"


SQL_MEMBERS = "member AS (SELECT DISTINCT id AS community, unnest(members) AS key FROM (SELECT id, arg_max(struct_pack(m := members), ord).m AS members FROM communities GROUP BY id))"
