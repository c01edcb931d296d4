"""Queries of checkpoints, caches, keyed tables and control operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import textops as X
from loomgraph.operators import graph as G
from loomgraph.operators import tables as T
from loomgraph.plans.inputs import sql_key
from loomgraph.session import table


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Names of relation sources that the registry does not hold as they are written."""
    done = table(spark, d, "graph_node").select(F.col("name").alias("id"))
    return T.pending(table(spark, d, "relation_mention").filter("source is not null").select(F.col("source").alias("id")).distinct(), done)


def min_length(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with at least ten characters."""
    return table(spark, d, "embeddings_checkpoint").filter(F.length(X.strip("text")) >= 10).select("ord", "id")


def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """Last row per community id."""
    return T.last_wins(table(spark, d, "communities").select("id", "ord", "level", "parent"), "id", "ord")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relation_mention").filter("source is not null").select(X.vector_key("source").alias("key")).distinct()


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_mention").select(F.col("name").alias("text"))


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Distinct entity names missing from a cache of all relation sources."""
    return T.cache_misses(_names(spark, d), _cache(spark, d))


def cache_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Keys of that cache that entity names still need."""
    return T.cache_pruned(_cache(spark, d), _names(spark, d))


def set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether mentions and checkpoint name the same chunks."""
    a = table(spark, d, "embeddings_checkpoint").select("id").distinct()
    b = table(spark, d, "entity_mention").select(F.col("chunk_id").alias("id")).distinct()
    return T.same_set(a, b)


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the total of their last order laid over their balance."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("value"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return T.upsert(c, o, "c_custkey", "at")


def batch_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of embedding batches of ten chunks."""
    return T.batch_tokens(T.batches(table(spark, d, "embeddings_checkpoint").select("ord", "text"), ["ord"], 10))


def rate_windows(spark: SparkSession, d: str) -> DataFrame:
    """Requests per minute of events."""
    return T.rate_windows(table(spark, d, "events"))


def last_message(spark: SparkSession, d: str) -> DataFrame:
    """Last view per user, as a message."""
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("turn"), F.when(F.col("event_type") == "view", "user").otherwise("assistant").alias("role"), F.col("props").alias("text"))
    return T.last_user_message(e, "user_id")


def summaries_due(spark: SparkSession, d: str) -> DataFrame:
    """Registry entries with descriptions to be summarised."""
    n = table(spark, d, "entity_mention").filter("name is not null").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("description")), " | ").alias("description"))
    cache = spark.createDataFrame([], "id string, hash string")
    due = T.summaries_due(n.select(F.col("name").alias("id"), F.col("name").alias("subject"), "description"), cache)
    return due.select("id", F.size("descriptions").cast("bigint").alias("n"), F.md5(F.array_join("descriptions", "\n")).alias("digest"))


def gleaned(spark: SparkSession, d: str) -> DataFrame:
    """Relation lines whose key no relation mention has, the first of each."""
    keys = lambda df: df.select("id", *[X.name_key_az(c).alias(c) for c in ("source", "target", "relation")]).dropna()
    base = keys(table(spark, d, "relation_mention").withColumnRenamed("rel_id", "id"))
    r = F.from_json("line", "source string, target string, relation string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    extra = table(spark, d, "relation_line").filter(F.col("line").rlike(r"(?s)^\s*\{.*\}\s*$")).select(F.col("line_id").alias("id"), r.alias("r")).filter("r._bad is null").select("id", "r.source", "r.target", "r.relation")
    merged, _ = G.merge_gleaned(base.withColumn("from_line", F.lit(False)), keys(extra).withColumn("from_line", F.lit(True)), ["source", "target", "relation"], "id")
    return merged.filter("from_line").drop("from_line")


QUERIES = {f.__name__: f for f in (resume_pending, min_length, last_write_wins, cache_misses, cache_pruned, set_equality, upserted, batch_tokens, rate_windows, last_message, summaries_due, gleaned)}

_K = lambda x: f"sha1('gemini-embedding-001|768|RETRIEVAL_DOCUMENT|' || {x})"
_GK = ", ".join(f"{sql_key(c)} AS {c}" for c in ("source", "target", "relation"))
SQL = {
    "resume_pending": "SELECT DISTINCT source AS id FROM relation_mention WHERE source IS NOT NULL AND source NOT IN (SELECT name FROM graph_node WHERE name IS NOT NULL)",
    "min_length": "SELECT ord, id FROM embeddings_checkpoint WHERE length(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) >= 10",
    "last_write_wins": "SELECT id, ord, level, parent FROM communities QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1",
    "cache_misses": f"SELECT DISTINCT {_K('name')} AS key, name AS text FROM entity_mention WHERE name IS NOT NULL AND name NOT IN (SELECT source FROM relation_mention WHERE source IS NOT NULL)",
    "cache_pruned": f"SELECT DISTINCT {_K('name')} AS key FROM entity_mention WHERE name IN (SELECT source FROM relation_mention)",
    "set_equality": "SELECT NOT EXISTS ((SELECT id FROM embeddings_checkpoint EXCEPT SELECT chunk_id FROM entity_mention) UNION ALL (SELECT chunk_id FROM entity_mention EXCEPT SELECT id FROM embeddings_checkpoint)) AS same",
    "upserted": "WITH o AS (SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(o_totalprice, c_acctbal) AS value FROM customer FULL JOIN o ON o_custkey = c_custkey",
    "batch_tokens": "SELECT (rn - 1) // 10 AS batch, count(*) AS n, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM embeddings_checkpoint) GROUP BY ALL",
    "rate_windows": "SELECT date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY ALL",
    "last_message": "SELECT user_id, props AS text FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "summaries_due": """WITH g AS (SELECT name, list(DISTINCT description ORDER BY description) FILTER (description IS NOT NULL) AS a FROM entity_mention WHERE name IS NOT NULL GROUP BY name),
t AS (SELECT name, list_filter(list_transform(string_split(array_to_string(a, ' | '), ' | '), lambda x: trim(x)), lambda x: x <> '') AS a FROM g)
SELECT name AS id, CAST(least(20, len(a)) AS BIGINT) AS n, md5(array_to_string(a[1:20], chr(10))) AS digest FROM t WHERE len(a) >= 2""",
    "gleaned": f"""WITH l AS (SELECT line_id AS id, line ->> '$.source' AS source, line ->> '$.target' AS target, line ->> '$.relation' AS relation FROM (SELECT line_id, CASE WHEN json_valid(line) THEN line END AS line FROM relation_line) WHERE line IS NOT NULL),
x AS (SELECT id, {_GK} FROM l WHERE source IS NOT NULL AND target IS NOT NULL AND relation IS NOT NULL), b AS (SELECT DISTINCT {_GK} FROM relation_mention WHERE source IS NOT NULL AND target IS NOT NULL AND relation IS NOT NULL)
SELECT x.* FROM x ANTI JOIN b USING (source, target, relation) QUALIFY row_number() OVER (PARTITION BY source, target, relation ORDER BY id) = 1""",
}
