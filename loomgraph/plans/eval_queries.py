"""Queries of the evaluation metrics. Answers and contexts are made of the items by a fixed rule, so that every metric has hits and misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import context as X
from loomgraph.operators import evaluation as V
from loomgraph.session import table


def answered(spark: SparkSession, d: str) -> DataFrame:
    """Items with an answer that cites the first expected article and that of the item's number, and one context."""
    g = table(spark, d, "gruth_dataset")
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    e = F.coalesce("expected_behavior.expected_articles", F.array().cast("array<string>"))
    own = F.concat(F.lit("Maddə "), n.cast("string"))
    cites = F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.slice(e, 1, 1), F.array(own)))
    answer = F.concat(F.lit("Cavab " + X.CITED + "Maddə 999\n"), F.when(F.size(cites) > 0, F.concat(F.lit(X.CITED), F.array_join(cites, ",  "))).otherwise("son"))
    ctx = F.concat(F.lit(X.ENTITIES + "\n[Maddə 998]\n\n" + X.CHUNKS + "\n["), own, F.lit("]\nmətn\n\n---\n\n["), F.coalesce(F.try_element_at(e, F.lit(2)), F.lit("Preambula")), F.lit(", hissə 1]\nmətn"))
    q = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("question"))
    return g.select("id", F.col("question").alias("input"), e.alias("expected"), F.col("expected_behavior.should_call_tool").alias("should_call"), q.alias("tool_queries"), answer.alias("answer"), F.array(ctx).alias("contexts"), n.alias("n"), F.size("expected_behavior.expected_response_elements").alias("n_elements"))


def eval_cited(spark: SparkSession, d: str) -> DataFrame:
    """Articles cited by every answer."""
    return answered(spark, d).select("id", F.array_join(F.array_sort(V.cited("answer")), ", ").alias("cited"))


def eval_retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Articles among the contexts' chunks."""
    return answered(spark, d).select("id", F.array_join(F.array_sort(V.retrieved(F.col("contexts"))), ", ").alias("retrieved"))


def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    """All rule-based metrics."""
    return V.scores(answered(spark, d)).select("id", "name", F.round("value", 6).alias("value"))


def eval_averages(spark: SparkSession, d: str) -> DataFrame:
    """Their means."""
    return V.averages(V.scores(answered(spark, d))).select("name", F.round("value", 6).alias("value"), "n")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return answered(spark, d).select("id", F.lit("judge_overall").alias("name"), (F.col("n") % 5 + 1).cast("double").alias("value"))


def eval_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of items judged 4 or better."""
    return V.pass_rate(_judged(spark, d)).select(F.round("value", 6).alias("value"), "n")


def eval_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of expected elements covered, by verdicts of a fixed rule."""
    a = answered(spark, d).withColumn("verdicts", F.transform(F.sequence(F.lit(1), F.col("n") % 4 + 1), lambda i: i % 2 == 1))
    return V.element_coverage(a).select("id", F.round("value", 6).alias("value"))


def eval_export(spark: SparkSession, d: str) -> DataFrame:
    """Items with their scores as JSON; items without a score have none."""
    a = answered(spark, d)
    return V.exported(a.select("id"), V.scores(a).filter("name <> 'no_false_citation' and name <> 'tool_call_correct'")).select("id", F.array_join(F.transform(F.array_sort(F.map_keys("scores")), lambda k: k), ",").alias("names"), F.size("scores").cast("bigint").alias("n"))


QUERIES = {f.__name__: f for f in (eval_cited, eval_retrieved, eval_scores, eval_averages, eval_pass_rate, eval_coverage, eval_export)}

_A = """a AS (SELECT id, n, e, q, call, n_el, CASE WHEN n % 7 = 0 THEN [] ELSE list_distinct(list_concat(e[1:1], ['Maddə ' || n])) END AS cited, list_distinct(['Maddə ' || n, coalesce(e[2], 'Preambula')]) AS got FROM (
SELECT id, CAST(regexp_extract(id, '(\\d+)$', 1) AS INT) AS n, coalesce(expected_behavior.expected_articles, []) AS e, CAST(regexp_extract(id, '(\\d+)$', 1) AS INT) % 5 <> 0 AS q, expected_behavior.should_call_tool AS call, len(expected_behavior.expected_response_elements) AS n_el FROM gruth_dataset)),
c AS (SELECT *, CASE WHEN n % 7 = 0 THEN ['Maddə 999'] ELSE cited END AS cites, list_distinct(e) AS exp FROM a),
s AS (SELECT id, 'tool_call_correct' AS name, CASE WHEN q = coalesce(call, len(exp) > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM c
UNION ALL SELECT id, 'retrieval_recall', len(list_intersect(exp, got)) / len(exp) FROM c WHERE len(exp) > 0
UNION ALL SELECT id, 'citation_recall', len(list_intersect(exp, cites)) / len(exp) FROM c WHERE len(exp) > 0
UNION ALL SELECT id, 'citation_precision', CASE WHEN len(cites) > 0 THEN len(list_intersect(exp, cites)) / len(cites) ELSE 0 END FROM c WHERE len(exp) > 0
UNION ALL SELECT id, 'no_false_citation', CASE WHEN len(cites) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM c WHERE len(exp) = 0)"""
SQL = {
    "eval_cited": f"WITH {_A} SELECT id, array_to_string(list_sort(cites), ', ') AS cited FROM c",
    "eval_retrieved": f"WITH {_A} SELECT id, array_to_string(list_sort(got), ', ') AS retrieved FROM c",
    "eval_scores": f"WITH {_A} SELECT id, name, round(value, 6) AS value FROM s",
    "eval_averages": f"WITH {_A} SELECT name, round(avg(value), 6) AS value, count(*) AS n FROM s GROUP BY name",
    "eval_pass_rate": f"WITH {_A} SELECT round(avg(CASE WHEN n % 5 + 1 >= 4 THEN 1.0 ELSE 0.0 END), 6) AS value, count(*) AS n FROM a",
    "eval_coverage": f"WITH {_A} SELECT id, round(least((n % 4 + 2) // 2, n_el) / n_el, 6) AS value FROM a WHERE n_el > 0",
    "eval_export": f"WITH {_A}, g AS (SELECT id, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM s WHERE name NOT IN ('no_false_citation', 'tool_call_correct') GROUP BY id) SELECT a.id, coalesce(names, '') AS names, coalesce(g.n, 0) AS n FROM a LEFT JOIN g USING (id)",
}
