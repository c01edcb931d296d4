"""Queries of vector and lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import embed as E
from loomgraph.operators import search as S
from loomgraph.plans.inputs import SQL_CHUNKS, SQL_ITEMS, chunks, items, sql_tokens
from loomgraph.session import table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return E.with_unit(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "embedding", "vec").drop("embedding")


def vec_norms(spark: SparkSession, d: str) -> DataFrame:
    """Length of every vector."""
    return table(spark, d, "embeddings").select("vec_id", F.round(E.norm("embedding"), 6).alias("norm"))


def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to vector 0."""
    v = _vectors(spark, d)
    q = v.filter("vec_id = 0").select(F.col("vec").alias("q"))
    # one query row
    near = v.crossJoin(F.broadcast(q)).select("vec_id", F.round(E.dot("vec", "q"), 6).alias("score"))
    return near.orderBy(F.desc("score"), "vec_id").limit(10)


def vec_topk_set(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to every vector whose id is divisible by 20."""
    v = _vectors(spark, d)
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query_vec"))
    return S.vector_topk(v, q, 10, row_id="vec_id").withColumn("rank", F.col("rank").cast("bigint"))


def vec_seed_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The three vectors of every label nearest to vector 0."""
    v = _vectors(spark, d)
    q = v.filter("vec_id = 0").select(F.col("vec").alias("q"))
    near = v.crossJoin(F.broadcast(q)).select("label", "vec_id", F.round(E.dot("vec", "q"), 6).alias("score"))
    return S.ranked(near, ["label"], [F.desc("score"), F.asc("vec_id")], 3).withColumn("rank", F.col("rank").cast("bigint"))


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number and mean length of the documents."""
    return S.vocabulary(table(spark, d, "documents"))[1].select(F.col("n").cast("bigint").alias("n"), F.round("avgdl", 6).alias("avgdl"))


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and weight of every word of the chunks."""
    c = chunks(spark, d)
    return S.vocabulary(c)[0].select("term", F.col("df").cast("bigint").alias("df"), F.round("idf", 6).alias("idf"))


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every chunk that shares a word with an item's question."""
    return S.bm25(chunks(spark, d), items(spark, d)).select("query_id", "id", "score")


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The three best chunks per question by words; chunks without a hit fill up."""
    return S.bm25_topk(chunks(spark, d), items(spark, d), 3).withColumn("rank", F.col("rank").cast("bigint"))


def search_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest chunks per question."""
    c = chunks(spark, d)
    best = S.vector_topk(c, items(spark, d), 3)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The three chunks per question with the best fused rank."""
    h = S.hybrid(chunks(spark, d), items(spark, d))
    return h.select("query_id", "id", *[F.col(c).cast("bigint").alias(c) for c in ("cosine_rank", "bm25_rank", "rank")], "score")


QUERIES = {f.__name__: f for f in (vec_norms, vec_topk, vec_topk_set, vec_seed_by_label, bm25_stats, bm25_idf, bm25_scores, search_bm25, search_cosine, search_hybrid)}

_VEC = """v AS (SELECT vec_id, label, list_transform(e, lambda x: x / n) AS vec FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)))"""
_DOT = "round(list_dot_product({}, {}), 6) + 0.0"
_BM25 = f"""{SQL_CHUNKS}, {SQL_ITEMS}, tok AS (SELECT id, ord, {sql_tokens('text')} AS t FROM chunk WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok), post AS (SELECT id, ord, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, ord, t, unnest(t) AS term FROM tok) GROUP BY ALL),
w0 AS (SELECT term, count(*) AS df, any_value(ln(n - df0 + 0.5) - ln(df0 + 0.5)) AS raw FROM (SELECT post.term, n, count(*) OVER (PARTITION BY post.term) AS df0 FROM post, st) GROUP BY term),
w AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM w0) ELSE raw END AS idf FROM w0),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({sql_tokens('query_text')}) AS term FROM item) GROUP BY ALL),
sc AS (SELECT query_id, id, ord, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN w USING (term) JOIN post USING (term), st GROUP BY ALL),
bm AS (SELECT query_id, c.id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, c.ord) AS rank FROM (SELECT query_id, id, ord FROM item, chunk) c LEFT JOIN sc USING (query_id, id))"""
_COS = f"""cs AS (SELECT query_id, id, ord, {_DOT.format('vec', 'query_vec')} AS score FROM item, chunk WHERE vec IS NOT NULL), co AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs)"""
SQL = {
    "vec_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings",
    "vec_topk": f"WITH {_VEC} SELECT a.vec_id, {_DOT.format('a.vec', 'q.vec')} AS score FROM v a, v q WHERE q.vec_id = 0 ORDER BY score DESC, a.vec_id LIMIT 10",
    "vec_topk_set": f"WITH {_VEC}, s AS (SELECT q.vec_id AS query_id, a.vec_id, {_DOT.format('a.vec', 'q.vec')} AS score FROM v a, v q WHERE q.vec_id % 20 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10",
    "vec_seed_by_label": f"WITH {_VEC}, s AS (SELECT a.label, a.vec_id, {_DOT.format('a.vec', 'q.vec')} AS score FROM v a, v q WHERE q.vec_id = 0) SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 3",
    "bm25_stats": f"SELECT count(*) AS n, round(avg(len({sql_tokens('text')})), 6) AS avgdl FROM documents WHERE text IS NOT NULL",
    "bm25_idf": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM w",
    "bm25_scores": f"WITH {_BM25} SELECT query_id, id, score FROM sc",
    "search_bm25": f"WITH {_BM25} SELECT query_id, id, score, rank FROM bm WHERE rank <= 3",
    "search_cosine": f"WITH {SQL_CHUNKS}, {SQL_ITEMS}, {_COS} SELECT query_id, id, score, rank FROM co WHERE rank <= 3",
    "search_hybrid": f"""WITH {_BM25}, {_COS}, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS cosine_rank, b.rank AS bm25_rank, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score
FROM (SELECT * FROM co WHERE rank <= 5) a FULL JOIN (SELECT * FROM bm WHERE rank <= 5) b ON a.query_id = b.query_id AND a.id = b.id)
SELECT query_id, f.id, cosine_rank, bm25_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM f JOIN chunk ON chunk.id = f.id QUALIFY rank <= 3""",
}
