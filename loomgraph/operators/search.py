"""Vector and lexical search of a query set against all rows, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.textops import tokens
from loomgraph.session import materialize

#: Query vectors that go to the workers at a time.
QUERY_BLOCK = 2048
#: Candidates that a task holds before it drops beaten ones.
HELD = 200_000
#: Words of all queries up to which they are sent to every task.
SENT_WORDS = 500_000
#: Decimals that scores are compared at, so that ties are ties everywhere.
DECIMALS = 6
K1, B, EPSILON = 1.5, 0.75, 0.25


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the rank within ``by``, the first ``k`` only if given."""
    r = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return r.filter(F.col(name) <= k) if k else r


def _blocks(queries: DataFrame, qid: str, vec: str) -> Iterator[tuple[list, np.ndarray]]:
    ids, rows = [], []
    for r in queries.select(qid, vec).filter(F.col(vec).isNotNull()).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def _least(top: np.ndarray, k: int) -> np.ndarray:
    """The score per query from which on a row can still be among the best ``k``."""
    return top.min(axis=1) if top.shape[1] >= k else np.full(len(top), -np.inf)


def _beaten(held: list[tuple[np.ndarray, pa.Array, np.ndarray]], top: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    qi, score = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
    keep = np.flatnonzero(score >= _least(top, k)[qi])
    return qi[keep], pa.concat_arrays([h[1] for h in held]).take(pa.array(keep)), score[keep]


def vector_topk(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "id", vec: str = "vec", query_id: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """(``query_id``, ``row_id``, ``score``, ``rank``): the ``k`` rows with the largest inner product per query, ties by id.

    Exact: blocks of at most QUERY_BLOCK queries meet all rows, each task keeps its best ``k`` per query
    (and all that tie with the last), and the tasks' best are ranked. Null vectors are in no result; vectors are compared as stored, so normalise them before.
    """
    src = rows.select(F.col(row_id).alias("_r"), F.col(vec).cast("array<double>").alias("_v")).filter("_v is not null")
    qtype, rtype = dict(queries.dtypes)[query_id], dict(src.dtypes)["_r"]
    schema = f"_q {qtype}, _r {rtype}, score double"
    out = None
    for ids, m in _blocks(queries, query_id, query_vec):
        sent = rows.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
            top, size = np.empty((len(q_ids), 0)), 0
            for b in batches:
                v = b.column(1)
                if not len(v):
                    continue
                x = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()].reshape(len(v), -1)
                s = np.round(q @ x.T, DECIMALS)
                top = np.concatenate((top, s), axis=1)
                if top.shape[1] > k:
                    top = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :]
                qi, ri = np.nonzero(s >= _least(top, k)[:, None])
                held.append((qi, b.column(0).take(pa.array(ri)), s[qi, ri]))
                size += len(qi)
                if size > HELD:  # what later batches have beaten goes
                    held = [_beaten(held, top, k)]
                    size = len(held[0][0])
            if held:
                qi, r, score = _beaten(held, top, k)
                for at in range(0, len(qi), HELD):
                    cut = slice(at, at + HELD)
                    yield pa.RecordBatch.from_arrays([pa.array([q_ids[i] for i in qi[cut]]), r[cut], pa.array(score[cut])], ["_q", "_r", "score"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], schema)
    best = ranked(out, ["_q"], [F.desc("score"), F.asc("_r")], k)
    return best.select(F.col("_q").alias(query_id), F.col("_r").alias(row_id), (F.col("score") + 0.0).alias("score"), "rank")


def vocabulary(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(words, stats) from one pass: (``term``, ``df``, ``idf``), and one row with ``n`` documents and ``avgdl`` words on average.

    A negative idf is replaced by a quarter of the mean over the vocabulary. Null texts are no documents.
    """
    t = docs.select(tokens(text).alias("_t")).filter("_t is not null")
    # the empty term stands for the documents themselves
    terms = t.select(F.size("_t").alias("dl"), F.explode(F.array_append(F.array_distinct("_t"), F.lit(""))).alias("term"))
    counts = materialize(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("words")), "vocabulary")
    stats = counts.filter("term = ''").select(F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"))
    d = counts.filter("term <> ''").crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = d.agg(F.avg("raw").alias("mean"))
    return d.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")), stats


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "id", text: str = "text", query_id: str = "query_id", query_text: str = "query_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(``query_id``, ``doc_id``, ``keep``, ``score``) of all documents that share a word with a query; a word repeated in the query counts each time.

    Only words of queries leave the documents, counted per document, so no word's documents ever come together. The queries' words are sent to
    every task while they are at most SENT_WORDS, and joined beyond that.
    """
    words, stats = vocabulary(docs, text)
    asked = queries.select(query_id, F.explode(tokens(query_text)).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qf"))
    asked = materialize(asked.join(words.drop("df"), "term"), "asked")
    few = asked.count() <= SENT_WORDS
    send = F.broadcast if few else (lambda df: df)
    t = docs.select(doc_id, *keep, tokens(text).alias("_t")).select(doc_id, *keep, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    tf = t.join(send(asked.select("term").distinct()), "term", "left_semi").groupBy(doc_id, *keep, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    met = tf.join(send(asked), "term").crossJoin(F.broadcast(stats))
    gain = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy(query_id, doc_id, *keep).agg(F.round(F.sum(gain), DECIMALS).alias("score"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "id", order: str = "ord", text: str = "text", query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """(``query_id``, ``doc_id``, ``score``, ``rank``): always ``k`` documents, without a hit those first in ``order`` with score 0."""
    scored = bm25(docs, queries, doc_id, text, query_id, query_text, (order,))
    best = materialize(ranked(scored, [query_id], [F.desc("score"), F.asc(order)], k).drop("rank"), "best")
    # a query with fewer than k hits is filled up; the first k documents and its hits are enough to fill it
    hits = best.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n"))
    short = queries.select(query_id).distinct().join(hits, query_id, "left").filter(F.coalesce("_n", F.lit(0)) < k).select(query_id)
    first = docs.select(doc_id, order).orderBy(order).limit(2 * k)
    fill = short.crossJoin(F.broadcast(first)).join(best.select(query_id, doc_id), [query_id, doc_id], "left_anti").select(query_id, doc_id, F.lit(0.0).alias("score"), order)
    return ranked(best.select(query_id, doc_id, "score", order).unionByName(fill), [query_id], [F.desc("score"), F.asc(order)], k).drop(order)


def fuse(a: DataFrame, b: DataFrame, k: int, on: list[str], a_rank: str, b_rank: str, order: DataFrame, rrf_k: int = 60, tie: str = "ord") -> DataFrame:
    """Reciprocal rank fusion of two rankings: ``on``, both ranks (null where absent), ``score``, ``rank``."""
    part = lambda r: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    both = a.join(b, on, "full_outer").withColumn("score", F.round(part(a_rank) + part(b_rank), 9))
    both = both.join(order, on[-1])
    return ranked(both, on[:-1], [F.desc("score"), F.asc(tie)], k).drop(tie)


def hybrid(docs: DataFrame, queries: DataFrame, k: int = 3, per_method: int = 5, rrf_k: int = 60) -> DataFrame:
    """(``query_id``, ``id``, ``cosine_rank``, ``bm25_rank``, ``score``, ``rank``) over chunks (``id``, ``ord``, ``text``, ``vec``)."""
    cos = vector_topk(docs, queries, per_method).select("query_id", "id", F.col("rank").alias("cosine_rank"))
    lex = bm25_topk(docs, queries, per_method).select("query_id", "id", F.col("rank").alias("bm25_rank"))
    return fuse(cos, lex, k, ["query_id", "id"], "cosine_rank", "bm25_rank", docs.select("id", "ord"), rrf_k)
