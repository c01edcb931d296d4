"""Checkpoints, caches and keyed tables: resume filters, last write wins, set equality, batching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.textops import summary_hash, token_estimate, vector_key
from loomgraph.operators.skew import numbered


def pending(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Items whose key is not done yet; a key that ``items`` holds twice stays twice, null keys stay."""
    return items.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` per key."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def cache_misses(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """(``key``, ``text``): distinct texts whose vector the cache lacks."""
    wanted = texts.filter(F.col(text).isNotNull()).select(vector_key(text).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    return wanted.join(cache.select("key"), "key", "left_anti")


def cache_pruned(cache: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """The cache without vectors of texts that are gone."""
    return cache.join(texts.filter(F.col(text).isNotNull()).select(vector_key(text).alias("key")), "key", "left_semi")


def vector_index(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """The pruned cache (``key``, ``vec``) with the vectors of new texts; ``embed`` adds ``vec`` to rows with ``key`` and ``text``."""
    new = embed(cache_misses(texts, cache, text)).select("key", "vec")
    return cache_pruned(cache, texts, text).select("key", "vec").unionByName(new)


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``same``: whether both have the same distinct rows."""
    diff = a.subtract(b).unionByName(b.subtract(a))
    return diff.limit(1).agg((F.count(F.lit(1)) == 0).alias("same"))


def summaries_due(items: DataFrame, cache: DataFrame, most: int = 20, sep: str = " | ") -> DataFrame:
    """Items (``id``, ``subject``, ``description``) with at least two descriptions whose cached summary is missing or of another hash.

    Columns: ``id``, ``subject``, ``descriptions`` (the first ``most``), ``hash``.
    """
    d = F.filter(F.transform(F.split("description", rf"\Q{sep}\E"), F.trim), lambda x: x != "")
    many = items.withColumn("_d", d).filter(F.size("_d") >= 2).select("id", "subject", F.slice("_d", 1, most).alias("descriptions"))
    hashed = many.withColumn("hash", summary_hash("subject", "descriptions"))
    return hashed.join(cache.select("id", "hash"), ["id", "hash"], "left_anti")


def batches(df: DataFrame, order: list[str], size: int, by: list[str] = ()) -> DataFrame:
    """``df`` with ``batch``: fixed-size runs in ``order`` within ``by``."""
    if not by:  # numbered by ranges, so that no task sees all rows
        return numbered(df, order, "_number").withColumn("batch", F.floor(F.col("_number") / size).cast("bigint")).drop("_number")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def batch_tokens(df: DataFrame, text: str = "text", batch: str = "batch") -> DataFrame:
    """Estimated tokens per batch."""
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.sum(token_estimate(text)).alias("tokens"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``current`` with the last change of every key laid over it."""
    new = last_wins(changes, key, order)
    return current.join(new.select(key), key, "left_anti").unionByName(new.select(*current.columns))


def rate_windows(events: DataFrame, ts: str = "ts", tokens: str | None = None) -> DataFrame:
    """Requests (and tokens) per fixed minute: what a limiter with fixed windows would have counted."""
    w = F.window(ts, "1 minute")
    aggs = [F.count(F.lit(1)).alias("requests")] + ([F.sum(tokens).alias("tokens")] if tokens else [])
    return events.groupBy(w.alias("w")).agg(*aggs).select(F.col("w.start").alias("minute"), *[c for c in ("requests", "tokens") if c == "requests" or tokens])


def last_user_message(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last message of the role 'user' per conversation."""
    return messages.filter("role = 'user'").groupBy(conv).agg(F.max_by("text", turn).alias("text"))
