"""Joins and counts that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 0.005


def hot_keys(counts: DataFrame, key: str, n: str = "n", share: float = HOT_SHARE) -> list:
    """Keys with at least ``share`` of all rows; at most ``1/share`` values reach the driver.

    ``counts`` has one row per key with its row count. Null keys are never hot. An empty table gives [].
    """
    total = counts.agg(F.sum(n)).first()[0]
    if not total:
        return []
    least = max(2, int(total * share))
    return [r[0] for r in counts.filter((F.col(n) >= least) & F.col(key).isNotNull()).select(key).collect()]


def split_join(rows: DataFrame, dim: DataFrame, on: str, hot: list, how: str = "inner") -> DataFrame:
    """Equi-join on ``on``; rows of the hot keys meet a broadcast of at most ``len(hot)`` keys of ``dim``.

    ``dim`` holds one row per key, so the broadcast is bounded by the number of hot keys. The
    others are shuffled as usual. Nothing is dropped; null keys match nothing.
    """
    if not hot:
        return rows.join(dim, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    a = rows.filter(is_hot).join(F.broadcast(dim.filter(F.col(on).isin(hot))), on, how)
    b = rows.filter(~is_hot).join(dim.filter(~F.col(on).isin(hot)), on, how)
    return a.unionByName(b)


def salt(row_id: Column, key: Column, hot: list, n: int) -> Column:
    """0 for ordinary keys, a number under ``n`` by row for hot ones."""
    if not hot:
        return F.lit(0)
    return F.when(key.isin(hot), F.pmod(F.xxhash64(row_id), F.lit(n))).otherwise(0).cast("int")


def spread(df: DataFrame, key: str, hot: list, n: int) -> DataFrame:
    """``df`` with ``salt``: rows of hot keys once per salt, all others once with salt 0."""
    if not hot:
        return df.withColumn("salt", F.lit(0))
    return df.withColumn("salt", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` 0, 1, .. in ``order``: ranges are sorted apart, their sizes give each its offset; no single task sees all rows."""
    from loomgraph.session import materialize

    s = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    s = materialize(s, "ranges")
    sizes = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))
    local = s.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    # one row per range
    return local.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")
