"""Entity resolution, edge aggregation and the graph's projections.

``variant`` is 'community' (Azerbaijani keys, most frequent name and type, no self relations, summed weights) or
'entity' (plain keys, first name and type, self relations kept, no weights).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.textops import name_key_az, name_key_plain
from loomgraph.operators.skew import hot_keys, numbered, split_join
from loomgraph.session import materialize

VARIANTS = ("community", "entity")


def _check(variant: str) -> None:
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")


def key_of(c: Column | str, variant: str) -> Column:
    """The key that mentions of one entity share."""
    _check(variant)
    return name_key_az(c) if variant == "community" else name_key_plain(c)


def keyed(df: DataFrame, columns: dict[str, str], variant: str) -> DataFrame:
    """``df`` with key columns: ``columns`` maps a name column to its key column."""
    return df.withColumns({out: key_of(c, variant) for c, out in columns.items()})


def keyed_by_names(df: DataFrame, columns: dict[str, str], variant: str) -> DataFrame:
    """:func:`keyed` for rows without null names, of which many share theirs: distinct names are keyed, hot ones meet a broadcast."""
    names = df.select(F.explode(F.array(*columns)).alias("_name")).groupBy("_name").agg(F.count(F.lit(1)).alias("n"))
    names = materialize(names.withColumn("_key", key_of("_name", variant)), "names")
    hot = hot_keys(names, "_name")
    for c, out in columns.items():
        df = split_join(df, names.select(F.col("_name").alias(c), F.col("_key").alias(out)), c, hot)
    return df


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Per ``keys`` the distinct values in order of first sight, as an array. Values are made distinct before they are collected."""
    first = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v")))), lambda x: x["v"]).alias(out))


def most_frequent(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per ``keys`` the value with the most rows, ties to the one seen first; nulls count only where there is nothing else."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    return counts.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(F.col(value).isNull(), -F.col("_n"), F.col("_o"))).alias(value))


def resolve_entities(mentions: DataFrame, variant: str = "community", order: str = "ord") -> DataFrame:
    """(``key``, ``name``, ``type``, ``description``, ``source_chunks``, ``ord``) from mentions (``name``, ``type``, ``description``, ``chunk_id``, ``ord``).

    Mentions without a name or with a blank one are left out; null descriptions and chunks are not collected.
    """
    # keyed once, read by each aggregate
    m = materialize(keyed(mentions.filter("name is not null"), {"name": "key"}, variant).filter("key <> ''"), "mentions")
    first = m.groupBy("key").agg(F.min(order).alias("ord"), F.min_by(F.struct("name", "type"), order).alias("_f"))
    if variant == "community":
        named = most_frequent(m, ["key"], "name", order).join(most_frequent(m, ["key"], "type", order), "key").join(first.select("key", "ord"), "key")
    else:
        named = first.select("key", "_f.name", "_f.type", "ord")
    d = ordered_distinct(m, ["key"], "description", order, "_d")
    c = ordered_distinct(m, ["key"], "chunk_id", order, "source_chunks")
    out = named.join(d, "key", "left").join(c, "key", "left")
    none = F.array().cast("array<string>")
    return out.select("key", "name", "type", F.array_join(F.coalesce("_d", none), " | ").alias("description"), F.coalesce("source_chunks", none).alias("source_chunks"), "ord")


def valid_relations(relations: DataFrame, nodes: DataFrame, variant: str = "community") -> DataFrame:
    """``relations`` with ``src`` and ``tgt`` keys, those whose two ends are entities; self relations only in the 'entity' variant."""
    r = keyed_by_names(relations.filter("source is not null and target is not null"), {"source": "src", "target": "tgt"}, variant)
    if variant == "community":
        r = r.filter("src <> tgt")
    r = materialize(r, "relations")
    hot = {side: hot_keys(r.groupBy(side).agg(F.count(F.lit(1)).alias("n")), side) for side in ("src", "tgt")}
    for side, keys in hot.items():
        r = split_join(r, nodes.select(F.col("key").alias(side)), side, keys)
    return r


def aggregate_edges(relations: DataFrame, nodes: DataFrame, variant: str = "community", order: str = "ord", lists: bool = True) -> DataFrame:
    """(``src``, ``tgt``, ``description``, ``strength``, ``weight``, ``source_chunks``, ``ord``) per ordered pair of entities.

    ``strength`` is the largest, ``weight`` the sum over all mentions (null strengths count as 0); 'entity' has no ``weight``. Without ``lists`` there
    are no descriptions and chunks: one aggregation, for what needs only pairs and weights.
    """
    if not lists:
        relations = relations.drop("relation", "chunk_id")
    r = valid_relations(relations, nodes, variant)
    r = materialize(r, "valid") if lists else r
    pair = ["src", "tgt"]
    s = r.groupBy(*pair).agg(F.coalesce(F.max("strength"), F.lit(0)).alias("strength"), F.coalesce(F.sum("strength"), F.lit(0)).cast("bigint").alias("weight"), F.min(order).alias("ord"))
    if lists:
        none = F.array().cast("array<string>")
        s = s.join(ordered_distinct(r, pair, "relation", order, "_d"), pair, "left").join(ordered_distinct(r, pair, "chunk_id", order, "source_chunks"), pair, "left")
        s = s.select(*pair, F.array_join(F.coalesce("_d", none), " | ").alias("description"), "strength", "weight", F.coalesce("source_chunks", none).alias("source_chunks"), "ord")
    return s if variant == "community" else s.drop("weight")


def entity_keys(mentions: DataFrame, variant: str = "community") -> DataFrame:
    """(``key``) of all entities, for what needs no more of them; distinct names are keyed."""
    # written first: the filter on the key would else be carried below the distinct, and every mention keyed
    names = materialize(mentions.filter("name is not null").select("name").distinct(), "distinct")
    return keyed(names, {"name": "key"}, variant).filter("key <> ''").select("key").distinct()


def entity_pairs(mentions: DataFrame, relations: DataFrame, variant: str = "community") -> tuple[DataFrame, DataFrame]:
    """(``key``, ``id``) of all entities, numbered in the order of their keys, and their :func:`undirected` pairs (``u``, ``v``, ``weight``) by ids.

    Names of both tables are keyed once; a relation's ends become numbers at once, and those that are no entities drop out.
    """
    _check(variant)
    r = relations.filter("source is not null and target is not null").select("source", "target", "strength")
    ends = r.select(F.explode(F.array("source", "target")).alias("_name"), F.lit(False).alias("entity"), F.lit(1).alias("n"))
    names = mentions.filter("name is not null").select(F.col("name").alias("_name"), F.lit(True).alias("entity"), F.lit(0).alias("n")).unionByName(ends)
    names = names.groupBy("_name").agg(F.max("entity").alias("entity"), F.sum("n").alias("n"))
    names = materialize(names.withColumn("key", key_of("_name", variant)), "names")
    keys = materialize(numbered(names.filter("entity and key <> ''").select("key").distinct(), ["key"], "id"), "keys")
    known = materialize(names.filter("n > 0").join(keys, "key").select("_name", "id"), "known")
    hot = hot_keys(names, "_name")
    # read by the hot and the other rows of the second join
    r = materialize(split_join(r, known.select(F.col("_name").alias("source"), F.col("id").alias("u")), "source", hot).drop("source"), "half")
    r = split_join(r, known.select(F.col("_name").alias("target"), F.col("id").alias("v")), "target", hot)
    if variant == "community":
        r = r.filter("u <> v")
    return keys, undirected(r.select("u", "v", F.coalesce("strength", F.lit(0)).alias("weight")), "u", "v")


def undirected(edges: DataFrame, src: str = "src", tgt: str = "tgt", weight: str = "weight") -> DataFrame:
    """(``u``, ``v``, ``weight``): both directions of a pair summed, u <= v."""
    return edges.groupBy(F.least(src, tgt).alias("u"), F.greatest(src, tgt).alias("v")).agg(F.sum(weight).alias("weight"))


def degrees(edges: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """(``key``, ``degree``): in and out; a self relation counts twice."""
    ends = edges.select(F.explode(F.array(src, tgt)).alias("key"))
    return ends.groupBy("key").agg(F.count(F.lit(1)).alias("degree"))


def components(nodes: DataFrame, pairs: DataFrame, materialise) -> DataFrame:
    """(``key``, ``component``): the smallest key that can be reached, by label propagation with shortcuts.

    Every round a node takes the smallest label among its neighbours and then that label's own label, so the rounds grow
    with the logarithm of the diameter on most graphs. ``materialise`` cuts the lineage each round.
    """
    both = materialise(pairs.select(F.col("u").alias("key"), F.col("v").alias("other")).unionByName(pairs.select(F.col("v").alias("key"), F.col("u").alias("other"))).distinct(), "pairs")
    labels = materialise(nodes.select("key", F.col("key").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.min("component").alias("near"))
        step = labels.join(near, "key", "left").select("key", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = step.select(F.col("key").alias("low"), F.col("low").alias("next"))
        new = materialise(step.join(jump, "low", "left").select("key", "component", F.least("low", F.coalesce("next", "low")).alias("new")), "labels")
        changed = new.filter("new <> component").limit(1).count()
        labels = new.select("key", F.col("new").alias("component"))
        if not changed:
            return labels


def merge_gleaned(base: DataFrame, extra: DataFrame, keys: list[str], order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(merged, number added): ``base`` as it is, and of ``extra`` the first row of every key that ``base`` has not."""
    new = extra.join(base.select(*keys).distinct(), keys, "left_anti")
    new = new.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_i = 1").drop("_i")
    return base.unionByName(new.select(*base.columns)), new.agg(F.count(F.lit(1)).alias("n_added"))
