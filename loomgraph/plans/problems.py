"""Queries p3, p4 and p5: skewed keys, hierarchies and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import sqltext
from loomgraph.functions.visual import with_visual_key
from loomgraph.operators import hierarchy as H
from loomgraph.operators.orphans import even_bounds, parent_events, replay, snapshot
from loomgraph.operators.perkey import dominant_keys, per_key
from loomgraph.operators.skew import hot_keys, split_join
from loomgraph.session import materialize, table

#: p3_found: share of the rows of a table from which on a key is reported.
SHARE = 0.02
#: p5: epochs that the history is replayed in.
EPOCHS = 5


def _totals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return per_key(table(spark, d, "entity_mention"), "name"), per_key(table(spark, d, "relation_mention"), "source", ["strength"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(``table_name``, ``key_text``): values of ``name`` and ``source`` that at least 2% of their table's rows have."""
    e, r = (dominant_keys(materialize(t.select("key", "n"), "totals"), SHARE) for t in _totals(spark, d))
    return e.select(F.lit("entity_mention").alias("table_name"), F.col("key").alias("key_text")).unionByName(r.select(F.lit("relation_mention").alias("table_name"), F.col("key").alias("key_text")))


def p3_per_name(spark: SparkSession, d: str) -> DataFrame:
    """Per name as stored, null included: mentions as an entity, outgoing relations and the sum of their strengths."""
    e, r = _totals(spark, d)
    both = e.select("key", F.col("n").alias("mentions"), F.lit(0).cast("bigint").alias("relations"), F.lit(0).cast("bigint").alias("strength")).unionByName(
        r.select("key", F.lit(0).cast("bigint").alias("mentions"), F.col("n").alias("relations"), F.col("sum_strength").alias("strength"))
    )
    return both.groupBy(F.col("key").alias("name")).agg(F.sum("mentions").alias("mentions"), F.sum("relations").alias("relations"), F.sum("strength").alias("strength_total"))


def _hierarchy(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return H.hierarchy(H.current_rows(table(spark, d, "communities").select("id", "ord", "parent")), paths=paths)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(``id``): communities that lie on a circle of parent links by their current rows."""
    return _hierarchy(spark, d, paths=False).filter("kind = 'circle'").select(F.col("id").cast("int").alias("id"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Per community its path as text, depth, root, kind and the circle it hangs on."""
    return _hierarchy(spark, d).select("id", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"), F.col("depth").cast("bigint").alias("depth"), "root", "kind", "circle")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """(``id``, ``descendant``, ``distance``) of every community and everything under it."""
    return H.descendants(_hierarchy(spark, d)).select("id", "descendant", F.col("distance").cast("bigint").alias("distance"))


def registry(spark: SparkSession, d: str) -> DataFrame:
    """``name``, ``registered_at``, ``deleted_at`` of graph_node and core_node together."""
    g = table(spark, d, "graph_node").select("name", "registered_at", "deleted_at")
    c = table(spark, d, "core_node").select("name", "registered_at", F.lit(None).cast("timestamp").alias("deleted_at"))
    return g.unionByName(c)


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    """One row per endpoint that is not null or blank: (``rel_id``, ``side``, ``name``, ``ts``)."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("name")) for s in ("source", "target")]))
    ends = table(spark, d, "relation_mention").select("rel_id", F.col("extracted_at").alias("ts"), sides.alias("s")).select("rel_id", "s.side", "s.name", "ts")
    return ends.filter(F.col("name").rlike(r"[^\s\p{Z}]"))


def _orphans(spark: SparkSession, d: str, epochs: int, keep_pending: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, orphans, pending). Distinct names are keyed, at most 1/share of them are hot; their counts tell which keys are."""
    ends = _endpoints(spark, d)
    names = materialize(with_visual_key(ends.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", "key"), "names")
    refs = split_join(ends, names.select("name", "key"), "name", hot_keys(names, "name")).select("key", "ts", "rel_id", "side")
    hot = hot_keys(names.groupBy("key").agg(F.sum("n").alias("n")), "key")
    events = parent_events(with_visual_key(registry(spark, d), "name", "key"), "key", "registered_at", "deleted_at")
    return ends, *replay(refs, events, ["side"], ["rel_id", "side"], even_bounds(ends, epochs), hot, keep_pending)


def p5_found(spark: SparkSession, d: str, epochs: int = EPOCHS) -> DataFrame:
    """(``rel_id``, ``side``): endpoints whose name no registry row has at ``extracted_at``."""
    return _orphans(spark, d, epochs, False)[1].select("rel_id", "side")


def p5_by_month(spark: SparkSession, d: str, epochs: int = EPOCHS) -> DataFrame:
    """Per field and month of ``extracted_at``: references, orphans, and orphans whose name the registry does not have in the end."""
    ends, _, pending = _orphans(spark, d, epochs, True)
    return snapshot(ends, pending, ["side"])


QUERIES = {f.__name__: f for f in (p3_found, p3_per_name, p4_found, p4_hierarchy, p4_descendants, p5_found, p5_by_month)}

_WALK = f"""WITH RECURSIVE raw AS (SELECT id, arg_max(struct_pack(p := parent), ord).p AS parent FROM communities WHERE id IS NOT NULL GROUP BY id),
cur AS (SELECT r.id, k.id AS parent, r.parent IS NOT NULL AND k.id IS NULL AS missing FROM raw r LEFT JOIN raw k ON k.id = r.parent),
up AS (SELECT id AS start, parent AS node FROM cur WHERE parent IS NOT NULL UNION SELECT up.start, c.parent FROM up JOIN cur c ON c.id = up.node WHERE c.parent IS NOT NULL),
circle AS (SELECT start AS id FROM up WHERE start = node)"""
_PATHS = f"""{_WALK},
walk AS (SELECT id AS start, id AS node, [id] AS path FROM cur WHERE id NOT IN (SELECT id FROM circle)
  UNION ALL SELECT w.start, c.parent, list_prepend(c.parent, w.path) FROM walk w JOIN cur c ON c.id = w.node WHERE c.parent IS NOT NULL AND c.parent NOT IN (SELECT id FROM circle)),
paths AS (SELECT start AS id, path, c.missing, CASE WHEN c.parent IN (SELECT id FROM circle) THEN c.parent END AS circle, w.node AS top
  FROM walk w JOIN cur c ON c.id = w.node WHERE c.parent IS NULL OR c.parent IN (SELECT id FROM circle)
  UNION ALL SELECT id, [id], false, NULL, NULL FROM circle)"""
_REG = "SELECT name, registered_at, deleted_at FROM graph_node UNION ALL SELECT name, registered_at, NULL FROM core_node"
_ENDS = """SELECT rel_id, extracted_at AS ts, 'source' AS side, source AS name FROM relation_mention UNION ALL
SELECT rel_id, extracted_at, 'target', target FROM relation_mention"""
_ORPHANS = f"""WITH ends AS (SELECT * FROM ({_ENDS}) WHERE regexp_matches(name, '[^\\s\\p{{Z}}]')),
names AS (SELECT name, {sqltext.visual_key('name')} AS key FROM (SELECT DISTINCT name FROM ends)),
reg AS (SELECT DISTINCT {sqltext.visual_key('name')} AS key, registered_at AS b, deleted_at AS g FROM ({_REG})),
refs AS (SELECT e.*, n.key FROM ends e JOIN names n USING (name)),
orphan AS (SELECT r.* FROM refs r WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.key = r.key AND reg.b <= r.ts AND (reg.g IS NULL OR reg.g > r.ts)))"""

SQL = {
    "p3_found": f"""SELECT 'entity_mention' AS table_name, name AS key_text FROM entity_mention WHERE name IS NOT NULL GROUP BY name HAVING count(*) >= {SHARE} * (SELECT count(*) FROM entity_mention)
UNION ALL SELECT 'relation_mention', source FROM relation_mention WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= {SHARE} * (SELECT count(*) FROM relation_mention)""",
    "p3_per_name": """SELECT name, CAST(sum(m) AS BIGINT) AS mentions, CAST(sum(r) AS BIGINT) AS relations, CAST(sum(s) AS BIGINT) AS strength_total FROM (
SELECT name, 1 AS m, 0 AS r, 0 AS s FROM entity_mention UNION ALL SELECT source, 0, 1, coalesce(strength, 0) FROM relation_mention) GROUP BY name""",
    "p4_found": f"{_WALK} SELECT CAST(id AS INTEGER) AS id FROM circle",
    "p4_hierarchy": f"""{_PATHS} SELECT CAST(id AS BIGINT) AS id, array_to_string(path, '/') AS path, CASE WHEN circle IS NULL AND top IS NOT NULL THEN CAST(len(path) - 1 AS BIGINT) END AS depth,
CAST(CASE WHEN circle IS NULL THEN top END AS BIGINT) AS root, CASE WHEN top IS NULL THEN 'circle' WHEN circle IS NOT NULL THEN 'below' WHEN missing THEN 'missing' ELSE 'tree' END AS kind, CAST(circle AS BIGINT) AS circle FROM paths""",
    "p4_descendants": f"""{_PATHS}, ups AS (SELECT id AS descendant, CASE WHEN circle IS NULL THEN path ELSE list_prepend(circle, path) END AS up FROM paths)
SELECT CAST(u AS BIGINT) AS id, CAST(descendant AS BIGINT) AS descendant, CAST(len(up) - i AS BIGINT) AS distance FROM (SELECT descendant, up, unnest(up) AS u, unnest(range(1, len(up) + 1)) AS i FROM ups) WHERE u <> descendant""",
    "p5_found": f"{_ORPHANS} SELECT rel_id, side FROM orphan",
    "p5_by_month": f"""{_ORPHANS}, there AS (SELECT DISTINCT key, true AS here FROM reg WHERE b IS NOT NULL AND g IS NULL),
a AS (SELECT side, date_trunc('month', ts) AS month, count(*) AS n_refs FROM refs GROUP BY ALL),
o AS (SELECT side, date_trunc('month', ts) AS month, count(*) AS n_orphans, count_if(here IS NULL) AS n_unresolved FROM orphan LEFT JOIN there USING (key) GROUP BY ALL)
SELECT a.side, a.month, CAST(n_refs AS BIGINT) AS n_refs, CAST(coalesce(n_orphans, 0) AS BIGINT) AS n_orphans, CAST(coalesce(n_unresolved, 0) AS BIGINT) AS n_unresolved FROM a LEFT JOIN o ON a.side = o.side AND a.month IS NOT DISTINCT FROM o.month""",
}
