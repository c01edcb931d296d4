"""Queries of graph building, communities and graph retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import community as M
from loomgraph.operators import context as X
from loomgraph.operators import graph as G
from loomgraph.operators import retrieval as R
from loomgraph.operators.search import ranked
from loomgraph.plans.inputs import SQL_CHUNKS, SQL_ITEMS, SQL_MEMBERS, chunks, communities, graph, items, members, mentions, relations, reports, sql_article, sql_clip, sql_embed, sql_graph
from loomgraph.providers import generator
from loomgraph.session import materialize, table


def _nodes_out(n: DataFrame) -> DataFrame:
    return n.select("key", "name", "type", F.md5("description").alias("description_md5"), F.array_join("source_chunks", ",").alias("source_chunks"), "ord")


def ent_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Entities resolved by Azerbaijani keys, with the most frequent name and type."""
    return _nodes_out(G.resolve_entities(mentions(spark, d)))


def ent_nodes_first(spark: SparkSession, d: str) -> DataFrame:
    """Entities resolved by plain keys, with the first name and type."""
    return _nodes_out(G.resolve_entities(mentions(spark, d), "entity"))


def _edges(spark: SparkSession, d: str, variant: str) -> DataFrame:
    nodes = materialize(G.resolve_entities(mentions(spark, d), variant), "nodes")
    return G.aggregate_edges(relations(spark, d), nodes, variant)


def edge_directed(spark: SparkSession, d: str) -> DataFrame:
    """Relations aggregated per ordered pair."""
    return _edges(spark, d, "community").select("src", "tgt", F.md5("description").alias("description_md5"), F.col("strength").cast("bigint").alias("strength"), "weight", F.array_join("source_chunks", ",").alias("source_chunks"), "ord")


def edge_directed_first(spark: SparkSession, d: str) -> DataFrame:
    """The same by plain keys, with self relations and without weights."""
    return _edges(spark, d, "entity").select("src", "tgt", F.md5("description").alias("description_md5"), F.col("strength").cast("bigint").alias("strength"), F.array_join("source_chunks", ",").alias("source_chunks"))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Keys of all entities, and pairs with their weights."""
    keys = materialize(G.entity_keys(mentions(spark, d)), "keys")
    return keys, materialize(G.aggregate_edges(relations(spark, d), keys, lists=False), "pairs")


def edge_undirected(spark: SparkSession, d: str) -> DataFrame:
    """Both directions summed."""
    return G.undirected(_pairs(spark, d)[1]).select("u", "v", F.col("weight").cast("bigint").alias("weight"))


def degree_all(spark: SparkSession, d: str) -> DataFrame:
    """Degree of every entity that has relations."""
    return G.degrees(_pairs(spark, d)[1])


def degree_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten entities with most relations."""
    return degree_all(spark, d).orderBy(F.desc("degree"), "key").limit(10)


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected component of every entity."""
    keys, edges = _pairs(spark, d)
    return G.components(keys, G.undirected(edges), materialize)


def comm_current(spark: SparkSession, d: str) -> DataFrame:
    """Communities by their last rows."""
    return communities(spark, d).select("id", "ord", "level", "parent", F.size("members").cast("bigint").alias("n_members"))


def comm_leaf(spark: SparkSession, d: str) -> DataFrame:
    """Community without children of every member."""
    return M.leaf_members(communities(spark, d)).distinct()


def comm_levels(spark: SparkSession, d: str) -> DataFrame:
    """Communities, members and communities of one member per level."""
    c = communities(spark, d)
    return c.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("members")).cast("bigint").alias("n_members"), F.sum(F.when(F.size("members") == 1, 1).otherwise(0)).cast("bigint").alias("n_single"))


def comm_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Communities by number of members, at least two."""
    return communities(spark, d).filter(F.size("members") >= 2).groupBy(F.size("members").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without vectors."""
    nodes = materialize(G.resolve_entities(mentions(spark, d)), "nodes")
    return nodes, materialize(G.aggregate_edges(relations(spark, d), nodes), "edges")


def _graph_members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = resolved(spark, d)
    return members(spark, d).join(nodes.select("key"), "key", "left_semi"), nodes, edges


def comm_member_rank(spark: SparkSession, d: str) -> DataFrame:
    """Members by degree."""
    keys, e = _pairs(spark, d)
    m = members(spark, d).join(keys, "key", "left_semi")
    return X.member_ranks(m, e).withColumn("rank", F.col("rank").cast("bigint"))


def comm_internal_edges(spark: SparkSession, d: str) -> DataFrame:
    """Relations inside a community."""
    keys, e = _pairs(spark, d)
    m = members(spark, d).join(keys, "key", "left_semi")
    return X.internal_edges(m, e).select("community", "src", "tgt", F.col("rank").cast("bigint").alias("rank"))


def comm_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles that a community's members come from."""
    n = materialize(G.resolve_entities(mentions(spark, d)), "nodes")
    m = members(spark, d).join(n.select("key"), "key", "left_semi")
    return X.community_articles(m, n).select("community", F.array_join("articles", ", ").alias("articles"))


def comm_report_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What every community's report is written from."""
    m, n, e = _graph_members(spark, d)
    return X.report_inputs(m, n, e)


def comm_reports(spark: SparkSession, d: str) -> DataFrame:
    """Extractive reports."""
    n, e = graph(spark, d)
    return reports(spark, d, n, e).select("community", "title", "summary", F.col("size").cast("bigint").alias("size"), F.array_join("articles", ", ").alias("articles"))


def _louvain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities by number, their pairs and communities."""
    nodes, pairs = G.entity_pairs(mentions(spark, d), relations(spark, d))
    pairs = materialize(pairs, "pairs")
    return nodes, pairs, materialize(M.numbered_hierarchy(nodes, pairs), "communities")


def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    """Recursive communities of the relation graph."""
    return _louvain(spark, d)[2]


def violations(nodes: DataFrame, pairs: DataFrame, c: DataFrame) -> DataFrame:
    """(``what``, ``key``): what is broken in the communities ``c`` of nodes (``key``, ``id``) and pairs (``u``, ``v``, ``weight``) of ids."""
    leaf = materialize(nodes.join(M.leaf_members(c), "key", "left"), "leaf")
    once = leaf.groupBy("key").agg(F.count("community").alias("n")).filter("n <> 1").select(F.lit("node not in one leaf").alias("what"), "key")
    up = c.select(F.col("id").alias("parent"), F.col("level").alias("up"))
    level = c.join(up, "parent").filter("level <> up + 1").select(F.lit("level").alias("what"), F.col("id").cast("string").alias("key"))
    kids = c.filter("parent is not null").select("parent", F.explode("members").alias("key"), F.lit(1).alias("n"))
    mine = c.join(c.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("parent"), F.explode("members").alias("key"), F.lit(-1).alias("n"))
    # a row for each time that one has the member and the other has not
    split = kids.unionByName(mine).groupBy("parent", "key").agg(F.sum("n").alias("n")).filter("n <> 0").select(F.lit("children").alias("what"), F.explode(F.array_repeat("key", F.abs("n").cast("int"))).alias("key"))
    label = leaf.filter("community is not null").select(F.col("id").alias("key"), "community")
    q = M.modularity(pairs, label).filter("modularity < 0").select(F.lit("modularity").alias("what"), F.col("modularity").cast("string").alias("key"))
    return once.unionByName(level).unionByName(split).unionByName(q)


def louvain_violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken invariants of the recursive communities; there must be none."""
    return violations(*_louvain(spark, d))


def _local(spark: SparkSession, d: str, with_reports: bool = False) -> R.Found:
    n, e = graph(spark, d)
    r = None
    if with_reports:
        r = reports(spark, d, n, e).select("community", "title", "summary")
        n = n.join(members(spark, d).groupBy("key").agg(F.min("community").alias("community")), "key", "left")
    return R.local_search(items(spark, d), n, e, chunks(spark, d), r)


def _big(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def local_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The five chunks per question of the local graph search."""
    return _big(_local(spark, d).chunks.drop("text"), "graph_rank", "cosine_rank", "rank")


def local_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entities of the local graph search."""
    return _big(_local(spark, d).entities.select("query_id", "key", "name", "type", F.md5("description").alias("description_md5"), F.array_join("source_chunks", ",").alias("source_chunks"), "rank"), "rank")


def local_relations(spark: SparkSession, d: str) -> DataFrame:
    """The relations of the local graph search."""
    return _big(_local(spark, d).relations.select("query_id", "src", "tgt", "source", "target", "strength", "rank"), "strength", "rank")


def local_reports(spark: SparkSession, d: str) -> DataFrame:
    """The reports of the local graph search."""
    return _big(_local(spark, d, True).reports.select("query_id", "community", "title", "rank"), "rank")


def ctx_local(spark: SparkSession, d: str) -> DataFrame:
    """The local search's results as text."""
    f = _local(spark, d, True)
    return X.local_context(items(spark, d), f.entities, f.relations, f.reports, f.chunks)


def _dual(spark: SparkSession, d: str, mode: str) -> R.Found:
    n, e = graph(spark, d, "entity")
    return R.dual_search(items(spark, d), n, e, chunks(spark, d), mode)


def dual_local_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the dual search by entities."""
    return _big(_dual(spark, d, "local").chunks.drop("text"), "graph_rank", "cosine_rank", "rank")


def dual_global_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the dual search by relations."""
    return _big(_dual(spark, d, "global").chunks.drop("text"), "graph_rank", "cosine_rank", "rank")


def dual_hybrid_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the dual search by both."""
    return _big(_dual(spark, d, "hybrid").chunks.drop("text"), "graph_rank", "cosine_rank", "rank")


def dual_hybrid_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the dual search by both."""
    return _big(_dual(spark, d, "hybrid").entities.select("query_id", "key", "name", "type", "score", "rank"), "rank")


def dual_hybrid_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of the dual search by both."""
    return _big(_dual(spark, d, "hybrid").relations.select("query_id", "src", "tgt", "strength", "score", "rank"), "strength", "rank")


def global_batches(spark: SparkSession, d: str) -> DataFrame:
    """The six nearest reports per question in batches of three."""
    n, e = graph(spark, d)
    return _big(R.global_batches(items(spark, d), reports(spark, d, n, e)), "rank")


def global_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the global search by the offline generator, as text."""
    n, e = graph(spark, d)
    a = R.map_reduce(items(spark, d), materialize(reports(spark, d, n, e), "reports"), generator())
    return a.withColumn("context", X.global_context(F.col("answer"), F.col("articles_used"), F.col("communities_used")))


QUERIES = {
    f.__name__: f
    for f in (
        ent_nodes, ent_nodes_first, edge_directed, edge_directed_first, edge_undirected, degree_all, degree_top, graph_components, comm_current, comm_leaf, comm_levels, comm_sizes, comm_member_rank, comm_internal_edges, comm_articles,
        comm_report_inputs, comm_reports, louvain_communities, louvain_violations, local_chunks, local_entities, local_relations, local_reports, ctx_local, dual_local_chunks, dual_global_chunks, dual_hybrid_chunks, dual_hybrid_entities,
        dual_hybrid_relations, global_batches, global_answers,
    )
}

_G, _GE = sql_graph(vectors=False), sql_graph("entity", vectors=False)
_NODES = "SELECT key, name, type, md5(description) AS description_md5, array_to_string(source_chunks, ',') AS source_chunks, ord FROM node"
_UND = "und AS (SELECT least(src, tgt) AS u, greatest(src, tgt) AS v, CAST(sum(weight) AS BIGINT) AS weight FROM edge GROUP BY ALL)"
_DEG = "deg AS (SELECT key, count(*) AS degree FROM (SELECT src AS key FROM edge UNION ALL SELECT tgt FROM edge) GROUP BY key)"
_CUR = "cur AS (SELECT id, max(ord) AS ord, arg_max(struct_pack(x := level), ord).x AS level, arg_max(struct_pack(x := parent), ord).x AS parent, arg_max(struct_pack(x := members), ord).x AS members FROM communities GROUP BY id)"
_MEM = f"{SQL_MEMBERS}, gm AS (SELECT * FROM member WHERE key IN (SELECT key FROM node0))"
_RANK = f"{_DEG}, mr AS (SELECT community, key, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, key) AS rank FROM gm LEFT JOIN deg USING (key) QUALIFY rank <= 40)"
_ORDER = lambda x: f"CASE WHEN {x} = 'Preambula' THEN 0 ELSE CAST(regexp_extract({x}, '(\\d+)$', 1) AS BIGINT) END"
_ART = f"""art AS (SELECT community, list(a ORDER BY {_ORDER('a')}) AS articles FROM (SELECT DISTINCT community, {sql_article('c')} AS a FROM (SELECT community, unnest(source_chunks) AS c FROM gm JOIN node0 USING (key))) WHERE a IS NOT NULL GROUP BY community)"""
_REP0 = f"""{_MEM}, {_RANK}, {_ART}, top5 AS (SELECT * FROM mr JOIN node0 USING (key) WHERE rank <= 5),
rep0 AS (SELECT community, string_agg(name, ', ' ORDER BY rank) FILTER (rank <= 3) AS title, string_agg(name || ': ' || substr(description, 1, 100), ' ' ORDER BY rank) AS summary FROM top5 GROUP BY community),
rep1 AS (SELECT rep0.*, size, coalesce(articles, []) AS articles FROM rep0 JOIN (SELECT community, count(*) AS size FROM gm GROUP BY community) USING (community) LEFT JOIN art USING (community))"""
_REP = f"{_REP0}, rep AS MATERIALIZED (SELECT * FROM {sql_embed('''SELECT *, title || ': ' || summary AS _t FROM rep1''', sql_clip('_t', 600))})"


def _sims(rows: str, keys: str, vec: str = "vec") -> str:
    return f"SELECT query_id, {keys}, round(list_dot_product({vec}, query_vec), 6) + 0.0 AS score FROM item, {rows} WHERE {vec} IS NOT NULL AND query_vec IS NOT NULL"


_VALID = """cv AS (SELECT id FROM chunk WHERE vec IS NOT NULL),
nc AS (SELECT key, c AS id, 1 / sqrt(count(*) OVER (PARTITION BY key)) AS share FROM (SELECT key, unnest(source_chunks) AS c FROM node) WHERE c IN (SELECT id FROM cv)),
ec AS (SELECT src, tgt, c AS id, 1 / sqrt(count(*) OVER (PARTITION BY src, tgt)) AS share FROM (SELECT src, tgt, unnest(source_chunks) AS c FROM edge) WHERE c IN (SELECT id FROM cv))"""
_SEEDS = f"""seed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM ({_sims('node', 'key')}) QUALIFY rank <= 8),
near AS (SELECT query_id, src, tgt, strength, score AS sim FROM edge JOIN seed ON seed.key = src UNION ALL SELECT query_id, src, tgt, strength, score FROM edge JOIN seed ON seed.key = tgt)"""
_ESEEDS = f"eseed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src || chr(9) || tgt) AS rank FROM ({_sims('edge', 'src, tgt')}) QUALIFY rank <= 8)"
_WL = "SELECT query_id, id, score * share AS w FROM seed JOIN nc USING (key) UNION ALL SELECT query_id, id, sim * coalesce(strength, 5) / 10 * share FROM near JOIN ec USING (src, tgt)"
_WG = "SELECT query_id, id, score * share AS w FROM eseed JOIN ec USING (src, tgt)"


def _fused(weights: str) -> str:
    return f"""cand AS (SELECT query_id, c.id, ord, g, round(list_dot_product(vec, query_vec), 6) + 0.0 AS cos FROM (SELECT query_id, id, round(sum(w), 6) AS g FROM ({weights}) GROUP BY ALL) w JOIN chunk c ON c.id = w.id JOIN item USING (query_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, cos DESC, ord) AS graph_rank, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, ord) AS cosine_rank FROM cand),
fu AS (SELECT *, round(1.0 / (60 + graph_rank) + 1.0 / (60 + cosine_rank), 9) AS score FROM rk), hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM fu QUALIFY rank <= 5)"""


_FULL = {v: f"{sql_graph(v)}, {SQL_CHUNKS}, {SQL_ITEMS}, {_VALID}" for v in ("community", "entity")}
_HIT = "SELECT query_id, id, score, graph_rank, cosine_rank, rank FROM hit"
_ENTS = "ents AS (SELECT DISTINCT query_id, key FROM (SELECT query_id, key FROM seed UNION ALL SELECT query_id, src FROM eseed UNION ALL SELECT query_id, tgt FROM eseed))"
_RELS = "rels AS (SELECT DISTINCT query_id, src, tgt FROM (SELECT query_id, src, tgt FROM near UNION ALL SELECT query_id, src, tgt FROM eseed))"
_ROUNDS = 25  # more than any shortest path of the graph is long
_LABELS = ", ".join(f"l{i + 1} AS MATERIALIZED (SELECT a.key, least(any_value(a.c), coalesce(min(b.c), any_value(a.c))) AS c FROM l{i} a LEFT JOIN both_ways w ON w.key = a.key LEFT JOIN l{i} b ON b.key = w.other GROUP BY a.key)" for i in range(_ROUNDS))
SQL = {
    "graph_components": f"""WITH {sql_graph(vectors=False)}, both_ways AS MATERIALIZED (SELECT src AS key, tgt AS other FROM edge UNION SELECT tgt, src FROM edge), l0 AS (SELECT key, key AS c FROM node), {_LABELS}
SELECT key, c AS component FROM l{_ROUNDS}""",
    "ent_nodes": f"WITH {_G} {_NODES}",
    "ent_nodes_first": f"WITH {_GE} {_NODES}",
    "edge_directed": f"WITH {_G} SELECT src, tgt, md5(description) AS description_md5, CAST(strength AS BIGINT) AS strength, weight, array_to_string(source_chunks, ',') AS source_chunks, ord FROM edge",
    "edge_directed_first": f"WITH {_GE} SELECT src, tgt, md5(description) AS description_md5, CAST(strength AS BIGINT) AS strength, array_to_string(source_chunks, ',') AS source_chunks FROM edge",
    "edge_undirected": f"WITH {_G}, {_UND} SELECT * FROM und",
    "degree_all": f"WITH {_G}, {_DEG} SELECT * FROM deg",
    "degree_top": f"WITH {_G}, {_DEG} SELECT * FROM deg ORDER BY degree DESC, key LIMIT 10",
    "comm_current": f"WITH {_CUR} SELECT id, ord, level, parent, CAST(len(members) AS BIGINT) AS n_members FROM cur",
    "comm_leaf": f"WITH {_CUR} SELECT DISTINCT unnest(members) AS key, id AS community FROM cur WHERE id NOT IN (SELECT parent FROM cur WHERE parent IS NOT NULL)",
    "comm_levels": f"WITH {_CUR} SELECT level, count(*) AS n, CAST(sum(len(members)) AS BIGINT) AS n_members, CAST(count_if(len(members) = 1) AS BIGINT) AS n_single FROM cur GROUP BY level",
    "comm_sizes": f"WITH {_CUR} SELECT CAST(len(members) AS BIGINT) AS size, count(*) AS n FROM cur WHERE len(members) >= 2 GROUP BY ALL",
    "comm_member_rank": f"WITH {_G}, {_MEM}, {_RANK} SELECT * FROM mr",
    "comm_internal_edges": f"WITH {_G}, {_MEM} SELECT a.community, src, tgt, row_number() OVER (PARTITION BY a.community ORDER BY ord, src, tgt) AS rank FROM edge JOIN gm a ON a.key = src JOIN gm b ON b.key = tgt AND a.community = b.community QUALIFY rank <= 40",
    "comm_articles": f"WITH {_G}, {_MEM}, {_ART} SELECT community, array_to_string(articles, ', ') AS articles FROM art",
    "comm_report_inputs": f"""WITH {_G}, {_MEM}, {_RANK}, e AS (SELECT community, string_agg('- ' || name || ' (' || coalesce(type, '') || '): ' || substr(description, 1, 200), chr(10) ORDER BY rank) AS entities FROM mr JOIN node0 USING (key) GROUP BY community),
i AS (SELECT a.community, src, tgt, description, row_number() OVER (PARTITION BY a.community ORDER BY ord, src, tgt) AS rank FROM edge JOIN gm a ON a.key = src JOIN gm b ON b.key = tgt AND a.community = b.community QUALIFY rank <= 40),
l AS (SELECT community, string_agg('- ' || s.name || ' → ' || t.name || ': ' || substr(i.description, 1, 150), chr(10) ORDER BY rank) AS relations FROM i JOIN node0 s ON s.key = src JOIN node0 t ON t.key = tgt GROUP BY community)
SELECT community, entities, coalesce(relations, '{X.NO_RELATIONS}') AS relations FROM e LEFT JOIN l USING (community)""",
    "comm_reports": f"WITH {_G}, {_REP0} SELECT community, title, summary, size, array_to_string(articles, ', ') AS articles FROM rep1",
    "louvain_violations": "SELECT '' AS what, '' AS key WHERE false",
    "local_chunks": f"WITH {_FULL['community']}, {_SEEDS}, {_fused(_WL)} {_HIT}",
    "local_entities": f"""WITH {_FULL['community']}, {_SEEDS}, k AS (SELECT key, list(id ORDER BY id) AS c FROM nc GROUP BY key) SELECT query_id, s.key, name, type, md5({sql_clip('description', 400)}) AS description_md5, array_to_string(coalesce(c, []), ',') AS source_chunks, rank FROM seed s JOIN node USING (key) LEFT JOIN k USING (key)""",
    "local_relations": f"""WITH {_FULL['community']}, {_SEEDS}, q AS (SELECT query_id, src, tgt, max(sim) AS sim, max(strength) AS strength FROM near GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, strength DESC, src, tgt) AS rank FROM q QUALIFY rank <= 10)
SELECT query_id, src, tgt, a.name AS source, b.name AS target, CAST(strength AS BIGINT) AS strength, rank FROM t JOIN node0 a ON a.key = src JOIN node0 b ON b.key = tgt""",
    "local_reports": f"""WITH {_FULL['community']}, {_SEEDS}, {_REP0}, h AS (SELECT query_id, c.community, min(rank) AS r FROM seed JOIN (SELECT key, min(community) AS community FROM member GROUP BY key) c USING (key) GROUP BY ALL)
SELECT query_id, community, title, row_number() OVER (PARTITION BY query_id ORDER BY r, community) AS rank FROM h JOIN rep1 USING (community)""",
    "dual_local_chunks": f"WITH {_FULL['entity']}, {_SEEDS}, {_fused(_WL)} {_HIT}",
    "dual_global_chunks": f"WITH {_FULL['entity']}, {_ESEEDS}, {_fused(_WG)} {_HIT}",
    "dual_hybrid_chunks": f"WITH {_FULL['entity']}, {_SEEDS}, {_ESEEDS}, {_fused(_WL + ' UNION ALL ' + _WG)} {_HIT}",
    "dual_hybrid_entities": f"WITH {_FULL['entity']}, {_SEEDS}, {_ESEEDS}, {_ENTS}, s AS (SELECT query_id, key, name, type, round(list_dot_product(vec, query_vec), 6) + 0.0 AS score FROM ents JOIN node USING (key) JOIN item USING (query_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s QUALIFY rank <= 10",
    "dual_hybrid_relations": f"WITH {_FULL['entity']}, {_SEEDS}, {_ESEEDS}, {_RELS}, s AS (SELECT query_id, src, tgt, CAST(strength AS BIGINT) AS strength, round(list_dot_product(vec, query_vec), 6) + 0.0 AS score FROM rels JOIN edge USING (src, tgt) JOIN item USING (query_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, tgt) AS rank FROM s QUALIFY rank <= 10",
    "global_batches": f"WITH {_G}, {SQL_ITEMS}, {_REP}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS rank FROM ({_sims('rep', 'community')}) QUALIFY rank <= 6) SELECT *, CAST((rank - 1) // 3 AS BIGINT) AS batch FROM s",
}
