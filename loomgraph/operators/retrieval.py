"""Graph-scored retrieval for a set of queries: local, dual-level and global search.

Inputs are tables: queries (``query_id``, ``query_vec``), nodes (``key``, ``name``, ``type``, ``description``, ``source_chunks``, ``vec``), edges
(``src``, ``tgt``, ``description``, ``strength``, ``source_chunks``, for dual search ``vec``) and chunks (``id``, ``ord``, ``text``, ``vec``). Chunks without a vector are not
in the index. Every result is per ``query_id``; ties are broken by order or key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.embed import dot
from loomgraph.functions.textops import clip_words, sorted_articles
from loomgraph.operators.models import step
from loomgraph.operators.search import DECIMALS, ranked, vector_topk
from loomgraph.operators.tables import batches

CONTEXT_CHARS = 400
MODES = ("local", "global", "hybrid")


@dataclass
class Found:
    """Tables of a graph search."""

    chunks: DataFrame
    entities: DataFrame
    relations: DataFrame
    reports: DataFrame | None = None


def valid_chunks(df: DataFrame, keys: list[str], chunks: DataFrame) -> DataFrame:
    """(``keys``, ``id``, ``share``): the chunks of a node or edge that are in the index, each with 1/sqrt of their number."""
    known = chunks.filter("vec is not null").select("id")
    met = df.select(*keys, F.explode("source_chunks").alias("id")).join(known, "id")
    n = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return met.join(n, keys).select(*keys, "id", (1 / F.sqrt("_n")).alias("share"))


def seed_entities(queries: DataFrame, nodes: DataFrame, k: int = 8, vec: str = "query_vec") -> DataFrame:
    """(``query_id``, ``key``, ``score``, ``rank``): the nearest entities."""
    return vector_topk(nodes, queries, k, row_id="key", query_vec=vec)


def edge_id(src: str = "src", tgt: str = "tgt"):
    """One text that names an edge."""
    return F.concat(src, F.lit("\t"), tgt)


def seed_edges(queries: DataFrame, edges: DataFrame, k: int = 8, vec: str = "query_vec") -> DataFrame:
    """(``query_id``, ``src``, ``tgt``, ``score``, ``rank``): the nearest relations."""
    named = edges.withColumn("_e", edge_id())
    best = vector_topk(named, queries, k, row_id="_e", query_vec=vec)
    return best.select("query_id", F.split_part("_e", F.lit("\t"), F.lit(1)).alias("src"), F.split_part("_e", F.lit("\t"), F.lit(2)).alias("tgt"), "score", "rank")


def incident(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges out of and into the seeds, a self relation twice: (``query_id``, ``src``, ``tgt``, ``strength``, ``sim``, ``seed``)."""
    e = edges.select("src", "tgt", "strength")
    s = seeds.select("query_id", F.col("key").alias("seed"), F.col("score").alias("sim"))
    out = e.join(s.withColumn("src", F.col("seed")), "src")
    into = e.join(s.withColumn("tgt", F.col("seed")), "tgt")
    return out.unionByName(into)


def _local_scores(seeds: DataFrame, near: DataFrame, node_chunks: DataFrame, edge_chunks: DataFrame) -> DataFrame:
    a = seeds.join(node_chunks, "key").select("query_id", "id", (F.col("score") * F.col("share")).alias("w"))
    b = near.join(edge_chunks, ["src", "tgt"]).select("query_id", "id", (F.col("sim") * F.coalesce("strength", F.lit(5)) / 10 * F.col("share")).alias("w"))
    return a.unionByName(b)


def fused_chunks(weights: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = 5, rrf_k: int = 60) -> DataFrame:
    """(``query_id``, ``id``, ``text``, ``score``, ``graph_rank``, ``cosine_rank``, ``rank``) of the candidate chunks."""
    cand = weights.groupBy("query_id", "id").agg(F.round(F.sum("w"), DECIMALS).alias("graph_score"))
    cand = cand.join(chunks.select("id", "ord", "vec"), "id").join(queries.select("query_id", "query_vec"), "query_id")
    cand = cand.withColumn("cos", F.round(dot("vec", "query_vec"), DECIMALS)).drop("vec", "query_vec")
    cand = ranked(cand, ["query_id"], [F.desc("graph_score"), F.desc("cos"), F.asc("ord")], name="graph_rank")
    cand = ranked(cand, ["query_id"], [F.desc("cos"), F.asc("ord")], name="cosine_rank")
    cand = cand.withColumn("score", F.round(1.0 / (rrf_k + F.col("graph_rank")) + 1.0 / (rrf_k + F.col("cosine_rank")), 9))
    top = ranked(cand, ["query_id"], [F.desc("score"), F.asc("ord")], top_k)
    return top.join(chunks.select("id", "text"), "id").select("query_id", "id", "text", "score", "graph_rank", "cosine_rank", "rank")


def _entities(picked: DataFrame, nodes: DataFrame, node_chunks: DataFrame) -> DataFrame:
    kept = node_chunks.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("source_chunks"))
    out = picked.join(nodes.select("key", "name", "type", clip_words("description", CONTEXT_CHARS).alias("description")), "key").join(kept, "key", "left")
    return out.withColumn("source_chunks", F.coalesce("source_chunks", F.array().cast("array<string>")))


def _relations(picked: DataFrame, edges: DataFrame, nodes: DataFrame, edge_chunks: DataFrame) -> DataFrame:
    kept = edge_chunks.groupBy("src", "tgt").agg(F.array_sort(F.collect_list("id")).alias("source_chunks"))
    names = nodes.select("key", "name")
    out = picked.join(edges.select("src", "tgt", "strength", clip_words("description", CONTEXT_CHARS).alias("description")), ["src", "tgt"])
    out = out.join(names.withColumnsRenamed({"key": "src", "name": "source"}), "src").join(names.withColumnsRenamed({"key": "tgt", "name": "target"}), "tgt").join(kept, ["src", "tgt"], "left")
    return out.withColumn("source_chunks", F.coalesce("source_chunks", F.array().cast("array<string>")))


def local_search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, reports: DataFrame | None = None, top_k: int = 5, entity_k: int = 8, rrf_k: int = 60, max_entities: int = 10, max_relations: int = 10) -> Found:
    """Seeds by similarity; their chunks and those of their relations scored, fused with the chunks' own similarity.

    Relations are ordered by the best seed's similarity, then strength, then keys. ``reports`` (``community``, ``title``, ``summary``) need nodes with ``community``.
    """
    seeds = seed_entities(queries, nodes, entity_k)
    node_chunks, edge_chunks = valid_chunks(nodes, ["key"], chunks), valid_chunks(edges, ["src", "tgt"], chunks)
    near = incident(seeds, edges)
    found = fused_chunks(_local_scores(seeds, near, node_chunks, edge_chunks), queries, chunks, top_k, rrf_k)
    entities = _entities(seeds.filter(F.col("rank") <= max_entities).select("query_id", "key", "rank"), nodes, node_chunks)
    rels = near.groupBy("query_id", "src", "tgt").agg(F.max("sim").alias("sim"), F.max("strength").alias("_s"))
    rels = ranked(rels, ["query_id"], [F.desc("sim"), F.desc("_s"), F.asc("src"), F.asc("tgt")], max_relations).select("query_id", "src", "tgt", "rank")
    got = None
    if reports is not None:
        hit = seeds.join(nodes.select("key", "community"), "key").filter("community is not null").groupBy("query_id", "community").agg(F.min("rank").alias("_r"))
        got = ranked(hit.join(reports, "community"), ["query_id"], [F.asc("_r"), F.asc("community")]).select("query_id", "community", "title", "summary", "rank")
    return Found(found, entities, _relations(rels, edges, nodes, edge_chunks), got)


def dual_search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, mode: str = "hybrid", top_k: int = 5, entity_k: int = 8, edge_k: int = 8, rrf_k: int = 60, max_entities: int = 10, max_relations: int = 10) -> Found:
    """Entity seeds by ``local_vec`` and relation seeds by ``global_vec`` of the queries (both ``query_vec`` if absent); what is
    returned is ranked by the full query. An unknown mode finds nothing."""
    q = queries
    for c in ("local_vec", "global_vec"):
        if c not in q.columns:
            q = q.withColumn(c, F.col("query_vec"))
    node_chunks, edge_chunks = valid_chunks(nodes, ["key"], chunks), valid_chunks(edges, ["src", "tgt"], chunks)
    weights, ents, rels = [], [], []
    if mode in ("local", "hybrid"):
        seeds = seed_entities(q, nodes, entity_k, "local_vec")
        near = incident(seeds, edges)
        weights.append(_local_scores(seeds, near, node_chunks, edge_chunks))
        ents.append(seeds.select("query_id", "key"))
        rels.append(near.select("query_id", "src", "tgt"))
    if mode in ("global", "hybrid"):
        best = seed_edges(q, edges, edge_k, "global_vec")
        weights.append(best.join(edge_chunks, ["src", "tgt"]).select("query_id", "id", (F.col("score") * F.col("share")).alias("w")))
        rels.append(best.select("query_id", "src", "tgt"))
        ents.append(best.select("query_id", F.explode(F.array("src", "tgt")).alias("key")))
    if mode not in MODES:
        none = q.select("query_id").limit(0)
        weights = [none.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("w"))]
        ents, rels = [none.select("query_id", F.lit("").alias("key"))], [none.select("query_id", F.lit("").alias("src"), F.lit("").alias("tgt"))]
    join = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(dfs[1])
    found = fused_chunks(join(weights), q, chunks, top_k, rrf_k)
    qv = q.select("query_id", "query_vec")
    sim = F.round(dot("vec", "query_vec"), DECIMALS)
    e = join(ents).distinct().join(nodes.select("key", "vec"), "key").join(qv, "query_id").select("query_id", "key", sim.alias("score"))
    e = ranked(e, ["query_id"], [F.desc("score"), F.asc("key")], max_entities)
    r = join(rels).distinct().join(edges.select("src", "tgt", "vec"), ["src", "tgt"]).join(qv, "query_id").select("query_id", "src", "tgt", sim.alias("score"))
    r = ranked(r, ["query_id"], [F.desc("score"), F.asc("src"), F.asc("tgt")], max_relations)
    return Found(found, _entities(e, nodes, node_chunks), _relations(r, edges, nodes, edge_chunks))


def global_batches(queries: DataFrame, reports: DataFrame, top: int = 6, size: int = 3) -> DataFrame:
    """(``query_id``, ``community``, ``score``, ``rank``, ``batch``): the nearest reports (``community``, ``vec``) in batches for the map step."""
    best = vector_topk(reports, queries, top, row_id="community")
    return batches(best, ["rank"], size, ["query_id"])


def map_reduce(queries: DataFrame, reports: DataFrame, generator, top: int = 6, size: int = 3) -> DataFrame:
    """(``query_id``, ``answer``, ``communities_used``, ``articles_used``): global search.

    ``generator`` has ``map(query, batch) -> (relevant, partial)`` and ``reduce(query, partials) -> answer``. A batch whose map
    fails is skipped; no relevant part gives an empty answer; a failing reduce gives the parts joined. Articles come from the relevant batches' reports.
    """
    sel = global_batches(queries, reports, top, size).join(reports.select("community", "title", "summary", "articles"), "community").join(queries.select("query_id", "query_text"), "query_id")
    per = sel.groupBy("query_id", "query_text").agg(F.array_sort(F.collect_list(F.struct("rank", "batch", "title", "summary", "articles"))).alias("reports"))

    def one(r: dict) -> dict:
        parts, articles, rows = [], [], r["reports"]
        out = {"query_id": r["query_id"], "answer": "", "articles": [], "communities_used": [x["title"] for x in rows]}
        for b in sorted({x["batch"] for x in rows}):
            batch = [x for x in rows if x["batch"] == b]
            try:
                relevant, partial = generator.map(r["query_text"], batch)
            except Exception:  # noqa: BLE001 a failed map call skips its batch
                continue
            if relevant and partial.strip():
                parts.append(partial.strip())
                articles += [a for x in batch for a in x["articles"] or []]
        if not parts:
            return out
        try:
            return out | {"answer": generator.reduce(r["query_text"], parts), "articles": articles}
        except Exception:  # noqa: BLE001 a failed reduce call keeps the parts
            return out | {"answer": "\n\n".join(parts), "articles": articles}

    out = step(per, one, f"query_id {dict(per.dtypes)['query_id']}, answer string, articles array<string>, communities_used array<string>")
    return out.select("query_id", "answer", "communities_used", sorted_articles(F.col("articles")).alias("articles_used"))
