"""Search results as text for a model, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.textops import article_of, chunk_label, clip_hard, sorted_articles, source_suffix

# Titles of the sections and fixed lines.
ENTITIES = "## Entity-lər (bilik qrafı)"
RELATIONS = "## Əlaqələr (bilik qrafı)"
REPORTS = "## Mövzu xülasələri (community report)"
CHUNKS = "## Mətn parçaları (Konstitusiya)"
GLOBAL = "## Qlobal Sintez (bilik qrafının mövzu qruplarından)"
CITED = "İstinad olunan maddələr: "
NOT_FOUND = "tapılmadı"
USED = "(Nəzərə alınan mövzu qrupları: "
NO_RELATIONS = "(bu community daxilində əlaqə yoxdur)"
CHUNK_SEP = "\n\n---\n\n"


def lines(df: DataFrame, by: str, line: Column, order: str, out: str, sep: str = "\n") -> DataFrame:
    """(``by``, ``out``): the lines of a group in ``order``, joined."""
    g = df.select(by, F.col(order).alias("_o"), line.alias("_l")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_o", "_l"))).alias("_a"))
    return g.select(by, F.array_join(F.transform("_a", lambda x: x["_l"]), sep).alias(out))


def entity_lines(df: DataFrame, by: str = "query_id", order: str = "rank") -> DataFrame:
    """Entities (``name``, ``type``, ``description``, ``source_chunks``) as a list."""
    return lines(df, by, F.concat(F.lit("- "), "name", F.lit(" ("), F.coalesce("type", F.lit("")), F.lit("): "), "description", source_suffix(F.col("source_chunks"))), order, "entities")


def relation_lines(df: DataFrame, by: str = "query_id", order: str = "rank") -> DataFrame:
    """Relations (``source``, ``target``, ``description``, ``source_chunks``) as a list."""
    return lines(df, by, F.concat(F.lit("- "), "source", F.lit(" → "), "target", F.lit(": "), "description", source_suffix(F.col("source_chunks"))), order, "relations")


def report_lines(df: DataFrame, by: str = "query_id", order: str = "rank") -> DataFrame:
    """Reports (``title``, ``summary``) as a list."""
    return lines(df, by, F.concat(F.lit("- ["), "title", F.lit("] "), "summary"), order, "reports")


def chunk_blocks(df: DataFrame, by: str = "query_id", order: str = "rank") -> DataFrame:
    """Chunks (``id``, ``text``) as titled blocks."""
    return lines(df, by, F.concat(F.lit("["), chunk_label("id"), F.lit("]\n"), "text"), order, "chunks", CHUNK_SEP)


def local_context(queries: DataFrame, entities: DataFrame, relations: DataFrame, reports: DataFrame | None, chunks: DataFrame, by: str = "query_id") -> DataFrame:
    """(``by``, ``context``): titled sections with a blank line between, those without a row left out."""
    out = queries.select(by).distinct()
    parts = [(ENTITIES, entity_lines(entities, by), "entities"), (RELATIONS, relation_lines(relations, by), "relations")]
    if reports is not None:
        parts.append((REPORTS, report_lines(reports, by), "reports"))
    parts.append((CHUNKS, chunk_blocks(chunks, by), "chunks"))
    for _, df, _ in parts:
        out = out.join(df, by, "left")
    # concat is null for an absent section, and concat_ws leaves nulls out
    return out.select(by, F.concat_ws("\n\n", *[F.concat(F.lit(title + "\n"), F.col(c)) for title, _, c in parts]).alias("context"))


def global_context(answer: Column, articles: Column, used: Column) -> Column:
    """The answer of a global search with its articles and groups; empty without an answer."""
    cited = F.when(F.size(articles) > 0, F.array_join(articles, ", ")).otherwise(NOT_FOUND)
    text = F.concat(F.lit(GLOBAL + "\n"), answer, F.lit("\n\n" + CITED), cited, F.lit("\n" + USED), F.array_join(used, ", "), F.lit(")"))
    return F.when(F.coalesce(answer, F.lit("")) == "", "").otherwise(text)


def community_articles(members: DataFrame, nodes: DataFrame, by: str = "community") -> DataFrame:
    """(``by``, ``articles``): article labels of the members' chunks, in order. ``members`` has (``by``, ``key``)."""
    labels = members.join(nodes.select("key", F.explode("source_chunks").alias("chunk_id")), "key").select(by, article_of("chunk_id").alias("label")).filter("label is not null").distinct()
    return labels.groupBy(by).agg(sorted_articles(F.collect_list("label")).alias("articles"))


def member_ranks(members: DataFrame, edges: DataFrame, by: str = "community", most: int = 40) -> DataFrame:
    """(``by``, ``key``, ``degree``, ``rank``): members by degree in the whole graph, ties by key; the first ``most``."""
    from loomgraph.operators.graph import degrees
    from loomgraph.operators.search import ranked

    d = members.join(degrees(edges), "key", "left").select(by, "key", F.coalesce("degree", F.lit(0)).alias("degree"))
    return ranked(d, [by], [F.desc("degree"), F.asc("key")], most)


def internal_edges(members: DataFrame, edges: DataFrame, by: str = "community", most: int = 40) -> DataFrame:
    """(``by``, ``src``, ``tgt``, ``rank``): edges with both ends in a community, the first ``most`` in edge order."""
    from loomgraph.operators.search import ranked

    a = members.select(F.col(by).alias("ca"), F.col("key").alias("src"))
    b = members.select(F.col(by).alias("cb"), F.col("key").alias("tgt"))
    e = edges.join(a, "src").join(b, "tgt").filter("ca = cb").withColumnRenamed("ca", by).drop("cb")
    return ranked(e, [by], [F.asc("ord"), F.asc("src"), F.asc("tgt")], most)


def report_inputs(members: DataFrame, nodes: DataFrame, edges: DataFrame, by: str = "community", most: int = 40) -> DataFrame:
    """(``by``, ``entities``, ``relations``): what a report is written from; a fixed line where there are no relations."""
    n = nodes.select("key", "name", "type", "description")
    ents = member_ranks(members, edges, by, most).join(n, "key")
    e = lines(ents, by, F.concat(F.lit("- "), "name", F.lit(" ("), F.coalesce("type", F.lit("")), F.lit("): "), clip_hard("description", 200)), "rank", "entities")
    names = n.select("key", "name")
    rels = internal_edges(members, edges, by, most).join(names.withColumnsRenamed({"key": "src", "name": "source"}), "src").join(names.withColumnsRenamed({"key": "tgt", "name": "target"}), "tgt")
    r = lines(rels, by, F.concat(F.lit("- "), "source", F.lit(" → "), "target", F.lit(": "), clip_hard("description", 150)), "rank", "relations")
    return e.join(r, by, "left").withColumn("relations", F.coalesce("relations", F.lit(NO_RELATIONS)))
