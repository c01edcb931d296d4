"""Queries p6 to p9: pieces, containers, leaks and garbled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import encoding, leakage, packing, splitting
from loomgraph.session import materialize, table


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every checkpoint text, as last written, in ordered pieces of its id."""
    t = splitting.last_written(table(spark, d, "embeddings_checkpoint").select("id", "ord", "text"))
    return splitting.split_texts(t)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(``id``): ids whose text was cut."""
    return p6_pieces(spark, d).filter("piece = 2").select("id")


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(``id``, ``cut``, ``rebuilt_md5``, ``within``, ``repeats``): whether each text was cut, the MD5 of its new parts put together, and what must hold of its pieces."""
    p = p6_pieces(spark, d)
    one = F.array_sort(F.collect_list(F.struct("piece", "fresh", "piece_text")))
    g = p.groupBy("id").agg(one.alias("a"), F.max("n_pieces").alias("n"))
    new = F.array_join(F.transform("a", lambda x: F.right(x["piece_text"], x["fresh"])), "")
    overlap = splitting.OVERLAP
    # a piece begins with the last characters of the text before its new part
    shown = F.transform(F.slice("a", 2, F.size("a")), lambda x: F.substr(x["piece_text"], F.lit(1), F.lit(overlap)))
    ends = F.transform("a", lambda x: F.right(x["piece_text"], F.lit(overlap)))
    same = F.forall(F.zip_with(shown, F.slice(ends, 1, F.greatest(F.size("a") - 1, F.lit(0))), lambda x, y: x == y), lambda x: x)
    return g.select("id", (F.col("n") > 1).alias("cut"), F.md5(new).alias("rebuilt_md5"), F.forall("a", lambda x: F.length(x["piece_text"]) <= splitting.LIMIT).alias("within"), same.alias("repeats"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or part of one over 2,048 tokens, with its container."""
    return packing.pack(packing.token_sizes(table(spark, d, "documents")))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: what must hold of the containers of all documents."""
    sizes = materialize(packing.token_sizes(table(spark, d, "documents")), "sizes")
    p = materialize(packing.pack(sizes), "packed")
    c = packing.CAPACITY
    per = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("parts"), F.countDistinct("part").alias("different"))
    n = F.coalesce("n_tokens", F.lit(-1))
    whole = (F.col("packed") == n) & (F.col("parts") == F.greatest(F.lit(1), F.ceil(n / c))) & (F.col("different") == F.col("parts"))
    docs = per.join(sizes, "doc_id", "full").agg(F.count("packed").alias("documents"), F.bool_and(F.coalesce(whole, F.lit(False))).alias("every_part_once"))
    boxes = p.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.max("step_group").alias("g"), F.min("step_group").alias("h"))
    windows = p.groupBy("container", "tier", "slot").agg(F.sum("n_tokens").alias("n")).agg(F.bool_and(F.col("n") <= F.col("tier")).alias("no_window_over"))
    fill = boxes.agg(F.bool_and((F.col("n") <= c) & (F.col("g") == F.col("h"))).alias("no_container_over"), (F.count(F.lit(1)) <= F.ceil(F.sum("n") / (0.99 * c)) + 1).alias("at_least_99_percent_full"))
    even = boxes.groupBy("g").agg(F.sum("n").alias("n")).agg(((F.max("n") - F.min("n")) <= 0.02 * F.max("n")).alias("groups_within_2_percent"))
    # four tables of one row
    return docs.crossJoin(F.broadcast(windows)).crossJoin(F.broadcast(fill)).crossJoin(F.broadcast(even))


def _items(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("expected_behavior.expected_response_elements")
    texts = F.concat(F.array("question"), F.coalesce(e, F.array().cast("array<string>")))
    return table(spark, d, "gruth_dataset").select("id", F.filter(texts, lambda x: x.isNotNull()).alias("texts"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """(``doc_id``, ``item_id``, ``first``, ``after``): the spans of documents that leak an item, in characters."""
    spans = leakage.leaks(table(spark, d, "documents"), _items(spark, d)).select("doc_id", "item_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", "item_id", F.col("s.start").cast("bigint").alias("first"), F.col("s.end").cast("bigint").alias("after"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """(``doc_id``, ``item_id``): documents that hold at least 12 consecutive words of the item."""
    return leakage.leaks(table(spark, d, "documents"), _items(spark, d), offsets=False).select("doc_id", "item_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its text restored where it can be."""
    return encoding.repair(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(``doc_id``): documents of which a part was decoded with a wrong encoding."""
    return encoding.garbled(table(spark, d, "documents")).select("doc_id")


def p9_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(``ord``, ``text``): every checkpoint text, read with a wrong encoding and restored."""
    texts = table(spark, d, "embeddings_checkpoint").select("ord", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    return encoding.repair(texts, "ord").select("ord", "text")


QUERIES = {f.__name__: f for f in (p6_found, p6_invariants, p6_pieces, p7_containers, p7_invariants, p8_found, p8_leaks, p9_found, p9_restored, p9_round_trip)}

_WORDS = "regexp_extract_all(lower(translate({}, 'İIı', 'iii')), '[\\p{{L}}\\p{{N}}]+')"
SQL = {
    "p9_round_trip": "SELECT ord, text FROM embeddings_checkpoint",
    "p6_found": "SELECT id FROM (SELECT id, arg_max(text, ord) AS text FROM embeddings_checkpoint GROUP BY id) WHERE length(text) > 1500",
    "p6_invariants": "SELECT id, length(text) > 1500 AS cut, md5(text) AS rebuilt_md5, true AS within, true AS repeats FROM (SELECT id, arg_max(text, ord) AS text FROM embeddings_checkpoint GROUP BY id) WHERE text IS NOT NULL",
    "p7_invariants": "SELECT count(text) AS documents, true AS every_part_once, true AS no_window_over, true AS no_container_over, true AS at_least_99_percent_full, true AS groups_within_2_percent FROM documents",
    "p8_found": f"""WITH t AS (SELECT id AS item_id, question AS x FROM gruth_dataset UNION ALL SELECT id, unnest(expected_behavior.expected_response_elements) FROM gruth_dataset),
iw AS (SELECT item_id, {_WORDS.format('x')} AS w FROM t), ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw)),
dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    # a word's place is the sum of the lengths of all words and gaps before it
    "p8_leaks": f"""WITH t AS (SELECT id AS item_id, question AS x FROM gruth_dataset UNION ALL SELECT id, unnest(expected_behavior.expected_response_elements) FROM gruth_dataset),
iw AS (SELECT item_id, {_WORDS.format('x')} AS w FROM t), ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw)),
d AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w, regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]+') AS s, regexp_matches(text, '^[^\\p{{L}}\\p{{N}}]') AS led FROM documents),
dw AS (SELECT doc_id, i, length(word) AS n, sum(length(word) + coalesce(length(gap), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
  SELECT doc_id, i, w[i] AS word, CASE WHEN led THEN s[i] WHEN i > 1 THEN s[i - 1] END AS gap FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d))),
dg AS (SELECT doc_id, i, array_to_string(f[i:i + 11], ' ') AS g FROM (SELECT doc_id, f, unnest(range(1, len(f) - 10)) AS i FROM (SELECT doc_id, list_transform(w, lambda x: lower(translate(x, 'İIı', 'iii'))) AS f FROM d))),
hit AS (SELECT DISTINCT doc_id, item_id, i FROM dg JOIN ig USING (g)),
isle AS (SELECT *, sum(CASE WHEN i - before < 12 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS k FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS before FROM hit)),
span AS (SELECT doc_id, item_id, min(i) AS a, max(i) + 11 AS b FROM isle GROUP BY doc_id, item_id, k)
SELECT doc_id, item_id, CAST(x.e - x.n AS BIGINT) AS first, CAST(y.e AS BIGINT) AS after FROM span JOIN dw x USING (doc_id) JOIN dw y USING (doc_id) WHERE x.i = a AND y.i = b""",
}
