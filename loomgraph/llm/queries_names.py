"""Queries p1 and p2: look-alike names and hidden duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import sqltext, visual
from loomgraph.llm import lookalikes, records
from loomgraph.plans.problems import registry
from loomgraph.session import table

FIELDS = ("source", "target", "relation")


def _values(spark: SparkSession, d: str) -> DataFrame:
    """(``table_name``, ``row_id``, ``field``, ``value``) of the three name columns."""
    e = table(spark, d, "entity_mention").select(F.lit("entity_mention").alias("table_name"), F.col("mention_id").alias("row_id"), F.lit("name").alias("field"), F.col("name").alias("value"))
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("field"), F.col(s).alias("value")) for s in ("source", "target")]))
    r = table(spark, d, "relation_mention").select(F.lit("relation_mention").alias("table_name"), F.col("rel_id").alias("row_id"), ends.alias("s")).select("table_name", "row_id", "s.field", "s.value")
    return e.unionByName(r)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(``table_name``, ``row_id``, ``field``): values that look like a registry name but hold other characters."""
    return lookalikes.flagged_rows(_values(spark, d), registry(spark, d)).select("table_name", "row_id", "field")


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the three name columns with its one consistent form."""
    return lookalikes.canonical_rows(_values(spark, d), registry(spark, d)).select("table_name", "row_id", "field", "form")


def _tables(spark: SparkSession, d: str) -> list[tuple]:
    """(table, rows, id, raw columns, how their fields are made): lines are parsed once they are distinct."""
    return [
        ("relation_mention", table(spark, d, "relation_mention").select("rel_id", *FIELDS), "rel_id", FIELDS, None),
        ("relation_line", table(spark, d, "relation_line").select("line_id", "line"), "line_id", ("line",), records.parsed_lines),
    ]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(``table_name``, ``first_id``, ``copy_id``): the smallest id of each set of same records with each other id."""
    a, b = (records.copy_pairs(t, i, FIELDS, raw, parse).select(F.lit(n).alias("table_name"), "first_id", "copy_id") for n, t, i, raw, parse in _tables(spark, d))
    return a.unionByName(b)


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record of either table with its number of copies and of spellings."""
    a, b = (records.collapsed(t, i, FIELDS, raw, parse).select(F.lit(n).alias("table_name"), "first_id", *FIELDS, "copies", "spellings") for n, t, i, raw, parse in _tables(spark, d))
    return a.unionByName(b)


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_records)}



def _plain(x: str) -> str:
    """The folded name without spaces, tabs, line breaks and visible punctuation, in SQL."""
    return f"regexp_replace({sqltext.folded(x)}, '[ \\t\\r\\n\\p{{P}}\\p{{S}}]+', '', 'g')"


def _tidy(x: str) -> str:
    """The normalised text, in SQL, for the characters that names have."""
    wide = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    q = lambda t: "'" + "".join(t).replace("'", "''") + "'"
    bare = f"nfc_normalize(translate(regexp_replace({x}, '[{visual.INVISIBLE}]+', '', 'g'), {q(wide)}, {q(wide.values())}))"
    words = f"string_split(trim(regexp_replace({bare}, '[\\s\\p{{Z}}]+', ' ', 'g')), ' ')"
    mixed = f"CASE WHEN regexp_matches(w, '[A-Za-zÀ-ɏ]') THEN nfc_normalize(translate(w, {q(visual.LOOKALIKES)}, {q(visual.LOOKALIKES.values())})) ELSE w END"
    return f"array_to_string(list_transform({words}, lambda w: {mixed}), ' ')"


_VALUES = """SELECT 'entity_mention' AS table_name, mention_id AS row_id, 'name' AS field, name AS value FROM entity_mention
UNION ALL SELECT 'relation_mention', rel_id, 'source', source FROM relation_mention UNION ALL SELECT 'relation_mention', rel_id, 'target', target FROM relation_mention"""
_LINES = """SELECT line_id AS id, line ->> '$.source' AS source, line ->> '$.target' AS target, line ->> '$.relation' AS relation FROM (SELECT line_id, CASE WHEN json_valid(line) THEN line END AS line FROM relation_line) WHERE line IS NOT NULL"""
_KEYS = ", ".join(f"{sqltext.letters(f)} AS k_{f}" for f in FIELDS)
_RECORDS = f"""WITH rows AS (SELECT 'relation_mention' AS table_name, rel_id AS id, source, target, relation FROM relation_mention UNION ALL SELECT 'relation_line', * FROM ({_LINES})),
keyed AS (SELECT *, {_KEYS} FROM rows), same AS (SELECT *, min(id) OVER w AS first_id, count(*) OVER w AS copies FROM keyed WHERE k_source <> '' AND k_target <> '' AND k_relation <> '' WINDOW w AS (PARTITION BY table_name, k_source, k_target, k_relation))"""
SQL = {
    "p1_found": f"""WITH v AS ({_VALUES}), d AS (SELECT value, {sqltext.visual_key('value')} AS key, {_plain('value')} AS plain FROM (SELECT DISTINCT value FROM v WHERE value IS NOT NULL)),
r AS (SELECT {sqltext.visual_key('name')} AS key, {_plain('name')} AS plain FROM (SELECT name FROM graph_node UNION SELECT name FROM core_node)),
f AS (SELECT value FROM d WHERE key <> '' AND key IN (SELECT key FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.key = d.key AND r.plain = d.plain))
SELECT table_name, row_id, field FROM v WHERE value IN (SELECT value FROM f)""",
    "p1_forms": f"""WITH v AS ({_VALUES}), d AS (SELECT value, {sqltext.visual_key('value')} AS key, {_plain('value')} AS plain, {_tidy('value')} AS tidy FROM (SELECT DISTINCT value FROM v WHERE value IS NOT NULL)),
r AS (SELECT key, plain, min(name) AS known FROM (SELECT name, {sqltext.visual_key('name')} AS key, {_plain('name')} AS plain FROM (SELECT name FROM graph_node UNION SELECT name FROM core_node) WHERE name IS NOT NULL) WHERE key <> '' GROUP BY ALL),
k AS (SELECT key, min(known) AS look FROM r GROUP BY key),
f AS (SELECT value, coalesce(known, look, tidy) AS form FROM d LEFT JOIN k USING (key) LEFT JOIN r USING (key, plain))
SELECT table_name, row_id, field, form FROM v LEFT JOIN f USING (value)""",
    "p2_found": f"{_RECORDS} SELECT table_name, first_id, id AS copy_id FROM same WHERE id <> first_id",
    "p2_records": f"{_RECORDS} SELECT table_name, first_id, arg_min(source, id) AS source, arg_min(target, id) AS target, arg_min(relation, id) AS relation, CAST(count(*) AS BIGINT) AS copies, CAST(count(DISTINCT (source, target, relation)) AS BIGINT) AS spellings FROM same GROUP BY table_name, first_id",
}
