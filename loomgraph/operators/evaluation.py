"""Retrieval and citation metrics of answers, and run-level aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.textops import squeeze
from loomgraph.operators.context import CHUNKS

# Forms of article names, chunk titles and citation lines.
ARTICLE = r"(Maddə\s+\d+|Preambula)"
CHUNK_TITLE = r"(?m)^\[(Maddə \d+|Preambula)(?:, hissə \d+)?\]\s*$"
CITATION = r"(?iu)İstinad olunan maddələr\s*:\s*(.+)"
PASS = 4


def cited(answer: Column | str) -> Column:
    """Distinct articles of the last citation line of an answer; an empty array without one."""
    a = F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit(""))
    last = F.element_at(F.regexp_extract_all(a, F.lit(CITATION), F.lit(1)), -1)
    return F.when(last.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.regexp_extract_all(last, F.lit(ARTICLE), F.lit(1)), squeeze)))


def retrieved(contexts: Column) -> Column:
    """Distinct articles that head a chunk after the last section title of each context."""
    found = F.transform(contexts, lambda c: F.regexp_extract_all(F.element_at(F.split(c, r"\Q" + CHUNKS + r"\E"), -1), F.lit(CHUNK_TITLE), F.lit(1)))
    return F.array_distinct(F.transform(F.flatten(F.coalesce(found, F.array().cast("array<array<string>>"))), squeeze))


def scores(items: DataFrame) -> DataFrame:
    """Long form (``id``, ``name``, ``value``) of the rule-based metrics.

    ``items``: ``id``, ``expected`` (array), ``should_call`` (null: whether anything is expected), ``tool_queries``, ``answer``, ``contexts``.
    """
    none = F.array().cast("array<string>")
    i = items.select(
        "id", F.array_distinct(F.transform(F.coalesce("expected", none), squeeze)).alias("exp"), "should_call",
        (F.size(F.coalesce("tool_queries", none)) > 0).alias("called"), cited("answer").alias("cited"), retrieved(F.coalesce("contexts", none)).alias("got"),
    )
    n = F.size("exp")
    hits = F.size(F.array_intersect("exp", "cited"))
    want = F.coalesce("should_call", n > 0)
    one = lambda name, v, cond: F.struct(F.lit(name).alias("name"), F.when(cond, v).cast("double").alias("value"))
    some = n > 0
    all_ = F.array(
        one("tool_call_correct", F.when(F.col("called") == want, 1.0).otherwise(0.0), F.lit(True)),
        one("retrieval_recall", F.size(F.array_intersect("exp", "got")) / n, some),
        one("citation_recall", hits / n, some),
        one("citation_precision", F.when(F.size("cited") > 0, hits / F.size("cited")).otherwise(0.0), some),
        one("no_false_citation", F.when(F.size("cited") == 0, 1.0).otherwise(0.0), ~some),
    )
    return i.select("id", F.explode(all_).alias("s")).select("id", "s.name", "s.value").filter("value is not null")


def element_coverage(items: DataFrame) -> DataFrame:
    """(``id``, ``value``): share of expected elements judged covered, at most 1; items without elements or verdicts have none.

    ``items``: ``id``, ``n_elements``, ``verdicts`` (array of booleans).
    """
    c = F.size(F.filter("verdicts", lambda v: v))
    return items.filter("n_elements > 0 and size(verdicts) > 0").select("id", (F.least(c, "n_elements") / F.col("n_elements")).alias("value"))


def pass_rate(s: DataFrame, name: str = "judge_overall", least: float = PASS) -> DataFrame:
    """(``value``, ``n``): share of scores of ``name`` at or over ``least``; no row without such scores."""
    return s.filter(F.col("name") == name).filter("value is not null").agg(F.avg(F.when(F.col("value") >= least, 1.0).otherwise(0.0)).alias("value"), F.count(F.lit(1)).alias("n")).filter("n > 0")


def averages(s: DataFrame) -> DataFrame:
    """Mean and number of every score."""
    return s.groupBy("name").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def exported(items: DataFrame, s: DataFrame) -> DataFrame:
    """``items`` with ``scores`` as a map; items without scores, such as failed ones, have an empty map."""
    m = s.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("scores"))
    return items.join(m, "id", "left").withColumn("scores", F.coalesce("scores", F.create_map().cast("map<string,double>")))
