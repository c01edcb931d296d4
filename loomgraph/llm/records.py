"""Duplicates hidden by formatting differences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.visual import letters_col
from loomgraph.operators.skew import hot_keys, split_join
from loomgraph.session import materialize

HOT = 0.005
_RECORD = "source string, target string, relation string, strength bigint, _bad string"


def parsed_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with the fields of the JSON object in ``line``; rows that are not one JSON object are left out.

    The order of the fields, blanks and escapes between them make no difference. A missing field is null.
    """
    r = F.from_json(F.col(line), _RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    whole = F.col(line).rlike(r"(?s)^\s*\{.*\}\s*$")
    return lines.filter(whole).withColumn("_r", r).filter("_r is not null and _r._bad is null").select(*lines.columns, "_r.source", "_r.target", "_r.relation", "_r.strength")


def survivors(rows: DataFrame, row_id: str, fields: Sequence[str], raw: Sequence[str] | None = None, parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Byte-identical rows collapsed: the ``raw`` columns and ``fields``, ``copies``, ``low`` and ``high`` id, and the canonical text ``c0``.. per field.

    ``parse`` makes the fields from the ``raw`` columns (default: they are the fields), of distinct rows only. Only the distinct survivors are
    canonicalised (letters and digits, case aside). Rows in which a field is null or has no letter or digit are left out.
    """
    raw = list(raw or fields)
    distinct = rows.select(F.col(row_id).alias("_id"), *raw).dropna(subset=raw).groupBy(*raw).agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("low"), F.max("_id").alias("high"))
    if parse is not None:
        distinct = parse(distinct).dropna(subset=list(fields))
    canon = distinct.select(*dict.fromkeys([*raw, *fields]), "copies", "low", "high", *[letters_col(f).alias(f"c{i}") for i, f in enumerate(fields)])
    return canon.filter(" and ".join(f"c{i} <> ''" for i in range(len(fields))))


def collapsed(rows: DataFrame, row_id: str, fields: Sequence[str], raw: Sequence[str] | None = None, parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per record: ``first_id``, ``fields`` as the smallest survivor's first row has them, ``copies``, ``spellings``.

    Two levels: identical rows, then survivors by full canonical text, so a record with billions of copies is a
    few partial counts. Ids are unique; of rows with the same id both count. Empty tables give no rows.
    """
    keys = [f"c{i}" for i in range(len(fields))]
    s = survivors(rows, row_id, fields, raw, parse)
    if parse is not None:  # rows of other bytes may have the same fields
        s = s.groupBy(*fields, *keys).agg(F.sum("copies").alias("copies"), F.min("low").alias("low"))
    g = s.groupBy(*keys).agg(F.min("low").alias("first_id"), F.min_by(F.struct(*fields), F.col("low")).alias("_f"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("spellings"))
    return g.select("first_id", *[F.col(f"_f.{f}").alias(f) for f in fields], "copies", "spellings")


def copy_pairs(rows: DataFrame, row_id: str, fields: Sequence[str], raw: Sequence[str] | None = None, parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(``first_id``, ``copy_id``): the smallest id of every record that has copies, with each of the others.

    Ids of survivors stored once or twice are known from the first level; only rows of survivors stored more often are looked up again, by
    two 64-bit hashes of their bytes, so that ids and hashes travel and no texts; those of hot ones meet a broadcast of a bounded number of keys.
    """
    raw = list(raw or fields)
    keys = [f"c{i}" for i in range(len(fields))]
    marks = [F.xxhash64(*raw).alias("_h"), F.xxhash64(F.lit("second"), *reversed(raw)).alias("_g")]
    s = materialize(survivors(rows, row_id, fields, raw, parse).select(*keys, "copies", "low", "high", *marks), "survivors")
    g = s.groupBy(*keys).agg(F.min("low").alias("first_id"), F.sum("copies").alias("_all")).filter("_all > 1").drop("_all")
    dup = materialize(s.join(g, keys).select("_h", "_g", "copies", "low", "high", "first_id"), "copies")
    few = dup.filter("copies <= 2").select("first_id", F.explode(F.array_distinct(F.array("low", "high"))).alias("copy_id"))
    many = dup.filter("copies > 2")
    by_hash = many.groupBy("_h").agg(F.collect_list(F.struct("_g", "first_id")).alias("_m"), F.sum("copies").alias("n"))
    hot = hot_keys(by_hash.select("_h", "n"), "_h", share=HOT)
    all_rows = rows.select(F.col(row_id).alias("copy_id"), *raw).dropna(subset=raw).select("copy_id", *marks)
    met = split_join(all_rows, by_hash.select("_h", "_m"), "_h", hot).select("copy_id", "_g", F.explode("_m").alias("m")).filter("_g = m._g")
    return few.unionByName(met.select("m.first_id", "copy_id")).filter("first_id <> copy_id")
