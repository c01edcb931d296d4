"""Segmentation of legal texts: headers, clauses, sentences and greedy packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.textops import strip

MAX_CHARS = 1500
# The forms of article headers, clause numbers and sentence ends.
HEADER = r"Maddə\s+\d+[.\-–]"
CLAUSE = r"^[IVXLCDM]{1,6}\.\s"
SENTENCE = r"(?<=[.!?])\s+(?=[A-ZƏÖÜŞÇĞİ0-9])"


def clauses(body: Column) -> Column:
    """Clauses of a text, each with its number; what stands before the first is dropped, a text without numbers is one clause."""
    parts = F.split(body, f"(?dmU)(?={CLAUSE})")
    marked = F.filter(parts, lambda x: x.rlike(f"(?U){CLAUSE}"))
    one = strip(body)
    return F.when(F.size(marked) > 0, F.transform(marked, strip)).when(one == "", F.array().cast("array<string>")).otherwise(F.array(one))


def sentences(text: Column) -> Column:
    """Sentences of a text, blank ones left out."""
    return F.filter(F.split(text, f"(?U){SENTENCE}"), lambda s: strip(s) != "")


def units(body: Column, limit: int = MAX_CHARS) -> Column:
    """Clauses; those over ``limit`` as sentences."""
    return F.flatten(F.transform(clauses(body), lambda c: F.when(F.length(c) <= limit, F.array(c)).otherwise(sentences(c))))


def pack(header: Column, parts: Column, limit: int = MAX_CHARS) -> Column:
    """Parts put together in order to at most ``limit`` characters, the header before each; a part over it stays whole."""
    h = F.length(header)
    clean = F.filter(F.transform(parts, strip), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), header.alias("cur"), h.alias("n"))

    def add(a: Column, s: Column) -> Column:
        full = (a["n"] > h) & (a["n"] + F.length(s) + 1 > limit)
        cur, n = F.when(full, header).otherwise(a["cur"]), F.when(full, h).otherwise(a["n"])
        return F.struct(
            F.when(full, F.array_append(a["done"], strip(a["cur"]))).otherwise(a["done"]).alias("done"),
            F.concat(cur, F.when(n == h, F.lit("\n")).otherwise(F.lit(" ")), s).alias("cur"), (n + F.length(s) + 1).alias("n"),
        )

    def end(a: Column) -> Column:
        last = F.when(strip(a["cur"]) != strip(header), F.array_append(a["done"], strip(a["cur"]))).otherwise(a["done"])
        return F.when(F.size(last) > 0, last).otherwise(F.array(strip(header)))

    return F.aggregate(clean, start, add, end)


def split_headers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``pos``, ``header``, ``body``): the text before the first header has a null header."""
    parts = F.split(F.col(text), f"(?iuU)(?={HEADER})")
    p = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("pos", "_part"))
    head = F.regexp_extract("_part", f"(?iuU)^({HEADER})", 1)
    p = p.withColumn("_h", head)
    return p.select(key, "pos", F.when(F.col("_h") != "", strip(F.col("_h"))).alias("header"), strip(F.substr(F.col("_part"), F.length("_h") + 1)).alias("body")).filter("header is not null or body <> ''")


def chunk_articles(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_CHARS) -> DataFrame:
    """(``key``, ``ord``, ``id``, ``text``): one chunk per article, long ones in numbered parts; a preamble before the first header."""
    p = split_headers(df, key, text)
    full = strip(F.concat("header", F.lit(" "), "body"))
    chunks = F.when(F.col("header").isNull(), F.array("body")).when(F.length(full) <= limit, F.array(full)).otherwise(pack(F.col("header"), units(F.col("body"), limit), limit))
    number = F.concat(F.lit("madde_"), F.regexp_extract("header", r"(\d+)", 1))
    base = F.when(F.col("header").isNull(), F.lit("preambula")).otherwise(number)
    out = p.select(key, "pos", base.alias("base"), (F.col("header").isNotNull() & (F.length(full) > limit)).alias("long"), F.posexplode(chunks).alias("part", "text"))
    return out.select(key, F.struct("pos", "part").alias("ord"), F.when(F.col("long"), F.concat("base", F.lit("_p"), F.col("part") + 1)).otherwise(F.col("base")).alias("id"), "text")
