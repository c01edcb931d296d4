"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1500
OVERLAP = 120

# after a full stop, semicolon and the like, closing quotes and blanks; not after a number, a single letter or a two-letter abbreviation
_ENDED = r"(?<=[.!?…;:][\"»”’)\]]{0,2}\s{1,9})(?<!(?:^|[\s(«\"])(?:\p{L}{1,2}|\d{1,4}|[IVXLCDM]{1,6})\.\s{1,9})(?=[\p{Lu}\p{N}«\"“(—–-])"
_COLON = r"(?<!:[\"»”’)\]]{0,2}\s{1,9})"
_SENTENCE = _ENDED + _COLON
# a line that starts with a number, a Roman numeral, a letter in brackets or a dash begins a clause
_CLAUSE = r"(?<=[\r\n][ \t]{0,9})(?=(?:[IVXLCDM]{1,6}[.)]|\d{1,3}(?:\.\d{1,3}){0,2}[.)]|\(?\p{L}\)|[—–•-])\s)"
_LINE = r"(?<=[\r\n]{1,4})(?=[^\r\n])"


def pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """One piece of new text: alternatives ordered by the strength of the boundary they end at.

    The rest if it fits; a clause in the farther half; a sentence; a clause or a line; after a comma; a word; characters. Bounded
    quantifiers take as much as fits. A cut with at most ``overlap`` new characters is never the first and is taken only at a sentence, clause or
    line that is followed by none within the limit.
    """
    w = limit - overlap
    if overlap < 0 or w <= 2 * overlap + 1:
        raise ValueError("the limit must be more than three times the overlap")
    low = overlap + 1
    ends = [f".{{{max(low, w // 2)},{w}}}{_CLAUSE}", f".{{{low},{w}}}{_SENTENCE}", f".{{{low},{w}}}{_CLAUSE}", f".{{{low},{w}}}{_LINE}"]
    ends += [f"(?!\\A).{{1,{overlap}}}{b}" for b in (_SENTENCE, _CLAUSE, _LINE) if overlap]
    return "(?s)(?:" + "|".join([f".{{1,{w}}}\\z", *ends, f".{{{low},{w}}}(?<=,\\s)(?=\\S)", f".{{{low},{w}}}(?<=\\s)(?=\\S)", f".{{1,{w}}}(?!\\p{{M}})", f".{{1,{w}}}"]) + ")"


def split_texts(df: DataFrame, key: str = "id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text: the ``key``, ``piece`` from 1, ``n_pieces``, ``fresh`` and ``piece_text``.

    A text of at most ``limit`` characters is one piece. Otherwise no piece is over ``limit``; each after the first
    begins with the ``overlap`` characters before its first new one, and the new parts (the last ``fresh`` characters of each piece)
    put together are the text. Empty texts give one empty piece, null texts none; a null key stays null. Rows with
    the same key are split each on its own. Texts of any length are split whole, in one expression of the plan. Other
    columns are dropped; an empty table gives no rows.
    """
    t = df.select(F.col(key).alias("_key"), F.col(text).alias("_t")).filter("_t is not null")
    segs = F.when(F.length("_t") <= limit, F.array("_t")).otherwise(F.regexp_extract_all("_t", F.lit(pattern(limit, overlap)), F.lit(0)))
    t = t.select("_key", segs.alias("_s")).withColumn("_before", F.transform("_s", lambda _, i: F.when(i == 0, F.lit("")).otherwise(F.right(F.concat(F.when(i > 1, F.element_at("_s", i - 1)).otherwise(F.lit("")), F.element_at("_s", i)), F.lit(overlap)))))
    pieces = t.select("_key", F.size("_s").alias("n_pieces"), F.posexplode(F.arrays_zip(F.col("_s").alias("seg"), F.col("_before").alias("before"))).alias("_p", "x"))
    return pieces.select(
        F.col("_key").alias(key), (F.col("_p") + 1).alias("piece"), "n_pieces",
        F.length("x.seg").alias("fresh"), F.concat("x.before", "x.seg").alias("piece_text"),
    )


def last_written(df: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The row with the highest ``order`` per key; a null key counts as one key."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
