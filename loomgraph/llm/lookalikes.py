"""Visually identical text with different characters.

The keys of look-alike names, which orphan references need as well, are in :mod:`loomgraph.functions.visual`; the
normal form of a text, the key that keeps characters apart and the operator are here.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.functions.visual import INVISIBLE_RUN, LOOK, fold, fold_col, unstable, with_visual_key
from loomgraph.operators.skew import hot_keys, split_join
from loomgraph.session import materialize

#: From this share of all rows on a value is hot; such values meet a broadcast of at most 200 rows.
HOT = 0.005


def _normal_segment(m: re.Match) -> str:
    return unicodedata.normalize("NFKC", m.group())


def tidy(s: str) -> str:
    """Normalised text for display: compatibility forms composed, invisible characters dropped, blanks single.

    Only unstable segments are normalised. Look-alike letters are replaced only in words that mix scripts, where they can only be damage.
    """
    s = unstable().sub(_normal_segment, INVISIBLE_RUN.sub("", s))
    words = s.split()
    for i, w in enumerate(words):
        t = w.translate(LOOK)
        if t != w and any("a" <= c.lower() <= "z" or 0xC0 <= ord(c) < 0x250 for c in w):
            words[i] = unicodedata.normalize("NFC", t)
    return " ".join(words)


@lru_cache(4096)
def _aside(c: str) -> bool:
    return c in " \t\r\n" or unicodedata.category(c)[0] in "PS"


def plain_key(s: str) -> str:
    """``s`` folded, without spaces, tabs, line breaks and visible punctuation; all else stays."""
    return fold(s if s.isalnum() else "".join(c for c in s if not _aside(c)))


# the body imports the module, so that nothing of it is pickled
@F.pandas_udf(StringType())
def _tidy_udf(s: pd.Series) -> pd.Series:
    from loomgraph.llm import lookalikes

    return pd.Series([None if v is None or v != v else lookalikes.tidy(v) for v in s], dtype=object)


def plain_key_col(c: Column | str) -> Column:
    """Column form of :func:`plain_key`, inside the JVM; null stays null."""
    return F.regexp_replace(fold_col(c), r"[ \t\r\n\p{P}\p{S}]+", "")


def tidy_col(c: Column | str) -> Column:
    """Column form of :func:`tidy`; null stays null."""
    return _tidy_udf(c)


def _keyed(df: DataFrame, name: str) -> DataFrame:
    return with_visual_key(df, name, "key").withColumn("plain", plain_key_col(name))


def known_names(registry: DataFrame, name: str = "name") -> DataFrame:
    """Distinct non-null registry names with their look (``key``) and their characters (``plain``); one row per (key, plain), the smallest name."""
    names = registry.select(F.col(name).alias("known")).filter("known is not null").distinct()
    return _keyed(names, "known").filter("key <> ''").groupBy("key", "plain").agg(F.min("known").alias("known"))


def value_forms(values: DataFrame, registry: DataFrame, value: str = "value", name: str = "name") -> DataFrame:
    """Per distinct non-null ``value``: ``n`` rows, ``known``, ``other`` and ``form``.

    ``known`` is the registry name that looks the same, null if there is none; with several the one with the same
    characters, else the smallest. ``other`` is true if it holds other or additional characters than every such name.
    ``form`` is ``known``, or without one the normalised text. Case, spaces, tabs, line breaks and
    visible punctuation are put aside; texts without a letter or digit match nothing. Every distinct value is
    normalised once, however often it occurs. Empty tables give empty results.
    """
    forms = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    keyed = _keyed(forms, "value").withColumn("tidy", tidy_col("value"))
    known = known_names(registry, name)
    looks = known.groupBy("key").agg(F.min("known").alias("look"))
    both = keyed.join(looks, "key", "left").join(known, ["key", "plain"], "left")
    return both.select(
        "value", "n", F.coalesce("known", "look").alias("known"),
        (F.col("look").isNotNull() & F.col("known").isNull()).alias("other"), F.coalesce("known", "look", "tidy").alias("form"),
    )


def flagged_rows(rows: DataFrame, registry: DataFrame, value: str = "value", name: str = "name") -> DataFrame:
    """The rows of ``rows`` whose ``value`` looks like a registry name but holds other characters, with ``known``.

    All columns of ``rows`` are kept; repeated rows stay as often as they are stored.
    """
    forms = materialize(value_forms(rows, registry, value, name).select("value", "n", "known", "other"), "forms")
    hot = hot_keys(forms, "value", share=HOT)
    flagged = forms.filter("other").select(F.col("value").alias(value), "known")
    return split_join(rows, flagged, value, hot)


def canonical_rows(rows: DataFrame, registry: DataFrame, value: str = "value", name: str = "name") -> DataFrame:
    """``rows`` with ``form``, the one consistent form of ``value``; null stays null."""
    forms = materialize(value_forms(rows, registry, value, name).select("value", "n", "form"), "forms")
    hot = hot_keys(forms, "value", share=HOT)
    some = split_join(rows.filter(F.col(value).isNotNull()), forms.select(F.col("value").alias(value), "form"), value, hot)
    return some.unionByName(rows.filter(F.col(value).isNull()).withColumn("form", F.lit(None).cast("string")))
