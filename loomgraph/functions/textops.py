"""Column functions on strings: keys, clips, labels, tokens, hashes. Null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The grammar of chunk ids and the labels made of it.
CHUNK_ID = r"^(?:.*__)?(madde_(\d+)|preambula)(?:_p(\d+))?$"
PREAMBLE, ARTICLE, PART = "Preambula", "Maddə ", ", hissə "
# Patterns of retry delays and of daily quotas in error messages.
RETRY_DELAY = r"retryDelay['\"]?\s*:\s*['\"](\d+(?:\.\d+)?)s"
DAILY_QUOTA = r"(?i)per[\s_-]?day|daily"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else unicodedata.normalize("NFC", v) for v in s], dtype=object)


def nfc(c: Column | str) -> Column:
    """Canonical composition; Spark has no built-in for it. Texts of common characters are composed as they are and stay in the JVM."""
    x = _c(c)
    plain = F.coalesce(~x.rlike(r"[^\x00-\x7fçğıöşüəÇĞİÖŞÜƏа-яёА-ЯЁ]"), F.lit(True))
    return F.when(plain, x).otherwise(_nfc(F.when(~plain, x)))


def strip(c: Column | str) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Every run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def name_key_az(c: Column | str, composed: bool = False) -> Column:
    """Key of a name with the Azerbaijani pairs İ/i and I/ı; ``composed`` says that the text is NFC already."""
    x = _c(c) if composed else nfc(c)
    return squeeze(F.lower(F.translate(x, "İI", "iı")))


def name_key_plain(c: Column | str) -> Column:
    """Key of a name: lower case, single blanks."""
    return squeeze(F.lower(_c(c)))


def tokens(c: Column | str) -> Column:
    """Words of the lower-case text: letters, numbers and underscores."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def clip_words(c: Column | str, n: int) -> Column:
    """At most ``n`` characters, cut at the last blank before; without a blank after ``n``."""
    x = _c(c)
    return F.when(F.length(x) <= n, x).otherwise(F.regexp_replace(F.substring(x, 1, n), r"(?s) [^ ]*$", ""))


def clip_hard(c: Column | str, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(_c(c), 1, n)


def short_title(c: Column | str, n: int = 40) -> Column:
    """One line of at most ``n`` characters, the last one an ellipsis if more was there."""
    x = F.regexp_replace(strip(c), r"\n", " ")
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n - 1), F.lit("…")))


def truncate(c: Column | str, n: int = 200) -> Column:
    """The first ``n`` characters of one line and an ellipsis if more was there."""
    x = F.regexp_replace(strip(c), r"\n", " ")
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n), F.lit("…")))


def entity_text(name: Column, kind: Column, description: Column, n: int = 600) -> Column:
    """What an entity is embedded as."""
    return clip_words(F.concat(name, F.lit(" ("), kind, F.lit("): "), description), n)


def edge_text(source: Column, target: Column, description: Column, n: int = 600) -> Column:
    """What a relation is embedded as."""
    return clip_words(F.concat(source, F.lit(" → "), target, F.lit(": "), description), n)


def report_text(title: Column, summary: Column, n: int = 600) -> Column:
    """What a report is embedded as."""
    return clip_words(F.concat(title, F.lit(": "), summary), n)


def article_of(chunk_id: Column | str) -> Column:
    """The article that a chunk id names; null if it names none."""
    x = _c(chunk_id)
    n = F.regexp_extract(x, CHUNK_ID, 2)
    return F.when(~x.rlike(CHUNK_ID), None).when(n == "", F.lit(PREAMBLE)).otherwise(F.concat(F.lit(ARTICLE), n))


def chunk_label(chunk_id: Column | str) -> Column:
    """Article and part of a chunk id; an id of another form as it is."""
    x = _c(chunk_id)
    part = F.regexp_extract(x, CHUNK_ID, 3)
    base = article_of(x)
    return F.coalesce(F.when(part == "", base).otherwise(F.concat(base, F.lit(PART), part)), x)


def article_order(label: Column | str) -> Column:
    """Sort key of article labels: the preamble first, then by number."""
    x = _c(label)
    return F.when(x == PREAMBLE, F.lit(0).cast("bigint")).otherwise(F.regexp_extract(x, r"(\d+)$", 1).try_cast("bigint"))


def sorted_articles(labels: Column) -> Column:
    """Distinct article labels of an array in article order; nulls are left out."""
    keyed = F.transform(F.array_distinct(F.filter(labels, lambda x: x.isNotNull())), lambda x: F.struct(article_order(x).alias("n"), x.alias("label")))
    return F.transform(F.array_sort(keyed), lambda x: x["label"])


def source_suffix(chunk_ids: Column, most: int = 3) -> Column:
    """' [Maddə 8, Maddə 12]' for 1 to ``most`` articles of chunk ids, else an empty text."""
    a = sorted_articles(F.transform(chunk_ids, article_of))
    return F.when(F.size(a).between(1, most), F.concat(F.lit(" ["), F.array_join(a, ", "), F.lit("]"))).otherwise("")


def slug(c: Column | str, default: str = "doc") -> Column:
    """Namespace of a file name: other characters than ASCII letters, digits and underscores become one underscore."""
    x = F.lower(F.regexp_replace(F.regexp_replace(_c(c), r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", ""))
    return F.when(x == "", default).otherwise(x)


def token_estimate(c: Column | str) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(c)) / 4)).cast("bigint")


def vector_key(c: Column | str, model: str = "gemini-embedding-001", dim: int = 768, task: str = "RETRIEVAL_DOCUMENT") -> Column:
    """Content address of an embedded text."""
    return F.sha1(F.concat_ws("|", F.lit(model), F.lit(str(dim)), F.lit(task), _c(c)))


def summary_hash(subject: Column | str, descriptions: Column | str) -> Column:
    """First 12 hex digits of the MD5 of the JSON array [subject, *descriptions] written with ', ' between."""
    parts = F.transform(F.concat(F.array(_c(subject)), _c(descriptions)), _json_string)
    return F.substring(F.md5(F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))), 1, 12)


def _json_string(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)


def mask_key(c: Column | str) -> Column:
    """A secret with its middle hidden."""
    x = _c(c)
    return F.when(F.length(x) <= 10, F.lit("***")).otherwise(F.concat(F.substring(x, 1, 6), F.lit("..."), F.right(x, F.lit(4))))


def retry_delay(c: Column | str) -> Column:
    """Seconds that an error message asks to wait, null if it asks for none."""
    return F.regexp_extract(_c(c), RETRY_DELAY, 1).try_cast("double")


def is_daily_quota(c: Column | str) -> Column:
    """Whether an error message is about the quota of a day."""
    return _c(c).rlike(DAILY_QUOTA)


def flatten_content(blocks: Column, sep: str = "\n") -> Column:
    """Text blocks of a message joined; blocks of other kinds are left out."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), sep)
