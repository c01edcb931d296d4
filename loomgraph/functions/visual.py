"""Keys of names: Azerbaijani case folding, look-alike skeletons and plain forms.

``visual_key`` is equal for two names that look the same, case, blanks and
punctuation aside. Only segments that are not already stable are normalised: a regular
expression built from the normalisation quick-check properties finds them, each
with the starter before it, and the canonical segment is spliced back.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that look like another letter, and that letter.
# Cyrillic and Greek small letters whose capitals look alike follow their capital, as case is put aside.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ә": "Ə", "Һ": "H", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ү": "y", "ә": "ə", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "β": "b", "ε": "e", "ζ": "z", "η": "h", "ι": "ı", "κ": "k", "μ": "m", "ν": "n", "ο": "o", "ρ": "p", "τ": "t", "υ": "y", "χ": "x",
    "Օ": "O", "օ": "o", "ɡ": "g", "ǝ": "ə", "Ǝ": "Ə", "∆": "Δ", "ꞓ": "c", "ɑ": "a",
    "Ԍ": "G", "Ѵ": "V", "Ѡ": "W", "Ꮃ": "W", "Ꮩ": "V", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮓ": "Z", "Ϲ": "C", "Ϳ": "J", "Ϝ": "F", "Ո": "N", "Ս": "U", "Տ": "S", "Հ": "H", "Յ": "J", "Ց": "G", "Լ": "L",
}
# the other case of a letter looks like the other case of its look-alike, or is put aside with it
LOOKALIKES |= {o: v for k, v in LOOKALIKES.items() for o in (k.lower(), k.upper()) if len(o) == 1 and o not in LOOKALIKES and o.lower() == k.lower()}
# Characters that show nothing (default ignorable), as ranges.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8"

LOOK = str.maketrans(LOOKALIKES)
_AZ = str.maketrans("İI", "iı")
INVISIBLE_RUN = re.compile(f"[{INVISIBLE}]+")
_CACHE = 100_000


def fold(s: str) -> str:
    """Lower case with the Azerbaijani pairs İ/i and I/ı."""
    return s.translate(_AZ).lower()


def _ranges(cps: list[int]) -> str:
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(re.escape(chr(cps[i])) + (f"-{re.escape(chr(cps[j]))}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(1)
def unstable() -> re.Pattern:
    """A starter followed by characters that quick-check No or Maybe, combine, show nothing or look like others.

    Maybe are the characters that a composite has in second place, some of which are starters themselves.
    """
    maybe = set()
    for cp in range(0xC0, 0x2FA20):
        d = unicodedata.decomposition(chr(cp))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            maybe.add(int(d.split()[1], 16))
    invisible = INVISIBLE_RUN
    bad = []
    for cp in range(0x80, 0x323B0):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp < 0x2F800:
            continue
        c = chr(cp)
        if cp in maybe or unicodedata.combining(c) or 0x1160 <= cp <= 0x11FF or not unicodedata.is_normalized("NFKC", c) or invisible.match(c) or c in LOOKALIKES or any(x in LOOKALIKES for x in unicodedata.normalize("NFKD", c)):
            bad.append(cp)
    return re.compile(f".?[{_ranges(bad)}]+", re.S)


# Characters beyond ASCII that Azerbaijani and Turkish names have; all are stable.
_COMMON = "çğıöşüəÇĞİÖŞÜƏ"


def stable_col(c: Column | str) -> Column:
    """Whether a text has only characters known to be stable, so that it is its own skeleton; null for null.

    A short class of common characters is quick to test; texts with any other character count as not stable, which costs time only.
    """
    c = F.col(c) if isinstance(c, str) else c
    return ~c.rlike(f"[^\\x00-\\x7f{_COMMON}]")


def _canonical_segment(m: re.Match) -> str:
    s = INVISIBLE_RUN.sub("", unicodedata.normalize("NFKD", m.group().translate(LOOK)))
    return unicodedata.normalize("NFC", s.translate(LOOK))


def skeleton(s: str) -> str:
    """``s`` with every unstable segment replaced by its canonical look; case and blanks stay."""
    if s.isascii():
        return s
    # a mark may follow an invisible character, so both go before the segments are cut
    s = INVISIBLE_RUN.sub("", s)
    return unstable().sub(_canonical_segment, s)


def _alnum(s: str) -> str:
    return s if s.isalnum() else "".join(filter(str.isalnum, s))


def visual_key(s: str) -> str:
    """Letters and digits of the folded skeleton: equal for names that look the same."""
    return _alnum(fold(skeleton(s)).replace("i\u0307", "i"))


_cached_key = lru_cache(_CACHE)(visual_key)


def _mapped(f, s: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else f(v) for v in s], dtype=object)


def visual_keys(s: pd.Series) -> pd.Series:
    """Keys of a batch; short names are remembered, as most occur again."""
    return _mapped(lambda v: _cached_key(v) if len(v) < 200 else visual_key(v), s)


# the bodies import the module, so workers share its caches and nothing of it is pickled
@F.pandas_udf(StringType())
def _visual_key_udf(s: pd.Series) -> pd.Series:
    from loomgraph.functions import visual

    return visual.visual_keys(s)


def visual_key_col(c: Column | str) -> Column:
    """Column form of :func:`visual_key`; null stays null."""
    return _visual_key_udf(c)


def with_visual_key(df: DataFrame, c: str, out: str) -> DataFrame:
    """``df`` with the visual key of column ``c``: stable texts get theirs inside the JVM, only the others go to Python. Use it on distinct names."""
    marked = df.withColumn("_stable", F.coalesce(stable_col(c), F.lit(True)))
    return marked.withColumn(out, F.when(F.col("_stable"), letters_col(c)).otherwise(visual_key_col(F.when(~F.col("_stable"), F.col(c))))).drop("_stable")


def fold_col(c: Column | str) -> Column:
    """Azerbaijani lower case inside the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.translate(c, "İI", "iı"))


def letters_col(c: Column | str) -> Column:
    """Letters and digits of the folded text, inside the JVM."""
    return F.regexp_replace(fold_col(c), r"[^\p{L}\p{N}]+", "")
