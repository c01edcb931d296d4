"""SQL text of the name keys, for checking the Spark operators in another engine."""

from __future__ import annotations

from loomgraph.functions.visual import INVISIBLE, LOOKALIKES

# full-width forms stand at a fixed distance from ASCII
_WIDE = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_MORE = {"ӧ": "ö", "Ӧ": "Ö"}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def folded(x: str) -> str:
    """Azerbaijani lower case."""
    return f"lower(translate({x}, 'İI', 'iı'))"


def letters(x: str) -> str:
    """Letters and digits of the folded text."""
    return f"regexp_replace({folded(x)}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def visual_key(x: str) -> str:
    """The look-alike key of a name."""
    pairs = LOOKALIKES | _WIDE | _MORE
    bare = f"regexp_replace({x}, '[{INVISIBLE}]+', '', 'g')"
    # Roman numeral signs that names use
    for sign, text in (("Ⅷ", "VIII"), ("Ⅶ", "VII"), ("Ⅵ", "VI"), ("Ⅳ", "IV"), ("Ⅴ", "V"), ("Ⅸ", "IX"), ("Ⅲ", "III"), ("Ⅱ", "II"), ("Ⅰ", "I"), ("Ⅹ", "X")):
        bare = f"replace({bare}, '{sign}', '{text}')"
    canon = f"nfc_normalize(translate({bare}, {_quoted(''.join(pairs))}, {_quoted(''.join(pairs.values()))}))"
    return letters(canon)
