import pytest

from loomgraph.functions import visual as V


@pytest.mark.parametrize("a,b", [("Хаӏԛ Үıɡ̆ınсаɡ̆ı", "Xalq Yığıncağı"), ("ｕｃａ​ ｄｉｖａｎ", "Uca Divan"), ("Ⅱ dərəcəli", "II dərəcəli"), ("İcra", "İcra"), ("Совет", "СОВЕТ"), ("РННТ 2", "PHHT-2")])
def test_look_alikes_share_a_key(a, b):
    assert V.visual_key(a) == V.visual_key(b)


@pytest.mark.parametrize("s", ["\u09c7\u09be", "\u0bc6\u0bbe", "\u1025\u102e", "\u0cc6\u0cc2\u0cd5", "x\u1100\u1161\u11a8"])
def test_characters_that_may_compose_do(s):
    import unicodedata

    assert V.skeleton(s) == unicodedata.normalize("NFC", s) != s


@pytest.mark.parametrize("a,b", [("ᎪᏴ", "AB"), ("ϲ", "c"), ("ոս", "nu"), ("ԌѴ", "GV"), ("ѵѡ", "vw"), ("Ϝ", "F")])
def test_letters_of_rare_scripts_look_alike(a, b):
    assert V.visual_key(a) == V.visual_key(b) and V.visual_key(a.lower()) == V.visual_key(a.upper())


def test_letters_case_pairs_differ():
    assert V.visual_key("DIVAN") != V.visual_key("divan")


def test_column_forms_and_nulls(spark):
    vals = ["Uca Divan", None, "", "Uсa Divan", "x" * 5000 + "é", "  "]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = {r.s: r.k for r in V.with_visual_key(df, "s", "k").collect()}
    assert got == {v: None if v is None else V.visual_key(v) for v in vals}
