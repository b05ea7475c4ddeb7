"""Text rules on fixed examples, and against plain Python on random strings."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regelspur.functions import replies, titles
from regelspur.functions import text as T


def run(spark, f, values, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


#: Text, its normal form, its repaired form: one case a rule.
CASES = [
    ("Schalt\u00adtafel und Kran\u00ad\n tisch", "schalttafel und krantisch", "Schalttafel und Krantisch"),
    ("Leiter-\nprüfung", "leiterprüfung", "Leiterprüfung"),
    ("Kabel-\n  Trommel", "kabeltrommel", "Kabel-Trommel"),
    ("Regel 77-\n12", "regel 7712", "Regel 77-12"),
    ("Haupt-\noder Nebenkran", "hauptoder nebenkran", "Haupt- oder Nebenkran"),
    ("5\u00a0mm und\u20097\u202fkg", "5 mm und 7 kg", "5 mm und 7 kg"),
    ("Wert\x07 steht", "wert\x07 steht", "Wert steht"),
    ("eins \nzwei\n\n\n drei\t", "eins zwei drei", "eins zwei\n\n drei"),
    ("\u201eKran\u201c \u2013 Tor", '"kran" - tor', "\u201eKran\u201c \u2013 Tor"),
    ("  Rand  ", "rand", "Rand"),
    ("", "", ""),
    (None, None, None),
]


def test_normalise_and_clean(spark):
    texts = [c[0] for c in CASES]
    assert run(spark, T.normalise, texts) == [c[1] for c in CASES]
    assert run(spark, T.clean, texts) == [c[2] for c in CASES]


RANDOM = st.lists(st.text("aBzüÜ9- \n\t\u00ad\u00a0\u2011\u2009 §.,\x07", max_size=30), min_size=20, max_size=60)


@settings(max_examples=8, deadline=None)
@given(RANDOM)
def test_repaired_text_is_in_order(spark, texts):
    """No character that the repair removes is left, lines are paragraphs, letters and digits stay in their order."""
    for text, got in zip(texts, run(spark, T.clean, texts)):
        assert not set(got) & set("\u00ad\u00a0\u2009\x07") and got == got.strip()
        assert not re.search(r"[ \t]\n|[ \t]\Z|\n{3}|(?<!\n)\n(?!\n)", got)
        assert [c for c in got if c.isalnum()] == [c for c in text if c.isalnum()]
        assert len(got) <= len(text) + text.count("-\n") + text.count("\u2011\n")


@settings(max_examples=8, deadline=None)
@given(RANDOM)
def test_normal_form_settles(spark, texts):
    """A normal form is one line of lower case with single spaces, and its own normal form; letters stay in order."""
    once = run(spark, T.normalise, texts)
    assert run(spark, T.normalise, once) == once
    for text, got in zip(texts, once):
        assert got == got.lower() and not re.search(r"\s{2}|^\s|\s\Z|\n|\u00ad|\u2011", got)
        assert [c for c in got if c.isalnum()] == [c for c in text.lower() if c.isalnum()]


def test_terms(spark):
    got = run(spark, T.tokenize, ["203-071", "DIN VDE 0100-540", "§ 5", "unterneh-men", "café", "Prüfung - Fristen", "", None])
    assert got == [["203-071"], ["din", "vde", "0100-540"], ["§5"], ["unterneh-men"], ["caf"], ["prüfung", "fristen"], [], None]
    got = run(spark, T.analyse, ["Warum muss geprüft werden?", "SELV und PELV", "muss soll kann darf"])
    assert got == [["muss", "geprüft"], ["selv", "pelv"], ["muss", "soll", "kann", "darf"]]


def test_boilerplate(spark):
    texts = ["1.2 Anwendungsbereich..................... 7", "Impressum\nHerausgegeben von: X", "2.1.3", "Ein ganz gewöhnlicher Satz.", "", None]
    assert run(spark, lambda c: T.is_boilerplate(c, F.lit("NarrativeText")), texts) == [True, True, True, False, True, True]
    assert run(spark, lambda c: T.is_boilerplate(c, F.lit("Table")), ["1 2 3 4"]) == [False]


def test_headings(spark):
    yes = ["6.4.3.7 Text", "B.3 Text", "Anhang C", "Tabelle 6.1", "Bild 2-1: x", "1.2.3.4.5.6 x"]
    no = ["6 Text", "12.1a", "Siehe Anhang C"]
    assert run(spark, T.is_heading, yes + no) == [True] * len(yes) + [False] * len(no)


def test_chunk_id_of_missing_page(spark):
    df = spark.createDataFrame([("a.pdf", None, "Table", "x"), ("a.pdf", 1, "Table", "x")], "s string, p int, k string, t string")
    a, b = [r[0] for r in df.select(T.chunk_id(F.col("s"), F.col("p"), F.col("k"), F.col("t"))).collect()]
    assert len(a) == len(b) == 16 and a != b


def test_titles(spark):
    got = run(spark, titles.tidy, ["„UVK  Regel 1-2“: Prüfung –", "UVK Regel 1-2 UVK Regel Prüfung", "Sonst etwas", "UVK Information 3-4", None])
    assert got == ["UVK Regel 1-2 - Prüfung", "UVK Regel 1-2 - Prüfung", "Sonst etwas", "UVK Information 3-4", None]
    assert run(spark, titles.undouble, ["Ein Titel Ein Titel", "x UVK Regel 1-2 y UVK Regel 1-2 z", "ab"]) == ["Ein Titel", "x UVK Regel 1-2 y", "ab"]
    df = spark.createDataFrame([(None, ["Stand März 2020", "Sichere Arbeit an Anlagen", "UVK Regel 1-2", "12"], "f")], "t string, l array<string>, s string")
    assert df.select(titles.read_title(F.col("t"), F.col("l"), F.col("s"))).first()[0] == "UVK Regel 1-2 - Sichere Arbeit an Anlagen"


def test_replies(spark):
    got = run(spark, replies.citations, ["[203-071.pdf, Seite 12] und [203-071 , seite 12]", "ohne", None])
    assert [[(c["file"], c["page"]) for c in g] if g is not None else None for g in got] == [[("203-071.pdf", 12)], [], None]
    a = ["  [ keine_antwort ] Text", "Text [KEINE_ANTWORT]", None]
    assert run(spark, replies.is_refusal, a) == [True, False, None]
    assert run(spark, replies.without_refusal, a) == ["Text", "Text [KEINE_ANTWORT]", None]
    parsed = run(spark, lambda c: replies.json_object(c).isNotNull(), ['```json\n{"a": "x"}\n```', "[1]", "3", "kein json", None])
    assert parsed == [True, False, False, False, False]
    assert run(spark, lambda c: replies.json_field(replies.json_object(c), "a"), ['{"a": " x "}', '{"a": null}', '{"b": 1}']) == ["x", "", ""]
