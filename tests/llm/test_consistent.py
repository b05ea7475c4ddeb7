"""The consistent form: what changes and what stays."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regelspur.llm import consistent as C

RUSSIAN = ["Опасно для жизни", "Стой, напряжение", "Вход запрещён", "не трогать"] * 3
PLAIN = ["Die Prüfung der Anlage ist beendet und der Leiter PE wird mit 5 kΩ beansprucht."] * 20


@pytest.fixture(scope="module")
def model(spark):
    return C.fit_scripts(spark.createDataFrame([(t,) for t in PLAIN + RUSSIAN + [None, ""]], "t string"), "t")


CHANGED = [
    ("ｎｉｃｈｔ ２０６ mA", "nicht 206 mA"),
    ("Fremdﬁrma", "Fremdfirma"),
    ("Prüfung", "Prüfung"),
    ("Ver­ant​wor⁠tung", "Verantwortung"),
    ("a b c d", "a b c d"),
    ("204‑222 und B‐C", "204-222 und B-C"),
    ("dеr Lеіtеr РЕ", "der Leiter PE"),
    ("Typ ΤΝ und 5 mΑ", "Typ TN und 5 mA"),
    ("սnԁ lieɡt", "und liegt"),
    ("​", ""),
]
SAME = ["5 kΩ und cos φ", "16 mm² bei 5 °C", "das Schild «Опасно для жизни» hängt", "das Schild «не трогать» hängt", "„Zitat“ – so…", "", "a\tb\nc", "电压，", "№ 5"]


@pytest.mark.parametrize("text,want", CHANGED)
def test_changed(model, text, want):
    assert C.consistent_form(text, model) == want


@pytest.mark.parametrize("text", SAME)
def test_same(model, text):
    assert C.consistent_form(text, model) == text


@settings(max_examples=200, deadline=None)
@given(st.text("ab ü̈аеРЕж ​ｎΩ-‐", max_size=25))
def test_idempotent_and_composed(model, text):
    once = C.consistent_form(text, model)
    assert C.consistent_form(once, model) == once == unicodedata.normalize("NFC", once)


def test_tables(spark, model):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CHANGED)] + [(90, None, "x"), (91, "", "x"), (92, SAME[0], "x"), (92, SAME[0], "x")]
    df = spark.createDataFrame(rows, "id int, t string, model string")
    assert sorted(r["id"] for r in C.inconsistent(df, "t", model).collect()) == list(range(len(CHANGED)))
    got = {r["id"]: r["c"] for r in C.with_consistent(df, "t", "c", model).collect()}
    assert got[0] == "nicht 206 mA" and got[90] is None and got[91] == "" and got[92] == SAME[0]
    empty = df.limit(0)
    assert C.inconsistent(empty, "t").count() == 0 and C.with_consistent(empty, "t", "t").columns == df.columns


def test_chains_of_words_and_far_neighbours(model):
    """A word made Latin speaks for the next, however many there are; the nearest speaker counts, however far it is."""
    assert C.consistent_form("Anlage" + " РЕ сор" * 40, model) == "Anlage" + " PE cop" * 40
    far = "Anlage " + "5 " * 200 + "РЕ"
    assert C.consistent_form(far, model) == "Anlage " + "5 " * 200 + "PE"


def test_answers_in_one_form_with_their_passages(spark, sf):
    from regelspur.llm import queries

    got = queries.p3_texts(spark, sf)
    assert {r[0] for r in got.select("field").distinct().collect()} == {"chunks.text", "goldset.answer_snippet"}
    assert got.count() == sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("chunks", "goldset"))


def test_long_text(model):
    long = "Die Prüfung der Anlage. " * 20_000 + "dеr"
    assert C.consistent_form(long, model).endswith("der")
