"""Term bitmaps and pieces against plain Python."""

import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regelspur.llm import pieces as P
from regelspur.llm import terms as T
from regelspur.llm.words import terms_of, words_of


def test_terms():
    assert terms_of("203-071, A--B -c- d² mm² 5,3 Пр-Ω_x") == ["203-071", "A", "B", "c", "d", "mm", "5", "3", "Пр-Ω", "x"]


@settings(max_examples=300, deadline=None)
@given(st.text("aZä²½٣Ⅷ𝟙𐄇漢5_- ,ß", max_size=30))
def test_words_are_letters_and_plain_digits(text):
    plain = "".join(c if c.isalpha() or c in "0123456789" else c if c == "-" else " " for c in text)
    assert words_of(text) == plain.replace("-", " ").split()
    assert [t for t in terms_of(text)] == re.findall(r"[^\s-]+(?:-[^\s-]+)*", plain)


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 65535), min_size=1), st.integers(0, 20_000))
def test_containers(numbers, more):
    want = np.array(sorted(numbers | set(range(more))), np.uint16)
    assert (T.unpack(T.pack(want)) == want).all() and len(T.pack(want)) <= 8192


def test_frequencies_equal_counting(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.randrange(200_000), " ".join(rng.choices(["häufig", "der", "die", f"selten{i}", f"w{i % 9}"], k=rng.randint(1, 9)))) for i in range(400)]
    rows += [rows[0], rows[0], (7, None), (8, ""), (9, "  "), (10, "²")]
    got = {r["term"]: (r["occurrences"], r["rows"], r["mark"]) for r in T.term_frequencies(spark.createDataFrame([(a, b, "x") for a, b in rows], "position int, text string, term string"), "position", "text").collect()}
    occurrences, holding = Counter(), {}
    for i, t in rows:
        for w in terms_of(t or ""):
            occurrences[w] += 1
            holding.setdefault(w, set()).add(i)
    total = sum(bool(t) for _, t in rows)
    mark = lambda n: "rare" if n < 3 else "common" if n > total / 4 else None
    assert got == {w: (occurrences[w], len(s), mark(len(s))) for w, s in holding.items()}
    assert T.term_frequencies(spark.createDataFrame([], "position int, text string"), "position", "text").count() == 0


def test_keys_of_any_type(spark):
    rows = [("a", "eins zwei"), ("a", "eins"), ("b", "zwei zwei"), (None, "zwei"), (None, "zwei"), ("c", None)]
    want = {"eins": (2, 1), "zwei": (5, 4)}
    for schema, key in (("key string, text string", lambda k: k), ("key int, text string", lambda k: k and ord(k)), ("key decimal(9,2), text string", lambda k: k and Decimal(ord(k)))):
        df = spark.createDataFrame([(key(k), t) for k, t in rows], schema)
        assert {r["term"]: (r["occurrences"], r["rows"]) for r in T.term_frequencies(df, "key", "text").collect()} == want


def test_merge_of_split_containers(spark):
    part = lambda t, b, ns: (t, b, len(ns), bytearray(T.pack(np.array(ns, np.uint16))))
    rows = [part("a", 0, [1, 2]), part("a", 0, [2, 3]), part("a", 1, [5]), part("b", 0, list(range(9000))), part("b", 0, [8999, 9001])]
    got = T.merge(spark.createDataFrame(rows, "term string, box long, occurrences long, records binary"))
    assert {(r["term"], r["box"]): (r["occurrences"], r["rows"]) for r in got.collect()} == {("a", 0): (4, 3), ("a", 1): (1, 1), ("b", 0): (9002, 9001)}


def check(spark, texts, limit=1500, overlap=150):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, cut string")
    by = {}
    for r in P.pieces(df, "text", limit, overlap).collect():
        by.setdefault(r["id"], []).append((r["piece_no"], r["start"], r["piece"], r["cut"]))
    for i, text in enumerate(texts):
        got = sorted(by[i], key=lambda r: r[0])
        if text is None:
            assert got == [(0, 0, None, None)]
            continue
        ends = [s for _, s, _, _ in got[1:]] + [len(text)]
        for (no, start, piece, _), end in zip(got, ends):
            core = text[start:end]
            assert piece.endswith(core) and len(piece) <= max(limit, 0) or len(text) <= limit
            extra = len(piece) - len(core)
            assert text[start - extra : end] == piece and extra <= overlap and (no or not extra)
            if no and extra < overlap and extra:  # less than asked for: back to a natural boundary, or all of the piece before
                assert re.search(r"(\n|[.!?]\s+)\Z", text[: start - extra]) or start - extra == got[no - 1][1]
        if len(text) > limit:
            at = [0, *sorted({m.end() for m in re.finditer(r"[.!?]\s+|\n", text)} | {m.end() for m in re.finditer("\n", text)}), len(text)]
            assert got[0][3] == ("forced" if any(b - a > limit for a, b in zip(at, at[1:])) else "natural"), (i, got[0][3])
        assert "".join(text[s:e] for (_, s, _, _), e in zip(got, ends)) == text
    return by


def test_pieces(spark):
    sentence = "Ein Satz mit Inhalt steht hier. "
    texts = [None, "", "kurz", sentence * 200, "x" * 4000, ("Absatz " * 30 + "\n\n") * 20, "wort " * 900, "a" * 1400 + ". " + "b" * 1400 + ". c", "𝔘" * 1600, sentence * 20_000]
    by = check(spark, texts)
    assert [by[i][0][3] for i in range(1, 9)] == ["whole", "whole", "natural", "forced", "natural", "forced", "natural", "forced"]
    assert all(p.endswith((". ", ".")) for _, _, p, _ in by[3])
    assert P.pieces(spark.createDataFrame([], "id int, text string"), "text").count() == 0


def test_pieces_with_long_white_space(spark):
    texts = ["a" * 1340 + "." + " " * n + "b" * 1340 + ". c" for n in (1, 150, 151, 152, 160, 400, 1700, 5000)]
    texts += ["a" * 1340 + "\n" + " " * n + "\n" + "b" * 1340 for n in (0, 149, 150, 151, 160, 400, 1700)] + ["\n" * 4000, " " * 4000]
    check(spark, texts)
    check(spark, [t.replace("b" * 1340, "b") for t in texts], 1500, 0)
    check(spark, ["ab." + " " * n + "cd\n" + "\u3000" * n + "\nef" for n in range(40)], 20, 5)
    rng = random.Random(5)
    mixed = ["".join(rng.choice(("Wort ", "ein Satz.", "! ", "\n", "x" * rng.randint(1, 1400))) + rng.choice((" ", "\n", "\u2003")) * rng.choice((0, 0, 1, 3, 149, 200, 1600, 5000)) for _ in range(12)) for _ in range(60)]
    check(spark, mixed)


def test_overlap_in_front_of_a_wide_piece(spark):
    """A sentence that leaves less than the overlap repeats what follows a boundary in that room, or nothing."""
    long = "y" * 1470 + ". "
    a, b = "x" * 1200 + ". " + "kurz. " + long, "x" * 1200 + ". " + "z" * 100 + ". " + long
    by = check(spark, [a, b])
    assert by[0][1][2] == "kurz. " + long and by[1][1][2] == long


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab. !\n", max_size=120), min_size=1, max_size=15))
def test_pieces_of_random_texts(spark, texts):
    by = check(spark, texts, 20, 5)
    for i, t in enumerate(texts):
        if len(t) > 20:
            at = sorted({0, len(t)} | {m.end() for m in re.finditer(r"\n|[.!?]\s+", t)} | {m.end() for m in re.finditer(r"\n", t)})
            assert by[i][0][3] == ("forced" if any(b - a > 20 for a, b in zip(at, at[1:])) else "natural")
