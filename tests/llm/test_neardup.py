"""Near duplicates against comparing all pairs."""

import random
from itertools import combinations

import pytest

from regelspur.llm import neardup as N
from regelspur.llm.words import words_of


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"wort{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(12, 60))]
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy)
    rng.shuffle(out)
    return [" ".join(t) for t in out]


def sets(text, n):
    w = words_of(text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, threshold, n):
    s = {i: sets(t, n) for i, t in rows if t}
    return {(a, b) for a, b in combinations(sorted(s), 2) if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}


def test_pairs_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(900, None), (901, ""), (902, "zu kurz"), (903, "zu kurz")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id int, text string, rep string, words int")
    for threshold, n in ((0.6, 3), (0.8, 5)):
        got = [tuple(r) for r in N.similar_pairs(df, "id", "text", threshold, n).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, threshold, n)


def test_shape():
    assert N.shape(0.6) == (21, 3, 33)
    for k in range(10, 101):
        blocks, width, far = N.shape(k / 100)
        assert blocks <= N.MOST_BLOCKS and (1 - (k / 100) ** width) ** blocks <= N.MISSED and far <= 64
    with pytest.raises(ValueError):
        N.shape(0.05)


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.5])
def test_recall_of_low_thresholds(spark, threshold):
    """Pairs near the threshold; with ``exact`` none is missing."""
    rng = random.Random(8)
    base = [[f"w{i}x{k}" for k in range(60)] for i in range(150)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        keep = 60 - rng.randint(0, 35)
        rows.append((1000 + i, " ".join(b[:keep] + [f"v{i}y{k}" for k in range(60 - keep)])))
    df = spark.createDataFrame(rows, "id int, text string")
    want = brute(rows, threshold, 3)
    got = {tuple(r) for r in N.similar_pairs(df, "id", "text", threshold, 3).collect()}
    assert len(want) > 60 and got <= want and len(got) >= 0.97 * len(want)
    assert {tuple(r) for r in N.similar_pairs(df, "id", "text", threshold, 3, exact=True).collect()} == want


def test_recall_on_the_table(spark):
    """Against the exact join, on all chunks of a test table."""
    chunks = spark.read.parquet("/root/testdata/sf0.01/chunks.parquet")
    got = {tuple(r) for r in N.similar_classes(chunks, "position", "text", 0.6, 3)[1].select("a", "b").collect()}
    want = {tuple(r) for r in N.similar_classes(chunks, "position", "text", 0.6, 3, exact=True)[1].select("a", "b").collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 100


def test_hot_block_and_hot_class_are_split(spark, monkeypatch):
    """One template with many variants, and copies of one: the same pairs whatever the parts."""
    monkeypatch.setattr(N, "HOT", 7)
    monkeypatch.setattr(N, "HOT_MEMBERS", 4)
    monkeypatch.setattr(N, "COPIES", 20)
    template = [f"wort{i}" for i in range(60)]
    rows = [(i, " ".join([*template, f"ende{i}"])) for i in range(60)] + [(100 + i, " ".join(template)) for i in range(30)]
    rows += [(200 + i, " ".join(f"eigen{i}x{k}" for k in range(20))) for i in range(50)]
    got = [tuple(r) for r in N.similar_pairs(spark.createDataFrame(rows, "id int, text string"), "id", "text", 0.6, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.6, 3)


def test_groups(spark):
    a, b = "eins zwei drei vier fünf sechs sieben acht", "ganz andere wörter stehen hier im text heute"
    rows = [(1, a), (2, a), (3, a + " neun"), (4, b), (5, None), (6, "kurz")]
    got = {r["id"]: (r["group_id"], r["class_id"], r["links"]) for r in N.near_duplicate_groups(spark.createDataFrame(rows, "id int, text string"), "id", "text", 0.6, 3).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (1, 3, 1), 4: (4, 4, 0), 5: (5, 5, 0), 6: (6, 6, 0)}


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101)]
    random.Random(3).shuffle(links)
    got = {r["id"]: r["root"] for r in N.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_hot_group_of_copies_and_empty(spark):
    rows = [(i, "immer derselbe lange text mit vielen worten") for i in range(300)] + [(i, f"text nummer {i} hat eigene worte {i} {i}") for i in range(300, 900)]
    df = spark.createDataFrame(rows, "id int, text string")
    members, pairs = N.similar_classes(df, "id", "text", 0.8, 3)
    assert members.where("rep = 0").count() == 300 and pairs.count() == 0
    empty = df.limit(0)
    assert N.similar_pairs(empty, "id", "text").count() == 0 and N.near_duplicate_groups(empty, "id", "text").count() == 0


def test_long_text(spark):
    base = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    df = spark.createDataFrame([("a", base), ("b", base + " ende"), ("c", "nichts davon steht hier drin")], "id string, text string")
    assert [tuple(r) for r in N.similar_pairs(df, "id", "text").collect()] == [("a", "b")]
