"""Leak search and mixing against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regelspur.llm import leaks as L
from regelspur.llm import mixing as M


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    tokens = np.append(rng.integers(1, 4, 300), np.zeros(20, np.int64))
    order = L.suffix_array(tokens)
    keys = [tuple(tokens[i : i + 16]) for i in order]
    assert keys == sorted(keys)
    wanted = np.array([[1, 2, 3], [3, 3, -2], [9, 1, 1]])
    low, high = L.search(tokens, order, wanted)
    for w, a, b in zip(wanted, low, high):
        head = [x for x in w if x != -2]
        assert sorted(order[a:b]) == [i for i in range(len(tokens) - 2) if list(tokens[i : i + len(head)]) == head]


def brute(docs, items, n):
    out = {}
    for d, t in docs:
        w = L.leak_words(t or "")
        for i, s in items:
            v = L.leak_words(s or "")
            m = min(n, len(v))
            best = 0
            for a in range(len(w) - m + 1):
                for b in range(len(v) - m + 1):
                    k = 0
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    best = max(best, k)
            if m and best >= m:
                out[d, i] = best
    return out


@pytest.mark.parametrize("block,many,at_once", [(20_000, 16, 1 << 17), (2, 16, 3), (3, 2, 1 << 17)])
def test_leaks_equal_brute_force(spark, monkeypatch, block, many, at_once):
    monkeypatch.setattr(L, "ITEMS", block)
    monkeypatch.setattr(L, "PASS", many)
    monkeypatch.setattr(L, "SLICE", at_once)
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(8)] + [(8, ""), (9, None), (10, "...")]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randint(0, 30))]
        if d % 2:
            i = rng.randrange(8)
            w[3:3] = items[i][1].upper().split()
        docs.append((d, (" ,\n" if d % 3 else " ").join(w)))
    docs += [(60, None), (61, "  "), (62, items[0][1][:1] + "​" + items[0][1][1:])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, words int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = L.leaks(df, "doc_id", "text", it, "item_id", "text", n=5)
    assert {(r["document"], r["item"]): r["words"] for r in got.collect()} == brute(docs, items, 5)
    clean = L.without_leaks(df, "doc_id", got)
    assert clean.count() == len(docs) - got.select("document").distinct().count()
    assert L.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
    named = L.leaks(df, "doc_id", "text", it.withColumn("item_id", F.concat(F.lit("i"), "item_id")), "item_id", "text", n=5)
    assert named.count() == got.count() and named.schema["item"].dataType.simpleString() == "string"
    assert L.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


def test_runs_of_any_length():
    """Matches of more words than the array was first sorted by: few words, so many suffixes agree for long."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(30, 120))) for _ in range(40)]
    items = [" ".join(t.split()[5:45]) for t in texts[::3]]
    hashes = L.Hashes()
    parts = [hashes.array(L.leak_words(t)) for t in texts]
    for n in (12, 17, 24, 33):
        found = L.Shard(np.concatenate(parts), np.array([len(p) for p in parts]), n).matches(L.Items(list(range(len(items))), items))
        assert {(d, i): w for d, i, w in zip(found["document"], found["item"], found["words"])} == brute(list(enumerate(texts)), list(enumerate(items)), n)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64, 1000])
def test_permutation(size):
    assert sorted(M.permuted(np.arange(size), size, 5).tolist()) == list(range(size))


def test_mix(spark):
    docs = [(i, "ein wort und noch eins " * (1 + i % 7), "gross") for i in range(300)] + [(1000 + i, "kleine quelle mit text " * 3, "klein") for i in range(20)]
    docs += [(2000, None, "klein"), (2001, "", "klein"), (2002, "ohne quelle", None), (2003, "andere quelle", "sonst")]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in docs], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("gross", 0.5, 2), ("klein", 0.4, 3), ("leer", 0.1, 5)], "source string, target_share double, max_repeats int")
    mix = M.Mix(df, "doc_id", "text", "source", targets, block=32)
    report = {r["source"]: r for r in mix.report().collect()}
    assert report["klein"]["short"] and report["leer"]["short"] and not report["gross"]["short"]
    assert report["klein"]["drawn_tokens"] == 3 * report["klein"]["tokens"] and report["leer"]["tokens"] == 0
    assert report["klein"]["empty_slots"] > 0 and report["leer"]["empty_slots"] > 0 and report["gross"]["empty_slots"] == 0
    drawn = mix.drawn()
    # no part of a document more often than allowed, and parts of a document tile it
    most = {r["source"]: r["n"] for r in drawn.groupBy("source", "block", "doc", "from_token").count().groupBy("source").agg(F.max("count").alias("n")).collect()}
    assert most["klein"] == 3 and most["gross"] <= 2
    whole = mix.pieces().groupBy("doc").agg(F.sum("tokens").alias("t")).join(mix.sizes, "doc").where(F.col("t") != F.col("tokens"))
    assert whole.count() == 0
    assert mix.pieces().groupBy("source", "block").agg(F.sum("tokens").alias("t")).where("t > 32").count() == 0
    again = M.Mix(df, "doc_id", "text", "source", targets, block=32)
    assert sorted(map(tuple, again.drawn().collect())) == sorted(map(tuple, drawn.collect()))


def test_shortfall_comes_from_the_draw(spark):
    docs = [(i, "ein wort und noch eins " * (1 + i % 7), "gross") for i in range(300)] + [(1000 + i, "kleine quelle mit text " * 3, "klein") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = lambda share: M.Mix(df, "doc_id", "text", "source", spark.createDataFrame([("gross", 1 - share, 2), ("klein", share, 3)], "source string, target_share double, max_repeats int"), block=32)
    short = lambda m: {r["source"] for r in m.report().where("short").select("source").collect()}
    own = mix(0.4)
    plan = own.slot_table().where("block is null")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan  # the permutations
    # at the limit too, whatever number of slots was drawn by chance
    row = {r["source"]: r for r in own.totals.collect()}["klein"]
    limit = 3 * row["tokens"] / own.total
    assert short(mix(limit * 1.01)) == {"klein"} and short(mix(limit * 0.99)) == set()
    # slots that its turns can fill leave none empty: with more turns nothing is short
    more = own.held.withColumn("max_repeats", F.lit(100))
    own.held = more
    assert short(own) == set()


def test_many_sources_buckets_and_shards(spark, monkeypatch):
    """Beyond every former bound: more sources than one draw holds, small buckets and shards."""
    monkeypatch.setattr(M, "SHARD_BLOCKS", 16)
    monkeypatch.setattr(M, "SHARD_GROUP", 4)
    monkeypatch.setattr(M, "GROUP_SOURCES", 50)
    monkeypatch.setattr(M, "BUCKET_ROWS", 5)
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 10)
    docs = [(i, "ein wort und noch eins mehr " * (1 + i % 5), f"q{i % 300}") for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([(f"q{i}", 1.0, 2) for i in range(300)] + [("keine", 1.0, 3)], "source string, target_share double, max_repeats int")
    mix = M.Mix(df, "doc_id", "text", "source", targets, block=8)
    assert mix.sources == 301 and mix.shards > 30
    counts = mix.counts.orderBy("source", "shard").collect()
    ends = {}
    for r in counts:  # the slots of a source follow each other through all shards
        assert r["first"] == ends.get(r["source"], 0)
        ends[r["source"]] = r["first"] + r["n"]
    report = {r["source"]: r for r in mix.report().collect()}
    assert len(report) == 301 and report["keine"]["short"] and report["keine"]["repeats"] == 0
    for r in report.values():  # what is short has been used up, what is not has its share
        assert r["drawn_tokens"] == r["tokens"] * r["max_repeats"] if r["short"] else r["drawn_tokens"] >= r["target_tokens"]
        assert r["short"] == (r["tokens"] * r["max_repeats"] < r["target_tokens"])
    assert mix.drawn().groupBy("source", "block", "doc", "from_token").count().agg(F.max("count")).first()[0] <= 2


def test_targets_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "ein wort", "a"), (2, "ein wort", None), (3, "wort", "b")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("a", 0.3, 3), (None, 0.2, 2), ("b", None, None), ("c", -1.0, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in M.Mix(df, "doc_id", "text", "source", targets).report().collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["max_repeats"] == 3 and got["a"]["actual_share"] == 1.0 and not got["b"]["short"]


def test_shares_are_reached(spark):
    docs = [(i, "ein wort und noch eins mehr " * 20, f"q{i % 4}") for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("q0", 0.4, 9), ("q1", 0.3, 9), ("q2", 0.2, 9), ("q3", 0.1, 9)], "source string, target_share double, max_repeats int")
    for r in M.Mix(df, "doc_id", "text", "source", targets, block=16).report().collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.03


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix = M.Mix(df, "doc_id", "text", "source", targets)
    assert mix.drawn().count() == 0 and mix.report().first()["drawn_tokens"] == 0
    assert M.Mix(df, "doc_id", "text", "source", targets.limit(0)).report().count() == 0
