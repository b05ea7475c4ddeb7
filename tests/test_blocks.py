"""Searches in blocks: the same results as with all pairs as rows, and never all pairs as rows."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from regelspur import schemas
from regelspur.operators import answers, blocks, chunking, dense, lexical
from regelspur.plans import retrieval_queries

WORDS = [f"wort{i:02d}" for i in range(40)]


def passages(seed=3, n=300):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=rng.randrange(0, 12))) for _ in range(n)]
    texts[7] = texts[8] = texts[9]  # ties
    return {f"c{rng.randrange(10**6):06d}-{i}": t for i, t in enumerate(texts)}


def questions(seed=4, n=60):
    rng = random.Random(seed)
    return {f"q{i}": " ".join(rng.choices(WORDS + ["fremd"], k=rng.randrange(1, 6))) for i in range(n)}


def bm25(held, asked, k, decimals):
    """In plain Python."""
    docs = {key: collections.Counter(t.split()) for key, t in held.items()}
    n, avg = len(docs), sum(c.total() for c in docs.values()) / len(docs)
    df = collections.Counter(w for c in docs.values() for w in c)
    out = set()
    for qid, text in asked.items():
        scored = []
        for key, c in docs.items():
            s = sum(times * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / avg)) for w, times in collections.Counter(text.split()).items() if c[w])
            if s:
                first = min(i for i, w in enumerate(text.split()) if c[w])
                scored.append((-round(s, 10 if decimals is None else decimals), first if decimals is None else 0, key))
        out |= {(qid, rank, key, round(-s, 6)) for rank, (s, _, key) in enumerate(sorted(scored)[:k], 1)}
    return out


def frames(spark, held, asked):
    c = spark.createDataFrame([(i, k, "f", 1, "NarrativeText", t) for i, (k, t) in enumerate(held.items())], schemas.CHUNKS).repartition(3)
    return c, spark.createDataFrame(list(asked.items()), "qid string, question string")


@pytest.mark.parametrize("decimals", [6, None])
def test_search_equals_plain_python(spark, monkeypatch, decimals):
    monkeypatch.setattr(blocks, "QUESTION_TERMS", 70)
    held, asked = passages(), questions()
    c, q = frames(spark, held, asked)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r["qid"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in lexical.search(lexical.build_index(c), q, 5, decimals).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == bm25(held, asked, 5, decimals)


def test_answer_never_has_all_pairs_as_rows(spark):
    """What is shuffled are the best k of a task, not every passage that shares a term with a question."""
    held, asked = passages(), questions()
    c, q = frames(spark, held, asked)
    index = lexical.build_index(c)
    terms = q.select("qid", F.posexplode(F.split("question", " ")).alias("at", "term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"), F.min("at").alias("at"))
    pairs = sum(bool(set(t.split()) & set(a.split())) for t in held.values() for a in asked.values())
    few = index.best(terms, 5, 6)
    assert few.groupBy(F.spark_partition_id(), "qid").count().agg(F.max("count")).first()[0] <= 5
    assert few.count() < pairs / 5
    names = spark.createDataFrame([("f", "Titel")], "source_file string, title string")
    assert answers.answer(q, lexical.search(index, q, 5, decimals=6), c, names).count() == len(asked)


def test_halves_are_rounded_up():
    assert blocks.half_up(blocks.np.array([0.0078125, 0.1234565, 0.5, 1.0000004]), 6).tolist() == [0.007813, 0.123457, 0.5, 1.0]


def test_first_of_each_equals_dedupe(spark, monkeypatch):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "z"), (4, None, "w"), (5, "b", "v"), (0, "c", "u"), (0, "c", "u")]
    df = spark.createDataFrame(rows, "position int, chunk_id string, text string").repartition(3)
    for most in (chunking.FEW_REPEATED, 0):
        monkeypatch.setattr(chunking, "FEW_REPEATED", most)
        got = sorted((r["position"], r["chunk_id"] or "") for r in chunking.first_of_each(df).collect())
        assert got == sorted((r["position"], r["chunk_id"] or "") for r in chunking.dedupe_first(df).collect()) == [(0, "c"), (1, "a"), (3, ""), (4, ""), (5, "b")]


@pytest.mark.parametrize("self_match", [True, False])
def test_nearest_in_steps(spark, monkeypatch, self_match):
    """Several blocks, steps and batches, ties, a null, a short and an infinite vector; a task sends k rows a query however many its batches."""
    np = blocks.np
    monkeypatch.setattr(dense, "QUERY_BLOCK", 1)
    monkeypatch.setattr(dense, "QUERY_STEP", 16)
    monkeypatch.setattr(dense, "ROW_STEP", 24)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(500, 64)).round(2)
    v[100:140] = v[60:100]
    rows = [(f"k{i:03d}", [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame([*rows, ("n", None), ("s", [1.0]), ("i", [float("inf")] * 64)], "id string, v array<double>").repartition(30)
    q = spark.createDataFrame(rows[60:130], "qid string, w array<double>")
    found = dense.nearest(df, "id", "v", q, "qid", "w", 4, self_match)
    want = set()
    for qid, w in rows[60:130]:
        s = sorted((-round(float(np.dot(w, r)), 6), key) for key, r in rows if self_match or key != qid)
        want |= {(qid, n, key, -x) for n, (x, key) in enumerate(s[:4], 1)}
    assert {tuple(r) for r in found.select("qid", "rank", "id", "score").collect()} == want
    one = dense._pass(df, np.array([r[0] for r in rows[:20]], dtype=object), v[:20], 4, True, "string")
    assert one.count() <= 4 * 20 * 2 * spark.sparkContext.defaultParallelism < 4 * 20 * 30


@pytest.mark.parametrize("name", ["misses", "relevance_hits"])
def test_questions_are_judged_once(spark, sf, name):
    """Neither the passages nor the index are in the plan of what is made of the judged rows, however often they are used."""
    plan = getattr(retrieval_queries, name)(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "judged" in str(getattr(retrieval_queries, name)(spark, sf).inputFiles())


def test_fused_searches_share_packed_blocks(spark, sf, monkeypatch):
    """Both branches of the fusion search the blocks that were packed once; other passages are not packed again."""
    made = []
    monkeypatch.setattr(blocks, "pack", lambda *a, pack=blocks.pack: made.append(1) or pack(*a))
    found = retrieval_queries.hybrid_topk(spark, sf)
    assert len(made) == 1 and found.count() > 0
