"""Operators of the core on small fixtures with known results."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regelspur import schemas
from regelspur.config import CONFIGS, corpus_paths, get_config
from regelspur.operators import answers, chunking, compare, dense, evaluation, fusion, goldset, lexical, metrics, retrievers
from regelspur.plans import retrieval_queries
from regelspur.sources import elements as E
from regelspur.sources import tables
from regelspur.sources.store import VectorStore


def python_fold(blocks, most=600, least=300):
    """The chunker in plain Python."""
    out, no, n, bt, bc = [], 0, 0, 0, 0
    for tk, ch, hd in blocks:
        if n and (bt + tk > most or (hd and bc >= least)):
            no, n, bt, bc = no + 1, 0, 0, 0
        out.append(no)
        n, bt, bc = n + 1, bt + tk, bc + ch
        if bt > most:
            no, n, bt, bc = no + 1, 0, 0, 0
    return out


def python_merge(lengths, least=300):
    groups, pending, g, out = [], None, 0, []
    for x in lengths:
        total = (pending + 2 if pending is not None else 0) + x
        out.append(g)
        pending, g = (total, g) if total < least else (None, g + 1)
    return [min(y, g - 1) for y in out] if pending is not None and g > 0 else out


FOLD = [(10, 50, 1), (8, 40, 1), (90, 400, 0), (5, 20, 1), (700, 3000, 0), (20, 120, 0), (300, 1500, 0), (301, 1500, 0), (4, 30, 1)]


def numbers(docs):
    fold = [chunking.Fold() for _ in docs]
    return [[f.number(*b) for b in d] for f, d in zip(fold, docs)]


def groups(docs):
    out = []
    for d in docs:
        merge = chunking.Merge()
        out.append([n for x in d for n in merge.add(x)] + merge.end())
    return out


def test_fold_and_merge_examples():
    assert numbers([FOLD]) == [[0, 0, 0, 1, 2, 3, 3, 4, 5]] == [python_fold(FOLD)]
    assert groups([[494, 20, 3000, 1622, 1500, 30], [100, 50], [100, 250, 10], []]) == [[0, 1, 1, 2, 3, 3], [0, 0], [0, 0, 0], []]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 700), st.integers(0, 900), st.booleans()), max_size=12), min_size=1, max_size=20))
def test_folds_equal_python(docs):
    assert numbers(docs) == [python_fold(d) for d in docs]
    assert groups([[b for _, b, _ in d] for d in docs]) == [python_merge([b for _, b, _ in d]) for d in docs]


def test_folds_over_batches(spark):
    """Documents longer than an Arrow batch, several in a partition, one without a name, repeated rows."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sizes = {d: [(k * 37 + len(d or "")) % 400 for k in range(60)] for d in ("a", "bb", "ccc", None)}
        rows = [(d, k, "x" * n, None, None) for d, ns in sizes.items() for k, n in enumerate(ns)]
        df = spark.createDataFrame(rows, "source_file string, chunk_no int, text string, page_number int, page_end int")
        got = {}
        for r in chunking.merge_groups(df).orderBy("chunk_no").collect():
            got.setdefault(r["source_file"], []).append(r["group_no"])
        assert got == {d: python_merge(ns) for d, ns in sizes.items()}
        twice = chunking.merge_groups(df.unionByName(df))
        assert twice.count() == 2 * len(rows) and chunking.merge_groups(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def blocks(spark):
    long = "Ein Satz über die Prüfung der Anlage. " * 10
    rows = [("a", 0, "NarrativeText", "1.1 Kopf", None), ("a", 1, "NarrativeText", long, 2), ("a", 2, "Table", "| x | y |", 3), ("a", 3, "NarrativeText", "kurz", 4), ("b", 0, "NarrativeText", None, 1)]
    return spark.createDataFrame(rows, schemas.ELEMENTS)


def test_build_chunks(spark):
    got = {(r["type"], r["page_number"], r["page_end"]) for r in chunking.build_chunks(blocks(spark)).collect()}
    assert got == {("NarrativeText", 2, 4), ("Table", 3, 3)}
    assert chunking.build_chunks(spark.createDataFrame([], schemas.ELEMENTS)).count() == 0


def corpus(spark):
    rows = [(1, "A", "f", 1, "NarrativeText", "Prüfung Schutzleiter Prüfung"), (2, "B", "f", 2, "NarrativeText", "Schutzleiter SELV PELV"), (3, "C", "g", None, None, "Prüfung Frist")]
    return spark.createDataFrame(rows, schemas.CHUNKS)


def ask(spark, *questions):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "qid string, question string")


def test_bm25(spark):
    index = lexical.build_index(corpus(spark))
    assert round(index.corpus_stats.first()["avgdl"], 6) == 2.666667
    idf = {r["term"]: round(r["idf"], 6) for r in index.term_stats.collect()}
    assert idf["prüfung"] == 0.470004 and idf["selv"] == 0.980829
    got = lexical.search(index, ask(spark, "Prüfung", "Prüfung Prüfung", "SELV Schutzleiter", "xyzzy", "und der", None), 5).collect()
    found = {(r["qid"], r["chunk_id"]): (r["rank"], round(r["score"], 6)) for r in got}
    assert found == {
        ("q0", "A"): (1, 0.645499), ("q0", "C"): (2, 0.529582), ("q1", "A"): (1, 1.290997), ("q1", "C"): (2, 1.059163), ("q2", "B"): (1, 1.37357), ("q2", "A"): (2, 0.444974),
    }


def test_bm25_of_nothing(spark, tmp_path):
    index = lexical.build_index(spark.createDataFrame([], schemas.CHUNKS))
    assert index.corpus_stats.first()["n"] == 0
    assert lexical.search(index, ask(spark, "Prüfung"), 5).count() == 0
    index = lexical.build_index(corpus(spark))
    index.save(str(tmp_path))
    again = lexical.LexicalIndex.load(spark, str(tmp_path), "chunk_id")
    assert lexical.search(again, ask(spark, "Frist"), 5).first()["chunk_id"] == "C"


def ranked(spark, *rows):
    return spark.createDataFrame([("q", r, k, float(s)) for r, k, s in rows], "qid string, rank int, chunk_id string, score double")


def test_fusion(spark):
    a, b = ranked(spark, (1, "A", 9), (2, "B", 8)), ranked(spark, (1, "B", 5), (2, "C", 4))
    got = fusion.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["B", "A", "C"]
    assert (got[0]["rank_branch_0"], got[0]["rank_branch_1"], got[1]["rank_branch_1"]) == (2, 1, None)
    twice = fusion.reciprocal_rank_fusion([ranked(spark, (1, "A", 9), (2, "A", 7)), ranked(spark)]).first()
    assert (round(twice["score"], 6), twice["rank_branch_0"], twice["score_branch_0"]) == (round(1 / 61 + 1 / 62, 6), 2, 7.0)
    assert fusion.reciprocal_rank_fusion([ranked(spark), ranked(spark)]).count() == 0


def test_rerank_keeps_the_pool(spark):
    pool = ranked(spark, (1, "A", 3), (2, "B", 2), (3, "C", 1)).withColumn("qid", F.lit("q0"))
    got = fusion.rerank(pool, ask(spark, "SELV Frist"), corpus(spark), 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["B", "C", "A"] and got[0]["dense_score"] == 2.0
    model = fusion.model_scorer(lambda qs, ts: [float(len(t)) for t in ts])
    assert fusion.rerank(pool, ask(spark, "x"), corpus(spark), 1, model).first()["chunk_id"] == "A"


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(60)] + [(60, None), (61, [1.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    q = df.where("id % 20 = 0 and id < 60").select(F.col("id").alias("qid"), "v")
    dense.QUERY_BLOCK, kept = 2, dense.QUERY_BLOCK
    try:
        got = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in dense.nearest(df, "id", "v", q.withColumnRenamed("v", "w"), "qid", "w", 5, self_match=False).collect()}
    finally:
        dense.QUERY_BLOCK = kept
    s = v.astype(float) @ v.astype(float).T
    for i in (0, 20, 40):
        best = sorted((-round(float(s[i, j]), 6), j) for j in range(60) if j != i)[:5]
        assert [got[i, r + 1] for r in range(5)] == [(j, -x) for x, j in best]
    assert dense.nearest(df, "id", "v", q.limit(0), "qid", "v", 5).count() == 0


def test_retrievers(spark):
    chunks = corpus(spark)
    e = dense.HashingEmbedder(32)
    vectors = dense.embed(chunks, "text", e).select("chunk_id", "embedding")
    for name, config in CONFIGS.items():
        r = retrievers.build_retriever(config, chunks, vectors, e)
        got = r.retrieve(ask(spark, "Prüfung Frist", None), 2)
        assert {x["chunk_id"] for x in got.collect()} and got.groupBy("qid").count().where("count > 2").count() == 0, name
    assert retrievers.build_retriever(get_config("hybrid_rerank"), chunks, vectors, e).name == "hybrid+rerank"
    with pytest.raises(ValueError, match="hybrid"):
        get_config("nope")
    with pytest.raises(ValueError):
        corpus_paths("/x", "nope")


def test_hit_rule(spark):
    gold = spark.createDataFrame([("q", "f", 12, "Der  Schutzleiter"), ("n", "f", None, "")], "qid string, source_file string, page_number int, answer_snippet string")
    rows = [("q", 1, "f", 12, "x"), ("q", 2, "f", 13, "x"), ("q", 3, "g", 12, "x"), ("q", 4, "f", 13, "hier der schutzleiter"), ("n", 1, "f", None, "x"), ("n", 2, "f", 1, None)]
    r = spark.createDataFrame(rows, "qid string, rank int, source_file string, page_number int, text string")
    judged = metrics.hits(r, gold)
    assert [x["hit"] for x in judged.orderBy(F.desc("qid"), "rank").collect()] == [True, False, False, True, True, False]
    firsts = metrics.first_hits(spark.createDataFrame([("q",), ("n",), ("none",)], "qid string"), judged)
    assert {x["qid"]: x["rank"] for x in firsts.collect()} == {"q": 1, "n": 1, "none": None}


def test_rank_metrics(spark):
    df = spark.createDataFrame([(0, 3), (1, None)], "i int, rank int").orderBy("i")
    r = F.col("rank")
    got = df.select(metrics.recall_at(r, 5), metrics.recall_at(r, 2), metrics.reciprocal_rank(r), metrics.ndcg_at(r, 5), metrics.ndcg_at(r, 2)).collect()
    assert tuple(got[0]) == (1.0, 0.0, 1 / 3, 0.5, 0.0) and tuple(got[1]) == (0.0,) * 5
    assert df.limit(0).agg(metrics.mean(r)).first()[0] == 0.0


@pytest.mark.parametrize("pair,p", [((15, 1), 0.000519), ((24, 0), 0.0), ((6, 8), 0.790527), ((13, 7), 0.263176), ((3, 3), 1.0), ((6, 2), 0.289062), ((5, 0), 0.0625), ((0, 0), 1.0), ((700, 600), None), ((3000, 2900), None)])
def test_mcnemar(spark, pair, p):
    f, b = pair
    got = spark.createDataFrame([pair], "f long, b long").select(compare.p_value(F.col("f"), F.col("b"))).first()[0]
    n = f + b
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(f, b) + 1)) / 2**n) if n else 1.0
    assert abs(got - exact) < 1e-9 and (p is None or round(got, 6) == p)


def test_goldset(spark):
    text = "Die Anlage wird jährlich durch die Fachkraft geprüft und instandgesetzt. " * 6
    rows = [(i, f"c{i}", "f" if i < 8 else "g", i, "NarrativeText", text + str(i)) for i in range(10)] + [(10, "short", "g", 1, "NarrativeText", "kurz"), (11, "null", "g", 1, None, None)]
    chunks = spark.createDataFrame(rows, schemas.CHUNKS)
    first = goldset.build_goldset(chunks, None, 3)
    assert first.count() == 5 and {r["id"] for r in first.collect()} == {f"gold-00{i}" for i in range(1, 6)}
    both = goldset.build_goldset(chunks, first, 3)
    assert both.count() == 8 and both.select("chunk_id").distinct().count() == 8
    assert goldset.generate_entries(chunks, lambda t, s: F.lit("kein json")).where("problem is null").count() == 0


def test_answers(spark):
    chunks = corpus(spark).withColumn("page_number", F.coalesce("page_number", F.lit(0)))
    names = spark.createDataFrame([("f", "Titel"), ("g", "")], schemas.TITLES)
    q = ask(spark, "SELV PELV", "Baum Haus Schutzleiter Garten", "xyzzy")
    got = {r["qid"]: r for r in answers.answer(q, lexical.search(lexical.build_index(chunks), q, 5), chunks, names).collect()}
    assert not got["q0"]["abstained"] and "Seite 2" in got["q0"]["answer"]
    assert got["q1"]["abstained"] and got["q1"]["sources"] == [] and got["q2"]["abstained"]
    assert "SELV" in answers.render(1, got["q0"])


def test_answers_use_all_passages(spark):
    rows = [(f"c{i}", f"Wort {i}.", "f.pdf", i) for i in range(1, 7)]
    rows[2] = ("c3", "Vorweg. Die Frist der Prüfung beträgt ein Jahr.", "g.pdf", 7)
    rows[5] = ("c6", "Frist der Prüfung von Zangen.", "h.pdf", 9)
    rows += [("n1", "Erdung der Anlage.", None, 1), ("t1", "Kabel im Rohr.", "f.pdf", 1), ("t2", "Rohr und Kabel.", "g.pdf", 2)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, source_file string, page_number int")
    ranked = [("q", r, f"c{r}") for r in range(1, 7)] + [("z", r, f"c{r}") for r in range(1, 7)] + [("n", 1, "n1"), ("t", 1, "t1"), ("t", 2, "t2")]
    ranked = spark.createDataFrame(ranked, "qid string, rank int, chunk_id string")
    asked = spark.createDataFrame([("q", "Frist Prüfung?"), ("z", "Zangen Frist Prüfung Montage Kran?"), ("n", "Erdung Anlage?"), ("t", "Kabel Rohr?"), ("-", "Nichts?")], "qid string, question string")
    names = spark.createDataFrame([("g.pdf", "Titel")], schemas.TITLES)
    got = {r["qid"]: r for r in answers.answer(asked, ranked, chunks, names).collect()}
    assert not got["q"]["abstained"] and got["q"]["answer"] == "Die Frist der Prüfung beträgt ein Jahr. [g.pdf, Seite 7]"
    assert [s["source_file"] for s in got["q"]["sources"]] == ["g.pdf"]
    assert got["z"]["abstained"] and got["z"]["sources"] == []  # the only passage that would do has rank 6
    assert not got["n"]["abstained"] and got["n"]["answer"] == "Erdung der Anlage. [?, Seite 1]" and got["n"]["sources"] == []
    assert got["t"]["answer"].endswith("[f.pdf, Seite 1]") and got["-"]["abstained"]
    shown = {r["qid"]: r["answer"] for r in answers.answer(asked, ranked, chunks, names, generator=lambda q, p: answers.context(p)).collect()}
    want = {r["qid"]: r["context"] for r in answers.build_context(ranked.where("rank <= 5").join(chunks, "chunk_id")).collect()}
    assert want == {q: shown[q] for q in want} and shown["q"].count("---") == 4


def test_all_anchors_are_searched(spark, tmp_path):
    held = spark.range(1200).selectExpr("concat('u', id) AS id", "'' AS question", "'A' AS category", "concat('Wort', id, 'x') AS anchor_term")
    held.union(held.limit(1).selectExpr("'none'", "''", "'B'", "'fehlt'")).write.parquet(f"{tmp_path}/unanswerable.parquet")
    text = " ".join(f"Wort{i}x" for i in range(1200))
    rows = [(0, "c", "f.pdf", 1, "NarrativeText", text)]
    spark.createDataFrame(rows, "position int, chunk_id string, source_file string, page_number int, type string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["category"]: r["abstention_rate"] for r in retrieval_queries.abstention_rollup(spark, str(tmp_path)).collect()}
    assert got["A"] == 0 and got["B"] == 1


def test_sources_drop_pages_not_retrieved(spark):
    pages = spark.createDataFrame([("q", "f.pdf", 1), ("q", "f.pdf", 1), ("q", "g.pdf", 2)], "qid string, source_file string, page_number int")
    said = spark.createDataFrame([("q", "so [f, Seite 1] und [h, Seite 9]")], "qid string, answer string")
    names = spark.createDataFrame([], schemas.TITLES)
    assert [tuple(r) for r in answers.build_sources(pages, names, said).collect()] == [("q", "f.pdf", 1, "f.pdf")]
    refused = said.withColumn("answer", F.concat(F.lit("[KEINE_ANTWORT] "), "answer"))
    assert answers.build_sources(pages, names, refused).count() == 0 and answers.build_sources(pages, names).count() == 2


def test_evaluate(spark):
    chunks = corpus(spark)
    gold = spark.createDataFrame([("g1", "A", "f", 1, "NarrativeText", "Prüfung?", "Schutzleiter?", "Prüfung Schutzleiter"), ("g2", "C", "g", None, None, None, "Frist?", "Prüfung Frist")], schemas.GOLDSET)
    found = evaluation.evaluate(retrievers.LexicalRetriever(lexical.build_index(chunks)), gold, chunks, get_config("hybrid"))
    assert found["metrics"].count() == 2 and "| hybrid |" in evaluation.markdown(found["metrics"])
    a = spark.createDataFrame([("i", "?", "x", True, "a"), ("j", "?", None, False, "b" * 400)], "id string, question string, category string, abstained boolean, answer string")
    got = {(r["category"], r["total"]): r["abstention_rate"] for r in evaluation.abstention(a).collect()}
    assert got == {("x", 0): 1.0, ("uncategorised", 0): 0.0, (None, 1): 0.5}
    assert len(evaluation.answered_anyway(a).first()["answer"]) == 300


def test_store_and_tables(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/v")
    row = lambda k, x: (k, [float(x)], "Table", 1, "f")
    frame = lambda *rows: spark.createDataFrame(list(rows), schemas.CHUNK_VECTORS)
    store.upsert(frame())
    assert store.read().count() == 0
    store.upsert(frame(row("a", 1), row("b", 1)))
    store.upsert(frame(row("b", 2), row("c", 2)))
    assert {(r["chunk_id"], r["embedding"][0]) for r in store.read().collect()} == {("a", 1.0), ("b", 2.0), ("c", 2.0)}
    with pytest.raises(ValueError):
        VectorStore(spark, f"{tmp_path}/v", "l2")
    store.reset()
    assert store.read().count() == 0
    tables.write_chunks(corpus(spark), f"{tmp_path}/c.jsonl")
    assert tables.read_chunks(spark, f"{tmp_path}/c.jsonl").count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_goldset(spark, f"{tmp_path}/none.json")
    assert tables.read_unanswerable(spark, f"{tmp_path}/none.json") is None and tables.read_titles(spark, f"{tmp_path}/none").count() == 0
    log = spark.createDataFrame([("x", "precise", "i", True, True, 1)], schemas.PER_QUESTION)
    tables.write_results(log, f"{tmp_path}/r")
    assert tables.read_results(spark, f"{tmp_path}/r", "x").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_results(spark, f"{tmp_path}/r", "y")


def test_files_to_blocks(spark, tmp_path):
    for name in ("a.pdf", ".hidden.pdf", "b.txt"):
        (tmp_path / name).write_bytes(b"two")

    def extractor(content):
        yield 1, "Table", "| t |", 0.0, 0.0, 10.0, 10.0
        yield 1, "NarrativeText", "im Raster", 5.0, 5.0, 6.0, 6.0
        yield 1, "NarrativeText", "Ein freier Absatz mit Text.", 20.0, 20.0, 30.0, 30.0

    kept = E.without_overlap(E.extract(E.scan_files(spark, str(tmp_path)), extractor))
    assert {r["text"] for r in kept.collect()} == {"| t |", "Ein freier Absatz mit Text."}
    assert {r["text"] for r in E.accept(kept).collect()} == {"| t |", "Ein freier Absatz mit Text."}
    with pytest.raises(FileNotFoundError):
        E.scan_files(spark, str(tmp_path), "*.docx")


def test_streaming_ingest(spark, tmp_path):
    from regelspur.streaming.ingest import ingest

    store = VectorStore(spark, f"{tmp_path}/v")
    for n in (1, 2):
        blocks(spark).withColumn("source_file", F.concat("source_file", F.lit(str(n)))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = ingest(spark, f"{tmp_path}/in", store, dense.HashingEmbedder(), f"{tmp_path}/cp")
        q.awaitTermination()
        assert q.exception() is None
        assert store.read().count() == 2 * n


def test_cli(spark, sf, tmp_path, capsys):
    from regelspur import cli

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id <= 20")
    docs.write.parquet(f"{tmp_path}/docs")
    cli.main(["build-index", f"{tmp_path}/docs", f"{tmp_path}/ix"])
    cli.main(["goldset", f"{tmp_path}/ix", f"{tmp_path}/gold"])
    for c in ("hybrid", "mvp_baseline"):
        cli.main(["eval", f"{tmp_path}/ix", f"{tmp_path}/gold", f"{tmp_path}/res", "--config", c])
    cli.main(["compare", f"{tmp_path}/res", "mvp_baseline", "hybrid"])
    cli.main(["ask", f"{tmp_path}/ix", "Wer prüft die Anlage?", "--out", f"{tmp_path}/a.txt"])
    out = capsys.readouterr().out
    assert "hit_at_5" in out and (tmp_path / "a.txt").exists()
