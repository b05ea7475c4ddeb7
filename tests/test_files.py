"""Files to blocks and titles, the store in parts, the abstention run, chat models, the command line."""

import pytest
from pyspark.sql import functions as F

from regelspur import cli, session
from regelspur.config import get_config
from regelspur.operators import answers, dense, evaluation, goldset, lexical, retrievers
from regelspur.sources import elements as E
from regelspur.sources import extractors as X
from regelspur.sources.store import VectorStore

HTML = b"""<html><head><title>UVK Regel 1-2: Krane</title><style>p {}</style></head><body><h1>Krane</h1><p>Der Kran &amp; das Tor.<br>Zweite Zeile</p>
<table><tr><th>Typ</th><th>Wert</th></tr><tr><td>A|B</td><td>5 <b>kg</b></td></tr></table><p>Danach.</p><table><tr><td>offen"""
TEXT = "# Titel der Datei\n\nErster Absatz\nmit zwei Zeilen.\n\n| a | b |\n|---|---|\n| 1 | 2 |\ndahinter\n\fZweite Seite".encode()


def test_extractors():
    got = [(kind, text) for _, kind, text, *_ in X.html_blocks(HTML)]
    assert got == [("NarrativeText", "Krane"), ("NarrativeText", "Der Kran & das Tor."), ("NarrativeText", "Zweite Zeile"), ("Table", "| Typ | Wert |\n|---|---|\n| A\\|B | 5 kg |"), ("NarrativeText", "Danach."), ("Table", "| offen |\n|---|")]
    got = [(page, kind, text) for page, kind, text, *_ in X.text_blocks(TEXT)]
    assert got == [(1, "NarrativeText", "# Titel der Datei"), (1, "NarrativeText", "Erster Absatz\nmit zwei Zeilen."), (1, "Table", "| a | b |\n|---|---|\n| 1 | 2 |"), (1, "NarrativeText", "dahinter"), (2, "NarrativeText", "Zweite Seite")]
    assert list(X.html_blocks(b"")) == [] == list(X.text_blocks(b" \n\n ")) and X.title_of("a.html", HTML) == "UVK Regel 1-2: Krane" and X.title_of("a.md", TEXT) == "Titel der Datei"
    assert len(list(X.text_blocks(b"\xff\xfe kaputt"))) == 1


def test_files_to_an_index_and_titles(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "kran.html").write_bytes(HTML)
    (tmp_path / "in" / "tor.md").write_bytes(("# Das Tor im Hof\n\n" + "Das Tor wird jeden Tag von der Wache geprüft und am Abend verschlossen. " * 6).encode())
    (tmp_path / "in" / "leer.txt").write_bytes(b"\n")
    files = E.scan_files(spark, str(tmp_path / "in"), "*")
    blocks = E.without_overlap(E.extract(files))
    assert blocks.where("type = 'Table'").count() == 2 and blocks.where("source_file = 'leer.txt'").count() == 0
    cli.main(["build-index", str(tmp_path / "in"), str(tmp_path / "index"), "--files", "*"])
    cli.main(["titles", str(tmp_path / "in"), str(tmp_path / "index" / "titles")])
    names = {r["source_file"]: r["title"] for r in spark.read.parquet(str(tmp_path / "index" / "titles")).collect()}
    assert names == {"kran.html": "UVK Regel 1-2 - Krane", "tor.md": "Das Tor im Hof", "leer.txt": "leer"}
    capsys.readouterr()
    lines = iter(["Wer prüft das Tor jeden Tag?", ""])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    cli.main(["ask", str(tmp_path / "index"), "--config", "hybrid"])
    assert "Wache" in capsys.readouterr().out
    rows = [("u1", "Was kostet ein Flugzeug aus Papier?", "fremd", "Papier", None), ("u1", "Was kostet ein Flugzeug aus Papier?", "fremd", "Papier", None), ("u2", None, None, "x", None)]
    spark.createDataFrame(rows, "id string, question string, category string, anchor_term string, why_unanswerable string").write.parquet(str(tmp_path / "un"))
    gold = [("gold-001", "c", "tor.md", 1, "NarrativeText", "Wer prüft das Tor?", "Wer verschließt das Tor?", "von der Wache geprüft")]
    spark.createDataFrame(gold, "id string, chunk_id string, source_file string, page_number int, chunk_type string, question_colloquial string, question_precise string, answer_snippet string").write.parquet(str(tmp_path / "gold"))
    cli.main(["eval", str(tmp_path / "index"), str(tmp_path / "gold"), str(tmp_path / "results"), "--config", "hybrid", "--unanswerable", str(tmp_path / "un"), "--timed", "1"])
    out = capsys.readouterr().out
    assert "median" in out and "fremd" in out and "uncategorised" in out


def test_abstention_run_and_latency(spark):
    chunks = spark.createDataFrame([("c1", "Das Tor wird von der Wache geprüft.", "a.pdf", 1, "NarrativeText")], "chunk_id string, text string, source_file string, page_number int, type string")
    found = retrievers.LexicalRetriever(lexical.build_index(chunks))
    rows = spark.createDataFrame([("a", "Wer prüft das Tor der Wache?", "x"), ("b", "Wie hoch ist der Mond?", "y"), ("b", "Wie hoch ist der Mond?", "y"), ("c", None, None)], "id string, question string, category string")
    none = spark.createDataFrame([], "source_file string, title string")
    got = {r["id"]: r["abstained"] for r in evaluation.abstention_run(found, rows, chunks, none).collect()}
    assert got == {"a": False, "b": True, "c": True}
    asked = rows.select(F.col("id").alias("qid"), "question")
    assert evaluation.latency(found, asked, 5, 2) > 0 and evaluation.latency(found, asked, 5, 0) == 0


def test_chat_models(spark):
    def complete(prompts):
        return ["Die Wache [a.pdf, Seite 1]" if "Tor" in p.split("Frage:")[-1] else "[KEINE_ANTWORT] weiß ich nicht" for p in prompts]

    chunks = spark.createDataFrame([("c1", "Das Tor wird von der Wache geprüft.", "a.pdf", 1), ("c2", "Das Tor am Hof.", None, None)], "chunk_id string, text string, source_file string, page_number int")
    asked = spark.createDataFrame([("q1", "Wer prüft das Tor?"), ("q2", "Und der Kran?"), ("q3", "ohne")], "qid string, question string")
    ranked = spark.createDataFrame([("q1", 1, "c1"), ("q1", 2, "c2"), ("q2", 1, "c2")], "qid string, rank int, chunk_id string")
    none = spark.createDataFrame([], "source_file string, title string")
    got = {r["qid"]: r for r in answers.answer(asked, ranked, chunks, none, generator=answers.chat_generator(complete)).collect()}
    assert got["q1"]["answer"] == "Die Wache [a.pdf, Seite 1]" and len(got["q1"]["sources"]) == 1
    assert got["q2"]["abstained"] and got["q2"]["answer"] == "weiß ich nicht" and got["q3"]["abstained"]
    text = answers.render(1, got["q1"], [{"source_file": "a.pdf", "page_number": 1}, {"source_file": "b.pdf", "page_number": None}])
    assert "nicht verwendet" in text and "b.pdf, Seite ?" in text and text.count("a.pdf, Seite 1") == 2

    def entries(prompts):
        return ['{"question_colloquial": "Wer?", "question_precise": "Wer prüft?", "answer_snippet": "Das Tor wird von der Wache geprüft"}' for _ in prompts]

    made = goldset.generate_entries(chunks, goldset.chat_generator(entries)).collect()
    assert [r["problem"] for r in sorted(made, key=lambda r: r["chunk_id"])] == [None, "snippet not found verbatim in the chunk"]


def test_numbers_after_the_largest_in_use(spark):
    text = "Die Wache prüft jeden Tag das Tor und den Kran im Hof der Werkstatt sorgfältig. " * 5
    rows = [(i, f"c{i}", "a.pdf", 1, "NarrativeText", text + str(i)) for i in range(4)]
    chunks = spark.createDataFrame(rows, "position int, chunk_id string, source_file string, page_number int, type string, text string")
    old = [("gold-12345678", "c0", "a.pdf", 1, "NarrativeText", "x", "y", "z"), ("eigen", None, None, None, None, None, None, None)]
    old = spark.createDataFrame(old, "id string, chunk_id string, source_file string, page_number int, chunk_type string, question_colloquial string, question_precise string, answer_snippet string")
    assert sorted(r["id"] for r in goldset.new_entries(chunks, old).collect()) == [f"gold-{12345679 + k}" for k in range(3)]
    assert sorted(r["id"] for r in goldset.build_goldset(chunks).collect()) == [f"gold-00{k}" for k in range(1, 5)]


def test_store_in_parts(spark, tmp_path):
    rows = lambda ids, page: spark.createDataFrame([(i, [float(page)], "NarrativeText", page, "f") for i in ids], "chunk_id string, embedding array<float>, type string, page_number int, source_file string")
    store = VectorStore(spark, str(tmp_path / "s"), parts=8)
    store.upsert(rows([f"k{i}" for i in range(100)], 1))
    first = store._manifest()["versions"]
    reader = store.read()
    store.upsert(rows(["k1", "neu"], 2))
    second = store._manifest()["versions"]
    assert sum(first[p] != second[p] for p in first) <= 2  # only the parts touched are written anew
    assert reader.count() == 100  # a reader that began before goes on
    assert {r["chunk_id"]: r["page_number"] for r in store.read().where("page_number = 2").collect()} == {"k1": 2, "neu": 2} and store.read().count() == 101
    again = VectorStore(spark, str(tmp_path / "s"))
    assert again.parts == 8
    again.reset()
    assert again.read().count() == 0


def test_saved_index_reads_the_folders_of_its_terms(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"wort{i} kran tor{i % 5}") for i in range(50)], "chunk_id string, text string")
    index = lexical.build_index(chunks)
    index.save(str(tmp_path / "i"))
    asked = spark.createDataFrame([("q", "Kran tor3"), ("r", "fehlt")], "qid string, question string")
    loaded = lexical.LexicalIndex.load(spark, str(tmp_path / "i"), "chunk_id")
    want = sorted(map(tuple, lexical.search(index, asked, 5, decimals=6).collect()))
    assert want and sorted(map(tuple, lexical.search(loaded, asked, 5, decimals=6).collect())) == want
    plan = loaded.of_terms(asked.select(F.lit("kran").alias("term")))[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan


def test_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId, master = "app-x", "spark://host:7077"

        def getCheckpointDir(self):
            return self.folder

    class Session:
        conf, sparkContext = Conf(), Context()

    Context.folder = "hdfs://a/b/"
    assert session.shared_dir(Session()) == "hdfs://a/b"
    Context.folder = None
    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    Context.master = "local[4]"
    assert session.shared_dir(Session()).startswith("file://")
