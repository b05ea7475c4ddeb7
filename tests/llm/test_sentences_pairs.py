"""Sentence boundaries on examples of each script; broken pairs on the test tables."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regelspur.llm import pairs as P
from regelspur.llm import sentences as S


@pytest.fixture(scope="module")
def model(spark, sf):
    return S.fit_boundaries(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text")


UNITS = [
    ["Hr. Tesmark und Fr. Olberding begleiten z. B. die Messung u. a. in Ulrihagen.", "Zum Zubehör zählen Leitern usw.", "Die Prüfung ist beendet."],
    ["Am 8. März 2012 wurde im 2. Halbjahr geprüft.", "Laut Nr. 6 Abs. 2 gilt das nicht."],
    ["„Schalten Sie die Leitung ab! Sofort!“, verlangte die Betriebsleitung um 20.25 Uhr.", "Achtung!"],
    ["Die Prüfperson notierte: „Die Anlage ist gesichert.“", "Die Leitung fehlt."],
    ["Die Werkleitung zögerte ... und ließ es dann.", "Die Version 2.8.1 der Datei plan.318.pdf beschreibt die Messung ...", "Die Arbeit ruht."],
    ['"Is the bay logged?" asked the storekeeper twice.', 'The engineer shouted "Stop! Not that tray!" and froze.', "See Sec. 2.13 and Fig. 9 for approx. 622.5 V at the inverter."],
    ["Est-ce que le chariot a bien été balisé ?", "M. Dutreille note 78 °C dans le registre.", "Le gardien a crié : « Coupez ! Vite ! » avant que le câble ne soit rangé."],
    ["«¿Está medido?», preguntó la técnica junto a la puerta 46.", "¡No toque el andamio!", "El Sr. Barrunto anota 27 kV."],
    ["На рис. 9 показан насос, см. также стр. 24.", "«Не включать! Работают люди!» — гласит табличка.", "Кто видел, что кран заземлён?"],
    ["Ποιος φύλακας είδε ότι ο αγωγός σημαίνεται;", "Ο μηχανικός, π.χ. στη θέση BF4235, βλέπει."],
    ["电工说：“发电机坏了！快停！”，随后更换了变压器。", "监护人写道：“起重机已封闭。”", "谁测量了蓄电池？"],
    ["当直者は「変圧器を止めろ！早く！」と叫び、クレーンを点検した。", "発電機は誰が接地したのか？"],
    ["क्या पैनल को बंद किया गया?", "केबल पर 2.5 kV है, इसलिए डॉ. वेरोनी के बिना कोई पास न जाए।", "बिना अनुमति पैनल को मत छुओ!"],
    ["هل انتهى الحارس من تنظيف اللوحة؟", "لا تقترب من الرافعة أثناء عزل المحول!"],
    ["แรงดันของเครนคือ 4.3 kV และยามเวรเป็นผู้ตรวจสอบ", "หัวหน้ากะต้องเปลี่ยนปั๊มน้ำก่อนเริ่มงานทุกครั้ง"],
]


@pytest.mark.parametrize("units", UNITS)
def test_units(model, units):
    glue = "" if S._cjk.search(units[0]) else " "
    text, want = "", []
    for u in units:
        text += glue if text else "  "
        want.append(len(text))
        text += u
    assert model.starts(text) == want
    assert model.starts(text.replace(" ", "\n") if glue else text) == want  # hard-wrapped


def test_all_of_a_paragraph_decides_its_script():
    latin, russian = "Der Kran ist frei und wird nicht geprüft. ", "Насос включён. "
    assert S._group(latin * 9 + russian * 40) == "cy" and S._group(russian * 25 + latin * 20) == "la"
    assert S._group("µ" + latin) == "la" and S._group("ไฟ " + latin) == "la" and S._group("ชั้น ห้ามเข้าใกล้ a") == "th"


def test_language_lists_of_pairs():
    names = "Tesmark 4711, Olberding 0815; " * 12
    english, german = "The panel is open and was not in use. ", "Der Kran ist frei und wird nicht von der Werkstatt geprüft. "
    assert P.group_of(names + english * 3) == "en" and P.group_of(english * 9 + german * 30) == "de"


def fitted(texts):
    """The models, fitted as the tasks and the driver do, without Spark."""
    marks, counts = S.MarkCounts(), S.Counts()
    notes, words = S.Notes.read(texts), S.Words(texts)
    marks.add(notes)
    counts.add(words, notes.where(words)[notes.starts])
    S._count_styles(counts, notes)
    return S.Boundaries(S.MarkModel(*marks.rows()), S.WordModel(counts.tables, counts.marked, counts.bare))


def test_words_of_any_length_and_pairs_of_words():
    """Long abbreviations are known by themselves, and a number by the word before it."""
    words = [f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rng = random.Random(1)
    some = lambda: " ".join(rng.choices(words, k=rng.randint(3, 6)))
    texts = []
    for i in range(1500):
        inner = (f"Am {i % 28}. Mai {some()}.", f"{some()} Versuchsanordnungsbez. Kasten {some()}.", f"{some()} puerta {i % 50}.", f"{some()}.")[i % 4]
        texts.append(f"{some()}. {inner} {some()}.\n\n{some()} puerta {i % 40}.")
    model = fitted(texts)
    a, b = "Worta Wortb Versuchsanordnungsbez. Kasten Wortc.", "Worta Wortb Wortc. Kasten Wortc."
    assert model.starts(a) == [0] and model.starts(b) == [0, 19]
    assert model.starts("Am 8. Mai Worta Wortb.") == [0] and model.starts("Worta puerta 8. Mai Worta.") == [0, 16]


def test_every_word_is_counted_and_the_tables_do_not_grow():
    texts = [f"Wort{i} steht im Satz q{i}x. Ein anderes Wort{i}a folgt." for i in range(3000)]
    marks, counts = S.MarkCounts(), S.Counts()
    notes, words = S.Notes.read(texts), S.Words(texts)
    marks.add(notes)
    counts.add(words, notes.where(words)[notes.starts])
    (cells, n), (pairs, m) = marks.rows()
    assert n.sum() == len(notes.lefts) and m.sum() == (notes.contexts >= 0).sum()
    assert {k: len(t) for k, t in counts.tables.items()} == S.TABLES
    assert counts.tables["starts"].sum() == counts.tables["ends"].sum() == 3000
    assert counts.tables["pairs"].sum() == 3000 * 7


def test_tasks_send_a_row_a_slice_and_their_sums_are_whole(spark, monkeypatch):
    """Counts of several tasks come to the driver in rows of many cells each, and add up to those of all texts."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("length(text) > 0")
    sent, collect = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: sent.append(collect(self)) or sent[-1])
    got = S.fit_boundaries(df.repartition(5), "text")
    monkeypatch.undo()
    want = fitted([r["text"] for r in df.collect()])
    assert all((got.words.t[k] == want.words.t[k]).all() for k in S.TABLES) and got.words.bare_rate == want.words.bare_rate
    assert all(np.array_equal(getattr(got.marks, k), getattr(want.marks, k)) for k in ("cells", "context_cells", "weights", "told", "none", "some"))
    assert sum(t.num_rows for t in sent) < 500 < got.words.t["triples"].astype(bool).sum()


def test_counts_of_any_size_are_packed_and_added_up():
    rng = np.random.default_rng(8)
    cells = rng.choice(5 * S.SLICE, 4000, replace=False)
    total = np.zeros(5 * S.SLICE, np.int64)
    rows = []
    for n in (np.ones(4000, np.int64), rng.integers(0, 1 << 20, 4000), rng.integers(0, 1 << 40, 4000)):
        total[cells] += n
        rows += [(1, *r) for r in S._slices(cells, n)]
    rows.sort(key=lambda r: r[:2])
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 4]), S._COUNTS.values())], list(S._COUNTS)) for k in range(0, len(rows), 4)]
    found = np.zeros_like(total)
    for r in pa.Table.from_batches(list(S._add_up(iter(batches)))).to_pylist():
        found[np.cumsum(S._unpacked(r["cells"])) + r["slice"] * S.SLICE] += S._unpacked(r["counts"])
    assert (found == total).all() and not list(S._slices(np.arange(3), np.zeros(3, np.int64)))


def test_seconds_beside_those_of_finding_words(spark, model):
    """Reading, counting and deciding the texts of the table takes 5.4 times as long as finding their words at most
    (4 measured; 6.4 to 7.4 in the form over the budget)."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0").select("text").collect()]

    def decided():
        marks, counts = S.MarkCounts(), S.Counts()
        for k in range(0, len(texts), 250):
            part = texts[k : k + 250]
            notes, words = S.Notes.read(part), S.Words(part)
            marks.add(notes)
            counts.add(words, notes.where(words)[notes.starts])
            model.decide(part, notes)

    def seconds(f):
        times = []
        for _ in range(7):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        return min(times)

    assert seconds(decided) < 5.4 * seconds(lambda: [[w.lower() for w in re.findall(r"\w+", t)] for t in texts])


def test_scripts_with_spaces_between_phrases():
    own = lambda t: [t[a:b].strip() for m in [fitted([t] * 40)] for a, b in zip(m.starts(t), [*m.starts(t)[1:], len(t)])]
    lao = ["ຫ້າມເຂົ້າໃກ້ຕູ້ໄຟ", "ຊ່າງໄຟຟ້າຕ້ອງຕັດໄຟ 4 ເສັ້ນ"]
    khmer = ["ប្រយ័ត្នភ្លើង។", "កុំ ចូលជិត។", "ជាងត្រូវបិទ។"]
    burmese = ["မီးကိုပိတ်ပါ။", "အခန်းထဲ မဝင်ရ။", "လျှပ်စစ်သမား စစ်ဆေးသည်။"]
    for units in (lao, khmer, burmese):
        assert own(" ".join(units)) == units
    assert own("".join(khmer[::2])) == khmer[::2]


def test_text_without_marks(model):
    """Words alone decide where lines have no marks: nothing in a heading, sentences in a line of speech."""
    line = "the shift leader records each hand lamp that was measured during the shift nothing may be stored on the hand lamp"
    assert [line[a:] for a in model.starts(line)][1:] == ["nothing may be stored on the hand lamp"]
    japanese = "接地線は誰が測定したのか停止中に制御盤へ近づくな"
    assert model.starts(japanese) == [0, japanese.index("停止中")]
    for heading in ("Anforderungen an die Netzwagenleitung", "8.4 Anforderungen an die Netzwagenleitung", "Tabelle 2.9: Antriebseinzelanlage"):
        assert model.starts(heading) == [0]


def test_unmarked_lines_of_the_table(spark, model):
    """Sentences of the table with their marks taken away: most boundaries come out, few others do."""
    right = wrong = missed = 0
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and length(text) > 0").select("text").collect():
        for a, b in S.paragraphs(text):
            part = text[a:b]
            starts = model.starts(part)
            if len(starts) < 2 or '"' in part:
                continue
            units = [re.sub(r"[.!?](?=\s|$)", "", part[x:y].strip()).replace("\n", " ").lower() for x, y in zip(starts, [*starts[1:], len(part)])]
            want = [sum(len(u) + 1 for u in units[:k]) for k in range(len(units))]
            got = model.starts(" ".join(units))
            right, wrong, missed = right + len(set(got) & set(want)) - 1, wrong + len(set(got) - set(want)), missed + len(set(want) - set(got))
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.6


def test_events_depend_on_each_other():
    """Two places a few characters apart are not both boundaries; a chain equals the sum over all its paths."""
    b = S.Boundaries(S.MarkModel((np.zeros(0, np.int64),) * 2, (np.zeros(0, np.int64),) * 2), S.WordModel({}))
    rng = np.random.default_rng(3)
    for n in range(2, 7):
        weights = rng.random((n, 2, 2))
        got = b._forward_backward(np.arange(n) * 100, np.arange(n), weights.copy(), np.zeros(n))
        mass = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=n):
            w = weights[0, 0, path[0]] * np.prod([weights[k, path[k - 1], path[k]] for k in range(1, n)])
            for k in range(n):
                mass[k, path[k]] += w
        assert (got == (mass[:, 1] > mass[:, 0])).all()
    two = np.array([[[0.1, 0.9]] * 2, [[0.2, 0.8]] * 2])
    assert b._forward_backward(np.array([0, 3]), np.array([-1, -1]), two.copy(), np.zeros(2)).sum() == 1
    assert b._forward_backward(np.array([0, 30]), np.array([-1, -1]), two.copy(), np.zeros(2)).sum() == 2


def test_lists_headings_and_blank_lines(model):
    text = "4.1 Hinweise zur Prüfung\n\nEs gilt:\n• eins, 5 V;\n• zwei, 6 V;\n\n1. Leiter, 3 A.\n2. Mast, 4 A.\n \nEnde am\n8. Mai."
    units = [text[a:b].strip() for a, b in zip(model.starts(text), [*model.starts(text)[1:], len(text)])]
    assert units == ["4.1 Hinweise zur Prüfung", "Es gilt:", "• eins, 5 V;", "• zwei, 6 V;", "1. Leiter, 3 A.", "2. Mast, 4 A.", "Ende am\n8. Mai."]


def test_tables(spark, model):
    rows = [(1, " A ist da. B ist dort. ", 0), (2, None, 0), (3, "", 0), (4, " \n ", 0), (1, "Eins.", 0), (5, "Der Satz ist hier zu Ende. " * 20_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, unit int")
    got = S.sentence_units(df, "doc_id", "text", model)
    assert {(r["doc_id"], r["start_char"], r["unit"]) for r in got.where("doc_id = 1").collect()} == {(1, 1, "A ist da."), (1, 11, "B ist dort."), (1, 0, "Eins.")}
    assert got.where("doc_id in (2, 3, 4)").count() == 0 and got.where("doc_id = 5").count() == 20_000
    assert S.sentence_starts(df.where("doc_id < 5"), "doc_id", "text").count() >= 2
    assert S.sentence_starts(df.limit(0), "doc_id", "text").count() == 0


def test_held_out_accuracy(spark):
    """Responses made from entries that were not trained on, by their kind."""
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    chunks = read("chunks")
    texts = chunks.where("length(text) > 0").groupBy("chunk_id").agg(F.min_by("text", "position").alias("text"))
    rows = [tuple(r) for r in read("goldset").join(texts, "chunk_id").select("id", "question_colloquial", "question_precise", "answer_snippet", "text").orderBy("id").collect()]
    judge = P.Judge(P.fit_scripts(chunks, "text"), P.fit_boundaries(chunks, "text"))
    P.train(judge, rows[::2])
    plain = [(k, *(judge.plain(x) for x in r)) for k, *r in rows[1::2]]
    sound = [x for x in plain if len(x[3]) > 20 and judge.standing(x[3], x[4]) == (True, False, 0)]
    made, labels = P._responses(judge, sound, random.Random(99))
    scores = judge.scores(made)
    right = 0
    for s, y in zip(scores, labels):
        want = next((d for d, v in zip(P.DEFECTS, y) if v), None)
        right += judge.defect(s) == want
    assert right / len(labels) > 0.95


def test_broken_pairs_edges(spark):
    schema = "id string, chunk_id string, question_colloquial string, question_precise string, answer_snippet string, defect int"
    rows = [("a", "c1", "Was gilt?", "Welcher Wert gilt?", None, 1), ("a", "c1", "Was gilt?", "Welcher Wert gilt?", None, 1), ("b", None, None, None, " ​ ", 1), ("c", "zz", None, None, "Ein ganz gewöhnlicher Satz mit Inhalt.", 1)]
    gold = spark.createDataFrame(rows, schema)
    chunks = spark.createDataFrame([(1, "c1", "Der Wert gilt hier."), (2, "c1", None)], "position int, chunk_id string, text string")
    assert sorted(map(tuple, P.broken_pairs(gold, chunks).collect())) == [("a", "empty"), ("b", "empty")]
    assert P.broken_pairs(gold.limit(0), chunks.limit(0)).count() == 0


PAIRS = "id string, chunk_id string, question_colloquial string, question_precise string, answer_snippet string"


def german(rng):
    thing, who, when = (rng.choice(w.split()) for w in ("Anlage Leitung Pumpe Schaltung Station Kabeltrommel", "Werkstatt Aufsicht Leitstelle Schicht", "jährlich täglich monatlich wöchentlich"))
    return f"Was gilt für die {thing}?", f"Wer prüft die {thing} und wann?", f"Die {thing} {rng.randint(2, 900)} wird {when} von der {who} geprüft und gesichert."


def english(rng):
    thing, who, when = (rng.choice(w.split()) for w in ("pump gauge ladder panel engine cupboard", "foreman workshop keeper clerk", "yearly daily monthly weekly"))
    return f"What is the rule for the {thing}?", f"Who must check the {thing} and when?", f"The {thing} {rng.randint(2, 900)} must be checked {when} by the {who} and then locked again."


def table(spark, made):
    """(gold, chunks) of sound entries: (id, both questions, answer)."""
    gold = spark.createDataFrame([(k, f"c{k}", c, p, a) for k, (c, p, a) in made], PAIRS)
    return gold, spark.createDataFrame([(n, f"c{k}", f"{a}\n\nEnde.") for n, (k, (_, _, a)) in enumerate(made)], "position int, chunk_id string, text string")


def test_entries_beyond_one_block_train_too(spark):
    """Only the entries behind the first 2,000 by the hash of their id are English: their language is learned all the same."""
    rng = random.Random(5)
    ids = [r["id"] for r in spark.range(2400).select(F.concat(F.lit("k"), "id").alias("id")).orderBy(F.xxhash64("id"), "id").collect()]
    gold, chunks = table(spark, [(k, german(rng) if n < 2000 else english(rng)) for n, k in enumerate(ids)])
    odd = {f"e{n}": english(rng) for n in range(40)}
    gold = gold.unionByName(spark.createDataFrame([(k, None, *x) for k, x in odd.items()], PAIRS))
    swapped = {f"s{n}": (*english(rng)[:2], german(rng)[2]) for n in range(40)}
    gold = gold.unionByName(spark.createDataFrame([(k, None, *x) for k, x in swapped.items()], PAIRS))
    assert set(map(tuple, P.broken_pairs(gold, chunks).collect())) == {(k, "other_language") for k in swapped}


def test_one_block_is_what_the_driver_trains(spark):
    rng = random.Random(6)
    made = [(f"k{n}", (german, english)[n % 3 == 0](rng)) for n in range(150)]
    gold, chunks = table(spark, made)
    joined = gold.join(chunks.select("chunk_id", "text"), "chunk_id")
    scripts, boundaries = P.fit_scripts(joined, "text"), P.fit_boundaries(joined, "text")
    fields = ["id", "question_colloquial", "question_precise", "answer_snippet", "text"]
    want = P.train(P.Judge(scripts, boundaries), [tuple(r) for r in joined.select(fields).orderBy(F.xxhash64("id"), "id").collect()])
    got = P._learned(P._read(joined, scripts, boundaries))
    assert got.grams == want.grams and got.grams["en"] and np.allclose(got.weights, want.weights) and (got.thresholds == want.thresholds).all()


def test_blocks_hold_every_sound_entry(spark, monkeypatch):
    """Each block trains with the language that all entries teach, and the mean of the blocks judges."""
    rng = random.Random(7)
    monkeypatch.setattr(P, "BLOCK", 60)
    gold, chunks = table(spark, [(f"k{n}", (german, english)[n % 4 == 0](rng)) for n in range(400)])
    bad = [("x1", "ck1", *german(rng)[:2], english(rng)[2]), ("x2", None, *english(rng)[:2], "n/a"), ("x3", None, *german(rng)[:2], "Darauf kann ich nicht antworten.")]
    found = set(map(tuple, P.broken_pairs(gold.unionByName(spark.createDataFrame(bad, PAIRS)), chunks).collect()))
    assert found == {("x1", "other_language"), ("x2", "empty"), ("x3", "refusal")}
