"""Broken question and answer pairs.

Method: a multi-label linear classifier (one logistic regression a defect) over hashed word n-grams
of the answer and features of the pair: whether and how the answer stands in its chunk, how much of
it is the question, how much of its spelling is that of the question's language. It is trained here
on responses made from all of the table's own sound answers: truncated, copied from the question,
swapped between languages, refused, emptied. A quarter of these is held out to calibrate a threshold
a defect (best F1). The first defect of ``DEFECTS`` above its threshold is the entry's.

Every sound entry is trained on and every entry is judged. The tasks train on blocks of about
``BLOCK`` entries, put together by a hash of their id; the model is the mean of the blocks', each as
heavy as its responses are many, and its thresholds are the best on what all blocks held out. A table
of at most ``BLOCK`` sound entries is one block. All text is compared in consistent form.

- a null or blank answer is ``empty``; null questions and unknown chunks are no defect by themselves;
- repeated ids give one row: the entry whose fields come first in order;
- an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regelspur.session import cut, fits
from regelspur.llm.consistent import ScriptModel, consistent_form, fit_scripts
from regelspur.llm.sentences import Boundaries, fit_boundaries
from regelspur.llm.words import words_of

#: The defects in the order in which the first that applies is taken.
DEFECTS = ("empty", "refusal", "copied_question", "other_language", "truncated")
#: Entries that are trained on together, hashed n-gram buckets, steps of the descent.
BLOCK, BUCKETS, STEPS = 2000, 1 << 14, 80
#: Columns of the features of the pair, in front of those of the n-grams.
DENSE = 64
#: Thresholds that are tried.
LEVELS = np.linspace(0.2, 0.9, 29)
#: A trigram belongs to a language that has it twice, and once in so many of its entries.
USUAL = 1000
#: Words, tokens and n-grams remembered at most by a task; forgotten beyond it and worked out again.
MEMO = 200_000
#: Chunk ids up to which the gold set's are broadcast to the chunks; beyond it they are joined by a shuffle.
BROADCAST_IDS = 250_000

#: Material of the synthetic responses.
PLACEHOLDERS = ("", " ", "\t", "-", "--", "—", "...", "…", "?", "(…)", "„“", "k. A.", "k.A.", "keine Angabe", "keine Angaben", "n/a", "N/A", "n. a.", "na", "null", "NULL", "None", "none", "nil", "nan", "NaN", "[leer]", "leer", "(leer)", "[empty]", "empty", "TODO", "todo", "TBD", "tbd", "xxx", "XXX", "N.N.", "unbekannt", "unknown", "fehlt", "offen", "not available", "no answer", "[...]", "<null>", "#N/A", "undefined", "missing", "entfällt", "folgt", "ausstehend", "[Antwort]", "Platzhalter", "placeholder", "Antwort folgt", "leer lassen", "blank", "*", "./.", "/")
_SORRY = ("", "Leider ", "Tut mir leid, ", "Es tut mir leid, aber ", "Ich bedaure, aber ", "Hinweis: ", "Entschuldigung, ", "Bedauerlicherweise ", "[KEINE_ANTWORT] ", "Ich bitte um Verständnis: ", "Verzeihung, ")
_REFUSED = (
    "darauf kann ich nicht antworten", "diese Frage kann ich nicht beantworten", "diese Frage lässt sich aus dem Auszug nicht beantworten",
    "der vorliegende Text enthält keine Antwort darauf", "im Auszug steht dazu nichts", "dazu kann ich keine Auskunft geben", "dazu liegen mir keine Informationen vor",
    "ich kann hierzu nichts sagen", "hierzu möchte ich mich nicht äußern", "darauf darf ich nicht eingehen", "eine Beantwortung ist mir nicht möglich",
    "mir fehlen die Angaben, um das zu beantworten", "als Sprachmodell gebe ich keine Sicherheitsberatung", "als KI kann ich dazu keine Auskunft erteilen",
    "dabei kann ich nicht helfen", "das kann ich nicht beurteilen", "der Kontext beantwortet die Frage nicht", "ich habe darauf keine Antwort", "dazu finde ich im Text keine Angabe",
    "ich bin nicht in der Lage, diese Frage zu beantworten", "hierzu gebe ich keine Auskunft", "ich weiß es nicht", "diese Auskunft muss ich verweigern", "ich darf dazu keine Empfehlung abgeben",
)
_AFTER = ("", ".", ". Versuchen Sie es mit einer anderen Frage.", ". Bitte wenden Sie sich an {who}.", "; zuständig ist {who}.", ", fragen Sie bitte {who}.", ". Bitte fragen Sie {who}.", "; bitte schlagen Sie selbst nach.")
_WHO = ("die Leitstelle", "die Bauleitung", "die Koordination", "die Fremdfirma", "die Werkleitung", "eine Fachkraft", "die Prüfperson", "die Aufsichtsperson", "die Betriebsleitung", "die Arbeitsgruppe", "die Schaltleitung", "die Instandhaltung")
_SORRY_EN = ("", "Sorry, ", "I am sorry, but ", "I'm sorry, but ", "Unfortunately, ", "I apologise, but ", "Note: ", "Regrettably, ")
_REFUSED_EN = ("I cannot answer that", "I can't help with this question", "I am unable to answer this question", "the excerpt does not contain the answer, so I must decline", "the text does not say anything about this", "as a language model I do not give safety advice", "I have no information on this", "I would rather not comment on this", "I must decline to answer", "this cannot be answered from the excerpt", "I am not allowed to go into that", "I do not know", "no answer can be given to this question", "please ask someone else, I cannot say")
_AFTER_EN = (".", "", ". Please contact the safety officer.", ". Try another question.", "; please ask the supervisor.", ". Please ask the shift leader.")
_LEADS = ("", "", "", "Antwort: ", "Frage: ", "Gefragt ist: ", "Die Frage lautet: ", "Zur Frage: ", "Hier die Antwort: ", "Answer: ", "Question: ", "The question is: ", "You asked: ", "Sie fragten: ")
#: A few sentences of languages that the questions are not in.
_FOREIGN = (
    "Avant le début des travaux, le chef d'équipe vérifie que l'installation est hors tension.", "Le tableau doit être mesuré par la technicienne après chaque modification.", "Il est interdit de toucher le câble sans autorisation écrite.",
    "Mme Lenoir inscrit 12 V dans le cahier et ferme le local.", "Le responsable mesure 230 mA et note la valeur sur la fiche.", "On ferme le coffret dès que le témoin passe au rouge.", "Chaque disjoncteur porte un numéro et une date de contrôle.", "La borne reste sous clé jusqu'à la fin du service.",
    "La jefa anota 12 V en el libro y cierra la sala.", "Se mide la corriente y se apunta el valor en la hoja.", "Cada motor lleva un número y una fecha de control.", "Il tecnico misura 12 V e annota il valore nel registro.", "Ogni cavo porta un numero e una data di controllo.",
    "De monteur meet 12 V en noteert de waarde in het logboek.", "Elke schakelaar heeft een nummer en een datum van controle.", "Monter mierzy prąd i wpisuje wartość do zeszytu.", "Każdy kabel ma numer i datę kontroli.",
    "Antes de empezar el trabajo hay que desconectar el cuadro y bloquearlo.", "Nadie puede entrar en el recinto sin el permiso del encargado.", "El motor debe ser revisado una vez al año por un técnico.",
    "Prima dell'inizio dei lavori il quadro deve essere disinserito dalla persona preposta.", "Nessuno può entrare nel locale senza il permesso del responsabile.",
    "Voor het begin van de werkzaamheden moet de kast worden uitgeschakeld.", "Niemand mag de ruimte betreden zonder toestemming van de leiding.", "De kabel wordt elk jaar door een vakman gecontroleerd en gemeten.",
    "Przed rozpoczęciem prac należy wyłączyć zasilanie szafy.", "Nikt nie może wejść do pomieszczenia bez pisemnej zgody kierownika.", "Kabel musi być sprawdzony raz w roku przez elektryka.",
    "Antes de iniciar os trabalhos, o quadro deve ser desligado e bloqueado.", "Ninguém pode entrar na sala sem autorização do responsável.",
    "Перед началом работ шкаф должен быть отключён от сети.", "Никто не должен входить в помещение без разрешения мастера.", "Кабель проверяется раз в год и записывается в журнал.",
    "Før arbejdet begynder, skal tavlen frakobles og mærkes.", "Innan arbetet börjar måste skåpet kopplas från nätet.", "Před zahájením práce musí být rozvaděč vypnut a zajištěn.",
    "Çalışmaya başlamadan önce pano kapatılmalı ve etiketlenmelidir.", "Munkakezdés előtt a szekrényt le kell kapcsolni.", "Înainte de începerea lucrărilor, dulapul trebuie scos de sub tensiune.",
    "Πριν από την έναρξη της εργασίας ο πίνακας πρέπει να αποσυνδεθεί.", "开始工作之前，必须断开配电柜。", "作業を始める前に配電盤を停止すること。", "يجب فصل اللوحة قبل بدء العمل.",
)

_GROUPS = ("de", "en", "fr", "es")
#: Small words of the languages that questions and answers may be in.
_LISTS = (
    "der die das den dem des und oder ist sind wird werden nicht mit von vom ein eine einer an wer was wann wie wo welche ich zu zur im in auf für bei nach vor muss darf wenn bleibt es",
    "the is are was were and of by for to be been any a an that must not on in at with from what which who when how do i can if all",
    "le la les l'on est sont des du de une un pour sur doit être par été a et dans que qui ne en après",
    "el la los las es una un por para que en de del esté está no ha con se y quién según tras junto",
)
#: Small words and what each says for a language: one that several languages have speaks for each in part.
_SMALL = {
    w: [(k, 1 / sum(w in other.split() for other in _LISTS)) for k, mine in enumerate(_LISTS) if w in mine.split()]
    for ws in _LISTS
    for w in ws.split()
}


class _Votes(dict):
    """What each token says for a language."""

    def __missing__(self, w: str) -> list[tuple[int, float]]:
        if len(self) > MEMO:
            self.clear()
        found = self[w] = _SMALL.get(w) or _SMALL.get(w.strip("«»¿?¡!.,;:\"„“()")) or []
        return found


_votes = _Votes()


def small_words(text: str) -> list[float]:
    """How much the small words of a text speak for each language."""
    votes = [0.0] * len(_GROUPS)
    for w in text.lower().split():
        for k, n in _votes[w]:
            votes[k] += n
    return votes


def group_of(text: str) -> str:
    """The language whose small words a text holds most of."""
    votes = small_words(text)
    return _GROUPS[votes.index(max(votes))]


_edges = " \t\n„“”‚‘’»«\"'`´.…!?—–-,;:[]()*"
_space = re.compile(r"\s+")
_parts = re.compile(r"\n\s*\n|\s*\|\s*")


def bare(text: str) -> str:
    """Lower case, single spaces, no marks at either end."""
    return _space.sub(" ", text).strip(_edges).lower()


def trigrams(word: str) -> list[str]:
    """The letter trigrams of a word, its ends included."""
    word = f" {word} "
    return [word[k : k + 3] for k in range(len(word) - 2)]


class _Columns(dict):
    """The column of each n-gram."""

    def __missing__(self, gram: str) -> int:
        if len(self) > MEMO:
            self.clear()
        found = self[gram] = xxhash.xxh32_intdigest(gram) % BUCKETS + DENSE
        return found


_columns = _Columns()
_far = re.compile("[^\0-\u024f]")


class Judge:
    """Everything needed to judge an entry; small enough to travel with the tasks.

    The models of scripts and boundaries read texts; where these are read already the rest does without.
    """

    def __init__(self, scripts: ScriptModel | None = None, boundaries: Boundaries | None = None):
        self.scripts, self.boundaries = scripts, boundaries
        self.learn({})
        #: What is known of questions met.
        self.languages: dict[str, str] = {}
        self.questions: dict[str, tuple[Counter, int, str]] = {}
        #: The chunks of a batch: with single spaces, in lower case, where its sentences start.
        self.known: dict[str, tuple[str, str, list[int]]] = {}
        self.weights = np.zeros((len(DEFECTS), BUCKETS + DENSE))
        self.thresholds = np.full(len(DEFECTS), 0.5)

    def learn(self, grams: dict[str, set[str]]) -> None:
        """Take the trigrams of the languages."""
        self.grams = grams
        #: Of each word met: its trigrams, those that German has, those that English has.
        self.spelt: dict[str, tuple[int, int, int]] = {}

    def plain(self, text: str | None) -> str:
        return consistent_form(text, self.scripts) if text else ""

    @staticmethod
    def flat(chunk: str) -> str:
        """A chunk with single spaces; paragraphs, and the cells of tables, end sentences."""
        text = "\n\n".join(_space.sub(" ", p).strip() for p in _parts.split(chunk))
        low = text.lower()
        return text if len(low) == len(text) else low

    def prepare(self, chunks: list[str | None]) -> None:
        """Find the sentences of a batch of chunks at once."""
        new = list(dict.fromkeys(c for c in chunks if c))
        texts = [self.flat(c) for c in new]
        starts = self.boundaries.all_starts(texts) if texts else []
        self.known = {c: (t, t.lower(), [*s, len(t)]) for c, t, s in zip(new, texts, starts)}

    def standing(self, answer: str, chunk: str) -> tuple[bool, bool, int]:
        """How an answer stands in its chunk: found, broken inside a word, words of its sentence left over.

        Of several places the one that leaves the least is taken.
        """
        wanted = _space.sub(" ", answer).strip(_edges)
        if len(wanted) < 2 or not chunk:
            return False, False, 0
        if chunk not in self.known:
            self.prepare([chunk])
        text, low, starts = self.known[chunk]
        wanted = wanted.lower()
        at, best = low.find(wanted), None
        while at >= 0:
            end = at + len(wanted)
            if not at or not (low[at - 1].isalnum() and wanted[0].isalnum()) or best is None:
                inside = end < len(low) and low[end].isalnum() and wanted[-1].isalnum()
                stop = next(s for s in starts if s >= end) if starts[-1] >= end else len(text)
                rest = words_of(text[end:stop])
                found = (True, inside, len(rest))
                if best is None or (found[1], found[2]) < (best[1], best[2]):
                    best = found
                if best[2] == 0 and not best[1]:
                    break
            at = low.find(wanted, at + 1)
        return best or (False, False, 0)

    def spelling(self, words: list[str]) -> dict[str, float]:
        """The share of a text's letter trigrams that the texts of each language have."""
        total = german = english = 0
        de, en = self.grams.get("de") or (), self.grams.get("en") or ()
        for w in words:
            known = self.spelt.get(w)
            if known is None:
                if len(self.spelt) > MEMO:
                    self.spelt.clear()
                own = trigrams(w) if w.isalpha() else []
                known = self.spelt[w] = (len(own), sum(t in de for t in own), sum(t in en for t in own))
            total, german, english = total + known[0], german + known[1], english + known[2]
        return {"de": german / total if de and total else 0.5, "en": english / total if en and total else 0.5}

    def language(self, colloquial: str, precise: str) -> str:
        """The language of an entry's questions."""
        asked = f"{colloquial} {precise}"
        if asked not in self.languages:
            if len(self.languages) > 5000:
                self.languages.clear()
            self.languages[asked] = "en" if group_of(asked) == "en" else "de"
        return self.languages[asked]

    def question(self, text: str) -> tuple[Counter, int, str]:
        """The words of a question, their number and the question without marks."""
        if text not in self.questions:
            if len(self.questions) > 5000:
                self.questions.clear()
            words = words_of(text.lower())
            self.questions[text] = Counter(words), len(words), bare(text)
        return self.questions[text]

    def features(self, colloquial: str, precise: str, answer: str, chunk: str | None, standing: tuple[bool, bool, int] | None = None) -> tuple[list[int], list[float]]:
        """Columns and values of one entry, all texts in consistent form."""
        words = words_of(answer.lower())
        own = self.language(colloquial, precise)
        found, inside, left = standing if standing is not None else self.standing(answer, chunk or "")
        core, n = bare(answer), len(words)
        same, inner = 0.0, 0.0
        if words:
            have = Counter(words)
            for theirs, m, q in (self.question(colloquial), self.question(precise)):
                if m:
                    shared = sum([min(k, have[w]) for w, k in theirs.items() if w in have])
                    same = max(same, 2 * shared / (n + m))
                    inner = max(inner, float(q in core))
        spelt = self.spelling(words)
        mine, other = spelt[own], spelt["en" if own == "de" else "de"]
        votes = small_words(answer)
        ours = votes[1 if own == "en" else 0]
        theirs_ = sum(votes) - ours
        far = sum(c.isalpha() for c in _far.findall(answer))
        odd = far / sum(c.isalpha() for c in answer) if far else 0.0
        stripped = answer.rstrip(" \"“”»")
        dense = (
            1.0, not n, n <= 2, n <= 4, found, chunk is not None and bool(chunk), bool(chunk) and not found, found and inside, found and left > 0, found and not left and not inside,
            same, same >= 0.75, same >= 0.9, inner, stripped.endswith(("…", "...", "[...]", "-")), stripped.endswith((".", "!", "?")) and not stripped.endswith("..."),
            mine, mine < 0.9, mine < 0.8, mine < 0.7, other, other - mine > 0.1, other - mine > 0.2, (not found) * (1 - mine) * 4, odd, odd > 0.5, stripped.endswith("?"),
            "keine_antwort" in core.replace(" ", "_"), min(1.0, n / 20), found and n >= 5, inner * (same >= 0.7), (not found) and mine >= 0.9, (not found) and other - mine > 0.1,
            min(1.0, ours / 2), min(1.0, theirs_ / 2), (not found) and theirs_ > ours, (not found) and not ours,
        )
        columns, values = [k for k, v in enumerate(dense) if v], [float(v) for v in dense if v]
        marked = ["<", *words, ">"]
        column = _columns.__getitem__
        grams = {*map(column, words), *map(column, map(" ".join, zip(marked, marked[1:])))}
        weight = 1 / math.sqrt(len(grams))
        return columns + list(grams), values + [weight] * len(grams)

    def scores(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        """Probabilities, a row an entry and a column a defect."""
        at, columns, values = _flat(rows)
        z = np.stack([np.bincount(at, self.weights[k][columns] * values, len(rows)) for k in range(len(DEFECTS))], axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def defect(self, scores: np.ndarray) -> str | None:
        for k, name in enumerate(DEFECTS):
            if scores[k] > self.thresholds[k]:
                return name
        return None


def _cuts(answer: str, rng: random.Random) -> str | None:
    """A truncated response."""
    core = answer.rstrip(" .!?“\"»")
    spaces = [m.start() for m in re.finditer(" ", core)]
    if len(spaces) < 2:
        return None
    if rng.random() < 0.4:
        at = rng.choice(spaces[1:]) + rng.randint(2, 4)
        at = at if at < len(core) - 1 and core[at - 1].isalnum() and core[at].isalnum() else spaces[-1]
    else:
        at = rng.choice(spaces[1:])
    return core[:at].rstrip(" ,") + rng.choice(("", "", "", "…", " …", "...", " ...", " [...]", ".", "-", ",", "!"))


def _responses(judge: Judge, sample: list[tuple], rng: random.Random) -> tuple[list, list]:
    """Features and labels (-1: sound) of responses made from sound entries."""
    rows, labels = [], []

    def add(label: str | None, c: str, p: str, a: str, chunk: str | None, standing=None) -> None:
        rows.append(judge.features(c, p, a, chunk, standing))
        labels.append([d == label for d in DEFECTS])

    languages = {x[0]: judge.language(x[1], x[2]) for x in sample}
    answers = {g: [x for x in sample if languages[x[0]] == g] for g in ("de", "en")}
    for key, c, p, a, chunk in sample:
        own = languages[key]
        add(None, c, p, a, chunk, (True, False, 0))
        words = a.split(" ")
        if len(words) > 6:
            add(None, c, p, rng.choice(("", "„")) + " ".join(words[rng.randint(1, len(words) // 2) :]).rstrip(rng.choice(("", ".!?"))), chunk)
        add(None, rng.choice((c, "")), p, a, None)
        if (t := _cuts(a, rng)) is not None:
            add("truncated", c, p, t, chunk)
        if (t := _cuts(" ".join(words[1:]), rng)) is not None:
            add("truncated", c, p, t, chunk)
        if q := rng.choice((c, p)):
            q = rng.choice((str, str.lower, str.upper, str.capitalize))(q)
            q = q.rstrip("?") if rng.random() < 0.4 else q
            add("copied_question", c, p, rng.choice(_LEADS) + rng.choice(("{}", "{}", "„{}“", "\"{}\"")).format(q), rng.choice((chunk, chunk, None)))
        if rng.random() < 0.7:
            english = own == "en" and rng.random() < 0.8
            s, r, e = (_SORRY_EN, _REFUSED_EN, _AFTER_EN) if english else (_SORRY, _REFUSED, _AFTER)
            t = rng.choice(r)
            t = (rng.choice(s) + t + rng.choice(e)).format(who=rng.choice(_WHO) + rng.choice(("", " in " + rng.choice(words).strip(_edges))))
            t = t[:1].upper() + t[1:] if rng.random() < 0.8 else t
            add("refusal", c, p, rng.choice((str, str, str, str.lower))(t), rng.choice((chunk, chunk, chunk, None)))
        pick = answers["en" if own == "de" else "de"]
        if pick and rng.random() < 0.6:
            add("other_language", c, p, rng.choice(pick)[3], rng.choice((chunk, chunk, None)))
        if rng.random() < 0.6:
            add("other_language", c, p, rng.choice(_FOREIGN), rng.choice((chunk, chunk, None)))
        if rng.random() < 0.5:
            add(None, c, p, rng.choice(answers[own])[3], rng.choice((chunk, None)))
        if rng.random() < 0.3:
            add("empty", c, p, rng.choice(PLACEHOLDERS), rng.choice((chunk, chunk, None)))
    return rows, labels


def _counted(sound: list[tuple]) -> dict[str, tuple[int, Counter]]:
    """The entries and the letter trigrams of each language."""
    words: dict[str, Counter] = {"de": Counter(), "en": Counter()}
    entries = dict.fromkeys(words, 0)
    for _, c, p, a, _ in sound:
        own = "en" if group_of(f"{c} {p}") == "en" else "de"
        entries[own] += 1
        words[own].update(words_of(f"{c} {p} {a}".lower()))
    out = {}
    for own, met in words.items():
        grams: Counter = Counter()
        for w, n in met.items():
            if w.isalpha():
                for t in trigrams(w):
                    grams[t] += n
        out[own] = entries[own], grams
    return out


def _least(entries: int) -> float:
    """How often a language must have a trigram for it to be one of its own."""
    return max(2, entries / USUAL)


def _flat(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, columns and values of features, end to end."""
    sizes = [len(c) for c, _ in rows]
    n = sum(sizes)
    columns = np.fromiter(chain.from_iterable(c for c, _ in rows), np.int64, n)
    return np.repeat(np.arange(len(rows)), sizes), columns, np.fromiter(chain.from_iterable(v for _, v in rows), float, n)


def _descend(rows: list[tuple], y: np.ndarray) -> np.ndarray:
    """Weights, a row a defect.

    The n-grams of a response all have the same value, so their sums are taken without it. Sums of two defects
    are taken at once, as the parts of a complex number.
    """
    at, columns, values = _flat(rows)
    n, defects = y.shape
    y = np.pad(y, ((0, 0), (0, defects % 2)))
    twos = y.shape[1] // 2
    first = columns < DENSE
    pair, column = np.unique(columns[first], return_inverse=True)
    x = np.zeros((n, len(pair)))
    x[at[first], column] = values[first]
    at, columns, values = at[~first], columns[~first], values[~first]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # each response has an n-gram at least
    value = values[starts]
    used, columns = np.unique(columns, return_inverse=True)
    order = np.argsort(columns, kind="stable")
    holders, firsts = at[order], np.searchsorted(columns[order], np.arange(len(used)))
    many = y.sum(axis=0)
    weight = np.sqrt(np.where(y > 0, 0.5 * n / np.maximum(1.0, many), 0.5 * n / np.maximum(1.0, n - many)))
    w, v, slopes = np.zeros((len(pair), 2 * twos)), np.zeros((twos, len(used)), complex), np.zeros((twos, len(used)), complex)
    w_moment, v_moment = np.full(w.shape, 1e-8), np.full((twos, 2 * len(used)), 1e-8)
    met, sums = np.zeros(len(columns), complex), np.zeros(n, complex)
    for _ in range(STEPS):
        z = x @ w
        for k in range(twos):
            np.add.reduceat(v[k].take(columns, out=met, mode="clip"), starts, out=sums)
            z.view(complex)[:, k] += sums * value
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        slope = x.T @ error / n + 2e-6 * w
        w_moment += slope * slope
        w -= 0.7 * slope / np.sqrt(w_moment)
        for k in range(twos):
            np.add.reduceat((error.view(complex)[:, k] * value).take(holders, out=met, mode="clip"), firsts, out=slopes[k])
        slope = slopes.view(float) / n + 2e-6 * v.view(float)
        v_moment += slope * slope
        v.view(float)[:] -= 0.7 * slope / np.sqrt(v_moment)
    weights = np.zeros((defects, BUCKETS + DENSE))
    weights[:, pair] = w.T[:defects]
    weights[:, used] = v.view(float).reshape(twos, len(used), 2).transpose(0, 2, 1).reshape(2 * twos, len(used))[:defects]
    return weights


def _block(judge: Judge, sound: list[tuple], seed: int) -> tuple[np.ndarray, int, list[tuple], np.ndarray]:
    """Weights trained on a block of sound entries, on how many responses, and the responses held out with their labels."""
    rng = random.Random(seed)
    rows, labels = _responses(judge, sound, rng)
    y = np.array(labels, float)
    test = np.array([rng.random() < 0.25 for _ in rows])
    kept = [r for r, t in zip(rows, test) if not t]
    weights = _descend(kept, y[~test]) if kept else np.zeros_like(judge.weights)
    return weights, len(kept), [r for r, t in zip(rows, test) if t], y[test]


def _tried(judge: Judge, rows: list[tuple], y: np.ndarray) -> np.ndarray:
    """For each defect and threshold: responses said to have it, those that do of them, and all that do."""
    scores, truth = judge.scores(rows), y > 0
    said = scores[:, :, None] > LEVELS
    return np.stack([said.sum(axis=0), (said & truth[:, :, None]).sum(axis=0), np.repeat(truth.sum(axis=0)[:, None], len(LEVELS), axis=1)])


def _calibrate(judge: Judge, tried: np.ndarray) -> None:
    for k in range(len(DEFECTS)):
        best = (-1.0, 0.5)
        for threshold, said, hit, truth in zip(LEVELS, *tried[:, k]):
            f1 = 2 * hit / max(1, said + truth)
            if (f1, -abs(threshold - 0.5)) > (best[0], -abs(best[1] - 0.5)):
                best = (f1, threshold)
        judge.thresholds[k] = best[1]


def _unlearned(judge: Judge) -> Judge:
    """Nothing sound to learn from: only what is certain of the texts themselves counts."""
    judge.weights[0, [0, 1]] = -5, 10
    judge.weights[1:, 0] = -10
    return judge


def _sound(answer: str, chunk: str | None, standing: tuple[bool, bool, int]) -> bool:
    return bool(chunk) and len(answer) > 20 and standing == (True, False, 0)


def train(judge: Judge, entries: list[tuple], seed: int = 7) -> Judge:
    """Fit weights and thresholds as one block. ``entries``: (id, colloquial, precise, answer, chunk)."""
    plain = [(k, judge.plain(c), judge.plain(p), judge.plain(a), judge.plain(t) or None) for k, c, p, a, t in entries]
    judge.prepare([x[4] for x in plain])
    sound = [x for x in plain if x[4] and _sound(x[3], x[4], judge.standing(x[3], x[4]))]
    if not sound:
        return _unlearned(judge)
    judge.learn({g: {t for t, n in grams.items() if n >= _least(m)} for g, (m, grams) in _counted(sound).items()})
    judge.weights, _, rows, y = _block(judge, sound, seed)
    _calibrate(judge, _tried(judge, rows, y))
    return judge


def _read(joined: DataFrame, scripts: ScriptModel, boundaries: Boundaries) -> DataFrame:
    """Every entry in consistent form and how its answer stands; of sound ones the chunk and where its sentences start."""
    fields = ["question_colloquial", "question_precise", "answer_snippet", "text"]
    sent = joined.sparkSession.sparkContext.broadcast((scripts, boundaries))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(*sent.value)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                plain = [[judge.plain(x) for x in r] for r in part[fields].itertuples(index=False, name=None)]
                judge.prepare([r[3] for r in plain])
                standing = [judge.standing(r[2], r[3]) for r in plain]
                out = pd.DataFrame({"id": part["id"].tolist()})
                out["colloquial"], out["precise"], out["answer"] = ([r[k] for r in plain] for k in range(3))
                out["found"], out["inside"], out["left"] = ([x[k] for x in standing] for k in range(3))
                out["there"] = [bool(r[3]) for r in plain]
                sound = [_sound(r[2], r[3], x) for r, x in zip(plain, standing)]
                known = [judge.known[r[3]] if s else None for r, s in zip(plain, sound)]
                out["sound"] = sound
                out["chunk"] = [k and k[0] for k in known]
                out["starts"] = [k and k[2] for k in known]
                yield out

    return joined.select("id", *fields).mapInPandas(read, "id string, colloquial string, precise string, answer string, found boolean, inside boolean, left int, there boolean, sound boolean, chunk string, starts array<int>")


def _spelling(sound: DataFrame) -> dict[str, set[str]]:
    """The trigrams of each language, counted over all sound entries.

    What is collected does not grow with the table: an entry in ``USUAL`` has each of them.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(None, *r, None) for r in pdf.itertuples(index=False, name=None)]
            for own, (entries, grams) in _counted(rows).items():
                if entries:
                    yield pd.DataFrame({"own": own, "gram": ["", *grams], "n": [entries, *grams.values()]})

    counted = sound.select("colloquial", "precise", "answer").mapInPandas(count, "own string, gram string, n long").groupBy("own", "gram").agg(F.sum("n").alias("n"))
    counted = cut(counted, "trigrams")
    out = {}
    for own, entries in counted.where("gram = ''").select("own", "n").collect():
        out[own] = {r["gram"] for r in counted.where((F.col("own") == own) & (F.col("gram") != "") & (F.col("n") >= _least(entries))).select("gram").collect()}
    return out


def _learned(read: DataFrame, seed: int = 7) -> Judge:
    """The judge that all sound entries of a table train, a block at a time."""
    judge, sound = Judge(), read.where("sound")
    n = sound.count()
    if not n:
        return _unlearned(judge)
    judge.learn(_spelling(sound))
    fields = ["colloquial", "precise", "answer", "chunk", "starts"]
    blocks = sound.select(F.pmod(F.xxhash64("id"), F.lit(-(-n // BLOCK))).alias("block"), F.xxhash64("id").alias("h"), "id", *fields)
    blocks = blocks.repartition("block").sortWithinPartitions("block", "h", "id")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, responses = np.zeros_like(judge.weights), 0

        def add(block: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
            nonlocal responses
            judge.known = {r[4]: (r[4], r[4].lower(), list(r[5])) for r in rows}
            weights, n, held, y = _block(judge, [r[:5] for r in rows], seed + block)
            sums[:] += weights * n
            responses += n
            if held:
                yield pd.DataFrame({"part": None, "n": None, "labels": list(y), "columns": [c for c, _ in held], "values": [v for _, v in held]})

        last, rows = -1, []
        for pdf in batches:
            for block, part in pdf.groupby("block"):
                if rows and block != last:
                    yield from add(last, rows)
                    rows = []
                last = int(block)
                rows += part[["id", *fields]].itertuples(index=False, name=None)
        if rows:
            yield from add(last, rows)
            used = [np.flatnonzero(x) for x in sums]
            yield pd.DataFrame({"part": range(len(DEFECTS)), "n": responses, "labels": None, "columns": used, "values": [x[at] for x, at in zip(sums, used)]})

    fitted = cut(blocks.mapInPandas(fit, "part int, n long, labels array<double>, columns array<int>, values array<double>"), "fitted")
    sums = fitted.where("part is not null")
    responses = sums.where("part = 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    cells = sums.select("part", F.explode(F.arrays_zip("columns", "values")).alias("c"))
    cells = cells.groupBy("part", F.col("c.columns").alias("column")).agg(F.sum("c.values").alias("value")).toPandas()  # at most the cells of the model
    judge.weights[cells["part"], cells["column"]] = cells["value"] / max(1, responses)

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, len(DEFECTS), len(LEVELS)), np.int64)
        for pdf in batches:
            total += _tried(judge, list(zip(pdf["columns"], pdf["values"])), np.stack(pdf["labels"]))
        yield pd.DataFrame({"cell": np.arange(total.size), "n": total.ravel()})

    counted = fitted.where("part is null").select("labels", "columns", "values").mapInPandas(tried, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(3 * len(DEFECTS) * len(LEVELS), np.int64)
    total[counted["cell"]] = counted["n"]
    _calibrate(judge, total.reshape(3, len(DEFECTS), len(LEVELS)))
    return judge


def broken_pairs(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, defect) of every defective entry of a gold set whose chunks are given by chunk_id."""
    asked = (
        gold.select("id", "chunk_id", "question_colloquial", "question_precise", "answer_snippet")
        .groupBy("id")
        .agg(F.min(F.struct("chunk_id", "question_colloquial", "question_precise", "answer_snippet")).alias("e"))
        .select("id", "e.*")
    )
    wanted = gold.select("chunk_id").where("chunk_id is not null").distinct()
    texts = chunks.select("chunk_id", "position", "text").where(F.length("text") > 0)
    texts = texts.join(F.broadcast(wanted) if fits(wanted, BROADCAST_IDS) else wanted, "chunk_id", "left_semi")
    texts = texts.groupBy("chunk_id").agg(F.min_by("text", "position").alias("text"))
    # entries without a chunk take no part in the join, so that they do not meet in one task
    alone = asked.where("chunk_id is null").withColumn("text", F.lit(None).cast("string"))
    joined = cut(asked.where("chunk_id is not null").join(texts, "chunk_id", "left").unionByName(alone), "pairs")
    scripts = fit_scripts(joined.select(F.concat_ws("\n", "text", "answer_snippet").alias("t")), "t")
    read = cut(_read(joined, scripts, fit_boundaries(joined, "text")), "read")
    judge = _learned(read)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                rows = [judge.features(c, p, a, " " if there else None, (f, i, n)) for _, c, p, a, f, i, n, there in part.itertuples(index=False, name=None)]
                found = [judge.defect(s) for s in judge.scores(rows)]
                if any(found):
                    yield pd.DataFrame({"id": part["id"], "defect": found}).dropna(subset="defect")

    return read.select("id", "colloquial", "precise", "answer", "found", "inside", "left", "there").mapInPandas(judged, "id string, defect string")
