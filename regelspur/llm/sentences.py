"""Sentence boundaries across languages and scripts.

Method: a hidden-event n-gram language model. Between every two words of a paragraph stands an event,
boundary or none, that is not written. Two n-gram models give its evidence:

- at marks (full stops and the like) the n-gram (word before, word with its mark, event, class of what
  follows). Ends and starts of paragraphs are boundaries that can be seen, all other events at marks are
  hidden, and expectation maximisation fills them in. So ``Nr.`` and ``Hr.``, which never end a paragraph,
  become words that no boundary follows, ``usw.`` does not, and ``am 8.`` differs from ``puerta 8.``;
- at gaps without a mark the word trigram with events: P(end | words before) P(word | start) against
  P(word | words before). It is counted between the marks and at the ends of paragraphs, where the
  events are certain. In a paragraph that has no mark at all (lines of speech, titles) it decides alone; in one
  that has some, a boundary without a mark has the rate at which such paragraphs end without one.

Scripts that part phrases by spaces and not words (Thai, Lao, Khmer, Burmese, Tibetan) have events at
spaces and own marks; Chinese and Japanese characters are words of their own. Forward-backward over
the events of a paragraph gives the posteriors that decide: what follows a boundary has another history than
what does not, and a unit of a few characters is unlikely. A gap whose boundary is less likely than
``NEVER`` is certain to be none, so the chain may be cut there.

The tables of both models have a fixed number of cells, words are hashed into them: all texts are
counted, in the tasks, and what is summed, collected and sent does not grow with the collection.

What is certain is not asked of the model: a blank line ends a unit; a single line break does before
a list marker; marks inside a quotation that the outer sentence continues do not.

- null and blank texts have no units; repeated ids give their units once for each row;
- positions are code points; a unit starts at its first character that is no white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from regelspur.session import cut
from regelspur.llm.gaps import START, TABLES, Counts, WordModel, Words

ROUNDS = 12
#: Left classes of marks that end a sentence wherever one can start behind them.
MARKS = ("!", "?", "…", "。")
#: Words of five letters and more that only what can start a sentence follows are hardly abbreviations,
#: even if they seldom end a paragraph.
LONG = re.compile(r"[^\W\d_]{5,}\.\Z")
#: Shares of a word's places that are boundaries, each with its prior: most words end sentences
#: always or never.
SHARES = ((0.001, 0.15), (0.05, 0.01), (0.2, 0.01), (0.5, 0.01), (0.8, 0.01), (0.95, 0.02), (0.999, 0.79))
_SHARE, _PRIOR = (np.array(x) for x in zip(*SHARES))
#: Weight of what a word says by itself where it is seen with the word before it.
TRUST = 0.98

_blank = re.compile(r"\n[^\S\n]*\n\s*")
_closers = "\"'“”»«›‹’‘)\\]」』）】"
_spaced_marks, _any_marks = ".!?…;؟۔।॥;", "。！？｡．…។៕။།።։"
#: A place where an event may stand: marks with what closes after them, then white space (none in CJK). One class of
#: characters first, for which texts are searched faster than for alternatives.
_place = re.compile(rf"[{_spaced_marks}{_any_marks}](?:(?<=[{_spaced_marks}])[{_spaced_marks}]*[  ]?[!?]*[{_closers}]*(?=\s|$)|(?<=[{_any_marks}])[{_any_marks}]*[{_closers}]*)")
#: Scripts that put spaces between phrases or sentences, not words: group and its letters.
SPACED = {"th": "฀-๿", "lo": "຀-໿", "bo": "ༀ-࿿", "my": "က-႟", "km": "ក-៿"}
_own_marks = "។៕။།"
_phrase_end = re.compile(rf"\s+|(?<=[{_own_marks}])(?=[^\s{_own_marks}])")
_cjk = re.compile(r"[぀-ヿ㐀-鿿]")
_quote = re.compile(
    "[„«“「『\"‚](?:(?<=„)[^“”„]*[“”]|(?<=«)[^«»]*»|(?<=“)[^“”„]*”|(?<=「)[^「」]*」|(?<=『)[^『』]*』"
    "|(?<![^\\s(\\[]\")(?<=\")(?=\\S)[^\"]*\"|(?<=‚)[^‘’‚]*[‘’])"
)
_any_quote = re.compile(r"[„«“「『\"‚]")
_goes_on = re.compile(r"\s*(?:[,;:，、；：،—–-]|と|って|という|\s[—–-])")
_marker = re.compile(r"[^\S\n]*(?:(?P<b>[•‣▪●◦*·–—-])|(?P<n>\d{1,3})[.)]|\(?(?P<a>[a-zA-Z])[)])[^\S\n]+")
_bullets = "•‣▪●◦*·"
_letters = {
    "el": "\u0370-\u03a8\u03aa-\u03bb\u03bd-\u03c5\u03c7-\u03ff\u1f00-\u1fff",
    "cy": "\u0400-\u052f",
    "ar": "\u0590-\u08ff",
    "hi": "\u0900-\u0dff",
    "cjk": "\u3040-\u9fff\uac00-\ud7af",
    **SPACED,
    "la": "A-Za-z\u00c0-\u024f",
}
GROUPS = tuple(_letters)
_script = re.compile("|".join(f"(?P<{k}>[{v}]{'{2,}' if k in ('el', 'la') else '+'})" for k, v in _letters.items()))
#: Any letter that is not Latin: most texts have none and need no count of letters by script.
_other_script = re.compile("[" + "".join(v for k, v in _letters.items() if k != "la") + "]")


def _group(paragraph: str) -> str:
    """The script with most letters in a paragraph; texts of one script share a model."""
    if paragraph.isascii() or not _other_script.search(paragraph):
        return "la"
    letters = dict.fromkeys(("la",), 0)
    for m in _script.finditer(paragraph):
        letters[m.lastgroup] = letters.get(m.lastgroup, 0) + m.end() - m.start()
    return max(letters, key=letters.get)


def _mark(marks: str) -> str:
    """The class of the marks at a place."""
    if "!" in marks or "！" in marks:
        return "!"
    if any(c in marks for c in "?？؟;;"):
        return "?"
    if any(c in marks for c in "。।॥۔｡។៕။།።։"):
        return "。"
    return "." if marks[0] == "." and not marks.startswith("..") else "…"


def _word(word: str) -> str:
    """The class of a word before a dot: itself unless it holds digits."""
    word = word.lstrip("„“\"«‚'([")
    if word.isdigit():
        return "0."
    if not word:
        return "."
    return "w." if any(c.isdigit() for c in word) else word + "."


class _Memo(dict):
    """A function remembered; forgotten when it has grown."""

    def __init__(self, f):
        self.f = f

    def __missing__(self, key: str) -> str:
        if len(self) > 100_000:
            self.clear()
        found = self[key] = self.f(key)
        return found


_marks, _words = _Memo(_mark), _Memo(_word)


def _near(part: str, at: int) -> tuple[str, str]:
    """The word that ends at a place, empty where none does, and the word before that (``^``: none)."""
    wide = 32
    while True:
        near = part[max(0, at - wide) : at]
        words = near.rsplit(None, 2)
        if len(words) > 2 or wide >= at:
            break
        wide *= 4
    if not words or near[-1].isspace():
        return "", ""
    return words[-1], words[-2] if len(words) > 1 else "^"


def right_of(c: str) -> str:
    """The class of what follows a place, by its first character."""
    if c in "„“«\"‚「『¿¡([":
        return "q"
    if c.isdigit():
        return "0"
    if c.isupper():
        return "U"
    if c.islower():
        return "l"
    return "c" if c.isalpha() else "-" if c in "-–—" else "o"


def _side(c: str, group: str) -> str:
    """The class of a character beside a space of a script that has them between phrases."""
    if c in _own_marks:
        return "。"
    low, high = SPACED[group].split("-")
    return "t" if low <= c <= high else "x" if c.isdigit() or c.isascii() and c.isalpha() else "o"


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what lies between blank lines, white space at both ends left out; list entries apart."""
    at = 0
    while at < len(text):
        m = _blank.search(text, at)
        end = m.start() if m else len(text)
        yield from _entries(text, at, end)
        at = m.end() if m else len(text)


def _kind(m: re.Match | None) -> str:
    return "" if m is None else m.lastgroup or ""


def _entries(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A paragraph, cut at the line breaks before list markers."""
    cuts = [start]
    at = text.find("\n", start, end)
    if at >= 0:
        first = _kind(_marker.match(text, start, end))
        while at >= 0:
            m = _marker.match(text, at + 1, end)
            if m:
                kind, before = _kind(m), text[cuts[-1] : at].rstrip()[-1:]
                if m.group("b") and m.group("b") in _bullets or kind == first or before in (":", ";") or (kind == "n" and m.group("n") == "1" and before in ".:;!?"):
                    cuts.append(at + 1)
                    first = kind
            at = text.find("\n", at + 1, end)
    for a, b in zip(cuts, [*cuts[1:], end]):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            yield a, b


#: Classes of what follows a place; classes before one that are no words.
KINDS = ("$", "U", "l", "0", "q", "c", "-", "o", "t", "x")
_KIND_NO = {k: n for n, k in enumerate(KINDS)}
_CLASSES = ("^", "!", "?", "…", "。", ".", "0.", "w.", "t", "x", "o", "m")
#: Words before a mark, and pairs of words before one, that are told apart in each group.
LEFTS, CONTEXTS = 1 << 17, 1 << 18
_FIXED = {c: n for n, c in enumerate(_CLASSES)}
_GROUP_NO = {g: n for n, g in enumerate(GROUPS)}


def _code(key: tuple[str, str]) -> int:
    """The cell of a left class in its group; the last bit tells long words."""
    group, left = key
    n = _FIXED.get(left)
    if n is None:
        n = len(_CLASSES) + xxhash.xxh3_64_intdigest(left) % (LEFTS - len(_CLASSES))
    return (_GROUP_NO[group] * LEFTS + n) * 2 + bool(LONG.match(left))


def _context(key: tuple[str, str, str]) -> int:
    group, before, left = key
    return _GROUP_NO[group] * CONTEXTS + xxhash.xxh3_64_intdigest(f"{before} {left}") % CONTEXTS


def _dotted(key: tuple[str, str, str]) -> tuple[int, int]:
    """The cells of a word before a dot, and of it with the word before that."""
    group, word, before = key
    if not word:
        return _codes[group, "."], -1
    left = _words[word]
    return _codes[group, left], _context((group, _words[before], left))


_codes, _dots, _rights = _Memo(_code), _Memo(_dotted), _Memo(lambda c: _KIND_NO[right_of(c)])


def _spaced_places(part: str, start: int, group: str) -> list[int]:
    """The places of a paragraph whose script has spaces between phrases."""
    # where the script's own marks are used, a space between letters is another thing
    letter = "m" if any(c in part for c in _own_marks) else "t"
    left = lambda c: _codes[group, letter if (k := _side(c, group)) == "t" else k]
    found = []
    for m in _phrase_end.finditer(part):
        if m.end() < len(part):
            found += (start + m.end(), left(part[m.start() - 1]), -1, _KIND_NO[_side(part[m.end()], group).replace("。", "o")])
    found += (-1, left(part[-1]), -1, _KIND_NO["$"])
    return found


def _places(part: str, start: int, group: str, quotes: bool) -> list[int]:
    """The places of a paragraph, four numbers each as ``annotate`` has them.

    Places inside a quotation that goes on are left out; without ``quotes`` there is none.
    """
    skip: list[tuple[int, int]] = []
    if quotes and _any_quote.search(part):
        for m in _quote.finditer(part):
            after = part[m.end() : m.end() + 3]
            if _goes_on.match(after) or after.lstrip()[:1].islower():
                skip.append(m.span())
    found: list[int] = []
    head = _marker.match(part)
    floor = head.end() if head else 0
    n = len(part)
    for m in _place.finditer(part):
        s, e = m.span()
        if s < floor or skip and any(a < e <= b and not (e == b == n) for a, b in skip):
            continue
        c = part[s]
        if c in ";;":
            if group != "el":
                continue
        elif c == "…" and e < n and not part[e].isspace() and not _cjk.search(part[e]):
            continue
        p = e
        while p < n and part[p].isspace():
            p += 1
        at, kind = (start + p, _rights[part[p]]) if p < n else (-1, 0)
        mark = _marks[part[s:e]]
        if mark != ".":
            found += (at, _codes[group, mark], -1, kind)
            continue
        words = part[s - 32 if s > 32 else 0 : s].rsplit(None, 2)
        if len(words) == 3 and not part[s - 1].isspace():
            left, context = _dots[group, words[2], words[1]]
        else:
            left, context = _dots[group, *_near(part, s)]
        found += (at, left, context, kind)
    return found


def annotate(text: str) -> list[int]:
    """All that the model of marks needs of a text, four numbers for each place where a unit starts or might: the
    position, the cells of what is on its left (alone, with the word before; -1: none) and the class of what follows.

    The left class ``^`` marks the start of a paragraph, which is certain, the right class ``$`` its end, at
    position -1; a paragraph without places has the cell -1.
    """
    out: list[int] = []
    latin = text.isascii() or not _other_script.search(text)
    quotes = _any_quote.search(text) is not None
    for start, end in paragraphs(text):
        part = text[start:end]
        group = "la" if latin else _group(part)
        spaced = group in SPACED
        found = _spaced_places(part, start, group) if spaced else _places(part, start, group, quotes)
        if not found:
            out += (start, -1, -1, 0)
            continue
        out += (start, _codes[group, "^"], -1, _KIND_NO[_side(part[0], group).replace("。", "o")] if spaced else _rights[part[0]])
        out += found
    return out


class Notes:
    """The annotations of a batch of texts, end to end."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, lefts: np.ndarray, contexts: np.ndarray, kinds: np.ndarray):
        self.sizes, self.at, self.lefts, self.contexts, self.kinds = sizes, at, lefts, contexts, kinds
        self.starts = (lefts < 0) | (lefts // 2 % LEFTS == _FIXED["^"])

    @staticmethod
    def of(written: list[bytes]) -> "Notes":
        """From the annotations of each text as ``written`` has them."""
        sizes = np.fromiter(map(len, written), np.int64, len(written)) // 16
        return Notes(sizes, *np.frombuffer(b"".join(written), "<i4").reshape(-1, 4).T.astype(np.int64, order="C"))

    @staticmethod
    def read(texts: list[str]) -> "Notes":
        flat: list[int] = []
        ends = []
        for t in texts:
            flat += annotate(t)
            ends.append(len(flat) // 4)
        return Notes(np.diff(np.array([0, *ends])), *np.array(flat, np.int64).reshape(-1, 4).T.copy())

    def written(self) -> list[bytes]:
        """The annotations of each text in 32-bit numbers, four for each place."""
        all_ = np.stack([self.at, self.lefts, self.contexts, self.kinds], axis=1).astype("<i4").tobytes()
        ends = (np.cumsum(self.sizes) * 16).tolist()
        return [all_[a:b] for a, b in zip([0, *ends], ends)]

    def where(self, words: Words) -> np.ndarray:
        """The places in the texts laid end to end; -1 stays."""
        return np.where(self.at >= 0, self.at + np.repeat(words.base, self.sizes), -1)


class MarkCounts:
    """How often each cell of a left class and each of a context stands before each class of what follows."""

    def __init__(self):
        self.held: list[dict[int, int]] = [{}, {}]
        self.parts: list[list[np.ndarray]] = [[], []]
        self.size = 0

    def add(self, notes: Notes) -> None:
        for k, cells in enumerate((notes.lefts, notes.contexts)):
            there = cells >= 0
            self.parts[k].append(cells[there] * len(KINDS) + notes.kinds[there])
        self.size += len(notes.lefts)
        if self.size > 1_000_000:
            self._sum()

    def _sum(self) -> None:
        for k in range(2):
            if self.parts[k]:
                values, n = np.unique(np.concatenate(self.parts[k]), return_counts=True)
                for v, c in zip(values.tolist(), n.tolist()):
                    self.held[k][v] = self.held[k].get(v, 0) + c
                self.parts[k] = []
        self.size = 0

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        self._sum()
        return [(np.fromiter(h.keys(), np.int64, len(h)), np.fromiter(h.values(), np.int64, len(h))) for h in self.held]


def _matrix(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells, and their counts by class of what follows."""
    cells, row = np.unique(keys // len(KINDS), return_inverse=True)
    out = np.zeros((len(cells), len(KINDS)))
    np.add.at(out, (row, keys % len(KINDS)), n)
    return cells, out


class MarkModel:
    """The fitted model of marks.

    Expectation maximisation over the counted places, a group at a time. Hidden are the events inside
    paragraphs. Seen are the ends of paragraphs: a word that ends sentences ends paragraphs at the rate at which
    sentences do, a word that never does neither. What a word and the one before it say together starts from what
    the word says alone.
    """

    def __init__(self, lefts: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray]):
        self.cells, counts = _matrix(*lefts)
        self.context_cells, context_counts = _matrix(*contexts)
        n, k = len(self.cells), len(KINDS)
        #: Of each left class: weights of ``SHARES``; odds of each class behind it, without and with a boundary.
        self.weights, self.none, self.some = np.tile(_PRIOR, (n, 1)), np.full((n, k), 0.1), np.zeros((n, k))
        self.told = np.zeros((len(self.context_cells), len(SHARES)))
        #: Of each group the same for words that were never met, short and long; groups never met have none.
        self.form_weights = np.tile(_PRIOR, (len(GROUPS), 2, 1))
        self.form_none, self.form_some = np.zeros((len(GROUPS), k)), np.zeros((len(GROUPS), k))
        group, context_group = self.cells // 2 // LEFTS, self.context_cells // CONTEXTS
        for g in np.unique(group).tolist():
            self._fit(g, counts, context_counts, np.flatnonzero(group == g), np.flatnonzero(context_group == g))

    def _fit(self, g: int, counts: np.ndarray, context_counts: np.ndarray, rows: np.ndarray, context_rows: np.ndarray) -> None:
        spaced = GROUPS[g] in SPACED
        kind = self.cells[rows] // 2 % LEFTS
        first = kind == _FIXED["^"]
        start = counts[rows[first]].sum(axis=0)
        rows, kind = rows[~first], kind[~first]
        seen = counts[rows]
        ends, inner = seen[:, 0].copy(), seen.copy()
        inner[:, 0] = 0
        used = ((inner.sum(axis=0) + start) > 0) & (np.arange(len(KINDS)) > 0)
        many, total = max(1, used.sum()), start.sum() + 1.0
        given = np.where(used, (start + 0.001 * total / many) / (total * 1.001), 0)
        able = used & ((given > 0.005) | (np.isin(KINDS, ("U", "q")) & (not spaced)))
        able[_KIND_NO["l"]] = False
        long = (self.cells[rows] & 1).astype(bool)
        marks = np.isin(kind, [_FIXED[m] for m in MARKS])
        sure = marks | long | np.isin(kind, [_FIXED["w."], _FIXED["t"]])
        capital = inner[:, [_KIND_NO["U"], _KIND_NO["q"]]].sum(axis=1) >= 0.9 * inner.sum(axis=1)
        # words of one form that were seen seldom are taken for what most words of that form are
        form = np.where(kind >= len(_CLASSES), 1 + long, 0)
        prior, heavy = np.tile(_PRIOR, (3, 1)), np.minimum(ends + inner.sum(axis=1), 20)
        usual = np.where(used, 1.0 / many, 0)
        rate, share, none = 0.25, np.full(len(rows), 0.9), usual * np.ones((len(rows), 1))
        for _ in range(ROUNDS):
            a = share[:, None] * (1 - rate) * given * able
            b = (1 - share)[:, None] * none
            yes = inner * np.divide(a, a + b, out=np.zeros_like(a), where=a + b > 0)
            rate = min(0.7, max(0.02, (ends[sure].sum() + 1.0) / (ends[sure].sum() + yes[sure].sum() + 4.0)))
            logs = self._likelihood(ends, inner[:, able].sum(axis=1), rate) + np.log(prior[form])
            logs -= 70 * ((long & capital)[:, None] & (_SHARE < 0.5))
            weights = np.exp(logs - logs.max(axis=1, keepdims=True))
            weights /= weights.sum(axis=1, keepdims=True)
            share = weights @ _SHARE
            rest = inner - yes
            for f in (1, 2):
                prior[f] = (heavy[form == f] @ weights[form == f] + 5 * _PRIOR) / (heavy[form == f].sum() + 5)
            # what follows where no boundary is, is told by the words that have none
            apart = rest * (1 - share)[:, None]
            usual = np.where(used, (apart[form > 0].sum(axis=0) + 1.0 / many) / (apart[form > 0].sum() + 1.0), 0)
            none = np.where(used, (apart + usual) / (apart.sum(axis=1, keepdims=True) + 1.0), 0)
        self.weights[rows], self.none[rows], self.some[rows] = weights, none, (1 - rate) * given * able
        self.form_weights[g], self.form_none[g], self.form_some[g] = prior[1:], usual, (1 - rate) * given * able
        self.told[context_rows] = self._likelihood(context_counts[context_rows, 0], context_counts[context_rows][:, able].sum(axis=1), rate)

    @staticmethod
    def _likelihood(ends: np.ndarray, inner: np.ndarray, rate: float) -> np.ndarray:
        """log of the likelihood of each share in ``SHARES``, given how often a word ends a paragraph."""
        return ends[:, None] * np.log(_SHARE * rate) + inner[:, None] * np.log(1 - _SHARE * rate)

    def probability(self, lefts: np.ndarray, contexts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Of a boundary at each place; words never met are taken for usual ones of their form, other classes fall
        back to what follows."""
        left = lefts // 2 % LEFTS
        out = np.where(np.isin(kinds, [_KIND_NO["l"], _KIND_NO["x"]]) | (left == _FIXED["x"]) | (left == _FIXED["m"]), 0.02, 0.9)
        if not len(self.cells) or not len(lefts):
            return out
        group = lefts // 2 // LEFTS
        usual = self.form_weights[group, lefts & 1] @ _SHARE
        a, b = usual * self.form_some[group, kinds], (1 - usual) * self.form_none[group, kinds]
        out = np.where((left >= len(_CLASSES)) & (a + b > 0), np.divide(a, a + b, out=np.zeros(len(a)), where=a + b > 0), out)
        at = np.minimum(np.searchsorted(self.cells, lefts), len(self.cells) - 1)
        known = self.cells[at] == lefts
        logs = np.log(self.weights[at] + 1e-300)
        if len(self.context_cells):
            c = np.minimum(np.searchsorted(self.context_cells, contexts), len(self.context_cells) - 1)
            both = (self.context_cells[c] == contexts) & known & (contexts >= 0)
            logs[both] = np.log(TRUST * self.weights[at[both]] + (1 - TRUST) * _PRIOR) + self.told[c[both]]
        weights = np.exp(logs - logs.max(axis=1, keepdims=True))
        share = (weights @ _SHARE) / weights.sum(axis=1)
        a, b = share * self.some[at, kinds], (1 - share) * self.none[at, kinds]
        found = np.divide(a, a + b, out=np.zeros(len(a)), where=a + b > 0)
        return np.where(known, found, out)


#: Characters of a unit below which it is unlikely, and the probability of one so short.
NEAR, SHORT = 5, 0.02
#: Probability below which a boundary without a mark is out of the question.
NEVER = 1e-6


class Boundaries:
    """The fitted models: of marks, and of words where there is none."""

    def __init__(self, marks: MarkModel, words: WordModel):
        self.marks, self.words = marks, words
        #: Events decided, and those whose decision depended on another.
        self.events = self.linked = 0

    def starts(self, text: str) -> list[int]:
        """The first position of every sentence unit of ``text``."""
        return self.all_starts([text])[0]

    def all_starts(self, texts: list[str]) -> list[list[int]]:
        return self.decide(texts, Notes.read(texts))

    def decide(self, texts: list[str], notes: Notes) -> list[list[int]]:
        """The units of annotated texts: forward-backward over the events of each paragraph."""
        words = Words(texts)
        at = notes.where(words)
        heads = at[notes.starts]
        place = ~notes.starts & (at >= 0)
        p = at[place]
        yes = self.marks.probability(notes.lefts[place], notes.contexts[place], notes.kinds[place])
        # a row an event: position, gap (-1: of none), weights (boundary before? x boundary here?)
        weights = np.empty((len(p), 2, 2))
        weights[:, :, 0], weights[:, :, 1] = (1 - yes)[:, None], yes[:, None]
        gap = np.full(len(p), -1)
        bare, bare_at, bare_weights = self._bare(words, heads, p, notes.lefts[notes.starts] < 0)
        position = np.concatenate([p, bare_at])
        order = np.argsort(position, kind="stable")
        position, gap = position[order], np.concatenate([gap, bare])[order]
        weights = np.concatenate([weights, bare_weights])[order]
        keep = self._forward_backward(position, gap, weights, np.searchsorted(heads, position, "right"))
        found = np.concatenate([heads, position[keep]])
        found.sort()
        cuts = np.searchsorted(found, words.base)
        return [(found[a:b] - base).tolist() for a, b, base in zip(cuts, [*cuts[1:], len(found)], words.base)]

    def _bare(self, words: Words, heads: np.ndarray, places: np.ndarray, unmarked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gaps without a mark where a boundary is not out of the question: number, place and weights."""
        within, free, _ = words.gaps(heads)
        gap = np.flatnonzero(free)
        if not len(gap):
            return gap, gap, np.zeros((0, 2, 2))
        # the event behind a mark is that of its place, so its gap has no other
        taken = np.searchsorted(words.starts, places) - 1
        h, left, model = words.hashed, words.left, self.words
        alone = unmarked[np.searchsorted(heads, words.starts[gap], "right") - 1]
        style = np.where(alone, 1.0, model.bare_rate)
        a, b = left[gap], h[gap + 1]
        some = model.end(a) * model.start(b) * style
        # even if the pair was only ever seen with what is around it here
        least = np.minimum(*model.follows([None, np.where(gap > 0, left[gap - 1], START)], a, b))
        able = (some > NEVER * least) & ~np.isin(gap, taken)
        gap, a, b, some = gap[able], a[able], b[able], some[able]
        if not len(gap):
            return gap, gap, np.zeros((0, 2, 2))
        inside = np.concatenate([[False], within])
        # behind a mark the event is that of its place, which this one says nothing of
        before = np.where(inside[gap] & np.concatenate([[False], free])[gap], left[gap - 1], START)
        weights = np.empty((len(gap), 2, 2))
        weights[:, 0, 0], weights[:, 1, 0] = model.follows([before, None], a, b)
        weights[:, 0, 1] = weights[:, 1, 1] = some
        # the word after the next has another history behind a boundary; where its gap is an event of its own, that one says so
        own = np.zeros(len(h) + 1, bool)
        own[gap] = True
        more = np.concatenate([free, [False]])[gap + 1] & ~own[gap + 1]
        m = np.flatnonzero(more)
        c = h[gap[m] + 2]
        behind, ahead = model.follows([None, a[m]], left[gap[m] + 1], c)
        weights[m, :, 1] *= (behind / ahead)[:, None]
        return gap, words.place(gap), weights

    def _forward_backward(self, position: np.ndarray, gap: np.ndarray, weights: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
        """Which events are boundaries, by their posteriors."""
        n = len(position)
        self.events += n
        if not n:
            return np.zeros(0, bool)
        same = paragraph[1:] == paragraph[:-1]
        near = same & (position[1:] - position[:-1] < NEAR)
        weights[1:, 1, 1][near] *= SHORT
        linked = np.concatenate([[False], near | (same & (gap[1:] == gap[:-1] + 1) & (gap[:-1] >= 0))])
        keep = weights[:, 0, 1] > weights[:, 0, 0]
        link = np.flatnonzero(linked)
        self.linked += len(link)
        if not len(link):
            return keep
        # chains of two events and more, one after the other
        first = np.flatnonzero(linked & ~np.concatenate([[False], linked[:-1]])) - 1
        last = np.flatnonzero(linked & ~np.concatenate([linked[1:], [False]]))
        # in plain numbers: most chains have two events, and arrays of two cost more than what is done with them
        for a, b in zip(first.tolist(), last.tolist()):
            chain = weights[a : b + 1].tolist()
            none, some = chain[0][0]
            ahead = [(none, some)]
            for (nn, ns), (sn, ss) in chain[1:]:
                none, some = none * nn + some * sn, none * ns + some * ss
                total = none + some or 1.0
                none, some = none / total, some / total
                ahead.append((none, some))
            x, y = 1.0, 1.0
            for k in range(b - a, -1, -1):
                none, some = ahead[k]
                keep[a + k] = some * y > none * x
                (nn, ns), (sn, ss) = chain[k]
                x, y = nn * x + ns * y, sn * x + ss * y
                total = x + y or 1.0
                x, y = x / total, y / total
        return keep


#: The annotations of a text, and the text; or what a task counted: table, slice of it, cells there and their counts.
_NOTES = "notes binary, text string, part tinyint, slice int, cells binary, counts binary"
_COUNTS = {"part": pa.int8(), "slice": pa.int32(), "cells": pa.binary(), "counts": pa.binary()}
#: Tables by their number in ``part``.
_PARTS = ("lefts", "contexts", *TABLES, "styles")
#: Texts annotated and decided at a time; cells of a table in a row.
TEXTS, SLICE = 250, 1 << 17


def annotated(df: DataFrame, key: str, text: str, keep: bool = True) -> DataFrame:
    """(id, notes, text): every text annotated; and (part, slice, cells, counts): what the tasks counted.

    ``keep=False``: the counts alone.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, counts = MarkCounts(), Counts()
        schema = empty
        for batch in batches:
            schema = batch.schema
            written: list[bytes] = []
            for k in range(0, len(batch), TEXTS):
                texts = batch.column("text").slice(k, TEXTS).to_pylist()
                notes, words = Notes.read(texts), Words(texts)
                marks.add(notes)
                counts.add(words, notes.where(words)[notes.starts])
                _count_styles(counts, notes)
                if keep:
                    written += notes.written()
            if written:
                yield _batch(schema, len(batch), id=batch.column("id"), notes=written, text=batch.column("text"))
        tables = dict(zip(("lefts", "contexts"), marks.rows()))
        tables |= {name: (np.arange(len(t)), t) for name, t in counts.tables.items()}
        tables["styles"] = np.arange(2), np.array([counts.marked, counts.bare])
        for part, name in enumerate(_PARTS):
            found = list(_slices(*tables[name]))
            if found:
                numbers, cells, n = zip(*found)
                yield _batch(schema, len(found), part=[part] * len(found), slice=numbers, cells=cells, counts=n)

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    empty = to_arrow_schema(rows.schema)
    return rows.mapInArrow(read, f"id {rows.schema['id'].dataType.simpleString()}, {_NOTES}")


def _batch(schema: pa.Schema, n: int, **columns: object) -> pa.RecordBatch:
    """Rows of ``annotated``, from columns or lists; columns that are not given are null."""
    kinds = {"id": schema.field("id").type, "notes": pa.binary(), "text": schema.field("text").type, **_COUNTS}
    given = {c: x if isinstance(x, pa.Array) else pa.array(x, kinds[c]) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, kind) for c, kind in kinds.items()], list(kinds))


def _packed(n: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs; their width goes first."""
    width = next(w for w in (1, 2, 4, 8) if int(n.max()) < 1 << 8 * w)
    return bytes([width]) + n.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _slices(cells: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Counted cells in rows: number of the slice, steps from each cell to the next, counts."""
    cells, n = cells[n > 0], n[n > 0]
    order = np.argsort(cells)
    cells, n = cells[order], n[order]
    ends = [*(np.flatnonzero(np.diff(cells // SLICE)) + 1).tolist(), len(cells)]
    for a, b in zip([0, *ends], ends):
        if a < b:
            yield int(cells[a]) // SLICE, _packed(np.diff(cells[a:b] % SLICE, prepend=0)), _packed(n[a:b])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of each slice; those of one follow each other."""
    at, held = None, np.zeros(SLICE, np.int64)

    def row() -> pa.RecordBatch:
        cells = np.flatnonzero(held)
        found = at[0], at[1], _packed(np.diff(cells, prepend=0)), _packed(held[cells])
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(found, _COUNTS.values())], list(_COUNTS))

    for batch in batches:
        for part, number, cells, n in zip(*(batch.column(c).to_pylist() for c in _COUNTS)):
            if at != (part, number):
                if at:
                    yield row()
                at = part, number
                held[:] = 0
            held[np.cumsum(_unpacked(cells))] += _unpacked(n)
    if at:
        yield row()


def _count_styles(counts: Counts, notes: Notes) -> None:
    """Paragraphs that have a place before their end, and those of them that end without one."""
    heads = np.flatnonzero(notes.starts)
    if not len(heads):
        return
    inner = np.add.reduceat(~notes.starts & (notes.at >= 0), heads)
    ended = np.add.reduceat(~notes.starts & (notes.at < 0), heads)
    counts.marked += int(inner.sum() + ended.sum())
    counts.bare += int(((inner > 0) & (ended == 0)).sum())


def fit_annotated(notes: DataFrame) -> Boundaries:
    """Train the models on what the tasks counted of all texts; what is collected is bounded by the cells of the tables."""
    counted = notes.where("part is not null").select(*_COUNTS)
    summed = counted.repartition("part", "slice").sortWithinPartitions("part", "slice").mapInArrow(_add_up, counted.schema)
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {name: [] for name in _PARTS}
    for part, number, cells, n in zip(*(c.to_pylist() for c in summed.toArrow().columns)):
        found[_PARTS[part]].append((np.cumsum(_unpacked(cells)) + number * SLICE, _unpacked(n)))
    tables = {name: np.zeros(size) for name, size in TABLES.items()} | {"styles": np.zeros(2)}
    for name, table in tables.items():
        for cells, n in found[name]:
            table[cells] += n
    marks = [tuple(map(np.concatenate, zip(*found[name]))) if found[name] else (np.zeros(0, np.int64),) * 2 for name in ("lefts", "contexts")]
    styles = tables.pop("styles").tolist()
    return Boundaries(MarkModel(*marks), WordModel(tables, *map(int, styles)))


def fit_boundaries(df: DataFrame, text: str) -> Boundaries:
    """Train the models on every text of a column."""
    return fit_annotated(annotated(df.select(F.lit(0).alias("id"), F.col(text).alias("text")), "id", "text", keep=False))


def _decided(df: DataFrame, key: str, text: str, model: Boundaries | None, units: bool) -> DataFrame:
    notes = cut(annotated(df, key, text), "notes") if model is None else annotated(df, key, text)
    model = model or fit_annotated(notes)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                part = batch.slice(k, TEXTS)
                texts = part.column("text").to_pylist()
                found = sent.value.decide(texts, Notes.of(part.column("notes").to_pylist()))
                of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                out = {"id": part.column("id").take(of), "start_char": pa.array([p for f in found for p in f], pa.int32())}
                if units:
                    out["unit_no"] = pa.array([k for f in found for k in range(len(f))], pa.int32())
                    out["unit"] = pa.array([t[a:b].strip() for t, f in zip(texts, found) for a, b in zip(f, [*f[1:], len(t)])], pa.string())
                names = ["id", "unit_no", "start_char", "unit"] if units else ["id", "start_char"]
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

    kind = notes.schema["id"].dataType.simpleString()
    rows = notes.where("part is null").select("id", "notes", "text")
    return rows.mapInArrow(split, f"id {kind}, " + ("unit_no int, start_char int, unit string" if units else "start_char int")).withColumnRenamed("id", key)


def sentence_units(df: DataFrame, key: str, text: str, model: Boundaries | None = None) -> DataFrame:
    """(key, unit_no, start_char, unit): the sentence units of every text, in order."""
    return _decided(df, key, text, model, True)


def sentence_starts(df: DataFrame, key: str, text: str, model: Boundaries | None = None) -> DataFrame:
    """(key, start_char): where each unit starts.

    Texts are read once: they and their annotations are written to the shared folder; the models are trained
    on what was counted while they were read, and decide.
    """
    return _decided(df, key, text, model, False)
