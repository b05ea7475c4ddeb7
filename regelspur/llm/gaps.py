"""Words and the gaps between them, for a batch of texts at once, in numpy; n-gram counts in fixed tables.

A word is a run of letters, marks and digits, in lower case; words that hold a digit are one word. Chinese and
Japanese characters are words of their own. A gap lies between two successive words of a paragraph; an event
can stand in it where white space does, or between two characters that are words.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from regelspur.llm.words import MIX, mix

#: Cells of the tables: words, starts and ends of units, pairs, triples.
WORDS, PAIRS, TRIPLES = 1 << 17, 1 << 20, 1 << 20
TABLES = {"words": WORDS, "starts": WORDS, "ends": WORDS, "pairs": PAIRS, "triples": TRIPLES}
#: Share of what follows a word, or two, that is left to what was not seen there.
SPARE = 0.2
#: The word that stands before the first of a unit, and the one that every number is.
START, NUMBER = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code of the first plane its class (0 space, 1 in words, 2 other, 3 a word of its own, 4 mark, 5 digit) and lower case, 0 outside words."""
    kind, lower = np.full(1 << 16, 2, np.uint8), np.arange(1 << 16, dtype=np.uint64)
    for c in range(1 << 16):
        x = chr(c)
        if x.isspace():
            kind[c] = 0
        elif x.isdigit():
            kind[c] = 5
        elif x.isalnum() or unicodedata.category(x)[0] == "M":
            kind[c] = 1
        small = x.lower()
        if len(small) == 1:
            lower[c] = ord(small)
    for a, b in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)):
        kind[a:b][kind[a:b] == 1] = 3
    for x in ".!?…;。！？｡．؟۔।॥;។៕။།։":
        kind[ord(x)] = 4
    lower[(kind != 1) & (kind != 3) & (kind != 5)] = 0
    return kind, lower


_KIND, _VALUE = _tables()
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 21)
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


class Words:
    """The words of texts laid end to end, one place apart."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
        n = len(codes)
        plane = codes < 1 << 16
        if plane.all():
            kind, value = _KIND[codes], _VALUE[codes]
        else:
            small = np.where(plane, codes, 0)
            kind = np.where(plane, _KIND[small], np.where((codes >= 0x20000) & (codes < 0x40000), 3, 1)).astype(np.uint8)
            value = np.where(plane, _VALUE[small], codes)
        own, digit = kind == 3, kind == 5
        inside = (kind == 1) | digit
        # a dot, comma or colon between two digits is part of a number
        digits = np.flatnonzero(digit)
        joins = digits[:-1][np.diff(digits) == 2] + 1
        joins = joins[np.isin(codes[joins], (44, 46, 58))]
        inside[joins] = True
        kind[joins] = 5
        # white space and marks before each character
        self.space = kind == 0
        self.spaces, self.marks = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        np.cumsum(self.space, out=self.spaces[1:])
        np.cumsum(kind == 4, out=self.marks[1:])
        self.whites = np.flatnonzero(self.space)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if n else np.zeros(0, np.int64)
        if n and inside[0]:
            edge = np.append(0, edge)
        if n and inside[-1]:
            edge = np.append(edge, n)
        starts, ends = edge[::2], edge[1::2]
        if own.any():
            alone = np.flatnonzero(own)
            order = np.argsort(np.concatenate([starts, alone]), kind="stable")
            starts, ends = np.concatenate([starts, alone])[order], np.concatenate([ends, alone + 1])[order]
        self.starts, self.ends, self.own = starts, ends, own[starts]
        if not len(starts):
            self.hashed = self.left = np.zeros(0, np.uint64)
            return
        up, down = _power(n)
        self.hashed = mix(np.add.reduceat(value * up[:n], starts) * down[starts])
        self.hashed[np.searchsorted(starts, digits, "right") - 1] = NUMBER
        # what stands before the gap: the word, or the last other character behind it
        self.left = self.hashed.copy()
        last = starts[1:] - 1
        wide = np.flatnonzero((last >= ends[:-1]) & (self.spaces[starts[1:]] - self.spaces[ends[:-1]] < starts[1:] - ends[:-1]))
        others = np.flatnonzero(~self.space)
        at = others[last[wide] - self.spaces[last[wide] + 1]]
        self.left[wide] = mix(codes[at].astype(np.uint64) * MIX)

    def gaps(self, paragraphs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the gap behind each word but the last: whether it lies inside a paragraph (given by their sorted
        starts), whether an event can stand in it without a mark, and whether a mark stands in it."""
        s, e = self.starts, self.ends
        if len(s) < 2:
            none = np.zeros(max(0, len(s) - 1), bool)
            return none, none, none
        of = np.searchsorted(paragraphs, s, "right")
        inside = of[1:] == of[:-1]
        marked = self.marks[s[1:]] > self.marks[e[:-1]]
        spaced = self.spaces[s[1:]] > self.spaces[e[:-1]]
        return inside, inside & ~marked & (spaced | (self.own[1:] & self.own[:-1] & (s[1:] == e[:-1]))), marked

    def place(self, gap: np.ndarray) -> np.ndarray:
        """Where a unit would start that begins at each gap: behind the last white space, else at the word."""
        s, least = self.starts[gap + 1], self.ends[gap]
        before = self.spaces[s]
        # where there is no white space before, what is looked up does not count
        last = self.whites[before - 1] if len(self.whites) else np.full(len(s), -1)
        return np.where((before > 0) & (last >= least), last + 1, s)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * MIX + b)


def _cell(hashed: np.ndarray, size: int) -> np.ndarray:
    return (hashed & np.uint64(size - 1)).astype(np.int64)


class Counts:
    """What the tasks count: cells of ``TABLES``, and numbers of paragraphs (``marked``: with an inner place; ``bare``: of those, ending without mark)."""

    def __init__(self):
        self.sums = {k: np.zeros(n, np.int64) for k, n in TABLES.items()}
        self.waiting: dict[str, list[np.ndarray]] = {k: [] for k in TABLES}
        self.size = self.marked = self.bare = 0

    @property
    def tables(self) -> dict[str, np.ndarray]:
        """The counts; cells are added up many at a time, for a table is larger than a batch."""
        for k, cells in self.waiting.items():
            if cells:
                self.sums[k] += np.bincount(np.concatenate(cells), minlength=TABLES[k])
                self.waiting[k] = []
        self.size = 0
        return self.sums

    def add(self, words: Words, paragraphs: np.ndarray) -> None:
        """Count the events that are certain: ends of paragraphs, and none in gaps without a mark."""
        h = words.hashed
        if not len(h):
            return
        inside, free, marked = words.gaps(paragraphs)
        first = np.concatenate([[True], ~inside])
        last = np.concatenate([~inside, [True]])
        w = _cell(h, WORDS)
        known = np.concatenate([free, [False]]) | last  # the event behind the word is certain
        left = np.where(last, h, words.left)
        a, b = left[:-1][free], h[1:][free]
        # the word before: of the paragraph, or its start; unknown behind a mark
        at = np.flatnonzero(free)
        sure = first[at] | np.concatenate([[False], free])[at]
        before = np.where(first[at], START, left[at - 1])[sure]
        found = {
            "words": _cell(left[known], WORDS),
            "starts": w[first],
            "ends": w[last],
            "pairs": _cell(pair(a, b), PAIRS),
            "triples": _cell(pair(pair(before, a[sure]), b[sure]), TRIPLES),
        }
        for k, cells in found.items():
            self.waiting[k].append(cells)
        self.size += len(h)
        if self.size > 1_000_000:
            _ = self.tables


class WordModel:
    """The word trigram with events, from summed tables."""

    def __init__(self, tables: dict[str, np.ndarray], marked: int = 0, bare: int = 0):
        self.t = {k: tables.get(k, np.zeros(n)).astype(np.float32) for k, n in TABLES.items()}
        ends, words = float(self.t["ends"].sum()), float(self.t["words"].sum())
        self.total, self.units = max(1.0, words), max(1.0, ends)
        self.end_rate = (ends + 0.01) / (words + 1.0)
        #: How often a boundary of a paragraph with marks has none.
        self.bare_rate = (bare + 0.01) / (marked + 10.0)

    def _seen(self, b: np.ndarray) -> np.ndarray:
        w = _cell(b, WORDS)
        return (self.t["words"][w] + 0.05) / (self.total + 0.05 * WORDS)

    def start(self, b: np.ndarray) -> np.ndarray:
        """P(word | start of a unit)."""
        return (self.t["starts"][_cell(b, WORDS)] + 2.0 * self._seen(b)) / (self.units + 2.0)

    def end(self, a: np.ndarray) -> np.ndarray:
        """P(end | word)."""
        w = _cell(a, WORDS)
        return (self.t["ends"][w] + 2.0 * self.end_rate) / (self.t["words"][w] + 2.0)

    def follows(self, before: list[np.ndarray | None], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """P(word | the two before it), for each of several first ones; ``START`` or None: the second starts the unit."""
        cell, both = _cell(a, WORDS), pair(a, b)
        held, starts = self.t["words"][cell], self.t["starts"][cell]
        spare = 2.0 + SPARE * held
        two = (self.t["pairs"][_cell(both, PAIRS)] + spare * self._seen(b)) / (held + spare)
        found = []
        for x in before:
            if x is None:
                context, x = starts, np.full(1, START)
            else:
                context = np.where(x == START, starts, self.t["pairs"][_cell(pair(x, a), PAIRS)])
            three = self.t["triples"][_cell(pair(pair(x, a), b), TRIPLES)]
            spare = 2.0 + SPARE * context
            found.append((three + spare * two) / (np.maximum(context, three) + spare))
        return found
