"""Text that looks the same, written the same: the consistent form.

A text is brought to its consistent form in three steps:

1. compatibility: full-width and half-width letters and digits and typographic ligatures become
   ordinary letters, ignorable characters go, spaces and hyphens of other codes become U+0020 and
   U+002D, and base letters and combining marks are composed (NFC);
2. every word that holds a letter with a Latin look-alike opens a lattice, one column a letter,
   each with the stored letter and the Latin one; Viterbi finds the best path under character
   bigram scores per script, with a price for changing the script inside a word, a price for
   each replaced letter and a prior from the script of the words around it;
3. the best path is written back.

The bigram scores are counted over the whole column (``fit_scripts``); the model is bounded by
the square of the alphabet, about 100,000 counts, whatever the size of the table.

Nulls stay null, empty texts stay empty, other columns pass through untouched.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that cannot be seen (fixed values, from the Unicode list of default ignorables).
IGNORABLE = (
    "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯"
    "ㅤ︀-️﻿ﾠ"
)
#: Spaces of another code that look like U+0020 (fixed values).
SPACES = "   -   　"
#: Hyphens of another code that look like U+002D; dashes are not among them (fixed values).
HYPHENS = "˗‐‑⁃﹣－"

#: Letters of other scripts and the Latin letter each looks like (fixed values).
LOOK_ALIKES = {
    **dict(zip("аеорсухіјѕһԁԛԝӏкӕ", ["a", "e", "o", "p", "c", "y", "x", "i", "j", "s", "h", "d", "q", "w", "l", "k", "æ"])),
    **dict(zip("АВЕКМНОРСТУХІЈЅԌԚԜҮѴ", "ABEKMHOPCTYXIJSGQWYV")),
    **dict(zip("οανικρυγχϲϳ", "oavikpuyxcj")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ")),
    **dict(zip("օսոհցզյՕՍԼ", "ounhgqjOUL")),
    **dict(zip("ɡɑıʏᴄᴏᴠᴡᴢꜱꓐꓮꓰ", ["g", "a", "i", "y", "c", "o", "v", "w", "z", "s", "B", "A", "E"])),
}
#: Letters of other scripts used as symbols: they neither change nor speak for a script.
SYMBOLS = "ΩωφµμπΔδθλ"

KEEP, REPLACE, SWITCH, NEAR = 0.0, math.log(0.2), math.log(1e-4), 10.0
FLOOR = math.log(1e-4)


def _composed() -> dict[str, str]:
    """Look-alikes with marks: the composed letter whose base has a Latin look-alike."""
    out = dict(LOOK_ALIKES)
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in LOOK_ALIKES:
            latin = unicodedata.normalize("NFC", LOOK_ALIKES[base] + "".join(marks))
            if len(latin) == 1:
                out.setdefault(chr(code), latin)
    return out


LATIN_OF = _composed()


def _simple() -> dict[int, str | None]:
    """The table of step 1, one entry a code point."""

    def chars(spec: str) -> Iterator[int]:
        for m in re.finditer(r"(.)-(.)|(.)", spec, re.S):
            yield from range(ord(m[1]), ord(m[2]) + 1) if m[1] else [ord(m[3])]

    table: dict[int, str | None] = dict.fromkeys(chars(IGNORABLE))
    table |= dict.fromkeys(range(0xE0000, 0xE0080)) | dict.fromkeys(range(0xE0100, 0xE01F0))
    table |= dict.fromkeys(chars(SPACES), " ") | dict.fromkeys(chars(HYPHENS), "-")
    for code in (*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), *range(0xFF10, 0xFFDD), 0x1D7FF, *range(0x1D400, 0x1D800)):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and plain.isalnum():
            table[code] = plain
    return table


SIMPLE = _simple()
#: What makes a text worth a look; everything else is in consistent form as it is. The class is
#: written so that Python and Java read it alike.
PLAIN = "\\u0000-\\u009f\\u00a1-\\u00ac\\u00ae-\\u0130\\u0132-\\u0250\\u2012-\\u2027\\u2030-\\u2042\\u2044-\\u205e\\u20a0-\\u2129\\u212c-\\u2bff\\u3001-\\u3163\\u3165-\\ua4cf\\uac00-\\ud7af\\u03a9\\u03c6\\u03bc"
SUSPECT = f"[^{PLAIN}]"
_suspect = re.compile(SUSPECT)
_odd = re.compile("[" + "".join(map(re.escape, LATIN_OF)) + "]")
_word = re.compile(r"[^\W_]+")
_voiced = re.compile("[ｦ-ﾟ]+")
_table = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(SIMPLE) if c < 0x10000) + "\U0001d400-\U0001d7ff\U000e0000-\U000e01ef]")
_word_end = re.compile(r"[^\W_]*")

#: Alphabet of the bigram model: index 0 is everything that is no letter of these blocks.
_BLOCKS = [(0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x180), (0x370, 0x400), (0x400, 0x530), (0x531, 0x588)]
_ALPHABET = [chr(c) for a, b in _BLOCKS for c in range(a, b) if chr(c).isalpha()]
_INDEX = np.zeros(0x10000, np.int64)
for _i, _c in enumerate(_ALPHABET, 1):
    _INDEX[ord(_c)] = _i
_N = len(_ALPHABET) + 1


def script(c: str) -> str:
    """L, C, G or A for a Latin, Cyrillic, Greek or Armenian letter, else an empty string."""
    if not c or c in SYMBOLS or not c.isalpha():
        return ""
    o = ord(c)
    if o == 0x131 or c in LATIN_OF and o not in range(0x370, 0x600):
        return "X"  # phonetic letters and the like: never part of an ordinary word
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    return "A" if 0x531 <= o < 0x588 else "X"


class ScriptModel:
    """Character bigram scores, each relative to the letters of one script."""

    def __init__(self, pairs: dict[int, int] | None = None):
        self.pairs = pairs or {}
        total: dict[int, int] = {}
        for k, n in self.pairs.items():
            total[k // _N] = total.get(k // _N, 0) + n
        self.total = total
        self.starts: dict[str, int] = {}
        #: Letters seen of each script that cannot be Latin ones: without any, its words are all look-alikes.
        self.real: dict[str, int] = {}
        for k, n in self.pairs.items():
            if k % _N and _ALPHABET[k % _N - 1] not in LATIN_OF:
                c = script(_ALPHABET[k % _N - 1])
                self.real[c] = self.real.get(c, 0) + n
            if k < _N and k:
                c = script(_ALPHABET[k - 1])
                self.starts[c] = self.starts.get(c, 0) + n
        self.memo: dict[tuple, str] = {}

    def __reduce__(self):
        return ScriptModel, (self.pairs,)

    def score(self, a: str, b: str) -> float:
        """log P(b after a), smoothed, so a script of which little was seen is not ruled out; not below the floor.

        What starts a word of a script is told from the other starts of that script.
        """
        i, j = int(_INDEX[ord(a)]) if a and ord(a) < 0x10000 else 0, int(_INDEX[ord(b)]) if b and ord(b) < 0x10000 else 0
        if a and not i or b and not j:
            return FLOOR  # no letter of the alphabets
        if b and script(b) and not self.real.get(script(b)):
            return FLOOR
        total = self.total.get(i, 0) if i else self.starts.get(script(b), 0)
        return max(FLOOR, math.log((self.pairs.get(i * _N + j, 0) + 0.5) / (total + 20.0)))

    def best(self, word: str, prior: dict[str, float]) -> str:
        """The best path through the lattice of ``word``."""
        key = (word, tuple(sorted(prior.items())))
        if (known := self.memo.get(key)) is not None:
            return known
        # state: script so far and last letter -> (score, letters)
        states: dict[tuple[str, str], tuple[float, str]] = {("", ""): (0.0, "")}
        for c in word:
            options = [(c, KEEP)] + ([(LATIN_OF[c], REPLACE)] if c in LATIN_OF else [])
            after: dict[tuple[str, str], tuple[float, str]] = {}
            for (s, last), (value, text) in states.items():
                for o, price in options:
                    k = script(o)
                    v = value + price + (self.score(last, o) if k else 0.0)
                    if k and s and k != s:
                        v += SWITCH
                    elif k and not s:
                        v += prior.get(k, 0.0)
                    state = (k or s, o)
                    if state not in after or v > after[state][0]:
                        after[state] = (v, text + o)
            states = after
        found = max((v + self.score(last, ""), text) for (_, last), (v, text) in states.items())[1]
        if len(self.memo) > 100_000:
            self.memo.clear()
        self.memo[key] = found
        return found


def _speaks(word: str) -> str:
    """The script a neighbouring word speaks for: of letters that cannot be taken for Latin ones, else Latin."""
    latin = ""
    for c in word:
        if c not in LATIN_OF and (k := script(c)):
            if k != "L":
                return k
            latin = "L"
    return latin


_breaks = re.compile(r"[^\w\s-]")


def _priors(text: str, spans: list[tuple[int, int]]) -> list[dict[str, float]]:
    """What the nearest words on either side that speak for a script make of each word between them.

    A neighbour behind a mark (a quote, a comma) speaks half as loud.
    """
    speakers = [(m.start(), m.end(), k) for m in _word.finditer(text) if (k := _speaks(m[0]))]
    starts = [s for s, _, _ in speakers]
    out = []
    for start, end in spans:
        prior: dict[str, float] = {}
        before, after = bisect.bisect_left(starts, start) - 1, bisect.bisect_left(starts, end)
        if before >= 0 and speakers[before][1] > start:
            before -= 1
        for at, (a, b) in ((before, (speakers[before][1], start) if before >= 0 else (0, 0)), (after, (end, speakers[after][0]) if after < len(speakers) else (0, 0))):
            if 0 <= at < len(speakers):
                k = speakers[at][2]
                prior[k] = prior.get(k, 0.0) + NEAR / (2 if _breaks.search(text, a, b) else 1)
        out.append(prior)
    return out


def simple_form(text: str) -> str:
    """Step 1 alone: compatibility, ignorables, spaces, hyphens, composition."""
    if not _suspect.search(text):
        return text
    if _voiced.search(text):
        text = _voiced.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return unicodedata.normalize("NFC", _table.sub(lambda m: SIMPLE.get(ord(m[0]), m[0]) or "", text))


def consistent_form(text: str, model: ScriptModel) -> str:
    """The consistent form of one text."""
    if not _suspect.search(text):
        return text
    text = simple_form(text)
    while _odd.search(text):  # a word made Latin speaks for its neighbours, so again until nothing changes
        spans, at = [], 0
        while m := _odd.search(text, at):
            start, end = m.start(), _word_end.match(text, m.start()).end()
            while start > at and (text[start - 1].isalnum()):
                start -= 1
            spans.append((start, max(end, m.end())))
            at = spans[-1][1]
        out, at = [], 0
        for (start, end), prior in zip(spans, _priors(text, spans)):
            out += [text[at:start], model.best(text[start:end], prior)]
            at = end
        after = unicodedata.normalize("NFC", "".join(out) + text[at:])
        if after == text:
            break
        text = after
    return text


def fit_scripts(df: DataFrame, *columns: str) -> ScriptModel:
    """Count the character bigrams of whole columns, in numpy a batch at a time, and sum them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_N * _N, np.int64)
        for pdf in batches:
            for c in pdf.columns:
                texts = pdf[c].dropna().tolist()
                for k in range(0, len(texts), 500):
                    codes = np.frombuffer("\n".join(texts[k : k + 500]).encode("utf-32-le", "replace"), np.uint32)
                    index = _INDEX[np.minimum(codes, 0xFFFF)]
                    if len(index) > 1:
                        total += np.bincount(index[:-1] * _N + index[1:], minlength=_N * _N)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at, "n": total[at]})

    counted = df.select(*columns).mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return ScriptModel({r["pair"]: r["n"] for r in counted.collect()})  # at most the alphabet squared


def with_consistent(df: DataFrame, column: str, to: str, model: ScriptModel | None = None) -> DataFrame:
    """``df`` with the consistent form of ``column`` as ``to``."""
    model = model or fit_scripts(df, column)

    @F.pandas_udf(T.StringType())
    def form(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: consistent_form(t, model), na_action="ignore")

    return df.withColumn(to, F.when(F.col(column).rlike(SUSPECT), form(F.col(column))).otherwise(F.col(column)))


def inconsistent(df: DataFrame, column: str, model: ScriptModel | None = None) -> DataFrame:
    """The rows of ``df`` whose ``column`` is not in consistent form.

    Only rows with a character worth a look leave the JVM; the regex on them is pushed below Python.
    """
    model = model or fit_scripts(df, column)

    @F.pandas_udf(T.BooleanType())
    def differs(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: t is not None and consistent_form(t, model) != t).astype(bool)

    return df.where(F.col(column).rlike(SUSPECT)).where(differs(F.col(column)))
