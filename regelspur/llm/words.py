"""Words and word hashes, in numpy a batch at a time."""

from __future__ import annotations

import re
import sys

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def _no_words() -> str:
    """A class of the characters Python calls alphanumeric that are neither letters nor the digits 0-9."""
    runs: list[list[int]] = []
    for c in range(0x80, min(0x20000, sys.maxunicode)):
        if chr(c).isalnum() and not chr(c).isalpha():
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "[_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


_other = re.compile(_no_words())
_run = re.compile(r"[^\W_]+")
_hyphened = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def _found(pattern: re.Pattern, text: str) -> list[str]:
    """What a pattern of alphanumeric runs finds; searched again without other characters only where a run holds one."""
    found = pattern.findall(text)
    if text.isascii() or all(w.isascii() or w.replace("-", "").isalpha() for w in found):
        return found
    return pattern.findall(_other.sub(" ", text)) if _other.search("".join(w for w in found if not w.isascii())) else found


def words_of(text: str) -> list[str]:
    """The longest runs of letters and digits 0-9 of a text, as they stand."""
    return _found(_run, text)


def terms_of(text: str) -> list[str]:
    """Runs of letters and digits 0-9, joined where a single hyphen stands between two of them."""
    return _found(_hyphened, text)


class Hashes(dict):
    """64-bit hashes of words; a word met again costs one look-up. Emptied when it grows."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def runs(lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of ``n`` items from each place stays within its text; texts lie end to end."""
    total = int(lengths.sum())
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)
    return left >= n


def shingles(hashed: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` successive items (the last ``n - 1`` places hold no true run)."""
    total = np.zeros(len(hashed), np.uint64)
    for k in range(n):
        part = hashed[k:] * np.uint64(2 * (0x5851F42D4C957F2D * (k + 1) % 2**62) + 1)
        total[: len(part)] += mix(part)
    return mix(total)
