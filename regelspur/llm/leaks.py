"""Evaluation texts leaking into training text, by suffix arrays of the training text.

Method: each task turns its documents, a shard at a time, into a suffix array over words (prefix
doubling to ``n`` words and more, in numpy). Every suffix of every item is binary-searched in it for its
first ``n`` words; the range found holds all verbatim occurrences. Each is extended word by word to
the longest match, and its place is kept. Affected documents can then be removed.

Shards hold whole documents, so no match is lost at a border; each is sorted in memory of fixed size.
Items are sent to the tasks as word hashes, in blocks of bounded size; a shard is sorted once and searched for
the blocks of a pass one after the other. What a pass broadcasts is at most ``PASS`` blocks, so bounded
whatever the number of items; more items need more passes.

- words: runs of letters and digits 0-9, lower-cased, after dropping invisible characters;
- an item of fewer than ``n`` words must be held whole; one without a word is in no document;
- null and blank texts hold nothing; repeated ids give one row a document and item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regelspur.llm.consistent import IGNORABLE
from regelspur.llm.words import Hashes, words_of

#: Words of a shard; items and characters of a block; blocks of a pass; suffixes searched at once.
SHARD, ITEMS, CHARS, PASS, SLICE = 1 << 19, 20_000, 1 << 24, 16, 1 << 17

_invisible = re.compile(f"[{IGNORABLE}\U000e0000-\U000e007f]")


def leak_words(text: str) -> list[str]:
    return words_of(_invisible.sub("", text).lower())


def suffix_array(tokens: np.ndarray, depth: int = 16) -> np.ndarray:
    """The places of ``tokens`` (small non-negative integers) in the order of their first ``depth`` tokens or more."""
    rank, k = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while k < depth:
        follow = np.zeros(len(rank), np.int64)
        follow[:-k] = rank[k:] + 1
        both = rank * (len(rank) + 2) + follow
        order = np.argsort(both)
        step = np.concatenate([[0], np.diff(both[order]) != 0])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(step)
        k *= 2
    return np.argsort(rank)


def _compare(tokens: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the text at each place is before, equal to or after the words wanted (-2: any word)."""
    have = tokens[at[:, None] + np.arange(wanted.shape[1])]
    differ = (have != wanted) & (wanted != -2)
    first = differ.argmax(axis=1)
    rows = np.arange(len(at))
    return np.where(differ.any(axis=1), np.sign(have[rows, first] - wanted[rows, first]), 0)


def search(tokens: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: for each row of ``wanted`` the range of ``order`` whose suffixes start with it."""
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            c = np.where(open_, _compare(tokens, order[np.minimum(mid, len(order) - 1)], wanted), 0)
            right = open_ & ((c <= 0) if upper else (c < 0))
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        bounds.append(low)
    return bounds[0], bounds[1]


class Items:
    """A block of items: their ids, and the hashes of their words end to end."""

    def __init__(self, ids: list, texts: list[str]):
        hashes = Hashes()
        words = [leak_words(t) for t in texts]
        self.ids = ids
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.flat = hashes.array([w for ws in words for w in ws])

    def suffixes(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, offset, size) of every suffix of ``n`` words, or the whole item if that has fewer."""
        size = np.minimum(self.lengths, n)
        count = np.where(self.lengths > 0, self.lengths - size + 1, 0)
        item = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        return item, inner + np.repeat(np.cumsum(self.lengths) - self.lengths, count), size[item]


class Shard:
    """Documents as one text of numbered words, a separator after each, and its suffix array."""

    def __init__(self, hashed: np.ndarray, lengths: np.ndarray, n: int):
        self.n, self.lengths = n, lengths
        self.names, tokens = np.unique(hashed, return_inverse=True)
        # a separator, 0, ends every document, so no match runs over its end
        places = np.arange(len(tokens)) + np.repeat(np.arange(len(lengths)), lengths)
        self.text = np.zeros(len(tokens) + len(lengths) + n + 1, np.int64)
        self.text[places] = tokens + 1
        self.document = np.full(len(self.text), -1, np.int64)
        self.document[places] = np.repeat(np.arange(len(lengths)), lengths)
        self.order: np.ndarray | None = None

    def matches(self, items: Items) -> pd.DataFrame:
        """(document number, item number, words, word_at) of the longest match of each document and item."""
        n, names, text = self.n, self.names, self.text
        parts = []
        if len(items.flat) and len(names):
            # the items' words as this shard numbers them; -1: not in it, so no suffix over it can match
            at = np.minimum(np.searchsorted(names, items.flat), len(names) - 1)
            flat = np.concatenate([np.where(names[at] == items.flat, at + 1, -1), np.full(n, -1)])
            unknown = np.concatenate([[0], np.cumsum(flat == -1)])
            item, offset, size = items.suffixes(n)
            able = unknown[offset + size] == unknown[offset]
            item, offset, size = item[able], offset[able], size[able]
            if len(item) and self.order is None:
                self.order = suffix_array(text[: len(text) - n - 1], max(16, n))
            ends = np.cumsum(items.lengths)
            for k in range(0, len(item), SLICE):
                parts.append(self._found(flat, ends, item[k : k + SLICE], offset[k : k + SLICE], size[k : k + SLICE]))
        if not parts:
            return pd.DataFrame({"document": [], "item": [], "words": [], "word_at": []}, dtype=np.int64)
        found = pd.concat(parts, ignore_index=True)
        found = found.sort_values(["document", "item", "words", "word_at"], ascending=[True, True, False, True]).drop_duplicates(["document", "item"])
        first = np.cumsum(self.lengths) - self.lengths + np.arange(len(self.lengths))
        return found.assign(word_at=found["word_at"] - first[found["document"].to_numpy(np.int64)])

    def _found(self, flat: np.ndarray, ends: np.ndarray, item: np.ndarray, offset: np.ndarray, size: np.ndarray) -> pd.DataFrame:
        text = self.text
        wanted = flat[offset[:, None] + np.arange(self.n)]
        wanted[np.arange(self.n) >= size[:, None]] = -2
        low, high = search(text, self.order, wanted)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        place = self.order[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        words = size[which].copy()
        growing = np.arange(len(which))
        while len(growing):  # extend each to its longest match
            a, b = place[growing] + words[growing], offset[which[growing]] + words[growing]
            fits = (b < ends[item[which[growing]]]) & (a < len(text))
            same = fits.copy()
            same[fits] = (text[a[fits]] == flat[b[fits]]) & (text[a[fits]] > 0)
            growing = growing[same]
            words[growing] += 1
        return pd.DataFrame({"document": self.document[place], "item": item[which], "words": words, "word_at": place})


def _pass(df: DataFrame, blocks: list[Items], item_kind: str, n: int) -> DataFrame:
    """One pass over the documents against some blocks of items."""
    sent = [df.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, keys, parts, lengths, held = Hashes(), [], [], [], 0

        def flush() -> Iterator[pd.DataFrame]:
            shard = Shard(np.concatenate(parts), np.array(lengths, np.int64), n)
            for block in sent:
                found = shard.matches(block.value)
                if len(found):
                    yield pd.DataFrame({
                        "document": [keys[k] for k in found["document"]],
                        "item": [block.value.ids[k] for k in found["item"]],
                        "words": found["words"].astype("int32"),
                        "word_at": found["word_at"].astype("int32"),
                    })

        for pdf in batches:
            for key, text in zip(pdf["id"].tolist(), pdf["text"].tolist()):
                hashed = hashes.array(leak_words(text))
                keys.append(key), parts.append(hashed), lengths.append(len(hashed))
                held += len(hashed)
                if held >= SHARD:
                    yield from flush()
                    keys, parts, lengths, held = [], [], [], 0
        if held:
            yield from flush()

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInPandas(scan, f"document {kind}, item {item_kind}, words int, word_at int")


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = 12) -> DataFrame:
    """(document, item, words, word_at): each document and item it holds text of, with the length of
    the longest verbatim match in words and the word of the document at which it starts."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    asked = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["chars"] // CHARS))
    kind = asked.schema["id"].dataType.simpleString()
    out: DataFrame | None = None
    for start in range(0, blocks, PASS):
        held = []
        for k in range(start, min(blocks, start + PASS)):
            part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
            got = part.orderBy("id").collect()  # a block of about ITEMS rows and CHARS characters
            held.append(Items([r["id"] for r in got], [r["text"] for r in got]))
        found = _pass(rows, held, kind, n)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("words", "word_at"), F.struct("words", -F.col("word_at")))
    return out.groupBy("document", "item").agg(best.alias("best")).select("document", "item", "best.words", "best.word_at")


def without_leaks(docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The documents that hold no text of any item."""
    return docs.join(found.select(F.col("document").alias(key)).distinct(), key, "left_anti")
