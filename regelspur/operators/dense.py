"""Embeddings and exact nearest neighbours in blocks.

A stated set of query vectors goes against all rows: queries are sent to the tasks in blocks of bounded
size, each task multiplies its rows with the block and keeps its best ``k`` a query, and only those are
shuffled. Null vectors and vectors of another length than the queries' have no score.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors of 1,024 dimensions sent at once, 32 MB; of shorter ones as many more.
QUERY_BLOCK = 4096
#: Queries and rows multiplied at once.
QUERY_STEP, ROW_STEP = 256, 4096
_words = re.compile(r"[a-zäöüß0-9]+")


class Embedder(Protocol):
    """Texts to unit vectors. Models are loaded in the workers, once each."""

    dim: int
    query_prefix: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """An offline stand-in for a neural model: signed hashed words, L2-normalised.

    A word (a run of German letters and digits, lower-cased) adds 1 or -1 to one component: the first two bytes of its MD5
    tell the component, the third the sign, so other engines can repeat it. Components are rounded to six digits.
    """

    def __init__(self, dim: int = 64, query_prefix: str = ""):
        self.dim, self.query_prefix = dim, query_prefix
        self._seen: dict[str, tuple[int, float]] = {}

    def _place(self, word: str) -> tuple[int, float]:
        found = self._seen.get(word)
        if found is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            h = hashlib.md5(word.encode()).digest()
            found = self._seen[word] = (h[0] * 256 + h[1]) % self.dim, 1.0 if h[2] >= 128 else -1.0
        return found

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in _words.findall(text.lower()):
                k, sign = self._place(word)
                out[i, k] += sign
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).round(6)


def embed(df: DataFrame, text: str, embedder: Embedder, to: str = "embedding", query: bool = False) -> DataFrame:
    """``df`` with the embedding of ``text``; questions get the embedder's prefix. Nulls stay null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            there = s.dropna()
            for at in range(0, len(there), 256):
                part = there.iloc[at : at + 256]
                for i, v in zip(part.index, embedder.encode([(embedder.query_prefix if query else "") + t for t in part])):
                    out[i] = v
            yield out

    return df.withColumn(to, encode(F.col(text)))


def _close(m: np.ndarray, rows: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs that may be among the best ``k``, given that ``least`` is needed: found in single precision,
    with a margin beyond its error."""
    big = max(np.abs(m).max(initial=0), np.abs(rows).max(initial=0)) > 1e15
    kind = np.float64 if big else np.float32
    error = 1e-6 + m.shape[1] * np.finfo(kind).eps * np.linalg.norm(m, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0)
    right, found = np.ascontiguousarray(rows.T.astype(kind)), []
    for a in range(0, len(m), QUERY_STEP):
        scores = m[a : a + QUERY_STEP].astype(kind) @ right
        need = least[a : a + QUERY_STEP] - error[a : a + QUERY_STEP]
        if len(rows) >= k and np.isneginf(need).any():
            kth = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
            need = np.maximum(need, kth - 2 * error[a : a + QUERY_STEP])
        mask = (scores >= need.astype(kind)[:, None]).ravel()
        if len(mask) % 8 == 0:  # few are set, so eight are looked at together
            some = np.flatnonzero(mask.view(np.uint64))
            at = (some[:, None] * 8 + np.arange(8)).ravel()
            at = at[mask[at]]
        else:
            at = np.flatnonzero(mask)
        found.append((at // len(rows) + a, at % len(rows)))
    return np.concatenate([q for q, _ in found]), np.concatenate([c for _, c in found])


class _Best:
    """The best ``k`` rows of every query so far."""

    def __init__(self, qids: np.ndarray, m: np.ndarray, k: int, self_match: bool):
        self.qids, self.m, self.k, self.self_match = qids, m, k, self_match
        self.least = np.where(np.isfinite(m).all(axis=1), -np.inf, np.inf)  # a query that is not finite has no scores
        self.m = np.where(np.isfinite(m), m, 0.0)
        self.q, self.score, self.row = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.ids = np.zeros(0, object)
        self.new: list[tuple] = []

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        q, c = _close(self.m, rows, self.least, self.k + (not self.self_match))
        score = np.concatenate([np.einsum("ij,ij->i", self.m[q[a : a + 65536]], rows[c[a : a + 65536]]) for a in range(0, len(q), 65536)] or [np.zeros(0)]).round(6)
        keep = np.isfinite(score) & (score >= self.least[q])
        if not self.self_match:
            keep &= ~np.equal(self.qids[q], ids[c]).astype(bool)
        if keep.any():
            self.new.append((q[keep], score[keep], c[keep] + len(self.ids)))
            self.ids = np.append(self.ids, ids)
            if sum(len(x[0]) for x in self.new) * 4 >= len(self.q):
                self.settle()

    def settle(self) -> None:
        """Keep the best ``k`` a query of those held and new."""
        q, score, row = (np.concatenate(x) for x in zip((self.q, self.score, self.row), *self.new))
        self.new = []
        order = np.lexsort((-score, q))
        q, score, row = q[order], score[order], row[order]
        same = np.append(False, (q[1:] == q[:-1]) & (score[1:] == score[:-1]))
        tied = same | np.append(same[1:], False)
        place = np.zeros(len(q), np.int64)  # ids are compared only where scores are equal
        some, at = np.unique(row[tied], return_inverse=True)
        place[tied] = np.argsort(np.argsort(self.ids[some], kind="stable"), kind="stable")[at]
        order = np.lexsort((place, -score, q))
        starts = np.searchsorted(q, np.arange(len(self.m) + 1))
        order = order[np.arange(len(q)) - starts[q] < self.k]
        self.q, self.score, self.row = q[order], score[order], row[order]
        full = np.flatnonzero(np.diff(starts) >= self.k)
        self.least[full] = np.maximum(self.least[full], self.score[np.searchsorted(self.q, full, side="right") - 1])
        used, self.row = np.unique(self.row, return_inverse=True)  # ids of rows no longer held go
        self.ids = self.ids[used]


def _pass(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, self_match: bool, qid_type: str) -> DataFrame:
    """The best ``k`` rows a task for one block of queries."""
    context = vectors.sparkSession.sparkContext
    sent = context.broadcast((ids, matrix))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, m = sent.value
        best = _Best(qids, m, k, self_match)
        for pdf in batches:
            right = [i for i, v in enumerate(pdf["v"]) if v is not None and len(v) == m.shape[1]]
            for a in range(0, len(right), ROW_STEP):
                part = right[a : a + ROW_STEP]
                rows = np.stack(pdf["v"].to_numpy()[part]).astype(float)
                there = np.isfinite(rows).all(axis=1)
                if there.any():
                    best.add(pdf["id"].to_numpy()[part].astype(object)[there], rows[there])
        if best.new:
            best.settle()
        for a in range(0, len(best.q), 65536):
            at = slice(a, a + 65536)
            yield pd.DataFrame({"qid": qids[best.q[at]], "id": best.ids[best.row[at]], "score": best.score[at]})

    # few tasks: each sends k rows a query
    rows = vectors.select("id", "v").coalesce(max(1, 2 * context.defaultParallelism))
    return rows.mapInPandas(scan, f"qid {qid_type}, id {rows.schema['id'].dataType.simpleString()}, score double")


def nearest(vectors: DataFrame, key: str, embedding: str, queries: DataFrame, qid: str, query_embedding: str, k: int, self_match: bool = True) -> DataFrame:
    """(qid, rank, id, score): the ``k`` rows of highest inner product (cosine of unit vectors), exactly.

    Scores are rounded to six digits, ties go to the smaller id. ``self_match=False`` leaves out the
    row whose id is the query's.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).alias("v"))
    asked = queries.select(F.col(qid).alias("qid"), F.col(query_embedding).alias("v")).where("v is not null")
    first = asked.select(F.size("v").alias("n")).first()
    size = QUERY_BLOCK * max(1, 1024 // max(1, first["n"])) if first else QUERY_BLOCK
    blocks = max(1, -(-asked.count() // size))
    kind = asked.schema["qid"].dataType.simpleString()
    found: DataFrame | None = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        got = part.orderBy("qid").toArrow().combine_chunks()  # about ``size`` rows
        if got.num_rows:
            matrix = np.array(got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(got.num_rows, -1)
            best = _pass(rows, np.array(got["qid"].to_pylist(), dtype=object), matrix, k, self_match, kind)
            found = best if found is None else found.unionByName(best)
    if found is None:
        empty = f"qid {kind}, rank int, id {rows.schema['id'].dataType.simpleString()}, score double"
        return vectors.sparkSession.createDataFrame([], empty)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "id", "score")
