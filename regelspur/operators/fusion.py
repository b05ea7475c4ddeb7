"""Reciprocal rank fusion and re-ranking of ranked lists (qid, rank, key, score).

Ranks start at 1. Empty branches pass the others through; two empty ones give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regelspur.functions import text as X


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def reciprocal_rank_fusion(branches: list[DataFrame], key: str = "chunk_id", k: int = 60, decimals: int | None = None) -> DataFrame:
    """(qid, rank, key, score, score_branch_i, rank_branch_i): the sum of 1 / (k + rank) over all branches.

    A key that a branch lists twice adds twice and keeps its last rank and score there. Ties go to the
    key seen first (earlier branch, then rank); with ``decimals`` scores are rounded and ties go to the key.
    """
    tagged = [b.select("qid", key, "rank", "score", F.lit(i).alias("branch")) for i, b in enumerate(branches)]
    # an exchange of its own: a union may claim the partitioning of its branches and not keep it
    both = reduce(DataFrame.unionByName, tagged).repartition("qid", key)
    total = F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank")))
    parts = []
    for i in range(len(branches)):
        here = F.col("branch") == i
        parts.append(F.max_by(F.when(here, F.col("score")), F.when(here, F.col("rank"))).alias(f"score_branch_{i}"))
        parts.append(F.max(F.when(here, F.col("rank"))).alias(f"rank_branch_{i}"))
    fused = both.groupBy("qid", key).agg(
        (F.round(total, decimals) if decimals is not None else total).alias("score"), F.min(F.struct("branch", "rank")).alias("seen"), *parts
    )
    ties = [F.col(key)] if decimals is not None else [F.col("seen"), F.col(key)]
    names = [f"{what}_branch_{i}" for i in range(len(branches)) for what in ("score", "rank")]
    return _ranked(fused, F.desc("score"), *ties).select("qid", "rank", key, "score", *names)


def token_overlap(question: Column, text: Column) -> Column:
    """The share of a question's distinct terms that a passage holds: the offline scorer, all in the JVM."""
    asked = F.array_distinct(X.analyse(question))
    shared = F.size(F.array_intersect(asked, X.analyse(text)))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(asked)), F.lit(0.0))


def model_scorer(score: Callable[[list[str], list[str]], list[float]], max_chars: int = 4096) -> Callable[[Column, Column], Column]:
    """A scorer column from a function on batches of (questions, texts), e.g. a cross-encoder; texts are cut first."""

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(score(q.fillna("").tolist(), t.fillna("").tolist()), index=q.index, dtype=float)

    return lambda question, text: scored(question, F.substring(text, 1, max_chars))


def rerank(pool: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = token_overlap, key: str = "chunk_id", decimals: int | None = None) -> DataFrame:
    """(qid, rank, key, score, dense_score): the pool in the order of the scorer, ties as the pool had them.

    ``dense_score`` is the score the pool's own retriever gave, whatever retriever that was.
    """
    pairs = pool.select("qid", key, F.col("rank").alias("base_rank"), F.col("score").alias("dense_score"))
    pairs = pairs.join(queries.select("qid", "question"), "qid").join(chunks.select(key, "text"), key)
    score = scorer(F.col("question"), F.coalesce(F.col("text"), F.lit("")))
    scored = pairs.withColumn("score", F.round(score, decimals) if decimals is not None else score)
    return _ranked(scored, F.desc("score"), F.col("base_rank")).where(F.col("rank") <= k).select("qid", "rank", key, "score", "dense_score")
