"""Relevance and rank metrics as Column expressions; ``rank`` is that of the first hit, null without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regelspur.functions import text as T


def is_relevant(page: Column, norm_text: Column, gold_page: Column, norm_snippet: Column) -> Column:
    """For a passage of the right file: its page is the gold page (two missing pages are equal), or it holds the snippet."""
    held = (norm_snippet != "") & F.contains(norm_text, norm_snippet)
    return page.eqNullSafe(gold_page) | F.coalesce(held, F.lit(False))


def hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``ranked`` (with qid, source_file, page_number, text) and the column ``hit``; gold is (qid, source_file, page_number, answer_snippet)."""
    g = gold.select("qid", F.col("source_file").alias("gold_file"), F.col("page_number").alias("gold_page"), T.normalise(F.coalesce("answer_snippet", F.lit(""))).alias("snippet"))
    right = F.col("source_file") == F.col("gold_file")
    hit = right & is_relevant(F.col("page_number"), T.normalise(F.coalesce("text", F.lit(""))), F.col("gold_page"), F.col("snippet"))
    return ranked.join(g, "qid").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("gold_file", "gold_page", "snippet")


def first_hits(questions: DataFrame, judged: DataFrame) -> DataFrame:
    """(qid, rank) of every question, also of those with no result at all."""
    best = judged.groupBy("qid").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("rank"))
    return questions.select("qid").join(best, "qid", "left")


def recall_at(rank: Column, k: int) -> Column:
    return F.coalesce((rank <= k).cast("double"), F.lit(0.0))


def reciprocal_rank(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def ndcg_at(rank: Column, k: int) -> Column:
    """With a single relevant passage; further hits do not count."""
    return F.when(rank <= k, F.lit(1.0) / F.log2(rank + F.lit(1))).otherwise(F.lit(0.0))


def mean(value: Column) -> Column:
    """0 of nothing."""
    return F.coalesce(F.avg(value), F.lit(0.0))
