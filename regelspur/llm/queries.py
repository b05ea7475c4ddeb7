"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regelspur.llm import consistent, leaks, mixing, neardup, pairs, pieces, sentences, terms


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    similar = neardup.similar_pairs(_table(spark, sf, "chunks"), "position", "text", threshold=0.6, n=3)
    return similar.select(F.col("a").alias("position_a"), F.col("b").alias("position_b"))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_groups(_table(spark, sf, "chunks"), "position", "text", threshold=0.6, n=3)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.broken_pairs(_table(spark, sf, "goldset"), _table(spark, sf, "chunks"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks, gold = _table(spark, sf, "chunks"), _table(spark, sf, "goldset")
    model = consistent.fit_scripts(chunks, "text")
    odd = consistent.inconsistent(chunks, "text", model).select(F.lit("chunks.text").alias("field"), F.col("position").cast("string").alias("row_key"))
    quoted = consistent.inconsistent(gold, "answer_snippet", model).select(F.lit("goldset.answer_snippet").alias("field"), F.col("id").alias("row_key")).distinct()
    return odd.unionByName(quoted)


def p3_texts(spark: SparkSession, sf: str) -> DataFrame:
    chunks, gold = _table(spark, sf, "chunks"), _table(spark, sf, "goldset")
    model = consistent.fit_scripts(chunks, "text")
    passages = chunks.select(F.lit("chunks.text").alias("field"), F.col("position").cast("string").alias("row_key"), "text")
    quotes = gold.select(F.lit("goldset.answer_snippet").alias("field"), F.col("id").alias("row_key"), F.col("answer_snippet").alias("text"))
    return consistent.with_consistent(passages.unionByName(quotes), "text", "consistent", model).select("field", "row_key", "consistent")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _table(spark, sf, "chunks").select("position", "text").where(F.length("text") > 1500)
    return pieces.pieces(chunks, "text", 1500, 150).where("piece_no = 0").select("position", "cut")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.pieces(_table(spark, sf, "chunks").select("position", "text"), "text", 1500, 150).select("position", "piece_no", "start", "piece", "cut")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(_table(spark, sf, "chunks"), "position", "text").where("mark is not null").select("term", "mark")


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_frequencies(_table(spark, sf, "chunks"), "position", "text")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(_table(spark, sf, "documents"), "doc_id", "text", _table(spark, sf, "eval_items"), "item_id", "text", n=12)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select(F.col("document").alias("doc_id"), F.col("item").alias("item_id"))


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.without_leaks(_table(spark, sf, "documents"), "doc_id", _leaks(spark, sf)).select("doc_id", "source", "lang")


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    return mixing.Mix(_table(spark, sf, "documents"), "doc_id", "text", "source", _table(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report().where("short").select("source")


def p7_drawn(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).drawn()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_starts(_table(spark, sf, "documents"), "doc_id", "text")


def p8_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(_table(spark, sf, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
