"""Evaluation of retrieval variants. The two forms of a question are never averaged together."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regelspur.config import RetrievalConfig
from regelspur.functions import text as T
from regelspur.operators import answers, lexical, metrics
from regelspur.session import cut

FORMS = ("colloquial", "precise")


def unpivot(gold: DataFrame) -> DataFrame:
    """(id, variant, qid, question, ...): an entry's two questions as rows; missing questions stay, as null."""
    keep = ["id", "source_file", "page_number", "answer_snippet"]
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"question_{v}").alias("question")) for v in FORMS])).alias("q")
    rows = gold.dropDuplicates(["id"]).select(*keep, pairs)
    return rows.select(*keep, "q.variant", "q.question", F.concat("id", F.lit("-"), F.substring("q.variant", 1, 1)).alias("qid"))


def per_question(questions: DataFrame, judged: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(config, variant, id, hit_at_<k>, rank): a row a question."""
    ranks = metrics.first_hits(questions, judged)
    out = questions.select("qid", "id", "variant").join(ranks, "qid")
    for k in (config.top_k, config.candidate_k):
        out = out.withColumn(f"hit_at_{k}", F.coalesce(F.col("rank") <= k, F.lit(False)))
    return out.select(F.lit(config.name).alias("config"), "variant", "id", f"hit_at_{config.top_k}", f"hit_at_{config.candidate_k}", "rank")


def variant_metrics(log: DataFrame, top_k: int = 5, candidate_k: int = 20) -> DataFrame:
    """Means a config and variant over a log of (config, variant, id, rank); a repeated row counts once."""
    rank = F.col("rank")
    means = {
        f"recall_at_{top_k}": metrics.recall_at(rank, top_k),
        f"recall_at_{candidate_k}": metrics.recall_at(rank, candidate_k),
        "mrr": metrics.reciprocal_rank(rank),
        f"ndcg_at_{top_k}": metrics.ndcg_at(rank, top_k),
    }
    aggs = [F.round(metrics.mean(c), 6).alias(n) for n, c in means.items()]
    once = log.select("config", "variant", "id", "rank").distinct()
    return once.groupBy("config", "variant").agg(F.count(F.lit(1)).alias("questions"), *aggs, F.count_if(rank.isNull()).alias("no_hit"))


def per_document_recall(log: DataFrame, gold: DataFrame, top_k: int = 5) -> DataFrame:
    """Recall by the document an entry comes from."""
    files = gold.select("id", "source_file").dropDuplicates(["id"])
    rows = log.select("config", "variant", "id", "rank").distinct().join(files, "id")
    return rows.groupBy("config", "variant", "source_file").agg(F.count(F.lit(1)).alias("questions"), F.round(metrics.mean(metrics.recall_at(F.col("rank"), top_k)), 6).alias("recall"))


def per_document_pivot(recall: DataFrame) -> DataFrame:
    """A row a config and document, a column a form; a form without questions reads 0."""
    wide = recall.groupBy("config", "source_file").pivot("variant", list(FORMS)).agg(F.first("recall"))
    return wide.na.fill(0.0, list(FORMS))


def misses(questions: DataFrame, judged: DataFrame, shown: int = 3) -> DataFrame:
    """(qid, expected, retrieved): questions without a hit, where the answer is and what came first instead."""
    ranks = metrics.first_hits(questions, judged).where("rank is null").select("qid")
    label = T.location(F.col("source_file"), F.col("page_number"))
    tops = judged.where(F.col("rank") <= shown).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", label.alias("l")))).alias("t"))
    out = questions.join(ranks, "qid", "left_semi").join(tops, "qid", "left")
    names = F.transform(F.coalesce("t", F.array().cast("array<struct<rank:int,l:string>>")), lambda x: x["l"])
    return out.select("qid", "question", label.alias("expected"), F.array_join(names, "; ").alias("retrieved"))


def latency(retriever, questions: DataFrame, k: int, asked: int = 20) -> float:
    """The median time of a question asked by itself, in seconds, over ``asked`` of them (by the hash of their id); 0 of none."""
    few = questions.where("question is not null").orderBy(F.xxhash64("qid"), "qid").limit(asked).select("qid", "question").collect()
    spark, times = questions.sparkSession, []
    for r in few:
        one = spark.createDataFrame([(r["qid"], r["question"])], "qid string, question string")
        began = time.perf_counter()
        retriever.retrieve(one, k).collect()
        times.append(time.perf_counter() - began)
    return statistics.median(times) if times else 0.0


def evaluate(retriever, gold: DataFrame, chunks: DataFrame, config: RetrievalConfig, timed: int = 0) -> dict[str, DataFrame | float]:
    """All questions in one batch; ``seconds_per_question`` is the batch's time divided, ``median_latency`` that
    of ``timed`` questions asked one by one."""
    questions = unpivot(gold).where("question is not null")
    began = time.perf_counter()
    ranked = cut(retriever.retrieve(questions.select("qid", "question"), config.candidate_k), "ranked")
    count = ranked.select("qid").distinct().count()
    seconds = time.perf_counter() - began
    judged = metrics.hits(lexical.with_passages(ranked, chunks), questions)
    log = per_question(questions, judged, config)
    return {
        "per_question": log,
        "metrics": variant_metrics(log, config.top_k, config.candidate_k),
        "per_document": per_document_recall(log, gold, config.top_k),
        "misses": misses(questions, judged),
        "seconds_per_question": seconds / max(1, count),
        "median_latency": latency(retriever, questions, config.top_k, timed),
    }


def abstention_run(retriever, unanswerable: DataFrame, chunks: DataFrame, names: DataFrame, top_k: int = 5, generator=answers.extractive) -> DataFrame:
    """(id, category, question, answer, abstained): what is answered to the questions (id, question, category) that no
    passage answers. Null questions find nothing and abstain; repeated ids count once."""
    rows = unanswerable.groupBy("id").agg(F.min(F.struct("question", "category")).alias("r")).select("id", "r.question", "r.category")
    asked = rows.select(F.col("id").alias("qid"), "question")
    done = answers.answer(asked, retriever.retrieve(asked, top_k), chunks, names, top_k, generator)
    return done.select(F.col("qid").alias("id"), "question", "answer", "abstained").join(rows.select("id", "category"), "id")


def abstention(answers: DataFrame) -> DataFrame:
    """(category, questions, abstention_rate, total): by category and, as total, over all questions."""
    rows = answers.select(F.coalesce("category", F.lit("uncategorised")).alias("category"), F.col("abstained").cast("double").alias("a"))
    return rows.rollup("category").agg(
        F.count(F.lit(1)).alias("questions"), F.round(metrics.mean(F.col("a")), 6).alias("abstention_rate"), F.grouping("category").cast("int").alias("total")
    )


def answered_anyway(answers: DataFrame, shown: int = 300) -> DataFrame:
    """The unanswerable questions that got an answer, with its beginning."""
    return answers.where(~F.col("abstained")).select("id", "question", F.substring("answer", 1, shown).alias("answer"))


def markdown(rows: DataFrame) -> str:
    """A small result (a row a variant or document) as a markdown table."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.collect()])
