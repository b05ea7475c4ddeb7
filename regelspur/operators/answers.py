"""From retrieved passages to a cited answer or a refusal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from regelspur.functions import replies, titles
from regelspur.functions import text as T
from regelspur.operators import lexical
from regelspur.session import cut

SEPARATOR = "\n\n---\n\n"
#: Share of a question's terms that the best sentence must hold for the offline generator to answer.
LEAST_OVERLAP = 0.5


def _labelled(source: Column, page: Column, text: Column) -> Column:
    """A passage under its label, the form in which it is to be cited."""
    missing = F.lit("?")
    label = F.concat(F.lit("["), F.coalesce(source, missing), F.lit(", Seite "), F.coalesce(page.cast("string"), missing), F.lit("]\n"))
    return F.concat(label, F.coalesce(text, F.lit("")))


def context(passages: Column) -> Column:
    """What a model is prompted with: the passages of a question (array of rank, text, source_file, page_number) in order."""
    return F.array_join(F.transform(passages, lambda p: _labelled(p["source_file"], p["page_number"], p["text"])), SEPARATOR)


def build_context(passages: DataFrame) -> DataFrame:
    """(qid, context): the passages of a question (qid, rank, source_file, page_number, text) in order, each under its label."""
    block = F.struct("rank", _labelled(F.col("source_file"), F.col("page_number"), F.col("text")).alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda s: s["b"]), SEPARATOR)
    return passages.groupBy("qid").agg(joined.alias("context"))


def build_sources(passages: DataFrame, names: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(qid, source_file, page_number, title): the distinct pages retrieved; given answers (qid, answer), only
    those an answer cites, none for one that refuses."""
    pages = passages.select("qid", "source_file", "page_number").distinct()
    if answers is not None:
        cited = answers.where(~replies.is_refusal(F.col("answer"))).select("qid", F.explode(replies.citations(F.col("answer"))).alias("c"))
        cited = cited.select("qid", F.col("c.file").alias("source_file"), F.col("c.page").alias("page_number"))
        pages = pages.join(cited, ["qid", "source_file", "page_number"], "left_semi")
    known = names.groupBy("source_file").agg(F.max("title").alias("title"))
    return pages.join(known, "source_file", "left").select("qid", "source_file", "page_number", titles.describe(F.col("title"), F.col("source_file")).alias("title"))


def extractive(question: Column, passages: Column) -> Column:
    """The offline generator: of all passages the sentence that holds most of the question's terms, cited; a
    refusal where even that holds fewer than half of them. Ties go to the better rank."""

    def best(asked: Column) -> Column:
        def scored(p: Column) -> Column:
            sentences = F.split(F.coalesce(p["text"], F.lit("")), r"(?<=[.!?])\s+")
            share = lambda s: F.try_divide(F.size(F.array_intersect(asked, T.analyse(s))).cast("double"), F.size(asked))
            return F.transform(sentences, lambda s: F.struct(share(s).alias("v"), (-p["rank"]).alias("r"), s.alias("s"), p["source_file"].alias("f"), p["page_number"].alias("p")))

        return F.array_max(F.flatten(F.transform(passages, scored)))

    def said(b: Column) -> Column:
        missing = F.lit("?")
        cite = F.concat(F.lit(" ["), F.coalesce(b["f"], missing), F.lit(", Seite "), F.coalesce(b["p"].cast("string"), missing), F.lit("]"))
        refuse = F.lit(replies.REFUSAL_TOKEN + " Der Kontext beantwortet die Frage nicht.")
        return F.when(b["v"] >= LEAST_OVERLAP, F.concat(b["s"], cite)).otherwise(refuse)

    # the question's terms and the best sentence are used several times and worked out once
    found = F.transform(F.array(F.array_distinct(T.analyse(question))), best)
    return F.get(F.transform(found, said), F.lit(0))


def answer(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, names: DataFrame, top_k: int = 5, generator: Callable[[Column, Column], Column] = extractive) -> DataFrame:
    """(qid, question, answer, abstained, sources): every question answered from its ``top_k`` passages.

    The generator is given the question and all its passages, an array of (rank, text, source_file, page_number)
    in order; ``context`` makes of it the text that a model is prompted with. Without passages a fixed sentence,
    as a refusal. A refusal has no sources, whatever its text cites.
    """
    passages = lexical.with_passages(ranked.where(F.col("rank") <= top_k), chunks)
    passages = cut(passages.select("qid", "rank", "text", "source_file", "page_number"), "retrieved")
    held = passages.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "source_file", "page_number"))).alias("passages"))
    raw = queries.select("qid", "question").join(held, "qid", "left")
    made = F.when(F.col("passages").isNotNull(), generator(F.col("question"), F.col("passages")))
    raw = cut(raw.select("qid", "question", made.alias("raw")), "replies")
    cited = build_sources(passages, names, raw.where("raw is not null").select("qid", F.col("raw").alias("answer")))
    order = F.struct(F.coalesce("source_file", F.lit("")).alias("f"), F.coalesce("page_number", F.lit(0)).alias("p"), F.struct("source_file", "page_number", "title").alias("s"))
    sources = cited.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(order)), lambda o: o["s"]).alias("sources"))
    refused = F.col("raw").isNull() | replies.is_refusal(F.col("raw"))
    none = F.array().cast("array<struct<source_file:string,page_number:int,title:string>>")
    return raw.join(sources, "qid", "left").select(
        "qid",
        "question",
        F.coalesce(replies.without_refusal(F.col("raw")), F.lit(replies.NO_PASSAGE)).alias("answer"),
        refused.alias("abstained"),
        F.when(refused, none).otherwise(F.coalesce("sources", none)).alias("sources"),
    )


#: What a chat model is told; the page is part of the passage's label, so that it can be cited.
PROMPT = (
    "Beantworte die Frage nur mit dem Kontext und belege jede Aussage mit [Datei, Seite N]. Steht die Antwort nicht darin, "
    "beginne mit " + replies.REFUSAL_TOKEN + ".\n\nKontext:\n{context}\n\nFrage: {question}"
)


def chat(complete: Callable[[list[str]], list[str]], prompts: Column, batch: int = 16) -> Column:
    """The replies of a chat model, a batch of prompts at a time: ``complete`` is any client, made to travel to the
    tasks. Null prompts have no reply."""

    @F.pandas_udf(T_.StringType())
    def replied(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            there = s.dropna()
            for at in range(0, len(there), batch):
                part = there.iloc[at : at + batch]
                out[part.index] = complete(part.tolist())
            yield out

    return replied(prompts)


def chat_generator(complete: Callable[[list[str]], list[str]], template: str = PROMPT, batch: int = 16) -> Callable[[Column, Column], Column]:
    """A generator of answers from a chat model."""
    return lambda question, passages: chat(complete, replies.prompt(template, context=context(passages), question=question), batch)


def render(index: int, row, retrieved: list | None = None) -> str:
    """One answer as text: question, answer, sources; with ``retrieved`` (source_file, page_number) pages, also those not used."""
    lines = [f"{index}. {row['question']}", "", row["answer"], ""]
    lines += [f"  - {s['title']}, Seite {s['page_number']}" for s in row["sources"]] or ["  (keine Quellen)"]
    used = {(s["source_file"], s["page_number"]) for s in row["sources"]}
    left = [p for p in dict.fromkeys((r["source_file"], r["page_number"]) for r in retrieved or []) if p not in used]
    if left:
        lines += ["  gefunden, nicht verwendet:"] + [f"  - {f}, Seite {'?' if p is None else p}" for f, p in left]
    return "\n".join(lines)
