"""Command line: build-index, titles, goldset, eval, compare, ask."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regelspur.config import CONFIGS, get_config
from regelspur.operators import answers, chunking, compare, dense, evaluation, goldset, lexical, retrievers
from regelspur.session import cut, local_session, ship
from regelspur.sources import elements as E
from regelspur.sources import tables
from regelspur.sources.store import VectorStore


def build_index(spark: SparkSession, documents: str, out: str, reset: bool = False, pattern: str = "") -> DataFrame:
    """Texts (Parquet: doc_id, text), or with ``pattern`` files below a folder, to passages and vectors below ``out``;
    no documents at all is an error."""
    if pattern:
        raw = E.without_overlap(cut(E.extract(E.scan_files(spark, documents, pattern)), "blocks"))
        blocks = E.accept(raw.select("source_file", "elem_idx", "type", "text", "page_number"))
    else:
        blocks = E.accept(E.from_text_table(spark.read.parquet(documents)))
    if not blocks.limit(1).count():
        raise FileNotFoundError(f"no documents in {documents}")
    chunks = chunking.build_chunks(blocks).withColumn("position", F.xxhash64("source_file", "part", "seq"))
    tables.write_chunks(chunks, f"{out}/chunks")
    written = spark.read.parquet(f"{out}/chunks")
    store = VectorStore(spark, f"{out}/vectors")
    if reset:
        store.reset()
    store.upsert(dense.embed(written, "text", dense.HashingEmbedder()), "position")
    return chunking.index_report(written)


def _chunks(spark: SparkSession, index: str) -> DataFrame:
    return chunking.dedupe_first(spark.read.parquet(f"{index}/chunks").where("NOT (type <=> 'Image')"))


def _names(spark: SparkSession, index: str, path: str) -> DataFrame:
    """The title map given, else the one beside the index, else none."""
    return tables.read_titles(spark, path or f"{index}/titles")


def _ask(retriever, chunks: DataFrame, names: DataFrame, questions: list[str]) -> str:
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(questions, 1)], "qid string, question string")
    ranked = cut(retriever.retrieve(asked, 5), "ranked")
    pages: dict[str, list] = {}
    for r in lexical.with_passages(ranked, chunks).select("qid", "rank", "source_file", "page_number").orderBy("rank").collect():  # five a question
        pages.setdefault(r["qid"], []).append(r)
    rows = sorted(answers.answer(asked, ranked, chunks, names).collect(), key=lambda r: int(r["qid"]))
    return "\n\n".join(answers.render(int(r["qid"]), r, pages.get(r["qid"])) for r in rows)


def _retriever(spark: SparkSession, index: str, name: str):
    chunks = _chunks(spark, index)
    return retrievers.build_retriever(get_config(name), chunks, VectorStore(spark, f"{index}/vectors").read(), dense.HashingEmbedder()), chunks


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="regelspur", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build-index")
    p.add_argument("documents"), p.add_argument("out"), p.add_argument("--reset", action="store_true"), p.add_argument("--files", default="", help="a pattern: extract the files below the folder")
    p = sub.add_parser("titles")
    p.add_argument("folder"), p.add_argument("out"), p.add_argument("--files", default="*")
    p = sub.add_parser("goldset")
    p.add_argument("index"), p.add_argument("out"), p.add_argument("--per-document", type=int, default=5), p.add_argument("--seed", type=int, default=42), p.add_argument("--extend")
    p = sub.add_parser("eval")
    p.add_argument("index"), p.add_argument("goldset"), p.add_argument("results"), p.add_argument("--config", default="hybrid_rerank", choices=sorted(CONFIGS))
    p.add_argument("--unanswerable", default=""), p.add_argument("--timed", type=int, default=20)
    p = sub.add_parser("compare")
    p.add_argument("results"), p.add_argument("before"), p.add_argument("after")
    p = sub.add_parser("ask")
    p.add_argument("index"), p.add_argument("question", nargs="*"), p.add_argument("--config", default="hybrid_rerank", choices=sorted(CONFIGS)), p.add_argument("--titles", default=""), p.add_argument("--out")
    a = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    ship(spark)
    if a.command == "build-index":
        print(evaluation.markdown(build_index(spark, a.documents, a.out, a.reset, a.files)))
    elif a.command == "titles":
        tables.build_titles(E.file_titles(E.scan_files(spark, a.folder, a.files))).write.mode("overwrite").parquet(a.out)
    elif a.command == "goldset":
        old = tables.read_goldset(spark, a.extend) if a.extend else None
        chunks = _chunks(spark, a.index)
        goldset.build_goldset(chunks, old, a.per_document, a.seed).write.mode("overwrite").parquet(a.out)
    elif a.command == "eval":
        retriever, chunks = _retriever(spark, a.index, a.config)
        found = evaluation.evaluate(retriever, tables.read_goldset(spark, a.goldset), chunks, get_config(a.config), a.timed)
        tables.write_results(found["per_question"], a.results)
        print(evaluation.markdown(found["metrics"]), f"\n{found['seconds_per_question']:.3f} s a question (batch time divided), median {found['median_latency']:.3f} s asked one by one")
        rows = tables.read_unanswerable(spark, a.unanswerable) if a.unanswerable else None
        if rows is not None:
            done = cut(evaluation.abstention_run(retriever, rows, chunks, _names(spark, a.index, "")), "abstention")
            print(evaluation.markdown(evaluation.abstention(done)))
            print(evaluation.markdown(evaluation.answered_anyway(done)))
    elif a.command == "compare":
        log = tables.read_results(spark, a.results, a.before).unionByName(tables.read_results(spark, a.results, a.after))
        print(evaluation.markdown(compare.mcnemar(log, a.before, a.after)))
    else:
        retriever, chunks = _retriever(spark, a.index, a.config)
        names = _names(spark, a.index, a.titles)
        if a.question:
            text = _ask(retriever, chunks, names, a.question)
            print(text)
            if a.out:
                tables.write_report(text, a.out)
        else:  # one question a line until an empty one
            while question := _line():
                print(_ask(retriever, chunks, names, [question]))


def _line() -> str:
    try:
        return input("Frage: ").strip()
    except EOFError:
        return ""


if __name__ == "__main__":
    main()
