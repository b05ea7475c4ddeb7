"""The gold set: usable passages, stratified sample, generated entries, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regelspur.functions import replies
from regelspur.functions import text as T
from regelspur.operators import answers
from regelspur.session import cut

LEAST_CHARS, LEAST_LETTERS = 300, 0.55
#: Strata whose rows carry a salt of so many values before they are ranked, so that no task sorts a large one whole.
SALTS = 32


def is_usable(kind: Column, text: Column, least: int = LEAST_CHARS) -> Column:
    """Text or table, long enough, without dot leaders, mostly letters. Null texts are not usable."""
    share = T.letters(text) / F.nullif(F.length(text), F.lit(0))
    return F.coalesce(kind.isin("NarrativeText", "Table") & (F.length(text) >= least) & ~text.rlike(T.LEADERS) & (share > LEAST_LETTERS), F.lit(False))


def exclude_used(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """The passages no gold entry is made from."""
    return chunks.join(gold.select("chunk_id").distinct(), "chunk_id", "left_anti")


def stratified_sample(chunks: DataFrame, per_stratum: int = 5, seed: int = 42, stratum: str = "source_file", key: str = "chunk_id") -> DataFrame:
    """Up to ``per_stratum`` rows of every stratum, by the order of a seeded hash of the key.

    The same rows whatever the partitioning. Ranked first in salted parts of a stratum, of which each
    keeps ``per_stratum``, then over what is left, so a hot stratum is never sorted in one task.
    """
    draw = chunks.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)))).withColumn("_salt", F.pmod(F.crc32("_h"), F.lit(SALTS)))
    order = ["_h", key, *(["position"] if "position" in chunks.columns else [])]
    part = draw.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_salt").orderBy(*order))).where(F.col("_r") <= per_stratum)
    whole = part.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_r") <= per_stratum)
    return whole.drop("_h", "_salt", "_r")


def problem(colloquial: Column, precise: Column, snippet: Column, text: Column) -> Column:
    """Why an entry must be discarded, the first reason that applies; null if it is sound."""
    words = F.size(F.filter(F.split(snippet, T.WS + "+"), lambda w: w != ""))
    blank = [F.coalesce(c, F.lit("")) == "" for c in (colloquial, precise, snippet)]
    inside = F.contains(T.normalise(F.coalesce(text, F.lit(""))), T.normalise(snippet))
    return (
        F.when(blank[0] | blank[1], "missing question")
        .when(blank[2], "missing snippet")
        .when(words < 4, "snippet too short to be evidence")
        .when(~inside, "snippet not found verbatim in the chunk")
        .when(colloquial == precise, "both questions are identical")
    )


def number_entries(entries: DataFrame, existing: int, order: list[str]) -> DataFrame:
    """``entries`` with ids ``gold-001`` onwards after the number ``existing``.

    Numbered by parts: each range partition, written with its number, counts its own, and the small table of
    counts gives the offsets.
    """
    parted = cut(entries.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()), "entries")
    counts = parted.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = counts.select("_p", before.alias("_o"))
    numbered = parted.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(offsets), "_p")
    return numbered.withColumn("id", F.format_string("gold-%03d", F.lit(existing) + F.col("_o") + F.col("_n"))).drop("_p", "_n", "_o")


PROMPT = (
    "Stelle zwei Fragen zu diesem Auszug aus {source_file} und zitiere die Antwort wörtlich. Gib nur ein JSON-Objekt "
    "mit question_colloquial, question_precise und answer_snippet zurück.\n\n{text}"
)


def template_reply(text: Column, source: Column) -> Column:
    """An offline stand-in for the model: questions from the passage's longest term, a snippet of eight words."""
    terms = T.analyse(text)
    longest = F.element_at(F.array_sort(F.transform(terms, lambda t: F.struct(-F.length(t), t.alias("t")))), 1)["t"]
    words = F.split(T.strip(text), T.WS + "+")
    snippet = F.array_join(F.slice(words, 1, 8), " ")
    return F.to_json(
        F.struct(
            F.concat(F.lit("Was gilt eigentlich für "), longest, F.lit("?")).alias("question_colloquial"),
            F.concat(F.lit("Welche Anforderung gilt für "), longest, F.lit("?")).alias("question_precise"),
            snippet.alias("answer_snippet"),
        )
    )


def chat_generator(complete: Callable[[list[str]], list[str]], template: str = PROMPT, batch: int = 16) -> Callable[[Column, Column], Column]:
    """A generator of entries from a chat model, a batch of prompts at a time."""
    return lambda text, source: answers.chat(complete, replies.prompt(template, source_file=source, text=text), batch)


def generate_entries(chunks: DataFrame, generator: Callable[[Column, Column], Column] = template_reply) -> DataFrame:
    """(chunk columns, questions, snippet, problem): a reply a passage, parsed and validated; unreadable replies are rejected."""
    parsed = replies.json_object(generator(F.col("text"), F.col("source_file")))
    out = chunks.withColumn("_p", parsed)
    for name in ("question_colloquial", "question_precise", "answer_snippet"):
        out = out.withColumn(name, replies.json_field(F.col("_p"), name))
    bad = F.when(F.col("_p").isNull(), "reply is no JSON object").otherwise(problem(F.col("question_colloquial"), F.col("question_precise"), F.col("answer_snippet"), F.col("text")))
    return out.withColumn("problem", bad).drop("_p")


def new_entries(chunks: DataFrame, existing: DataFrame | None = None, per_document: int = 5, seed: int = 42, generator: Callable[[Column, Column], Column] = template_reply) -> DataFrame:
    """Usable passages that no entry uses yet, sampled, asked about, validated; numbered after the largest number in use."""
    usable = chunks.where(is_usable(F.col("type"), F.col("text")))
    last = 0
    if existing is not None:
        usable = exclude_used(usable, existing)
        last = existing.agg(F.max(F.try_to_number(F.regexp_extract("id", "([0-9]{1,18})$", 1), F.lit("9" * 18)).cast("long")).alias("n")).first()["n"] or 0
    made = generate_entries(stratified_sample(usable, per_document, seed), generator).where("problem is null")
    new = number_entries(made.withColumn("_page", F.coalesce("page_number", F.lit(0))), last, ["source_file", "_page", "chunk_id"])
    columns = ["id", "chunk_id", "source_file", "page_number", F.col("type").alias("chunk_type"), "question_colloquial", "question_precise", "answer_snippet"]
    return new.select(*columns)


def build_goldset(chunks: DataFrame, existing: DataFrame | None = None, per_document: int = 5, seed: int = 42, generator: Callable[[Column, Column], Column] = template_reply) -> DataFrame:
    """The existing entries, and the new ones behind them."""
    new = new_entries(chunks, existing, per_document, seed, generator)
    return existing.select(new.columns).unionByName(new) if existing is not None else new
