"""Blocks of documents to passages: two numeric folds and the assembly of texts.

The folds run over the sorted blocks of a document as they stream by, in Arrow batches. Texts are
never split. Null texts count as empty and are left out; an empty table gives no passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regelspur.functions import text as T
from regelspur.session import cut, fits

MOST_TOKENS, LEAST_CHARS = 600, 300
#: Repeated keys up to which they are broadcast to all rows.
FEW_REPEATED = 500_000


class Fold:
    """The chunk number of each block of a document, one after the other.

    A block opens a new chunk if the buffer holds some and would exceed ``most`` tokens with it, or if
    it is a heading and the buffer has ``least`` characters; a buffer beyond ``most`` closes behind it.
    """

    def __init__(self, most: int = MOST_TOKENS, least: int = LEAST_CHARS):
        self.most, self.least = most, least
        self.no = self.held = self.tokens = self.chars = 0

    def number(self, tokens: int, chars: int, heading: bool) -> int:
        if self.held and (self.tokens + tokens > self.most or heading and self.chars >= self.least):
            self.no, self.held, self.tokens, self.chars = self.no + 1, 0, 0, 0
        mine = self.no
        self.held, self.tokens, self.chars = self.held + 1, self.tokens + tokens, self.chars + chars
        if self.tokens > self.most:
            self.no, self.held, self.tokens, self.chars = self.no + 1, 0, 0, 0
        return mine


class Merge:
    """The group of each chunk of a document: what is shorter than ``least`` waits and is put in front of the
    next; a rest at the end joins the last group, or stands alone. Waiting chunks are numbered when that is settled."""

    def __init__(self, least: int = LEAST_CHARS):
        self.least, self.group, self.chars, self.waiting = least, 0, 0, 0

    def add(self, chars: int) -> list[int]:
        """The numbers of the chunks that are settled now: none, or those that waited and this one."""
        self.chars += chars + (2 if self.waiting else 0)
        self.waiting += 1
        if self.chars < self.least:
            return []
        done = [self.group] * self.waiting
        self.group, self.chars, self.waiting = self.group + 1, 0, 0
        return done

    def end(self) -> list[int]:
        return [max(0, self.group - 1)] * self.waiting


def _numbered(rows: DataFrame, order: str, name: str, fold: Callable[[], Callable[[tuple | None], list[int]]], columns: list[str]) -> DataFrame:
    """``rows`` with the number that a fold over the rows of each document in their order gives them.

    Documents lie sorted in their partitions and stream through, so the cost is that of the rows however
    long a document is; only rows that the fold has not numbered yet are held.
    """
    schema = T.types(rows) + f", {name} int"
    at = [rows.columns.index(c) for c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, source, held = None, None, None
        for pdf in batches:
            if held is not None and len(held):
                pdf = pd.concat([held, pdf], ignore_index=True)
            old = 0 if held is None else len(held)
            numbers: list[int] = []
            files = pdf["source_file"].tolist()
            values = list(zip(*(pdf.iloc[:, k].tolist() for k in at)))
            for k in range(old, len(pdf)):
                if step is None or files[k] != source:
                    if step is not None:
                        numbers += step(None)
                    step, source = fold(), files[k]
                numbers += step(values[k])
            done = pdf.iloc[: len(numbers)].copy()
            held = pdf.iloc[len(numbers) :]
            if len(done):
                done[name] = numbers
                yield done
        if held is not None and len(held):
            yield held.assign(**{name: step(None)})

    return rows.repartition("source_file").sortWithinPartitions("source_file", order).mapInPandas(run, schema)


def _assign() -> Callable[[tuple | None], list[int]]:
    fold = Fold()
    return lambda v: [] if v is None else [fold.number(*v)]


def _merge() -> Callable[[tuple | None], list[int]]:
    merge = Merge()
    return lambda v: merge.end() if v is None else merge.add(*v)


def assign_chunks(elements: DataFrame) -> DataFrame:
    """(source_file, elem_idx, chunk_no, text, page_number) of the narrative blocks."""
    text = F.col("text")
    sized = elements.where("type = 'NarrativeText' AND length(text) > 0").select(
        "source_file", "elem_idx", "text", "page_number", T.token_estimate(text).cast("int").alias("tk"), F.length(text).alias("ch"), T.is_heading(text).alias("hd")
    )
    return _numbered(sized, "elem_idx", "chunk_no", _assign, ["tk", "ch", "hd"]).select("source_file", "elem_idx", "chunk_no", "text", "page_number")


def _joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Texts joined by blank lines in order, with the first page there is (0 counts as none) and the last."""
    page = F.nullif(F.col("page_number"), F.lit(0))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col("text").alias("t"))))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(sorted_, lambda s: s["t"]), "\n\n").alias("text"),
        F.min_by(page, F.when(page.isNotNull(), F.col(order))).alias("page_number"),
        F.max(F.coalesce(F.col("page_end") if "page_end" in rows.columns else page, page)).alias("page_end"),
    )


def fold_chunks(elements: DataFrame) -> DataFrame:
    """(source_file, chunk_no, text, page_number, page_end): blocks folded into chunks, before merging."""
    return _joined(assign_chunks(elements), ["source_file", "chunk_no"], "elem_idx")


def merge_groups(chunks: DataFrame) -> DataFrame:
    """(source_file, chunk_no, group_no, text, ...): to which merged chunk each belongs."""
    sized = chunks.select("source_file", "chunk_no", "text", "page_number", "page_end", F.length("text").alias("ch"))
    return _numbered(sized, "chunk_no", "group_no", _merge, ["ch"]).select("source_file", "chunk_no", "group_no", "text", "page_number", "page_end")


def merge_short(chunks: DataFrame) -> DataFrame:
    """(source_file, chunk_no, text, page_number, page_end): short chunks merged forward; the earlier page stays."""
    return _joined(merge_groups(chunks), ["source_file", "group_no"], "chunk_no").withColumnRenamed("group_no", "chunk_no")


def build_chunks(elements: DataFrame) -> DataFrame:
    """(source_file, seq, type, text, page_number, page_end, chunk_id): text passages, then one a table."""
    text = merge_short(fold_chunks(elements)).select(
        "source_file", F.lit(0).alias("part"), F.col("chunk_no").alias("seq"), F.lit("NarrativeText").alias("type"), "text", "page_number", "page_end"
    )
    tables = elements.where("type = 'Table' AND length(text) > 0").select(
        "source_file", F.lit(1).alias("part"), F.col("elem_idx").alias("seq"), "type", "text", "page_number", F.col("page_number").alias("page_end")
    )
    return text.unionByName(tables).withColumn("chunk_id", T.chunk_id(F.col("source_file"), F.col("page_number"), F.col("type"), F.col("text")))


def dedupe_first(chunks: DataFrame, key: str = "chunk_id", order: str = "position") -> DataFrame:
    """The first row of every key; rows without a key are kept, each for itself."""
    first = F.row_number().over(Window.partitionBy(F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.col(order).cast("string")))).orderBy(order))
    return chunks.withColumn("_first", first).where("_first = 1").drop("_first")


def first_of_each(chunks: DataFrame, key: str = "chunk_id", order: str = "position") -> DataFrame:
    """What ``dedupe_first`` gives, without a shuffle of all texts: where few keys are repeated, only rows of those (and
    rows without a key) are compared. Beyond ``FEW_REPEATED`` such keys it is ``dedupe_first``."""
    repeated = cut(chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    if not fits(repeated, FEW_REPEATED):
        return dedupe_first(chunks, key, order)
    marked = chunks.join(F.broadcast(repeated.withColumn("_repeated", F.lit(True))), key, "left").select(*chunks.columns, "_repeated")
    open_ = F.col("_repeated").isNotNull() | F.col(key).isNull()
    return marked.where(~open_).drop("_repeated").unionByName(dedupe_first(marked.where(open_).drop("_repeated"), key, order))


def index_report(chunks: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """A row a document and one for all (source_file null): passages, tables, median tokens of text passages, share at the cap."""
    sized = chunks.select("source_file", "type", T.token_estimate(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"))
    narrative = F.col("type") == "NarrativeText"
    return sized.rollup("source_file").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("type") == "Table").alias("tables"),
        F.round(F.coalesce(F.median(F.when(narrative, F.col("tokens"))), F.lit(0.0)), 6).alias("median_tokens"),
        F.round(F.try_divide(F.lit(100.0) * F.count_if(F.col("tokens") >= 0.9 * most), F.count(F.lit(1))), 6).alias("at_cap_percent"),
        F.grouping("source_file").cast("int").alias("total"),
    )
