"""Documents to blocks (source_file, elem_idx, type, text, page_number).

Extraction is pluggable: an extractor takes a file's bytes and yields blocks with their rectangles;
``extractors`` has those of text, markdown and HTML. What is found in tables is not repeated as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regelspur.functions import text as T
from regelspur.functions import titles
from regelspur.sources import extractors

#: (page, type, text, x0, y0, x1, y1); tables come as markdown text.
Block = tuple[int, str, str, float, float, float, float]
Extractor = Callable[[bytes], Iterator[Block]]
RAW = "source_file string, elem_idx int, type string, text string, page_number int, x0 double, y0 double, x1 double, y1 double"


def scan_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, source_file, content) of all files below a folder, hidden ones left out; none at all is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", name.alias("source_file"), "content").where(~name.startswith("."))
    if not found.select("path").limit(1).count():
        raise FileNotFoundError(f"no {pattern} below {path}")
    return found


def extract(files: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """Every block of every file, in reading order, with its rectangle; without an extractor by the file's ending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["source_file"], pdf["content"]):
                rows = [(name, i, kind, text, page, *box) for i, (page, kind, text, *box) in enumerate(extractor(content) if extractor else extractors.of_file(name, content))]
                if rows:
                    yield pd.DataFrame(rows, columns=["source_file", "elem_idx", "type", "text", "page_number", "x0", "y0", "x1", "y1"])

    return files.select("source_file", "content").mapInPandas(run, RAW)


def file_titles(files: DataFrame, lines: int = 10) -> DataFrame:
    """(path, source_file, title): the best title of each file: its own, else its first lines', else its name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, name, content in zip(pdf["path"], pdf["source_file"], pdf["content"]):
                first = [x for _, kind, text, *_ in extractors.of_file(name, content) if kind != "Table" for x in text.split("\n")][:lines]
                rows.append((path, name, extractors.title_of(name, content), first))
            yield pd.DataFrame(rows, columns=["path", "source_file", "raw", "first"])

    read = files.select("path", "source_file", "content").mapInPandas(run, "path string, source_file string, raw string, first array<string>")
    stem = F.regexp_replace("source_file", F.lit(r"\.[^.]*$"), F.lit(""))
    return read.select("path", "source_file", titles.read_title(F.col("raw"), F.col("first"), stem).alias("title"))


def without_overlap(blocks: DataFrame) -> DataFrame:
    """Text blocks that no table of their page overlaps, and all tables, also ones discarded later."""
    is_table = F.col("type") == "Table"
    tables = blocks.where(is_table).alias("t")
    b = blocks.alias("b")
    same = (F.col("b.source_file") == F.col("t.source_file")) & (F.col("b.page_number") == F.col("t.page_number")) & (F.col("b.type") != "Table")
    over = (F.col("b.x0") < F.col("t.x1")) & (F.col("b.x1") > F.col("t.x0")) & (F.col("b.y0") < F.col("t.y1")) & (F.col("b.y1") > F.col("t.y0"))
    return b.join(tables, same & over, "left_anti")


def accept(elements: DataFrame, drop_boilerplate: bool = True) -> DataFrame:
    """Cleaned blocks that are not empty and, unless asked to keep it, no boilerplate."""
    others = [c for c in elements.columns if c != "text"]
    cleaned = elements.where("text is not null").select(*others, T.once(T.clean(F.col("text"))).alias("text")).select(elements.columns).where(F.length("text") > 0)
    return cleaned.where(~T.is_boilerplate(F.col("text"), F.col("type"))) if drop_boilerplate else cleaned


def split_types(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text blocks, tables)."""
    return elements.where("type = 'NarrativeText'"), elements.where("type = 'Table'")


def documents(elements: DataFrame) -> DataFrame:
    """(source_file, content): the blocks of a document joined by blank lines."""
    blocks = F.array_sort(F.collect_list(F.struct("elem_idx", "text")))
    return elements.groupBy("source_file").agg(F.array_join(F.transform(blocks, lambda s: s["text"]), "\n\n").alias("content"))


def from_text_table(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks_per_page: int = 4) -> DataFrame:
    """Blocks of a table of plain texts: what blank lines separate, so many to a page; ``doc-<key>`` is the file."""
    parts = F.posexplode(F.split(text, r"\n[ \t\r]*\n")).alias("elem_idx", "text")
    rows = docs.where(F.col(text).isNotNull()).select(F.concat(F.lit("doc-"), F.col(key).cast("string")).alias("source_file"), parts)
    page = (F.floor(F.col("elem_idx") / blocks_per_page) + 1).cast("int")
    return rows.select("source_file", "elem_idx", F.lit("NarrativeText").alias("type"), "text", page.alias("page_number"))
