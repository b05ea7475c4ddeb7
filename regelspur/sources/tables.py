"""Readers and writers of the engine's tables: JSON at the edges, Parquet inside."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regelspur import schemas


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table from Parquet or, by its ending, JSON (an array or lines)."""
    if not _there(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema)
    return reader.option("multiLine", "true").json(path) if path.endswith(".json") else reader.json(path) if path.endswith((".jsonl", ".ndjson")) else reader.parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The passages without their embeddings, as JSON lines or Parquet by the ending; repeated ids stay."""
    out = chunks.drop("embedding")
    (out.write.mode("overwrite").json if path.endswith((".jsonl", ".ndjson")) else out.write.mode("overwrite").parquet)(path)


def read_chunks(spark: SparkSession, path: str, images: bool = False) -> DataFrame:
    """The passages; images are left out, passages of unknown type stay."""
    found = _read(spark, path, schemas.CHUNKS)
    return found if images else found.where("NOT (type <=> 'Image')")


def read_goldset(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.GOLDSET)


def read_unanswerable(spark: SparkSession, path: str) -> DataFrame | None:
    """The unanswerable questions, or None if there is no such table."""
    return _read(spark, path, schemas.UNANSWERABLE) if _there(spark, path) else None


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """The titles; no table reads as an empty one, for every reader falls back to the file's name."""
    return _read(spark, path, schemas.TITLES) if _there(spark, path) else spark.createDataFrame([], schemas.TITLES)


def build_titles(titles: DataFrame, path_column: str = "path") -> DataFrame:
    """One title a file name; of files of one name in several folders the last path wins."""
    name = F.element_at(F.split(path_column, "/"), -1)
    return titles.groupBy(name.alias("source_file")).agg(F.max_by("title", path_column).alias("title"))


def write_results(log: DataFrame, path: str) -> None:
    """The log of each config in its own partition, replaced as a whole."""
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config").parquet(path)


def read_results(spark: SparkSession, path: str, config: str) -> DataFrame:
    """The log of one config; none is an error."""
    found = spark.read.schema(schemas.PER_QUESTION).parquet(path).where(F.col("config") == config)
    if not found.limit(1).count():
        raise FileNotFoundError(f"no results of {config} in {path}")
    return found


def write_report(text: str, path: str) -> None:
    """A rendered report as a local text file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
