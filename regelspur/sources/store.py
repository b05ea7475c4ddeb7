"""The vector store: a Parquet table keyed by passage id, in parts, with the metric recorded beside it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regelspur import schemas
from regelspur.operators.chunking import dedupe_first
from regelspur.session import cut


def upserted(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of ``existing`` that ``new`` does not replace, and ``new``. Rows are never deleted."""
    return existing.join(new.select(key), key, "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


#: Parts of a store, by a hash of the id; an upsert rewrites only those it touches.
PARTS = 64


class VectorStore:
    """A table in parts, each in versions; a manifest names the version of each part that counts.

    The manifest is written beside the old one and moved over it, so readers see all of an upsert or nothing.
    Files that neither the manifest nor the one before it names are deleted by the next upsert, so a reader that began
    before one can end. Ids come from content, so writing the same passages again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine", parts: int = PARTS):
        self.spark, self.path = spark, path
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(sc._jsc.hadoopConfiguration())
        made = json.loads(self._get("store") or "null")
        if made is None:
            made = {"metric": metric, "parts": parts}
            self._put("store", json.dumps(made))
        elif made["metric"] != metric:
            raise ValueError(f"the store at {path} was made for {made['metric']}, not {metric}")
        self.metric, self.parts = made["metric"], made["parts"]

    def _get(self, name: str) -> str | None:
        at = self._path(f"{self.path}/_{name}")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, value: str) -> None:
        """Write beside the file of that name and move over it; where moving over is refused, the old one goes first."""
        new, at = self._path(f"{self.path}/_{name}-{uuid.uuid4().hex}"), self._path(f"{self.path}/_{name}")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(value.encode()))
        finally:
            stream.close()
        if not self.fs.rename(new, at):
            self.fs.delete(at, False)
            self.fs.rename(new, at)

    def _manifest(self) -> dict:
        """versions: of each part the folder that counts; before: those that the manifest before this one named."""
        return json.loads(self._get("manifest") or '{"versions": {}, "before": []}')

    def _part(self) -> Column:
        return F.pmod(F.crc32(F.col("chunk_id").cast("string")), F.lit(self.parts)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schemas.CHUNK_VECTORS)
        return self.spark.read.schema(schemas.CHUNK_VECTORS).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        return self._read(sorted(self._manifest()["versions"].values()))

    def upsert(self, new: DataFrame, order: str = "chunk_id") -> None:
        """Insert or replace by passage id; the first of repeated ids counts, an empty table changes nothing."""
        first = dedupe_first(new, "chunk_id", order).select("chunk_id", "embedding", "type", "page_number", "source_file")
        first = cut(first, "upsert")
        touched = [str(r[0]) for r in first.select(self._part().alias("p")).distinct().collect()]  # at most so many as there are parts
        if not touched:
            return
        held = self._manifest()
        version = f"v-{uuid.uuid4().hex}"
        old = self._read([held["versions"][p] for p in touched if p in held["versions"]])
        upserted(old, first).withColumn("part", self._part()).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{version}")
        versions = held["versions"] | {p: f"{version}/part={p}" for p in touched}
        self._put("manifest", json.dumps({"versions": versions, "before": sorted(set(held["versions"].values()))}))
        for folder in set(held["before"]) - set(held["versions"].values()) - set(versions.values()):
            self.fs.delete(self._path(f"{self.path}/{folder}"), True)

    def reset(self) -> None:
        """Delete everything in the store."""
        self.fs.delete(self._path(self.path), True)
        self._put("store", json.dumps({"metric": self.metric, "parts": self.parts}))
