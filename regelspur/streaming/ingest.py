"""Incremental ingest: new blocks arrive as files, passages and vectors are upserted batch by batch.

Passage ids come from content, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from regelspur import schemas
from regelspur.operators import chunking, dense
from regelspur.sources import elements as E
from regelspur.sources.store import VectorStore


def ingest(spark: SparkSession, folder: str, store: VectorStore, embedder: dense.Embedder, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Read Parquet files of blocks from ``folder`` as they come. A file holds whole documents."""
    blocks = spark.readStream.schema(schemas.ELEMENTS).option("maxFilesPerTrigger", 64).parquet(folder)

    def upsert(batch: DataFrame, _: int) -> None:
        chunks = chunking.build_chunks(E.accept(batch))
        store.upsert(dense.embed(chunks, "text", embedder))

    writer = blocks.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
