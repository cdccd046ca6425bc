"""Incremental ingestion: new JSON-lines chunks flow into a collection, each micro-batch an idempotent upsert."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow.sources.collections import Collection


def upsert_stream(spark: SparkSession, folder: str, schema: str, collection: Collection, checkpoint: str, key_from: str = "chunk_id", once: bool = True) -> StreamingQuery:
    """Files that arrive under folder go into the collection, by key_from; later batches win. A batch that is run again after
    a failure writes the same rows, so nothing is doubled."""
    rows = spark.readStream.schema(schema).json(folder)

    def write(batch, number: int) -> None:
        named = batch.withColumn(collection.key, F.col(key_from)) if key_from != collection.key else batch
        collection.add(named.withColumn("version", F.lit(number).cast("long")))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
