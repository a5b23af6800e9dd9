"""A queue of recordings and control messages as an append-only table, drained as a stream with stored offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an entry asks for.
FILE, REINDEX = "file", "reindex"
ENTRIES = "kind string, item string"


def enqueue(spark: SparkSession, queue: str, items: DataFrame | None = None, reindex: bool = False) -> None:
    """Appends a set of items (item) as one file, and a rebuild that comes behind all of them."""
    entries = spark.createDataFrame([(REINDEX, None)] if reindex else [], ENTRIES)
    if items is not None:
        entries = items.select(F.lit(FILE).alias("kind"), F.col("item").cast("string").alias("item")).unionByName(entries)
    entries.coalesce(1).write.mode("append").parquet(queue)


def drain(spark: SparkSession, queue: str, checkpoint: str, work: Callable[[DataFrame, int], None], reindex: Callable[[int], None] | None = None, once: bool = True, sets: int = 1):
    """Takes ``sets`` sets at a time, in the order of their arrival: ``work(items, number)`` first, then ``reindex(number)`` if one of them asks for it.

    The offset is stored when both have returned. What was killed before comes again
    under the same number, so ``work`` and ``reindex`` should replace what they
    wrote under it; then nothing is lost and nothing done twice.
    """
    entries = spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", sets).parquet(queue)

    def take(batch: DataFrame, number: int) -> None:
        work(batch.filter(F.col("kind") == FILE).select("item"), number)
        if reindex and not batch.filter(F.col("kind") == REINDEX).isEmpty():
            reindex(number)

    writer = entries.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
