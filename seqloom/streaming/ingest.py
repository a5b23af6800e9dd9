"""Decoding as a stream: files of frames become decoded sequences, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.sequences import silence_class
from seqloom.operators.tokens import run_tokens

FRAMES = T.StructType([T.StructField("rec", T.LongType()), T.StructField("t", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("cls", T.StringType())])
EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def decoded(frames: DataFrame) -> DataFrame:
    """One row a recording: its tokens as an array, kept where more than eight aren't silence."""
    tokens = run_tokens(frames)
    row = F.struct("start", "stop", "cls", F.col("cid").alias("id"))
    out = tokens.groupBy("rec").agg(F.array_sort(F.collect_list(row)).alias("sequence"))
    return out.filter(F.size(F.filter("sequence", lambda t: t["id"] > 0)) > 8)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, once: bool = True, files: int = 1):
    """Read frame files (Parquet) as they come, decode each batch and write it under its batch number.

    A batch that runs again replaces its own folder, so a restart neither loses
    nor repeats recordings; ``after`` (rebuilding an index, say) runs behind the
    data of each batch. ``once`` stops when all files that are there have been read.
    """
    frames = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        decoded(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if after:
            after(batch, number)

    writer = frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


#: What is carried from batch to batch for a recording: the open run, and the first frame that wasn't decoded.
_OPEN = "run long, cid long, cls string, start long, next long"
_RUNS = "rec long, run long, cid long, cls string, start long, stop long"


def _carry(key, parts, state):
    """Runs that a batch's frames end, begin or extend; the last one stays open."""
    import pandas as pd

    frames = pd.concat(list(parts)).sort_values("t").drop_duplicates("t")
    run, cid, cls, start, following = state.get if state.exists else (-1, None, None, 0, 0)
    frames = frames[frames.t >= following]
    if frames.empty:
        return
    ids = frames.cid.tolist()
    rows, t, names = [], frames.t.tolist(), frames.cls.tolist()
    for i, symbol in enumerate(ids):
        if run < 0 or symbol != cid:
            if run >= 0 and i:
                rows.append((run, cid, cls, start, t[i - 1] + 1))
            run, cid, cls, start = run + 1, symbol, names[i], t[i]
    rows.append((run, cid, cls, start, t[-1] + 1))
    state.update((run, cid, cls, start, t[-1] + 1))
    yield pd.DataFrame([(key[0], *r) for r in rows], columns=["rec", "run", "cid", "cls", "start", "stop"])


def ingest_carried(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True, files: int = 1):
    """Decode frame files (Parquet) as they come, each recording's frames in order, however they are cut over files.

    The run that is open at the end of a batch is kept as state of its recording and
    goes on in the next. A batch writes the runs that it touched, the open one as
    far as it is known, under its number, and replaces them if it runs again;
    :func:`carried_runs` takes the latest form of each. Frames behind the last one
    decoded were decoded before and are passed over.
    """
    frames = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files).parquet(source)
    runs = frames.groupBy("rec").applyInPandasWithState(_carry, _RUNS, _OPEN, "update", "NoTimeout")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
    writer = runs.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def carried_runs(spark: SparkSession, target: str, short: int = 35, middle: int = 80) -> DataFrame:
    """rec, run, cid, cls (silences by length), start and stop of every run that was decoded so far."""
    runs = spark.read.schema(_RUNS).parquet(f"{target}/batch=*")
    last = runs.groupBy("rec", "run").agg(F.max_by(F.struct("cid", "cls", "start", "stop"), "stop").alias("r")).select("rec", "run", "r.*")
    return last.withColumn("cls", F.when(F.col("cid") == 0, silence_class(F.col("stop") - F.col("start"), short, middle)).otherwise(F.col("cls")))


def event_windows(events: DataFrame, width: str = "60 seconds", slide: str | None = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts by event type in sliding or tumbling windows of event time, for a stream or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user's events: a pause longer than ``gap`` ends one."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
