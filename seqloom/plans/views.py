"""What the driver tables stand for: frames, tokens, sequences and series, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.prefix import number_in
from seqloom.operators.tokens import run_tokens

#: Frames that a silence may have to be short or of middle length; runs of events are short.
SHORT, MIDDLE = 2, 3
#: Days of events in one sequence.
DAYS = 3
#: Searches take the rows whose id is a multiple of this as queries.
QUERIES = 50

CLASSES = {"error": (0, "_"), "click": (1, "Ea"), "view": (2, "Bb"), "purchase": (3, "Ua"), "signup": (4, "Da")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column, values: dict, kind: str):
    out = F.lit(None).cast(kind)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v).cast(kind)).otherwise(out)
    return out


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec (user), t (frame from 0), cid, cls, value."""
    e = number_in(table(spark, sf_dir, "events").withColumnRenamed("user_id", "rec"), "rec", F.to_date("ts"), ["ts", "event_id"], "t")
    kind = F.col("event_type")
    return e.select("rec", F.col("t").cast("long").alias("t"), _case(kind, {k: v[0] for k, v in CLASSES.items()}, "long").alias("cid"), _case(kind, {k: v[1] for k, v in CLASSES.items()}, "string").alias("cls"), "value")


FRAMES = """frames AS (
  SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value,
         CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 END AS cid,
         CASE event_type WHEN 'error' THEN '_' WHEN 'click' THEN 'Ea' WHEN 'view' THEN 'Bb' WHEN 'purchase' THEN 'Ua' WHEN 'signup' THEN 'Da' END AS cls
  FROM events)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_tokens(frames(spark, sf_dir).select("rec", "t", "cid", "cls"), short=SHORT, middle=MIDDLE)


TOKENS = (
    FRAMES
    + """,
turns AS (SELECT *, CASE WHEN cid IS NOT DISTINCT FROM lag(cid) OVER (PARTITION BY rec ORDER BY t) AND t > 0 THEN 0 ELSE 1 END AS turn FROM frames),
runs AS (SELECT *, sum(turn) OVER (PARTITION BY rec ORDER BY t) - 1 AS run FROM turns),
tokens AS (
  SELECT rec, CAST(run AS BIGINT) AS run, CAST(any_value(cid) AS BIGINT) AS cid, CAST(min(t) AS BIGINT) AS start, CAST(max(t) + 1 AS BIGINT) AS stop,
         CASE WHEN any_value(cid) = 0 THEN CASE WHEN count(*) < 2 THEN '_' WHEN count(*) < 3 THEN '__' ELSE '___' END ELSE any_value(cls) END AS cls
  FROM runs GROUP BY rec, run)"""
)


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search corpus: a sequence of event types for each user and DAYS days; seq_id, symbols, encounter (user), start, stop (epoch seconds)."""
    e = table(spark, sf_dir, "events")
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    bucket = F.floor(second / (86_400 * DAYS)).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    g = e.withColumn("second", second).groupBy("user_id", bucket.alias("bucket")).agg(listed.alias("l"), F.min("second").alias("start"), F.max("second").alias("stop"))
    return g.select((F.col("user_id") * 100_003 + F.col("bucket")).alias("seq_id"), F.col("l.event_type").alias("symbols"), F.col("user_id").alias("encounter"), "start", "stop")


SEQUENCES = """sequences AS (
  SELECT user_id * 100003 + CAST(floor(epoch(ts) / 259200) AS BIGINT) AS seq_id, list(event_type ORDER BY ts, event_id) AS symbols,
         user_id AS encounter, CAST(min(floor(epoch(ts))) AS BIGINT) AS start, CAST(max(floor(epoch(ts))) AS BIGINT) AS stop
  FROM events GROUP BY user_id, CAST(floor(epoch(ts) / 259200) AS BIGINT))"""

#: n-grams of a list without its last element, as DuckDB SQL.
GRAMS = "CASE WHEN len({s}) > {n} THEN list_transform(range(1, len({s}) - {n} + 1), lambda i: array_to_string({s}[i:i + {n} - 1], '{sep}')) ELSE [] END"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_id, ts (64 doubles), label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ts_id"), F.col("embedding").cast("array<double>").alias("ts"), F.col("label").cast("long").alias("label"))


SERIES = "series AS (SELECT vec_id AS ts_id, embedding::DOUBLE[] AS ts, CAST(label AS BIGINT) AS label FROM embeddings)"


def queries_of(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key) % QUERIES == 0)
