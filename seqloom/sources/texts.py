"""Text made for sequence tools, the query history, and recordings of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.sequences import digits_to_letters
from seqloom.operators.prefix import running_total_in
from seqloom.sources.recordings import joined, wav_bytes

HISTORY = "query_string string, query_file string, date timestamp"


def grammar(labels: DataFrame, label: str = "label", continuous: bool = False) -> DataFrame:
    """One text row: a grammar of all labels, once or in a loop between silences. Labels are few."""
    words = F.array_join(F.array_sort(F.collect_set(F.when(F.col(label) == "sil", None).otherwise(digits_to_letters(F.col(label))))), " | ")
    rule = F.concat(F.lit("$unit = "), words, F.lit(";\n"), F.lit("( < $unit | sil > )" if continuous else "( $unit )"))
    return labels.agg(rule.alias("value"))


def word_list(labels: DataFrame, label: str = "label") -> DataFrame:
    """A dictionary row for each label and for silence, in order."""
    names = labels.filter(F.col(label) != "sil").select(digits_to_letters(F.col(label)).alias("w")).distinct().union(labels.sparkSession.createDataFrame([("sil",)], "w string")).distinct()
    return names.orderBy("w").select(F.concat_ws(" ", "w", "w").alias("value"))


def result_pairs(spark: SparkSession, path: str) -> DataFrame:
    """truth and prediction from a result file: the file line's leading letters and digits up to ``_``, then the first data line below it."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"), F.input_file_name().alias("src"))
    w = Window.partitionBy("src").orderBy("line")
    truth = F.regexp_extract(F.lag("value").over(w), r"([^/_\"]+)[^/\"]*\.rec", 1)
    predicted = F.get(F.split(F.trim("value"), r"\s+"), F.lit(2))
    return lines.select(truth.alias("truth"), predicted.alias("predicted")).filter((F.col("truth") != "") & F.col("predicted").isNotNull())


def append_history(spark: SparkSession, path: str, query: str, file: str | None = None) -> None:
    spark.createDataFrame([(query, file)], "query_string string, query_file string").withColumn("date", F.current_timestamp()).write.mode("append").parquet(path)


def latest_history(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Newest first."""
    h = spark.read.schema(HISTORY).parquet(path).orderBy(F.desc("date"), "query_string")
    return h.limit(n) if n is not None else h


def _in_parts(members: DataFrame, order: list[str], gap: int, longest: int) -> DataFrame:
    """name and samples: the members of each name laid end to end, in numbered parts (``name``, ``name_part_1`` and so on; ``unmerged_1`` and so on) of about ``longest`` samples, so that no row grows with the table."""
    sized = members.withColumn("size", F.size("samples") + gap)
    total = running_total_in(sized, "name", order, "size", "before")
    part = F.floor(F.col("before") / longest).cast("long")
    numbered = F.when(F.col("name") == "unmerged", F.concat_ws("_", "name", part)).otherwise(F.concat_ws("_part_", "name", part))
    named = total.withColumn("name", F.when(part > 0, numbered).otherwise(F.col("name")))
    return joined(named.withColumn("order", F.struct(*order)), "name", "order", gap=gap).select("name", "samples")


def cluster_parts(members: DataFrame, least: int = 2, silent: str = "ECHO", gap: int = 1_000, longest: int = 1 << 24) -> DataFrame:
    """name and samples of each cluster (label, cluster, start, samples) with ``least`` members; smaller ones share ``unmerged``, ``silent`` labels have none."""
    sizes = members.groupBy("label", "cluster").agg(F.count("*").alias("n"))
    kept = members.join(sizes, ["label", "cluster"]).filter(F.col("label") != silent)
    name = F.when(F.col("n") >= least, F.concat_ws("_", "label", F.col("cluster"))).otherwise("unmerged")
    return _in_parts(kept.withColumn("name", name), ["start", "label", "cluster"], gap, longest)


def cluster_recordings(members: DataFrame, least: int = 2, silent: str = "ECHO", gap: int = 1_000, longest: int = 1 << 24) -> DataFrame:
    """:func:`cluster_parts` as WAV files: name and wav."""
    return cluster_parts(members, least, silent, gap, longest).select("name", wav_bytes(F.col("samples")).alias("wav"))


def label_recordings(members: DataFrame, silent: str = "NOISE", longest: int = 1 << 24) -> DataFrame:
    """name and samples of each label and cluster (label, cluster, truth, start, samples), end to end.

    Members whose truth is another label go into ``label_truth`` too, so that what was
    taken for a label can be heard apart. ``silent`` labels have none.
    """
    kept = members.filter(F.col("label") != silent)
    own = kept.withColumn("name", F.concat_ws("_", "label", F.col("cluster")))
    wrong = kept.filter(F.col("truth") != F.col("label")).withColumn("name", F.concat_ws("_", "label", "truth"))
    return _in_parts(own.unionByName(wrong), ["start"], 0, longest)
