"""Label mappings, labelled regions, sampling by label and graph lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators.prefix import rank_in
from seqloom.operators.windows import sliding


def prefixes(sizes: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """label, first (clusters of the labels before it) and last (first + n): one row a label."""
    before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("first", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))
    return out.withColumn("last", F.col("first") + F.col(n))


def to_id(df: DataFrame, mapping: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """Number of a label's cluster (from 0); callers that keep 0 for noise add 1."""
    return df.join(F.broadcast(mapping.select(label, "first")), label).withColumn("id", F.col("first") + F.col(cluster)).drop("first")


def from_id(df: DataFrame, mapping: DataFrame, id_col: str = "id", label: str = "label") -> DataFrame:
    """Label and 1-based cluster of ids counted from 1."""
    m = F.broadcast(mapping.select(label, "first", "last"))  # a row for each label
    return df.join(m, (F.col(id_col) > F.col("first")) & (F.col(id_col) <= F.col("last"))).withColumn("cluster", F.col(id_col) - F.col("first")).drop("first", "last")


def short_name(label: Column, cluster: Column) -> Column:
    """First letter of a label (whistles by direction) and the cluster as a small letter."""
    letter = F.when(label.endswith("DOWN"), "D").when(label.endswith("UP"), "U").otherwise(F.left(label, F.lit(1)))
    return F.concat(letter, F.chr(96 + cluster))


def rewindow(regions: DataFrame, frames: str, whole: Column, size: int) -> DataFrame:
    """Regions where ``whole`` holds stay whole, others become windows of ``size`` frames at half steps: start, stop."""
    rest = sliding(regions.filter(~F.coalesce(whole, F.lit(False))), frames, size, size // 2).drop("win_id").select(*regions.columns, "start", "stop")
    kept = regions.filter(whole).select(*regions.columns, F.lit(0).cast("long").alias("start"), F.col(frames).cast("long").alias("stop"))
    return kept.unionByName(rest)


def rasterise(spans: DataFrame, frames: str, labels: str = "labels") -> DataFrame:
    """Labels spread evenly over a span's frames in bins of a constant size: t and label; what is over at the end has none."""
    bin_size = F.floor(F.col(frames) / F.size(labels)).cast("int")
    spread = F.slice(F.flatten(F.transform(labels, lambda v: F.array_repeat(v, bin_size))), F.lit(1), F.col(frames).cast("int"))
    return spans.select("*", F.posexplode(spread).alias("t", "label")).withColumn("t", F.col("t").cast("long"))


def balanced(df: DataFrame, label: str, key: str, n: int, seed: int = 2_654_435_761) -> DataFrame:
    """``n`` rows of each label with replacement: the k-th draw of a label is its row k modulo its size, in a mixed order."""
    ranked = rank_in(df.withColumn("_mixed", F.pmod(F.col(key) * seed, F.lit(1 << 32))), label, ["_mixed", key], "_r").drop("_mixed")
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("draw", F.col("draw").cast("long"))
    draws = draws.withColumn("_r", F.col("draw") % F.col("_n")).drop("_n")
    return draws.join(ranked, [label, "_r"]).drop("_r")


def noisy(drawn: DataFrame, noise: DataFrame, label: str, quiet, vector: str, draw: str = "draw") -> DataFrame:
    """Mean of each drawn row's vector and the noise row of the same draw; noise itself stays as it is."""
    other = noise.select(F.col(draw), F.col(vector).alias("_noise"))
    mixed = F.when(F.col(label) == quiet, F.col(vector)).otherwise(F.zip_with(vector, "_noise", lambda a, b: (a + b) / 2))
    return drawn.join(other, draw).withColumn(vector, mixed).drop("_noise")


def gapped_ngrams(tokens: DataFrame, n: int, part: str, least: float, near: int) -> DataFrame:
    """n-grams of likely tokens: equal neighbours (start, stop, cls, prob) merge where they lie closer than ``near``; mean probability at least ``least``.

    A merged token keeps its first probability. Columns: part, gram, start, stop, prob.
    """
    w = Window.partitionBy(part).orderBy("start")
    same = (F.col("cls") == F.lag("cls").over(w)) & (F.col("stop") - F.lag("stop").over(w) < near)
    runs = tokens.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(part, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("cls").alias("cls"), F.min_by("prob", "start").alias("prob"))
    ahead = w.rowsBetween(0, n - 1)
    grams = merged.select(part, F.array_join(F.collect_list("cls").over(ahead), "_").alias("gram"), "start", F.max("stop").over(ahead).alias("stop"), F.avg("prob").over(ahead).alias("prob"), F.count("*").over(ahead).alias("_n"))
    return grams.filter((F.col("_n") == n) & (F.col("prob") >= least)).drop("_n")


def limited(df: DataFrame, label: str, order: str, most: int, least: int) -> DataFrame:
    """The first ``most`` rows of each label that has more than ``least``."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(order))).filter(F.col("_r") <= most).drop("_r")
    return first.join(df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).drop("_n"), label)


def neighbourhood(graph: DataFrame, key: int) -> DataFrame:
    """Neighbours of one item in rank order."""
    return graph.filter(F.col("q") == key).orderBy("rank")


def at_point(annotations: DataFrame, t: int) -> DataFrame:
    """Annotations whose closed interval holds a point."""
    return annotations.filter(F.lit(t).between(F.col("start"), F.col("stop")))


def in_view(annotations: DataFrame, start: int, stop: int) -> DataFrame:
    """Annotations that lie inside a view."""
    return annotations.filter((F.col("start") >= start) & (F.col("stop") <= stop))


def page(frames: DataFrame, number: int, size: int, t: str = "t") -> DataFrame:
    """One screen of frames."""
    return frames.filter((F.col(t) >= number * size) & (F.col(t) < (number + 1) * size))


def full_views(frames: DataFrame, part: str, least: int) -> DataFrame:
    """Frames of the parts that have ``least`` of them; a view that runs out earlier is skipped."""
    return frames.join(frames.groupBy(part).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n"), part)
