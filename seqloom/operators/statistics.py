"""Comparing groups by n-gram frequencies, and evaluating predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.storage import store


def ordered_sum(value: str, *order: str) -> Column:
    """Aggregate: the sum of ``value`` taken in ``order``, for groups of few rows, so that like groups have like sums however rows are dealt. Nulls don't count."""
    listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, value))))
    return F.aggregate(listed, F.lit(None).cast("double"), lambda total, x: F.coalesce(total, F.lit(0.0)) + x[value])


def gram_counts(sequences: DataFrame, label: str, grams: Column) -> DataFrame:
    """label, gram, n."""
    return sequences.select(F.col(label).alias("label"), F.explode(grams).alias("gram")).groupBy("label", "gram").agg(F.count("*").alias("n"))


def frequencies(counts: DataFrame, support: int = 3) -> DataFrame:
    """label, gram, freq over grams with ``support`` occurrences in all labels together; a label's frequencies add to 1."""
    counts = store(counts, "gram-counts")
    frequent = counts.groupBy("gram").agg(F.sum("n").alias("all")).filter(F.col("all") >= support).select("gram")
    kept = store(counts.join(frequent, "gram"), "kept-grams")
    sums = kept.groupBy("label").agg(F.sum("n").alias("total"))  # a row for each label, of which there are few
    return kept.join(F.broadcast(sums), "label").select("label", "gram", (F.col("n") / F.col("total")).alias("freq"))


def paired(freqs: DataFrame) -> DataFrame:
    """kx, ky, gram, fx, fy for ordered pairs of different labels and grams of either; an absent gram has frequency 0.

    Labels are few: the grid of label pairs comes from their distinct values.
    """
    labels = freqs.select("label").distinct()
    grid = labels.select(F.col("label").alias("kx")).join(labels.select(F.col("label").alias("ky")), F.col("kx") != F.col("ky"))
    x = freqs.select(F.col("label").alias("kx"), "gram", F.col("freq").alias("fx")).join(grid, "kx").select("kx", "ky", "gram", "fx")
    y = freqs.select(F.col("label").alias("ky"), "gram", F.col("freq").alias("fy")).join(grid, "ky").select("kx", "ky", "gram", "fy")
    return x.join(y, ["kx", "ky", "gram"], "full").select("kx", "ky", "gram", F.coalesce("fx", F.lit(0.0)).alias("fx"), F.coalesce("fy", F.lit(0.0)).alias("fy"))


def chi_square(pairs: DataFrame) -> DataFrame:
    """kx, ky, statistic (sum of (fx - fy)^2 / fy where fy > 0), the number of grams and, of those, absent ones that ky lacks."""
    return pairs.groupBy("kx", "ky").agg(F.sum(F.when(F.col("fy") > 0, (F.col("fx") - F.col("fy")) ** 2 / F.col("fy"))).alias("statistic"), F.count("*").alias("grams"), F.count_if(F.col("fy") == 0).alias("absent"))


def differing(pairs: DataFrame, below: float = 0.001) -> DataFrame:
    """The label pairs (kx, ky) whose distributions differ by chi-square with p < ``below``; a gram that ky lacks makes the statistic infinite and p 0."""
    p = F.when(F.col("absent") > 0, F.lit(0.0)).otherwise(chi_square_p(F.col("statistic"), F.col("grams") - 1))
    return chi_square(pairs).withColumn("p", p).filter(F.col("p") < below).select("kx", "ky")


def _most(t: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each kx and ky, greatest ``_apart`` first, ties by gram."""
    t = t.sort_by([("kx", "ascending"), ("ky", "ascending"), ("_apart", "descending"), ("gram", "ascending")]).combine_chunks()
    kx, ky = (t[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("kx", "ky"))
    begins = np.flatnonzero(np.concatenate([[True], (kx[1:] != kx[:-1]) | (ky[1:] != ky[:-1])])) if len(kx) else np.zeros(0, int)
    place = np.arange(len(kx)) - np.repeat(begins, np.diff(np.append(begins, len(kx))))
    return t.filter(pa.array(place < k))


def most_differing(pairs: DataFrame, k: int) -> DataFrame:
    """Add ``rank`` (from 1) to the ``k`` grams of each kx and ky whose frequencies differ most, compared to twelve places, ties by gram.

    Tasks hold ``k`` rows a pair of labels while they read, and only these are
    ordered: a sort of all grams ahead of a window takes memory as they grow.
    """
    apart = pairs.withColumn("_apart", F.round(F.abs(F.col("fx") - F.col("fy")), 12))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b])
            kept = _most(t if kept is None else pa.concat_tables([kept, t]), k)
        if kept is not None:
            yield from kept.to_batches()

    w = Window.partitionBy("kx", "ky").orderBy(F.desc("_apart"), "gram")
    ranked = apart.mapInArrow(some, apart.schema).withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.filter(F.col("rank") <= k).drop("_apart")


def chi_square_p(statistic: Column, freedom: Column) -> Column:
    """Upper tail of the chi-square distribution."""

    @F.arrow_udf("double")
    def tail(s: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array([None if x is None or n is None else upper_gamma(n / 2, x / 2) for x, n in zip(s.to_pylist(), k.to_pylist(), strict=True)], pa.float64())

    return tail(statistic, freedom)


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d = 1 / ((n * d + b) or tiny)
        c = (b + n / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def dampener_sweep(df: DataFrame, noise: str, signal: str, truth: str, steps: int = 100) -> DataFrame:
    """Accuracy of "signal beats the damped noise" for dampeners 0, 1/steps, ...; rows hold two scores and a 0/1 truth.

    For a row the decision turns at one dampener, so rows are counted by that
    step and the sweep runs over step counts, not over rows times steps.
    """
    # the first step at which the damped noise is no longer below the signal
    turn = F.when(F.col(signal) <= 0, F.lit(0)).when(F.col(noise) <= 0, F.lit(steps)).otherwise(F.least(F.lit(steps), F.ceil(F.col(signal) * steps / F.col(noise) - 1e-9)))
    turned = df.select(turn.cast("long").alias("turn"), F.col(truth).cast("long").alias("truth")).groupBy("turn", "truth").agg(F.count("*").alias("n"))
    # at most 2 * (steps + 1) rows from here on
    grid = df.sparkSession.range(steps).select(F.col("id").alias("step"))
    hit = F.sum(F.when((F.col("turn") > F.col("step")) == (F.col("truth") == 1), F.col("n")).otherwise(0))
    return grid.join(F.broadcast(turned)).groupBy("step").agg((hit / F.sum("n")).alias("accuracy")).withColumn("dampener", F.col("step") / steps)
