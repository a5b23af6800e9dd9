"""Column expressions over arrays of numbers; float32 input is widened first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def finite_or_zero(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.transform(doubles(x), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (norm(x) * norm(y))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def deviation(x: Column) -> Column:
    """Population standard deviation."""
    m = mean(x)
    return F.sqrt(total(F.transform(x, lambda v: (v - m) * (v - m))) / F.size(x))


def argmax(x: Column) -> Column:
    """Place of the largest value from 0, the first of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("long")


def ema_gain(x: Column, smoothing: Column, gain: float = 0.8, eps: float = 1e-6, offset: float = 2.0, power: float = 0.5) -> Column:
    """Per-channel energy normalisation of one channel: recursive average, gain control, root compression; the first value stays 0."""
    step = lambda a, v: F.struct(
        F.array_append(a["out"], F.pow(v / F.pow(eps + smoothing * v + (1 - smoothing) * a["m"], gain) + offset, power) - offset**power).alias("out"),
        (smoothing * v + (1 - smoothing) * a["m"]).alias("m"),
    )
    first = F.struct(F.array(F.lit(0.0)).alias("out"), F.lit(0.0).alias("m"))
    return F.aggregate(F.slice(x, 2, F.size(x)), first, step, lambda a: a["out"])
