"""k-means and its scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans(df: DataFrame, k: int, vector: str = "ts", seed: int = 1):
    """(model, df with ``cluster``)."""
    fed = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(fed)
    return model, model.transform(fed).drop("features")


def bic(sizes: dict[int, int], within: float, dim: int) -> float:
    """Bayesian information criterion of a clustering from its sizes and its sum of squared distances to the centres."""
    m, n = len(sizes), sum(sizes.values())
    variance = within / (n - m) / dim
    fit = sum(c * math.log(c) - c * math.log(n) - c * dim / 2 * math.log(2 * math.pi * variance) - (c - 1) * dim / 2 for c in sizes.values() if c)
    return fit - 0.5 * m * math.log(n) * (dim + 1)


def bic_curve(df: DataFrame, ks: list[int], vector: str = "ts", seed: int = 1) -> DataFrame:
    """k and bic, with the knee marked: the point farthest above the chord of a rising concave curve."""
    dim, scores = df.select(F.size(vector)).first()[0], []
    for k in ks:  # one fit each; a fit is a distributed job
        model, _ = kmeans(df, k, vector, seed)
        scores.append((k, float(bic(dict(enumerate(model.summary.clusterSizes)), model.summary.trainingCost, dim))))
    return df.sparkSession.createDataFrame([(k, s, k == knee(scores)) for k, s in scores], "k long, bic double, knee boolean")


def knee(points: list[tuple[float, float]]) -> float:
    x, y = (np.array(v, float) for v in zip(*points, strict=True))
    if x[-1] == x[0] or y[-1] == y[0]:
        return points[0][0]
    above = (y - y[0]) / (y[-1] - y[0]) - (x - x[0]) / (x[-1] - x[0])
    return points[int(above.argmax())][0]
