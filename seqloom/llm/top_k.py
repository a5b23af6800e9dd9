"""Exact search for the largest inner products by columnar branch and bound.

A slice of the rows lies dimension by dimension (vertically). A query adds up its
products block of dimensions by block of dimensions over all candidates at once;
after each block, what the dimensions still to come can add is bounded by the
mass (norm) that query and candidate have left in them. Candidates that can't
reach the k-th best any more are left out and the others moved together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.integer_vectors import EXACT, clipped, finite, largest, whole
from seqloom.storage import store

#: Dimensions that are added up between two bounds.
BLOCK = 8
#: A task compares so many queries with so many rows.
GROUP = SLICE = 8_192
#: Long rows that every query meets first, for a bound to begin with.
SEEDS = 1_024
#: Candidates are moved together when this part of them or less is left.
COMPACT = 0.8
#: What a missing id counts as where ids break ties.
_NO_ID = np.iinfo(np.int64).max


class Slice:
    """Rows of one dimension, laid out by dimension: those with most mass first, in rows and in dimensions."""

    def __init__(self, row: np.ndarray, vec: np.ndarray, x: np.ndarray):
        mass = x.astype(np.float64) ** 2
        self.dims = np.argsort(-mass.sum(0), kind="stable")
        by_mass = np.argsort(-mass.sum(1), kind="stable")
        self.row, self.vec, self.x = row[by_mass], vec[by_mass], x[by_mass]
        self.most = largest(x)
        self.columns = np.ascontiguousarray(self.x[:, self.dims].T, np.float64)
        self.edges = [*range(0, x.shape[1], BLOCK), x.shape[1]]
        self.left = self._left(self.columns)

    def _left(self, columns: np.ndarray) -> np.ndarray:
        """The mass that is left in front of each block, and behind the last."""
        mass = np.zeros((len(self.edges), columns.shape[1]))
        for b in range(len(self.edges) - 2, -1, -1):
            mass[b] = mass[b + 1] + (columns[self.edges[b] : self.edges[b + 1]] ** 2).sum(0)
        return np.sqrt(mass)

    def best(self, row: np.ndarray, x: np.ndarray, reach: np.ndarray, k: int):
        """For each query its ``k`` best rows but itself, if they score ``reach`` at least: (query, place in the slice, score).

        Ties go to the smaller id. The last result is the number of products that were added up.
        """
        asked, places, scores, added = [], [], [], 0
        exact = self.most * largest(x) * max(x.shape[1], 1) < EXACT
        queries = np.ascontiguousarray(x[:, self.dims].T, np.float64)
        left = self._left(queries)
        for i in range(len(row)):
            if exact:
                at, score, n = self._bounded(row[i], queries[:, i], left[:, i], reach[i], k)
                added += n
            else:  # sums that doubles can't hold are taken as whole numbers of any size
                at = np.flatnonzero(self.row != row[i])
                score = clipped(self.x[at].astype(object) @ x[i].astype(object)) if len(at) else np.zeros(0, np.int64)
            if len(at) > k:
                enough = score >= np.partition(score, len(at) - k)[len(at) - k]
                at, score = at[enough], score[enough]
            first = np.lexsort((self.vec[at], -score))[:k]
            asked.append(np.full(len(first), i))
            places.append(at[first])
            scores.append(score[first])
        if not asked:
            return (np.zeros(0, np.int64),) * 3 + (0,)
        return np.concatenate(asked), np.concatenate(places), np.concatenate(scores).astype(np.int64), added

    def _bounded(self, own: int, query: np.ndarray, left: np.ndarray, reach: float, k: int):
        # rows come by falling mass, so those that may reach the bound at all are the first ones
        n = int(np.searchsorted(-self.left[0] * left[0] * (1 + 1e-9), -reach, "right")) if reach > -np.inf else len(self.row)
        at, columns = np.arange(n), self.columns[:, :n]
        score, added = np.where(self.row[:n] == own, -np.inf, 0.0), 0  # the query's own row never gets in
        for b in range(len(self.edges) - 1):
            lo, hi = self.edges[b], self.edges[b + 1]
            score += query[lo:hi] @ columns[lo:hi]
            added += len(score) * (hi - lo)
            gap = self.left[b + 1][at] * (left[b + 1] * (1 + 1e-9))
            if len(score) > k:  # the k-th best of what is certain already
                reach = max(reach, float(np.partition(score - gap, len(score) - k)[len(score) - k]))
            alive = score + gap >= reach
            if alive.sum() <= COMPACT * len(alive):
                score, at, columns = score[alive], at[alive], columns[:, alive]
        others = score > -np.inf
        return at[others], score[others], added


def _slices(table: pa.Table):
    """For each dimension of the vectors the row numbers, ids (_NO_ID for null), and whole numbers."""
    row = table["row"].to_numpy()
    vec = table["vec"].combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    for at, x in whole(table["embedding"]):
        yield at, row[at], vec[at], x


def _cell(k: int):
    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        asked = {x.shape[1]: (at, row, x) for at, row, _, x in _slices(queries)}
        out = []
        for _, row, vec, x in _slices(rows):
            if x.shape[1] in asked:
                at, own, q = asked[x.shape[1]]
                s = Slice(row, vec, x)
                reach = queries["reach"].to_numpy()[at]
                i, place, score, _ = s.best(own, q, reach, k)
                out.append((at[i], s.vec[place], score))
        i, vec, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        asked_by = queries.select(["row", "vec"]).take(pa.array(i, pa.int64()))
        found = pa.array(vec, pa.int64(), mask=vec == _NO_ID)
        return pa.table([asked_by["row"], asked_by["vec"], found, pa.array(score, pa.int64())], names=["row", "query", "vec", "score"])

    return compare


def _reached(seeds: dict[int, Slice], k: int):
    """Adds to each query the k-th best score among the seeds (minus infinity where there are fewer)."""

    def reach(batches):
        for b in batches:
            best = np.full(b.num_rows, -np.inf)
            for at, row, _, x in _slices(pa.Table.from_batches([b])):
                if x.shape[1] in seeds:
                    i, _, score, _ = seeds[x.shape[1]].best(row, x, np.full(len(row), -np.inf), k)
                    full = np.bincount(i, minlength=len(row)) == k
                    least = np.full(len(row), np.inf)
                    np.minimum.at(least, i, score)
                    best[at[full]] = least[full]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best)], names=[*b.schema.names, "reach"])

    return reach


def top_k(rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` rows with the largest inner products with each query, as whole numbers.

    Queries are the rows whose id is divisible by ``every``; every other row is a
    candidate, also one that repeats the query's id. Ties go to the smaller id,
    null ids last. Only vectors of one dimension meet; null vectors and those with
    null or non-finite components take no part, all-zero and empty ones do. Rows
    that repeat an id as queries are answered each for itself. Scores that no long
    holds become the nearest long. Other columns are ignored; empty in, empty out.

    Queries go to all slices of the rows and rows to all groups of queries, both
    dealt by a number of their own; a query's ``k`` best of each slice are ranked
    at the end. Long rows (SEEDS of them, broadcast) give every query a bound to
    begin with.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).alias("embedding")).filter(finite("embedding"))
    known = store(known.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = known.filter(F.col("vec") % every == 0)
    n, q = known.count(), asked.count()
    slices = max(-(-n // SLICE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, -(-q // GROUP))
    mass = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    longest = known.orderBy(mass.desc(), "row").limit(SEEDS).toArrow()
    seeds = {x.shape[1]: Slice(row, vec, x) for _, row, vec, x in _slices(longest)}
    field = known.schema["embedding"].dataType.simpleString()
    asked = asked.select("row", "vec", "embedding").mapInArrow(_reached(seeds, k), f"row long, vec long, embedding {field}, reach double")
    dealt = lambda df, mine, parts, other, to: df.withColumn(mine, F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(to - 1))))
    asked = dealt(asked, "_group", groups, "_slice", slices).groupBy("_group", "_slice")
    met = asked.cogroup(dealt(known, "_slice", slices, "_group", groups).groupBy("_group", "_slice"))
    found = met.applyInArrow(_cell(k), "row long, query long, vec long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec").asc_nulls_last())))
    return ranked.filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("vec").alias(id_col), "score")
