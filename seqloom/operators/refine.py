"""Filter and refine: k nearest rows from cheap lower bounds and as few exact distances as they allow.

Most pairs are far apart, and a bound tells so at a fraction of a distance's price.
Pairs come in the order of their bound, in waves, and a pair whose bound lies beyond
the k-th distance known is never computed. Results are those of all distances.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from seqloom.operators.distance import FEW, Warped, _band, warp_bounds, warped_distances
from seqloom.operators.pairs import in_blocks, pieces

#: Pairs whose distances are computed at once.
PAIRS = 1 << 15
#: Part of a bound that is left off, since rounding may put it above a distance that equals it.
SLACK = 1e-9
#: Cells in a row of the programme up to which all distances of a block cost less than their bounds.
CHEAP = 64
#: Queries and rows whose distances are all wanted.
PER_BLOCK = 1_024


def nearest_bounded(i: np.ndarray, bound: np.ndarray, distance: Callable[[np.ndarray], np.ndarray], k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the pairs among which are each query's ``k`` nearest, with all that tie with the last.

    ``i`` has the query of each pair, ``bound`` a lower bound of its distance, and
    ``distance`` computes those of an array of places. Waves grow fourfold. A bound
    that is no number bounds nothing. ``within`` has what is known of each query: its
    k-th distance is no more.
    """
    bound = np.nan_to_num(bound * (1 - SLACK), nan=0.0)
    order = np.lexsort((bound, i))
    i_of = i[order]
    place = np.arange(len(order)) - np.searchsorted(i_of, i_of)
    dist = np.full(len(order), np.nan)
    reach = np.full(int(i.max(initial=-1)) + 1, np.inf) if within is None else within.copy()
    done, lo, hi = np.zeros(len(order), bool), 0, k
    while True:
        wave = np.flatnonzero((place >= lo) & (place < hi) & (bound[order] <= reach[i_of]))
        for at in range(0, len(wave), PAIRS):
            some = wave[at : at + PAIRS]
            dist[some] = distance(order[some])
        done[wave] = True
        if not (place >= hi).any():
            break
        known = np.flatnonzero(done)
        by = known[np.lexsort((dist[known], i_of[known]))]
        nth = np.arange(len(by)) - np.searchsorted(i_of[by], i_of[by])
        last = by[nth == k - 1]
        reach[i_of[last]] = np.fmin(reach[i_of[last]], dist[last])
        lo, hi = hi, hi * 4
    known = np.flatnonzero(done)
    return order[known], dist[known]


def best(i: np.ndarray, dist: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest pairs, ties by ``tie`` ascending."""
    order = np.lexsort((tie, dist, i))
    rank = np.arange(len(order)) - np.searchsorted(i[order], i[order])
    return order[rank < k]


def bounds_pay(x: pa.Array, y: pa.Array, distances: Warped) -> bool:
    """Whether bounds of two tables' pairs cost less than their distances: where rows of the programme are long, or lengths so many that no two tables of one length meet."""
    n, m = (np.unique(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) // distances.dim) for c in (x, y))
    longest = np.int64(max(n.max(initial=0), m.max(initial=0)))
    row = longest if distances.squared else min(longest, 2 * _band(longest, longest, distances.band))
    return bool(row > CHEAP or len(n) * len(m) * FEW > len(x) * len(y))


def nearest_of_table(d: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` least numbers of each row of a matrix, ties by ``tie`` of the column; NaN takes no part."""
    some = min(k, d.shape[1])
    last = np.partition(np.where(np.isnan(d), np.inf, d), some - 1, 1)[:, some - 1] if some else np.zeros(len(d))
    i, j = np.nonzero(d <= last[:, None])
    kept = best(i, d[i, j], tie[j], k)
    return i[kept], j[kept]


def series_pairs(queries: DataFrame, corpus: DataFrame, key: str, vector: str, distances: Warped) -> DataFrame:
    """q, s and dist of every query with every row, itself included; dist is null where a series is null or has no frames.

    Blocks meet slices whole, so a row's series moves once a block and not once a pair.
    """

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        d = distances.table(a[vector].combine_chunks(), b[vector].combine_chunks())
        i, j = np.repeat(np.arange(len(d)), d.shape[1]), np.tile(np.arange(d.shape[1]), len(d))
        return pa.table({"q": a[key].take(pa.array(i)), "s": b[key].take(pa.array(j)), "dist": pa.array(d.ravel(), from_pandas=True)})

    kind = corpus.schema[key].dataType.simpleString()
    return in_blocks(queries.select(key, vector), corpus.select(key, vector), key, meet, f"q {kind}, s {kind}, dist double", PER_BLOCK, PER_BLOCK)


def series_distances(queries: DataFrame, corpus: DataFrame, key: str, vector: str, distances: Warped, k: int = 0, within: int | None = None, apart: bool = False) -> DataFrame:
    """q, dists and near: all distances of a query from a slice of the rows in no order, and the ``k`` nearest (dist, s) of these; a query has a row for each slice.

    Pairs whose series have no distance are left out, with ``within`` those whose
    lengths differ by so many frames or more, and with ``apart`` a query with itself.
    """

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, q, s = a[vector].combine_chunks(), b[vector].combine_chunks(), a[key].to_numpy(), b[key].to_numpy()
        d = distances.table(x, y)
        if within is not None:
            n, m = (pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) / distances.dim for c in (x, y))
            d[np.abs(n[:, None] - m) >= within] = np.nan
        if apart:
            d[q[:, None] == s] = np.nan
        some = ~np.isnan(d)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]), pa.int32()), pa.array(d[some]))
        i, j = nearest_of_table(d, s, k) if k else np.zeros((2, 0), int)
        found = pa.StructArray.from_arrays([pa.array(d[i, j]), pa.array(s[j])], ["dist", "s"])
        near = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(d) + 1)), pa.int32()), found)
        return pa.table({"q": a[key], "dists": lists, "near": near})

    kind = corpus.schema[key].dataType.simpleString()
    schema = f"q {kind}, dists array<double>, near array<struct<dist: double, s: {kind}>>"
    corpus = corpus.select(key, vector).filter(f"{key} IS NOT NULL")
    return in_blocks(queries.select(key, vector), corpus, key, meet, schema, PER_BLOCK, PER_BLOCK)


def nearest_series(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, dim: int = 1, squared: bool = False, band: float = 0.1, gap: float = 0.0, per_piece: int = 256) -> DataFrame:
    """q, s and dist of pairs among which are each query's ``k`` nearest rows under time warping, of equal distances the smaller id first.

    Every query meets every row of another id in blocks, as rows of row-major
    series with ``dim`` channels. A block hands on k rows a query and computes a
    distance only where the envelope bound is within reach, unless all distances cost
    less than the bounds. A series that is null or without frames has no distance
    and no neighbours; ids must be distinct.
    """
    distances = Warped(dim, squared, band, gap)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        y, s = b[vector].combine_chunks(), b[key].to_numpy()
        found = []
        for piece in pieces(a, per_piece):
            x, q = piece[vector].combine_chunks(), piece[key].to_numpy()
            if not bounds_pay(x, y, distances):
                d = distances.table(x, y)
                d[q[:, None] == s] = np.nan
                i, j = nearest_of_table(d, s, k)
                found.append((q[i], s[j], d[i, j]))
                continue
            i, j = np.nonzero(q[:, None] != s[None, :])
            exact = lambda at, x=x, i=i, j=j: warped_distances(x.take(pa.array(i[at])), y.take(pa.array(j[at])), dim, squared, band, gap)
            at, dist = nearest_bounded(i, warp_bounds(x, y, i, j, dim, squared, band), exact, k)
            at, dist = at[~np.isnan(dist)], dist[~np.isnan(dist)]
            kept = best(i[at], dist, s[j[at]], k)
            found.append((q[i[at[kept]]], s[j[at[kept]]], dist[kept]))
        q, s, dist = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"q": q, "s": s, "dist": dist})

    kind = corpus.schema[key].dataType.simpleString()
    return in_blocks(queries.select(key, vector), corpus.select(key, vector), key, meet, f"q {kind}, s {kind}, dist double")
