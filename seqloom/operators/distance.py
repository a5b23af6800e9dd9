"""Edit and time-warping distances, computed for whole batches of pairs at once.

The dynamic programmes run over cells, and every cell is one numpy operation over
all pairs of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of all pairs' matrices held at once.
CELLS = 1 << 20
#: Rows of either side whose pairs a table's programme takes at once, so that a few cells stay in a core's cache.
TALL, BROAD = 16, 512
#: Pairs of strings that are compared at once, so that two rows of the programme stay in a core's cache.
TOGETHER = 1 << 13
#: A group of fewer pairs of like lengths isn't worth a programme of its own.
FEW = 256


def _band(n: np.ndarray, m: np.ndarray, part: float) -> np.ndarray:
    """Half-width of the band for sequences of n and m places."""
    return np.maximum((np.maximum(n, m) * part).astype(np.int64), np.abs(n - m)) + 2


def _matrix(column: pa.Array, values: np.ndarray, fill, dim: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(rows padded to the longest with ``fill``, number of places of each row) of a list column whose flat values are ``values``."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) // dim
    ends = np.cumsum(n * dim)
    width = int(n.max(initial=0))
    place = np.arange(width * dim)
    at = (ends - n * dim)[:, None] + place
    inside = place < (n * dim)[:, None]
    out = np.where(inside, values[np.minimum(at, max(len(values) - 1, 0))] if len(values) else fill, fill)
    return out.reshape(len(n), width, dim), n


def _runs(n: np.ndarray, m: np.ndarray):
    """Pairs with places on both sides, in groups of like size so that CELLS cells are enough."""
    full = np.flatnonzero((n > 0) & (m > 0))
    full = full[np.argsort(n[full] * (1 << 20) + m[full], kind="stable")]
    lo = 0
    while lo < len(full):
        cells = np.maximum.accumulate(n[full[lo:]]) * np.maximum.accumulate(m[full[lo:]]) * np.arange(1, len(full) - lo + 1)
        hi = lo + max(1, int(np.searchsorted(cells, CELLS, "right")))
        yield full[lo:hi]
        lo = hi


def _programme(cost: np.ndarray, n: np.ndarray, m: np.ndarray, width: np.ndarray | None, gap: float | None) -> np.ndarray:
    """End value of each pair: borders are infinite but for the corner; a step aside costs one (no ``gap``: edit distance) or the cell's cost plus ``gap``."""
    b, rows, cols = cost.shape
    cost = np.ascontiguousarray(cost.transpose(1, 2, 0))  # a cell's values lie together
    prev = np.full((cols + 1, b), np.inf)
    prev[0] = 0
    out = np.full(b, np.nan)
    reach = cols + rows if width is None else int(width.max())
    for i in range(1, rows + 1):
        row = np.full((cols + 1, b), np.inf)
        for j in range(max(1, i - reach), min(cols + 1, i + reach)):
            v = _cell(cost[i - 1, j - 1], prev[j - 1], prev[j], row[j - 1], gap)
            row[j] = v if width is None else np.where((j >= i - width) & (j < i + width), v, np.inf)
        done = np.flatnonzero(n == i)
        out[done] = row[m[done], done]
        prev = row
    return out


def _cell(cost, both, up, left, gap):
    if gap is None:  # edit distance: a step aside costs one
        return np.minimum(np.minimum(up, left) + 1, both + cost)
    return cost + np.minimum(np.minimum(up, left) + gap, both)


def edit_distances(x, y, band: float = 0.1) -> np.ndarray:
    """Anchored, banded edit distance over the product of lengths: the first symbols are always aligned with each other. Null or empty: NaN."""
    x, y = (v if isinstance(v, pa.Array) else pa.array(v, pa.list_(pa.string())) for v in (x, y))
    fx, fy = x.flatten(), y.flatten()
    codes = pa.concat_arrays([fx, fy]).dictionary_encode().indices.fill_null(-3).to_numpy(zero_copy_only=False)
    a, n = _matrix(x, codes[: len(fx)], -1)
    c, m = _matrix(y, codes[len(fx) :], -2)
    out = np.full(len(n), np.nan)
    for at in _runs(n, m):
        rows, cols = n[at].max(), m[at].max()
        cost = (a[at, :rows] != c[at, :cols].transpose(0, 2, 1)).astype(float)
        out[at] = _programme(cost, n[at], m[at], _band(n[at], m[at], band), None) / (n[at] * m[at])
    return out


def warped_distances(x, y, dim: int = 1, squared: bool = True, band: float = 0.1, gap: float = 0.0) -> np.ndarray:
    """Dynamic time warping of row-major series with ``dim`` channels.

    ``squared``: squared Euclidean cost, no band, no normalisation. Otherwise root
    cost, banded, over the product of lengths. An empty series gives NaN.
    """
    x, y = (v if isinstance(v, pa.Array) else pa.array([np.asarray(s, np.float64) for s in v], pa.list_(pa.float64())) for v in (x, y))
    a, n = _matrix(x, x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, dim)
    c, m = _matrix(y, y.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, dim)
    out = np.full(len(n), np.nan)
    for at in _runs(n, m):
        rows, cols = n[at].max(), m[at].max()
        cost = np.zeros((len(at), rows, cols))
        for k in range(dim):
            d = a[at, :rows, k][:, :, None] - c[at, :cols, k][:, None, :]
            cost += d * d
        if squared:
            out[at] = _programme(cost, n[at], m[at], None, 0.0)
        else:
            out[at] = _programme(np.sqrt(cost), n[at], m[at], _band(n[at], m[at], band), gap) / (n[at] * m[at])
    return out


def _tile(x: np.ndarray, y: np.ndarray, width: int | None, gap: float) -> np.ndarray:
    """Distances of (place, channel, pair) from (place, channel, pair): the programme of :func:`warped_distances`, a cell of all pairs at a time.

    Pairs may have two axes, one of length 1 on either side: then all rows of x meet all of y.
    """
    (rows, dim), cols, pairs = x.shape[:2], len(y), np.broadcast_shapes(x.shape[2:], y.shape[2:])
    prev, row = np.full((2, cols + 1, *pairs), np.inf)
    prev[0] = 0
    cost, step = np.empty((2, *pairs))
    reach = cols + rows if width is None else width
    for i in range(rows):
        lo, hi = max(1, i + 1 - reach), min(cols + 1, i + 1 + reach)
        row[lo - 1] = np.inf
        for j in range(lo, hi):
            for k in range(dim):
                d = step if k else cost
                np.subtract(x[i, k], y[j - 1, k], out=d)
                np.multiply(d, d, out=d)
                if k:
                    cost += step
            if width is not None:
                np.sqrt(cost, out=cost)
            np.minimum(prev[j], row[j - 1], out=step)
            if gap:
                step += gap
            np.minimum(step, prev[j - 1], out=step)
            np.add(cost, step, out=row[j])
        row[hi : hi + 1] = np.inf
        prev, row = row, prev
    return prev[cols]


def _single(x: np.ndarray, y: np.ndarray, width: int | None, gap: float) -> np.ndarray:
    """As :func:`_tile` in single precision, of products (place, row, channel + 2) with (place, channel + 2, row), which sum up to squared distances."""
    (rows, p, _), (cols, _, q) = x.shape, y.shape
    prev, row = np.full((2, cols + 1, p, q), np.inf, np.float32)
    prev[0] = 0
    step = np.empty((p, q), np.float32)
    reach = cols + rows if width is None else width
    for i in range(rows):
        lo, hi = max(1, i + 1 - reach), min(cols + 1, i + 1 + reach)
        row[lo - 1] = np.inf
        cost = np.matmul(x[i], y[lo - 1 : hi - 1])
        np.maximum(cost, 0, out=cost)
        if width is not None:
            np.sqrt(cost, out=cost)
        for j in range(lo, hi):
            np.minimum(prev[j], row[j - 1], out=step)
            if gap:
                step += np.float32(gap)
            np.minimum(step, prev[j - 1], out=step)
            np.add(cost[j - lo], step, out=row[j])
        row[hi : hi + 1] = np.inf
        prev, row = row, prev
    return prev[cols]


def rough_table(x: pa.Array, y: pa.Array, dim: int = 1, squared: bool = True, band: float = 0.1, gap: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(r, f, g): :func:`warped_distances` of x's row i from y's row j is within f[i] + g[j] of r[i, j]. None where lengths differ or numbers are too large.

    Squared distances of frames come from one product in single precision, so they
    are off by (channels + 6) roundings of (|x| + |y|) ** 2 at most, and their roots by
    the root of that. Frames are taken from their mean first, which moves no distance.
    """
    a, n = _matrix(x, x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, dim)
    c, m = _matrix(y, y.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, dim)
    rows, cols = (int(v[0]) if len(v) else 0 for v in (n, m))
    if not rows or not cols or (n != rows).any() or (m != cols).any():
        return None
    mean = (a.mean((0, 1)) + c.mean((0, 1))) / 2
    a, c = a - mean, c - mean
    high, long = [np.sqrt((v * v).sum(2)).max(1) for v in (a, c)], rows + cols
    most = max(float(h.max()) for h in high)
    if not (most == 0 or 1e-12 < most < 1e12) or not 0 <= gap < 1e12:
        return None
    # of a cell, and of a path of fewer than ``long`` cells with its sums' own roundings
    unit = (dim + 6) * 2.0**-24
    if squared:
        off = [long * (2 * unit + 4 * long * 2.0**-24) * 2 * most * h for h in high]  # (p + q) ** 2 <= 2 * most * (p + q)
    else:
        off = [long * (np.sqrt(unit) + 4 * long * 2.0**-24) * h for h in high]
    off = [v + long * long * gap * 2.0**-23 for v in off]
    left = np.ones((rows, len(a), dim + 2), np.float32)
    left[:, :, :dim], left[:, :, dim] = -2 * a.transpose(1, 0, 2), (a * a).sum(2).T
    right = np.ones((cols, dim + 2, len(c)), np.float32)
    right[:, :dim], right[:, dim + 1] = c.transpose(1, 2, 0), (c * c).sum(2).T
    width = None if squared else int(_band(np.int64(rows), np.int64(cols), band))
    out = np.empty((len(a), len(c)), np.float32)
    for at in range(0, len(c), BROAD):
        some = np.ascontiguousarray(right[:, :, at : at + BROAD])
        for lo in range(0, len(a), 4 * TALL):
            out[lo : lo + 4 * TALL, at : at + BROAD] = _single(np.ascontiguousarray(left[:, lo : lo + 4 * TALL]), some, width, gap)
    if not squared:
        out /= np.float32(rows * cols)
        off = [v / (rows * cols) for v in off]
    return out, *off


def warped_some(x: pa.Array, y: pa.Array, i: np.ndarray, j: np.ndarray, dim: int = 1, squared: bool = True, band: float = 0.1, gap: float = 0.0) -> np.ndarray:
    """:func:`warped_distances` of x's rows i from y's rows j, bit by bit the same; all series of a side have one length."""
    a, n = _matrix(x, x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, dim)
    c, m = _matrix(y, y.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, dim)
    width = None if squared else int(_band(n[0], m[0], band))
    a, c = a.reshape(len(a), -1), c.reshape(len(c), -1)
    out = np.empty(len(i))
    for lo in range(0, len(i), TALL * BROAD):
        p, q = (np.ascontiguousarray(v[at[lo : lo + TALL * BROAD]].T) for v, at in ((a, i), (c, j)))
        out[lo : lo + TALL * BROAD] = _tile(p.reshape(int(n[0]), dim, -1), q.reshape(int(m[0]), dim, -1), width, gap)
    return out if squared else out / (n[0] * m[0])


def warped_table(x: pa.Array, y: pa.Array, dim: int = 1, squared: bool = True, band: float = 0.1, gap: float = 0.0) -> np.ndarray:
    """:func:`warped_distances` of all series of x from all of y, bit by bit the same, as a matrix with a row for each x.

    No pair is laid out: series of one length meet those of another in tiles. Lengths that few series have go pair by pair.
    """
    a, n = _matrix(x, x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, dim)
    c, m = _matrix(y, y.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, dim)
    out = np.full((len(n), len(m)), np.nan)
    few = []
    for rows in np.unique(n[n > 0]).tolist():
        i = np.flatnonzero(n == rows)
        mine = np.ascontiguousarray(a[i, :rows].transpose(1, 2, 0))
        for cols in np.unique(m[m > 0]).tolist():
            j = np.flatnonzero(m == cols)
            if len(i) * len(j) < FEW:
                few.append((np.repeat(i, len(j)), np.tile(j, len(i))))
                continue
            width = None if squared else int(_band(np.int64(rows), np.int64(cols), band))
            theirs = np.ascontiguousarray(c[j, :cols].transpose(1, 2, 0))
            for at in range(0, len(j), BROAD):
                some = np.ascontiguousarray(theirs[:, :, at : at + BROAD])
                for lo in range(0, len(i), TALL):
                    d = _tile(mine[:, :, lo : lo + TALL, None], some[:, :, None], width, gap)
                    out[np.ix_(i[lo : lo + TALL], j[at : at + BROAD])] = d if squared else d / (rows * cols)
    if few:
        i, j = (np.concatenate(f) for f in zip(*few, strict=True))
        for lo in range(0, len(i), CELLS >> 4):
            p, q = i[lo : lo + (CELLS >> 4)], j[lo : lo + (CELLS >> 4)]
            out[p, q] = warped_distances(x.take(pa.array(p)), y.take(pa.array(q)), dim, squared, band, gap)
    return out


def _edit_tile(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, band: float) -> np.ndarray:
    """Edits of all rows of x into all of y, (place, row) each, with n and m symbols in ascending order: whole numbers, and no step leaves a pair's band."""
    (rows, p), (cols, q), kind = x.shape, y.shape, x.dtype
    never = kind.type(np.iinfo(kind).max // 2)
    width = _band(n[:, None], m, band)
    reach, least = int(width.max()), int(width.min())
    # j - i is inside a pair's band where its width is at least that much
    beyond = {t: np.where(width >= max(-t, t + 1), 0, never).astype(kind) for t in range(-reach, reach) if least < max(-t, t + 1)}
    prev, row = np.full((2, cols + 1, p, q), never)
    prev[0] = 0
    step, side = np.empty((2, p, q), kind)
    out = np.zeros((p, q), kind)
    for i in range(1, rows + 1):
        lo, hi = max(1, i - reach), min(cols + 1, i + reach)
        row[lo - 1] = never
        for j in range(lo, hi):
            np.bitwise_xor(x[i - 1, :, None], y[j - 1], out=step)
            np.minimum(step, 1, out=step)
            step += prev[j - 1]
            np.minimum(prev[j], row[j - 1], out=side)
            side += 1
            np.minimum(step, side, out=row[j])
            if j - i in beyond:
                np.maximum(row[j], beyond[j - i], out=row[j])
        row[hi : hi + 1] = never
        done = np.flatnonzero(n == i)
        out[done] = row[m, done[:, None], np.arange(q)]
        prev, row = row, prev
    return out


def edit_table(x: pa.Array, y: pa.Array, band: float = 0.1) -> np.ndarray:
    """:func:`edit_distances` of all sequences of x from all of y, as a matrix with a row for each x: tiles of sequences of like length, in whole numbers."""
    fx, fy = x.flatten(), y.flatten()
    codes = pa.concat_arrays([fx, fy]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    codes = np.nan_to_num(codes, nan=-1).astype(np.int64) + 3  # a null is like a null; 0 and 1 are places behind the end
    a, n = _matrix(x, codes[: len(fx)], 0)
    c, m = _matrix(y, codes[len(fx) :], 1)
    out = np.full((len(n), len(m)), np.nan)
    rows, cols = (np.argsort(v, kind="stable")[np.count_nonzero(v == 0) :] for v in (n, m))
    if not len(rows) or not len(cols):
        return out
    kind = np.int16 if max(codes.max(), n.max() + m.max()) < 1 << 13 else np.int32
    tall = 2 * TALL  # numbers are a quarter as wide
    broad = max(1, min(BROAD, (CELLS << 4) // (int(m.max()) * tall)))
    for lo in range(0, len(rows), tall):
        i = rows[lo : lo + tall]
        mine = np.ascontiguousarray(a[i, : n[i].max(), 0].T, kind)
        for at in range(0, len(cols), broad):
            j = cols[at : at + broad]
            theirs = np.ascontiguousarray(c[j, : m[j].max(), 0].T, kind)
            out[np.ix_(i, j)] = _edit_tile(mine, theirs, n[i], m[j], band) / (n[i][:, None] * m[j])
    return out


def _edit_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, band: float) -> np.ndarray:
    """Edits of pairs of columns of x and y, as :func:`_edit_tile` has them."""
    (rows, b), cols, kind = x.shape, len(y), x.dtype
    never = kind.type(np.iinfo(kind).max // 2)
    width = _band(n, m, band)
    reach, least = int(width.max()), int(width.min())
    beyond = {t: np.where(width >= max(-t, t + 1), 0, never).astype(kind) for t in range(-reach, reach) if least < max(-t, t + 1)}
    prev, row = np.full((2, cols + 1, b), never)
    prev[0] = 0
    step, side = np.empty((2, b), kind)
    out = np.zeros(b, kind)
    for i in range(1, rows + 1):
        lo, hi = max(1, i - reach), min(cols + 1, i + reach)
        row[lo - 1] = never
        for j in range(lo, hi):
            np.bitwise_xor(x[i - 1], y[j - 1], out=step)
            np.minimum(step, 1, out=step)
            step += prev[j - 1]
            np.minimum(prev[j], row[j - 1], out=side)
            side += 1
            np.minimum(step, side, out=row[j])
            if j - i in beyond:
                np.maximum(row[j], beyond[j - i], out=row[j])
        row[hi : hi + 1] = never
        done = np.flatnonzero(n == i)
        out[done] = row[m[done], done]
        prev, row = row, prev
    return out


def edit_some(x: pa.Array, y: pa.Array, band: float = 0.1):
    """A function of places (i, j) that gives :func:`edit_distances` of rows i of x from rows j of y: pairs of like lengths together, in whole numbers."""
    fx, fy = x.flatten(), y.flatten()
    codes = pa.concat_arrays([fx, fy]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    codes = np.nan_to_num(codes, nan=-1).astype(np.int64) + 3  # as in edit_table
    a, n = _matrix(x, codes[: len(fx)], 0)
    c, m = _matrix(y, codes[len(fx) :], 1)
    kind = np.int16 if max(codes.max(initial=0), n.max(initial=0) + m.max(initial=0)) < 1 << 13 else np.int32
    a, c = (np.ascontiguousarray(v[:, :, 0].T, kind) for v in (a, c))
    most = max(1, min(TOGETHER, (CELLS << 4) // (int(m.max(initial=0)) + 1)))

    def distances(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.full(len(i), np.nan)
        full = np.flatnonzero((n[i] > 0) & (m[j] > 0))
        full = full[np.lexsort((m[j[full]], n[i[full]]))]
        for lo in range(0, len(full), most):
            at = full[lo : lo + most]
            p, q = n[i[at]], m[j[at]]
            out[at] = _edit_pairs(a[: p.max(), i[at]], c[: q.max(), j[at]], p, q, band) / (p * q)
        return out

    return distances


@dataclass(frozen=True)
class Edited:
    """:func:`edit_distances` with its band, of pairs (as a call) or of whole tables."""

    band: float = 0.1

    def __call__(self, x, y) -> np.ndarray:
        return edit_distances(x, y, self.band)

    def table(self, x: pa.Array, y: pa.Array) -> np.ndarray:
        return edit_table(x, y, self.band)


@dataclass(frozen=True)
class Warped:
    """:func:`warped_distances` with its settings, of pairs (as a call) or of whole tables."""

    dim: int = 1
    squared: bool = True
    band: float = 0.1
    gap: float = 0.0

    def __call__(self, x, y) -> np.ndarray:
        return warped_distances(x, y, self.dim, self.squared, self.band, self.gap)

    def table(self, x: pa.Array, y: pa.Array) -> np.ndarray:
        return warped_table(x, y, self.dim, self.squared, self.band, self.gap)

    def rough(self, x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        return rough_table(x, y, self.dim, self.squared, self.band, self.gap)

    def some(self, x: pa.Array, y: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return warped_some(x, y, i, j, self.dim, self.squared, self.band, self.gap)


def _side_bounds(a, n, c, m, i, j, back: int, ahead: int, squared: bool) -> np.ndarray:
    """Least cost of the inner places of a row's series, each against the box of what it may meet: places from ``back`` before it to ``ahead`` behind it."""
    rows, cols, dim = int(n[i].max()), c.shape[1], a.shape[2]
    out = np.zeros(len(i))
    inside = np.arange(cols)[None, :, None] < m[:, None, None]
    least = max(1, CELLS // max(1, rows * dim))
    some = np.unique(j)
    for at in range(0, len(some), least):
        part = some[at : at + least]
        low, high = np.where(inside[part], c[part], np.inf), np.where(inside[part], c[part], -np.inf)
        box = [np.stack([f(v[:, max(0, p - back) : max(1, p + ahead + 1)], axis=1) for p in range(rows)], 1) for f, v in ((np.min, low), (np.max, high))]
        mine = np.flatnonzero((j >= part[0]) & (j <= part[-1]))
        for lo in range(0, len(mine), least):
            pair = mine[lo : lo + least]
            of = np.searchsorted(part, j[pair])
            x = a[i[pair], :rows]
            place = np.arange(rows)
            inner = (place > 0) & (place < n[i[pair], None] - 1)
            beyond = np.where(inner[:, :, None], np.maximum(np.maximum(box[0][of] - x, x - box[1][of]), 0), 0)
            cost = (beyond * beyond).sum(2)
            out[pair] = (cost if squared else np.sqrt(cost)).sum(1)
    return out


def warp_bounds(x: pa.Array, y: pa.Array, i: np.ndarray, j: np.ndarray, dim: int = 1, squared: bool = True, band: float = 0.1) -> np.ndarray:
    """A lower bound of :func:`warped_distances` of pairs of rows, for any ``gap`` that isn't negative.

    A path meets every place of either series inside the band, so a place costs at
    least its distance from the box around what it may meet; the first and the last
    places meet each other. The larger of both sides' sums. Pairs with an empty
    series have the bound 0.
    """
    a, n = _matrix(x, x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, dim)
    c, m = _matrix(y, y.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0, dim)
    out = np.zeros(len(i))
    full = np.flatnonzero((n[i] > 0) & (m[j] > 0))
    if not len(full):
        return out
    width = np.full(len(full), max(a.shape[1], c.shape[1])) if squared else _band(n[i[full]], m[j[full]], band)
    for w in np.unique(width).tolist():
        at = full[width == w]
        ia, jc = i[at], j[at]
        sides = (_side_bounds(a, n, c, m, ia, jc, w, w - 1, squared), _side_bounds(c, m, a, n, jc, ia, w - 1, w, squared))
        ends = []
        for p, q in ((0 * ia, 0 * jc), (n[ia] - 1, m[jc] - 1)):
            d = a[ia, p] - c[jc, q]
            d = (d * d).sum(1)
            ends.append(d if squared else np.sqrt(d))
        whole = np.maximum(*sides) + ends[0] + np.where((n[ia] > 1) | (m[jc] > 1), ends[1], 0)
        out[at] = whole if squared else whole / (n[ia] * m[jc])
    return out


def edit_distance(x: Column, y: Column, band: float = 0.1) -> Column:
    """:func:`edit_distances` of two columns of symbol arrays."""

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(edit_distances(a, b, band), from_pandas=True)

    return distance(x, y)


def dtw(x: Column, y: Column, dim: int = 1, squared: bool = True, band: float = 0.1, gap: float = 0.0) -> Column:
    """:func:`warped_distances` of two columns of number arrays."""

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(warped_distances(a, b, dim, squared, band, gap), from_pandas=True)

    return distance(x, y)


def edit_distance_expr(x: Column, y: Column) -> Column:
    """The same edit distance as a nested fold, without Python; for short sequences."""
    n, m = F.size(x), F.size(y)
    width = F.greatest((F.greatest(n, m) * 0.1).cast("int"), F.abs(n - m)) + 2
    inf = F.lit(float("inf"))

    def row(prev: Column, i: Column) -> Column:
        def cell(cells: Column, j: Column) -> Column:
            cost = F.when(F.element_at(x, i) == F.element_at(y, j), 0.0).otherwise(1.0)
            best = F.least(F.element_at(prev, j + 1) + 1, F.element_at(cells, j) + 1, F.element_at(prev, j) + cost)
            return F.array_append(cells, F.when((j >= i - width) & (j < i + width), best).otherwise(inf))

        return F.aggregate(F.sequence(F.lit(1), m), F.array(inf), cell)

    start = F.concat(F.array(F.lit(0.0)), F.transform(F.sequence(F.lit(1), m), lambda _: inf))
    rows = F.aggregate(F.sequence(F.lit(1), n), start, row)
    return F.when((n > 0) & (m > 0), F.element_at(rows, m + 1) / (n * m))
