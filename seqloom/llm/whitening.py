"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X (one for each distinct vector) are brought to the form
X V = U B, with orthonormal U and V and B upper bidiagonal, by products X v and
X' u in turn, each one pass over the stored rows. New columns are made orthogonal
to all earlier ones, twice. The right singular vectors of the small B, turned by
V, are the components; its singular values give their deviations.

The columns of U are as long as the table. None is stored: each is X times a
short vector, so a task makes its rows' entries anew, and all that leaves a task
are sums as long as a vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.integer_vectors import clipped, finite, largest, whole
from seqloom.storage import store

#: Residuals and norms below this part of the largest singular value count as none.
TINY = 1e-13
#: Rows whose products are held at once.
ROWS = 4_096
#: Seed of the first direction, and of new ones where the rows that are left have no part in any.
SEED = 20_011


@dataclass
class Whitening:
    """Size and sums of the fit list, components as columns, their eigenvalues, the trace, and the identity error of the fit list."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact while longs hold it; else as whole numbers of any size."""
    if n * largest(x) + largest(sums) < 2.0**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums.astype(object)


class Rows:
    """The fit list as a stored table of vectors, and passes over it."""

    def __init__(self, table: DataFrame, dim: int, n: int, sums: np.ndarray):
        self.table, self.dim, self.n, self.sums = table, dim, n, sums
        self.passes = 0

    def sum_of(self, f, width: int, **data) -> np.ndarray:
        """The sum of f(centred rows, data), an array of ``width`` numbers at most, over all rows: one pass."""
        spark, n, sums = self.table.sparkSession, self.n, self.sums
        shared = spark.sparkContext.broadcast(data)  # as many numbers as a vector has, squared

        def part(batches):
            total = np.zeros(width)
            for b in batches:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                for lo in range(0, len(x), ROWS):
                    part_of = f((_centred(x[lo : lo + ROWS], n, sums) / n).astype(np.float64), shared.value)
                    total[: len(part_of)] += part_of
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["i", "v"])

        summed = self.table.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # width rows
        out = np.zeros(width)
        out[summed["i"].to_numpy()] = summed["v"].to_numpy()
        shared.unpersist()
        self.passes += 1
        return out


def _forward(x: np.ndarray, d: dict) -> np.ndarray:
    """What X w has in common with earlier columns of U."""
    return (x @ d["earlier"]).T @ (x @ d["w"])


def _back(x: np.ndarray, d: dict) -> np.ndarray:
    """X' X w, the square of X w, and what is still in common."""
    p = x @ d["w"]
    return np.concatenate([x.T @ p, [p @ p], (x @ d["earlier"]).T @ p])


def _fresh(rng: np.random.Generator, v: np.ndarray) -> np.ndarray:
    """A random unit vector orthogonal to the columns of v."""
    x = rng.normal(size=len(v))
    for _ in range(2):
        x -= v @ (v.T @ x)
        x /= np.linalg.norm(x)
    return x


def bidiagonalise(rows: Rows, count: int, trace: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` leading right singular vectors of the rows, as columns, and their singular values.

    ``trace`` is the sum of the squares of all entries of X. Steps end when the
    leading triples have no residual and what X has outside V is too little to hide
    a value as large as the last of them, and after as many steps as dimensions at
    the latest; then V is square and nothing is left outside. Where a product
    vanishes, a random direction orthogonal to V goes on, so that components of
    equal value are found too.
    """
    rng, d = np.random.default_rng(SEED), rows.dim
    v, w, b = np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))
    v[:, 0] = _fresh(rng, v[:, :0])
    top = 0.0
    for k in range(d):
        step = v[:, k] - (b[k - 1, k] * w[:, k - 1] if k else 0)
        # widths are the same in every step
        step = step - w @ rows.sum_of(_forward, d, w=step, earlier=w[:, :k])
        seen = rows.sum_of(_back, 2 * d + 1, w=step, earlier=w[:, :k])
        gram, square, again = seen[:d], seen[d], seen[d + 1 :]
        top = max(top, float(np.sqrt(max(square, 0))))
        alpha = np.sqrt(max(square - again @ again, 0))
        if alpha > TINY * top and alpha > 0:
            # what is still in common goes with its own image: X' u of every earlier column is V B'
            gram = (gram - v @ (b.T @ again)) / alpha
            w[:, k], b[k, k] = (step - w @ again) / alpha, alpha
        else:
            gram = np.zeros(d)
        if k + 1 == d:
            break
        r = gram - v[:, : k + 1] @ (v[:, : k + 1].T @ gram)
        r -= v[:, : k + 1] @ (v[:, : k + 1].T @ r)
        beta = float(np.linalg.norm(r))
        left, values, _ = np.linalg.svd(b[: k + 1, : k + 1])
        if k + 1 >= count and beta * np.abs(left[k, :count]).max() <= TINY * values[0] and trace - (values**2).sum() < (1 - 1e-6) * values[count - 1] ** 2:
            return _turned(v, b, k + 1, count)
        if beta > TINY * top:
            b[k, k + 1] = beta
            v[:, k + 1] = r / beta
        else:
            v[:, k + 1] = _fresh(rng, v[:, : k + 1])
    return _turned(v, b, d, count)


def _turned(v: np.ndarray, b: np.ndarray, k: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    _, values, right = np.linalg.svd(b[:k, :k])
    return v[:, :k] @ right[:count].T, values[:count]


def _gram(x: np.ndarray, d: dict) -> np.ndarray:
    y = x @ d["to"]
    return np.append((y.T @ y).ravel(), y.sum(0))


def _common_length(rows: DataFrame) -> int:
    """The length that most vectors have, the greater one of two that as many have; 0 if there is none."""
    top = rows.groupBy(F.size("embedding").alias("dim")).count().filter("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    return top.dim if top else 0


def _fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct whole-number vector (x) once."""

    def numbers(batches):
        for b in batches:
            for _, x in whole(b.column("embedding")):
                offs = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offs, pa.array(x.ravel()))], names=["x"])

    return rows.select("embedding").mapInArrow(numbers, "x array<long>").distinct()


def fit(usable: DataFrame, count: int = 4) -> Whitening | None:
    """The whitening of the distinct whole-number vectors among ``usable`` (embedding), all of one length; None where nothing varies."""
    dim = usable.select(F.size("embedding")).head()
    if dim is None:
        return None
    dim = dim[0]
    distinct = store(_fit_list(usable), "whole-vectors")
    n = distinct.count()
    total = distinct.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    sums = np.zeros(dim, object)
    for r in total:
        sums[r.pos] = int(r.s)
    rows = Rows(distinct, dim, n, sums)
    trace = float(rows.sum_of(lambda x, _: np.array([(x * x).sum()]), 1)[0])
    if trace <= 0:
        return None
    components, values = bidiagonalise(rows, min(count, dim), trace)
    values = values**2 / n
    real = values > TINY * values[0]
    found = Whitening(n, sums, components[:, real], values[real], trace / n)
    to = found.components / np.sqrt(found.values)
    k = to.shape[1]
    seen = rows.sum_of(_gram, k * k + k, to=to)
    mean = seen[k * k :] / n
    found.error = float(np.abs(seen[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return found


def whiten(rows: DataFrame, count: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every usable row.

    Null vectors, those with null or non-finite components, and those of another
    length than most have (of two equally frequent lengths the greater one counts)
    are left out; all-zero vectors take part. Rows that repeat an id, or have none,
    are whitened each for itself, and repeated vectors weigh once. Directions
    without variance are no components, so there may be fewer than ``count``, and
    none where all vectors are alike. Numbers that no long holds become the nearest
    one. Other columns are ignored; empty in, empty out.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding")).filter(finite("embedding"))
    dim = _common_length(known)
    known = known.filter(F.size("embedding") == dim)
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(known, count) if dim else None
    if found is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(found)  # count vectors

    def project(batches):
        f = shared.value
        k = f.components.shape[1]
        to = f.components / np.sqrt(f.values)
        for b in batches:
            for at, x in whole(b.column("embedding")):
                centred = _centred(x, f.n, f.sums)
                if largest(centred) ** 2 * x.shape[1] < 2.0**62:
                    deviation = (centred * centred).sum(1)
                else:
                    big = centred.astype(object)
                    deviation = clipped((big * big).sum(1))
                y = (centred / f.n).astype(np.float64) @ to
                m = len(at)
                each = lambda a, kind: pa.array(np.repeat(a, k), kind)  # noqa: E731, B023
                ids = b.column("id").take(pa.array(np.repeat(at, k)))
                tiled = [pa.array(np.tile(a, m), kind) for a, kind in ((np.arange(1, k + 1), pa.int32()), (f.values / f.trace, pa.float64()))]
                yield pa.RecordBatch.from_arrays([ids, tiled[0], each(np.full(m, f.n), pa.int64()), each(deviation, pa.int64()), pa.array(y.ravel()), tiled[1], each(np.full(m, f.error), pa.float64())], names=[c.split()[0] for c in schema.split(", ")])

    return known.mapInArrow(project, schema).withColumnRenamed("id", id_col)
