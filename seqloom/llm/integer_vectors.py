"""Vectors as whole numbers: each component x, as double, stands for floor(256 * x)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Whole-number steps to one.
SCALE = 256
#: Sums below this are exact in doubles.
EXACT = 2.0**53
#: The largest double that is a long.
_TOP = np.nextafter(2.0**63, 0)


def finite(vector: str):
    """Vectors that are not null and hold no null and no non-finite component."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def whole(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of longs) for each length of vector; what no long can hold becomes the nearest long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.clip(np.floor(SCALE * flat), -(2.0**63), _TOP).astype(np.int64)
    ends = np.cumsum(n)
    return [(at := np.flatnonzero(n == k), flat[(ends[at] - k)[:, None] + np.arange(k)]) for k in np.unique(n)]


def largest(x: np.ndarray) -> float:
    """The largest absolute value, 0 if there is none."""
    return float(np.abs(x.astype(np.float64)).max(initial=0))


def clipped(x: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as longs, the nearest one where they don't fit."""
    return np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in x.ravel()], np.int64).reshape(x.shape)
