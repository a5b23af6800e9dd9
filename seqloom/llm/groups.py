"""Attach per-group facts to rows when a few groups may hold a large part of all rows."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups with more than 1/HOT of all rows are hot; there can be at most HOT of them.
HOT = 1000


def attach(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` with ``groups`` (one row a key, with the number of its rows in ``size``); ``how`` is left or inner.

    Hot groups are broadcast (fewer than HOT rows, whatever the input), so that
    no shuffle deals a third of all rows to one task; the rest joins on the key.
    """
    edge = total // HOT
    keys = [key] if isinstance(key, str) else key
    hot, cold = groups.filter(F.col(size) > edge), groups.filter(F.col(size) <= edge)
    found = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return found.unionByName(rest)


#: Rows of whole texts that go to a Python worker at once.
TEXT_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def for_texts(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches small enough for whole texts, unless it asks for smaller ones itself."""
    if int(spark.conf.get(_BATCH)) > TEXT_ROWS:
        spark.conf.set(_BATCH, str(TEXT_ROWS))
    return spark


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows at most for jobs run inside, where rows are wide."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
