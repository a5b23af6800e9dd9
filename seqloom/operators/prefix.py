"""Running totals over a whole ordered table without a one-task sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqloom.operators.packed import unpacked
from seqloom.storage import store


def running_total(df: DataFrame, order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` (long, or double where that is its type) over all rows that sort before this one.

    Rows are dealt into ranges of ``order`` (ascending, nulls first), summed
    inside each range, and shifted by the totals of the ranges before, of which
    there are as many as partitions. ``df`` is read twice (bounds are sampled
    first), so pass a stored table. Null values count as 0; rows that tie on
    ``order`` get an unspecified order among themselves; an empty table stays
    empty. Names ``_sl_part`` and ``_sl_before`` are reserved.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = T.DoubleType() if isinstance(df.schema[value].dataType, T.DoubleType) else T.LongType()
    arrow = pa.float64() if isinstance(kind, T.DoubleType) else pa.int64()
    schema = T.StructType([*df.schema.fields, T.StructField("_sl_part", T.IntegerType()), T.StructField("_sl_before", kind)])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(value).cast(arrow).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(v) + total
            names = [*b.schema.names, "_sl_part", "_sl_before"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(ends - v)], names=names)
            total = ends[-1] if len(v) else total

    ranged = df.repartitionByRange(n, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    summed = store(ranged.mapInArrow(inside, schema), "ranges")
    ends = summed.groupBy("_sl_part").agg(F.max(F.col("_sl_before") + F.coalesce(F.col(value).cast(kind), F.lit(0).cast(kind))).alias("_sl_end"))
    before = Window.orderBy("_sl_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.select("_sl_part", F.coalesce(F.sum("_sl_end").over(before), F.lit(0).cast(kind)).alias("_sl_shift"))
    return (
        summed.join(F.broadcast(shift), "_sl_part")
        .withColumn(out, F.col("_sl_before") + F.col("_sl_shift"))
        .drop("_sl_part", "_sl_before", "_sl_shift")
    )


def running_total_in(df: DataFrame, part: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``part`` that sort before this one.

    The order runs over all parts, so a part with a third of all rows is dealt over
    many ranges; a part's total starts where the parts before it end.
    """
    stored = store(df, "parts")
    total = running_total(stored, [part, *order], value, "_sl_all")
    starts = total.groupBy(F.col(part).alias("_sl_of")).agg(F.min("_sl_all").alias("_sl_first"))
    return total.join(starts, F.col(part).eqNullSafe(F.col("_sl_of"))).withColumn(out, F.col("_sl_all") - F.col("_sl_first")).drop("_sl_all", "_sl_of", "_sl_first")


def rank_in(df: DataFrame, part: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the rank from 0 among the rows of the same ``part``; ``order`` should leave no ties."""
    return running_total_in(df.withColumn("_sl_one", F.lit(1)), part, order, "_sl_one", out).drop("_sl_one")


def number_in(df: DataFrame, part: str, cell, order: list[str], out: str) -> DataFrame:
    """As :func:`rank_in`, where a part's rows lie in cells (a day of a time, say) that follow each other in ``order`` and hold few rows each.

    Rows are ordered inside cells; of a whole part only the cells' counts are. So
    nothing is stored, at the price of a guess about the cells.
    """
    named = df.withColumn("_sl_cell", cell)
    counts = named.groupBy(F.col(part).alias("_sl_of"), F.col("_sl_cell").alias("_sl_at")).agg(F.count("*").alias("_sl_n"))
    before = Window.partitionBy("_sl_of").orderBy("_sl_at").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_sl_of", "_sl_at", F.coalesce(F.sum("_sl_n").over(before), F.lit(0)).alias("_sl_first"))
    placed = named.withColumn("_sl_row", F.row_number().over(Window.partitionBy(part, "_sl_cell").orderBy(*order)) - 1)
    joined = placed.join(first, F.col(part).eqNullSafe(F.col("_sl_of")) & F.col("_sl_cell").eqNullSafe(F.col("_sl_at")))
    return joined.withColumn(out, F.col("_sl_first") + F.col("_sl_row")).drop("_sl_cell", "_sl_of", "_sl_at", "_sl_first", "_sl_row")


#: Bits that each pass of :func:`values_at` adds to what is known of a value.
DIGITS = (16, 12, 12, 12, 12)
#: Values that are looked at together, so that they stay in a core's cache.
CACHED = 1 << 15


def _ordered(values: np.ndarray) -> np.ndarray:
    """Longs or doubles as unsigned numbers of the same order; NaN comes last, and -0 is 0."""
    if values.dtype == np.int64:
        return values.view(np.uint64) ^ np.uint64(1 << 63)
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(number: int, whole: bool):
    if whole:
        return number - (1 << 63)
    bits = number ^ (1 << 63) if number >> 63 else number ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def values_at(df: DataFrame, value: str, ranks: list[int]) -> list:
    """The values at some ranks (from 0) among all values of a column of longs, doubles, arrays of them, or packed doubles; nulls, which come first, are None.

    Every pass counts how often the next bits occur behind those known so far, so
    that equal values, however many, are one count, and nothing is sorted. ``df``
    is read five times and should be stored; ranks are few and must exist.
    """
    kind = df.schema[value].dataType
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    packed = isinstance(kind, T.BinaryType)
    whole = isinstance(kind, (T.LongType, T.IntegerType))
    arrow = pa.int64() if whole else pa.float64()

    def counts(known: np.ndarray, done: int, width: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, nulls = np.zeros(max(len(known), 1) << width, np.int64), 0
            for b in batches:
                v = b.column(0)
                v = v.flatten() if pa.types.is_list(v.type) else pa.array(unpacked(v)) if packed else v
                nulls += v.null_count
                numbers, found = v.drop_null().cast(arrow).to_numpy(zero_copy_only=False), []
                for lo in range(0, len(numbers), CACHED):
                    x = _ordered(numbers[lo : lo + CACHED])
                    at = np.zeros(len(x), np.int64)
                    if done:
                        head = x >> np.uint64(64 - done)
                        at = np.minimum(np.searchsorted(known, head), len(known) - 1)
                        same = known[at] == head
                        x, at = x[same], at[same]
                    digit = (x >> np.uint64(64 - done - width)) & np.uint64((1 << width) - 1)
                    found.append((at << width) + digit.astype(np.int64))
                if found:
                    total += np.bincount(np.concatenate(found), minlength=len(total))
            codes = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(codes, -1)), pa.array(np.append(total[codes], nulls))], names=["code", "n"])

        return count

    heads, left, done = [0] * len(ranks), list(ranks), 0
    out: list = [None] * len(ranks)
    for width in DIGITS:
        known = np.unique(np.array(heads, np.uint64))
        # a row for each of the next bits that occur: 2 ** 16, or 2 ** 12 for each rank, at most
        found = df.select(value).mapInArrow(counts(known, done, width), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow().sort_by("code")
        codes, n = found["code"].to_numpy(), found["n"].to_numpy()
        nulls, codes, n = (int(n[0]) if len(n) else 0), codes[1:], n[1:]
        if not done:
            left = [r - nulls for r in left]
        for i, r in enumerate(left):
            if r < 0:
                continue
            here = (codes >> width) == int(np.searchsorted(known, np.uint64(heads[i])))
            ends = np.cumsum(n[here])
            at = int(np.searchsorted(ends, r, "right"))
            left[i] = r - (int(ends[at - 1]) if at else 0)
            heads[i] = (heads[i] << width) | (int(codes[here][at]) & ((1 << width) - 1))
        done += width
    for i, r in enumerate(left):
        out[i] = None if r < 0 else _value(heads[i], whole)
    return out


def at_ranks(df: DataFrame, value: str, ranks: DataFrame) -> DataFrame:
    """The columns of ``ranks`` (a few rows with ``rank``, from 0) with the value of that rank among all rows, nulls first, as ``at``. ``df`` should be stored."""
    n = df.count()
    asked = [r for r in ranks.collect() if r["rank"] < n]
    values = values_at(df, value, [r["rank"] for r in asked]) if asked else []
    schema = T.StructType([*ranks.schema.fields, T.StructField("at", df.schema[value].dataType)])
    return df.sparkSession.createDataFrame([(*r, v) for r, v in zip(asked, values, strict=True)], schema)


def percentile_values(df: DataFrame, value: str, percents: list[int]) -> list[float]:
    """Exact percentiles of a column of doubles, or of the elements of its arrays, interpolated between the two nearest ranks. Nulls have none."""
    kind = df.schema[value].dataType
    size = F.sum(F.size(value)) if isinstance(kind, T.ArrayType) else F.sum(F.octet_length(value) / 8).cast("long") if isinstance(kind, T.BinaryType) else F.count(value)
    n = df.agg(size.alias("n")).first().n or 0
    if not n:
        return []
    places = [(n - 1) * p / 100 for p in percents]
    ranks = sorted({int(x) for x in places} | {min(int(x) + 1, n - 1) for x in places})
    at = dict(zip(ranks, values_at(df, value, ranks), strict=True))

    def between(x: float) -> float:
        a, b, t = at[int(x)], at[min(int(x) + 1, n - 1)], x - int(x)
        if a == b or t == 0:
            return a
        if np.isinf(b):
            return b
        return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)

    return [between(x) for x in places]


def percentiles(df: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """percent and dist: exact percentiles, interpolated between the two nearest ranks, without sorting or gathering the values. Nulls don't count; an empty table has none."""
    values = percentile_values(df.filter(F.col(value).isNotNull()), value, percents)
    return df.sparkSession.createDataFrame(list(zip(percents, values, strict=False)), "percent long, dist double")


def consecutive(df: DataFrame, order: str, key: str, out: str) -> DataFrame:
    """Add ``out``, the number from 0 of the run of rows with one ``key`` (null is a key too) that follow each other in ``order``, which must be distinct.

    A row finds its predecessor by rank, so no task orders the whole table.
    """
    stored = store(df, "ordered")
    ranked = store(running_total(stored.withColumn("_sl_one", F.lit(1)), [order], "_sl_one", "_sl_at").drop("_sl_one"), "numbered")
    before = ranked.select((F.col("_sl_at") + 1).alias("_sl_next"), F.col(key).alias("_sl_key"))
    fresh = F.when(F.col("_sl_next").isNotNull() & F.col(key).eqNullSafe(F.col("_sl_key")), 0).otherwise(1)
    turned = ranked.join(before, F.col("_sl_at") == F.col("_sl_next"), "left").withColumn("_sl_new", fresh).drop("_sl_next", "_sl_key")
    total = running_total(store(turned, "turned"), [order], "_sl_new", "_sl_runs")
    return total.withColumn(out, F.col("_sl_runs") + F.col("_sl_new") - 1).drop("_sl_runs", "_sl_new", "_sl_at")
