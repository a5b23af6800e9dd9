"""Windows over frames: sliding, splitting, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators.prefix import running_total_in

#: Frames of a recording that one task sees together.
STRETCH = 4_096


def sliding(df: DataFrame, length: str, size: int, hop: int) -> DataFrame:
    """A row for each window of ``size`` frames: win_id, start, stop. Ends lie below the length, so a tail (and the window at the very end) is dropped."""
    ends = F.when(F.col(length) > size, F.sequence(F.lit(size).cast("long"), F.col(length).cast("long") - 1, F.lit(hop).cast("long")))
    out = df.select("*", F.posexplode(ends).alias("win_id", "stop"))
    return out.withColumn("win_id", F.col("win_id").cast("long")).withColumn("start", F.col("stop") - size)


def split_regions(df: DataFrame, length: str, size: int, hop: int) -> DataFrame:
    """Regions (start, stop) of a recording: all of it if shorter than ``size``, else as :func:`sliding`."""
    n = F.col(length).cast("long")
    ends = F.when(n > size, F.sequence(F.lit(size).cast("long"), n - 1, F.lit(hop).cast("long")))
    regions = F.when(n < size, F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("stop")))).otherwise(F.transform(ends, lambda e: F.struct((e - size).alias("start"), e.alias("stop"))))
    return df.select("*", F.explode(regions).alias("_region")).select(*df.columns, "_region.start", "_region.stop")


def tumbling(df: DataFrame, t: str, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(t) / size).cast("long"))


def with_halo(df: DataFrame, t: str, before: int, after: int, width: int = STRETCH) -> DataFrame:
    """Rows dealt into stretches of ``width`` numbers ``t``, each with the ``before`` rows ahead of it and the ``after`` rows behind it.

    Adds ``_stretch``, to be a key of windows that reach no further, and ``_own``,
    false for a row that another stretch owns. ``t`` must number the rows of a part
    without gaps, so that a long recording is dealt over many tasks.
    """
    of = lambda c: F.floor(c / width).cast("long")
    dealt = df.withColumn("_stretch", F.explode(F.sequence(of(F.col(t) - after), of(F.col(t) + before))))
    return dealt.withColumn("_own", F.col("_stretch") == of(F.col(t)))


def own(df: DataFrame) -> DataFrame:
    """The rows of :func:`with_halo` that their stretch owns, after windows have looked at the others."""
    return df.filter("_own").drop("_stretch", "_own")


def _span(part: str | list[str], order: list[str]):
    return Window.partitionBy(part).orderBy(*order)


def smooth_same(value: Column, part: str | list[str], order: list[str], weights: list[float]) -> Column:
    """Convolution of the same length: frame t sees len//2 frames before it and the rest after; frames outside count as 0."""
    k = len(weights)
    w, out = _span(part, order), F.lit(0.0)
    for j, weight in enumerate(weights):
        # weights are symmetric, so direction doesn't matter
        out = out + F.coalesce(F.lag(value, k // 2 - j).over(w), F.lit(0.0)) * weight
    return out


def box(k: int) -> list[float]:
    return [1.0 / k] * k


def triangle(k: int) -> list[float]:
    """Triangular weights that add to 1."""
    raw = [(2 * n + 1) / k if k % 2 == 0 else 2 * (n + 1) / (k + 1) for n in range((k + 1) // 2)]
    raw += raw[::-1][k % 2 :]
    return [x / sum(raw) for x in raw]


def smoothed(df: DataFrame, value: str, part: str, t: str, weights: list[float], out: str, width: int = STRETCH) -> DataFrame:
    """Add ``out``, as :func:`smooth_same` says, for recordings of any length whose frames ``t`` numbers."""
    k = len(weights)
    halo = with_halo(df, t, k // 2, k - 1 - k // 2, width)
    return own(halo.withColumn(out, smooth_same(F.col(value), [part, "_stretch"], [t], weights)))


def moving_average(df: DataFrame, value: str, part: str, order: list[str], k: int, width: int = STRETCH) -> DataFrame:
    """Mean of the last k frames, which the one column of ``order`` numbers; the first k - 1 frames have none and are dropped."""
    (t,) = order
    last = _span([part, "_stretch"], [t]).rowsBetween(-(k - 1), 0)
    out = with_halo(df, t, k - 1, 0, width).withColumn("_n", F.count(F.lit(1)).over(last)).withColumn("average", F.avg(value).over(last))
    return own(out.filter(F.col("_n") == k)).drop("_n")


def running_offset(df: DataFrame, length: str, part: str, order: list[str]) -> DataFrame:
    """start and stop of each row when rows are laid end to end inside their part, however large a part is."""
    out = running_total_in(df, part, order, length, "start")
    return out.withColumn("stop", (F.col("start") + F.coalesce(F.col(length), F.lit(0))).cast("long"))
