"""Run-length tokens, merged annotations, n-gram postings and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.sequences import silence_class
from seqloom.operators.windows import STRETCH, own, with_halo


def run_tokens(frames: DataFrame, part: str = "rec", order: str = "t", symbol: str = "cid", short: int = 35, middle: int = 80, width: int = STRETCH) -> DataFrame:
    """Maximal runs of equal symbols as half-open tokens: part, run, symbol, start, stop, cls (silences, symbol 0, are named by length).

    Runs are found inside stretches of ``width`` frames, then those that a cut
    parted become one: a stretch's first run has the number of the last before it,
    or the next. What is ordered for a whole recording is a row a stretch.
    """
    cut = frames.withColumn("_stretch", F.floor(F.col(order) / width).cast("long"))
    w = Window.partitionBy(part, "_stretch").orderBy(order)
    turn = F.when(F.row_number().over(w) == 1, 0).when(F.lag(symbol).over(w).eqNullSafe(F.col(symbol)), 0).otherwise(1)
    local = cut.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a run has one symbol; min, unlike first, lets filters on the part pass through to the scan
    rest = [F.min(c).alias(c) for c in frames.columns if c not in (part, order, symbol)]
    runs = local.groupBy(part, "_stretch", "_run").agg(F.min(symbol).alias(symbol), F.min(order).cast("long").alias("start"), (F.max(order) + 1).cast("long").alias("stop"), *rest)
    ends = runs.groupBy(F.col(part).alias("_of"), F.col("_stretch").alias("_at")).agg(F.max("_run").alias("_last"), F.min_by(symbol, "_run").alias("_first"), F.max_by(symbol, "_run").alias("_end"))
    s = Window.partitionBy("_of").orderBy("_at")
    fresh = F.when(F.lag("_at").over(s).isNull() | F.lag("_end").over(s).eqNullSafe(F.col("_first")), 0).otherwise(1)
    steps = ends.withColumn("_step", fresh + F.lag("_last", 1, 0).over(s)).withColumn("_base", F.sum("_step").over(s.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col(part).eqNullSafe(F.col("_of")) & F.col("_stretch").eqNullSafe(F.col("_at"))
    whole = runs.join(steps.select("_of", "_at", "_base"), same).withColumn("run", F.col("_base") + F.col("_run"))
    out = whole.groupBy(part, "run").agg(F.min(symbol).alias(symbol), F.min("start").alias("start"), F.max("stop").alias("stop"), *rest)
    name = F.col("cls") if "cls" in frames.columns else F.col(symbol).cast("string")
    length = F.col("stop") - F.col("start")
    return out.withColumn("cls", F.when(F.col(symbol) == 0, silence_class(length, short, middle)).otherwise(name))


def merge_annotations(df: DataFrame, part: str, start: str = "start", stop: str = "stop", label: str = "label", value: str = "ll") -> DataFrame:
    """Neighbours of one label merge where one begins no later than its predecessor ends; their values add up."""
    w = Window.partitionBy(part).orderBy(start, stop)
    joins = (F.col(start) <= F.lag(stop).over(w)) & (F.col(label) == F.lag(label).over(w))
    islands = df.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(stop, F.struct(start, stop))  # the last row's end, not the furthest
    return islands.groupBy(part, "island").agg(F.min(start).alias(start), last.alias(stop), F.min(label).alias(label), F.sum(value).alias(value))


def postings(sequences: DataFrame, grams, seq_id: str = "seq_id", name: str = "gram") -> DataFrame:
    """gram, sequence, number of occurrences: the flat inverted index."""
    return sequences.select(F.col(seq_id), F.explode(grams).alias(name)).groupBy(name, seq_id).agg(F.count("*").alias("n_occ"))


def transitions(tokens: DataFrame, part: str = "rec", order: str = "start", cls: str = "cls", number: str | None = None) -> DataFrame:
    """Counts of neighbouring symbols; all silences are ``_``. With ``number``, which numbers a part's tokens without gaps, long parts are dealt over many tasks."""
    folded = tokens.withColumn("prev", F.when(F.col(cls).startswith("_"), "_").otherwise(F.col(cls)))
    if number is None:
        pairs = folded.withColumn("next", F.lead("prev").over(Window.partitionBy(part).orderBy(order)))
    else:
        pairs = own(with_halo(folded, number, 0, 1).withColumn("next", F.lead("prev").over(Window.partitionBy(part, "_stretch").orderBy(number))))
    return pairs.filter(F.col("next").isNotNull()).groupBy("prev", "next").agg(F.count("*").alias("n"))
