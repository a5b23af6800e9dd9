"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words, and every document an expected number of
copies in proportion to its weight, so that the words expected of a source add up
to its target. A document first gets the whole copies that are certain; what is
left of its expectation is its inclusion probability. Documents are ranked by
random odds divided by inclusion odds, and the sample is the head of that order,
its fixed size counted in words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.groups import attach
from seqloom.operators.prefix import running_total, running_total_in
from seqloom.storage import store

#: The weights of sources in order of name, repeating.
WEIGHTS = (1, 2, 3)
#: No source's target and no document's copies go beyond so many times its size.
MOST_COPIES = 3
#: A sample that misses its words by more than this part of its source's target is mended further down the order.
NEAR = 0.01
#: A null source is a key of its own.
KEY = ["_no_source", "_source"]


def words_in(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Add ``target`` to one row a source (source, source_size): shares of the total by weight, capped and reshared.

    A source is capped when the level (words a unit of weight) would give it more
    than ``most`` times its size. Sources are capped in order of size over weight,
    so the level is found from running sums over the sources in that order.
    """
    # one task sees one row a source, never the documents
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    s = s.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_used", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    s = s.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("_weight").over(everything))
    # the level if all sources before this one are capped and this one isn't
    s = s.withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.col("_weights") - F.col("_used")))
    s = s.withColumn("_open", F.col("_level") * F.col("_weight") <= F.col("_cap"))
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_used"), F.col("_level")))).over(everything)["_level"]
    return s.withColumn("target", F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_weight")))).select("source", "source_size", "target")


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 17, weight_col: str | None = None, row_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, expected (copies), copies and taken (copies times size) of every row.

    A document of weight w in a source is expected target * w / (sum of w * size)
    times, so that expected words add up to the target; without ``weight_col`` all
    weigh the same, and short and long documents are taken alike. Expectations stop
    at MOST_COPIES. Whole copies are certain, the fraction that is left is the
    document's inclusion probability in the sample of fixed size.

    Documents are taken whole: the sample ends with the document that brings its
    words closest. Where that misses by more than NEAR of the target, because a long
    document lies at the end of a small source's sample, the sample ends before it and
    goes on down the order with documents of half the missing words at most, and then
    with the first one that ends within NEAR, else with the one that ends closest; a
    sample of most of its source does the same, from the other end, with what it omits.
    So long documents at the end of a small source's sample are taken less often than
    stated; samples whose documents are short beside the target aren't touched. Where
    no document is left that helps, the miss stays.

    The order depends on the id and the seed alone, so reruns agree; rows that share
    an id and a size are interchangeable. A null or empty text has size 0 and is taken
    as often as the whole copies say, which adds no word. A null source is a
    source of its own, the last; a null or negative weight counts as 0. ``row_col``,
    a distinct number of each row, is handed on and orders rows that tie. Other
    columns are ignored; empty in, empty out.
    """
    row = [row_col] if row_col else []
    unit = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    keys = [F.col(source_col).isNull().alias("_no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source")]
    sizes = store(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *keys, words_in(F.col(text_col)).alias("size"), unit.alias("_u"), weight.alias("_w"), *row), "sizes")
    sums = store(sizes.groupBy("source", *KEY).agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_w")).alias("_weighted"), F.count("*").alias("_rows")), "sources")
    n = sums.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    of = targets(sums.select("source", "source_size"), weights).select(F.col("source").alias("_s"), "target")
    # where a source starts in the running total over all sources
    start = F.coalesce(F.sum("source_size").over(Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of = store(sums.withColumn("_start", start).join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source"), "targets")
    rows = attach(sizes, of, KEY, "_rows", n, "inner")
    expected = F.when(F.col("_weighted") > 0, F.least(F.col("target") * F.col("_w") / F.col("_weighted"), F.lit(float(MOST_COPIES)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("expected", expected).withColumn("_certain", F.floor(F.col("expected") + 1e-12).cast("long"))
    rows = rows.withColumn("_chance", F.greatest(F.col("expected") - F.col("_certain"), F.lit(0.0)))
    odds = F.when(F.col("_chance") > 1e-12, F.col("_chance") / (1 - F.col("_chance"))).otherwise(F.lit(1e-12))
    rows = rows.select("doc_id", "source", *KEY, "size", "source_size", "target", "expected", "_certain", "_chance", "_start", ((F.col("_u") / (1 - F.col("_u"))) / odds).alias("_rank"), *row)
    rows = store(rows, "ranked")
    # the words that the sample of each source is to have
    rest = rows.groupBy(*KEY).agg(F.sum(F.col("_chance") * F.col("size")).alias("_rest"), F.count("*").alias("_rows"))
    ranked = attach(running_total(rows, ["source", "_rank", "doc_id", "size", *row], "size", "_before"), store(rest, "rests"), KEY, "_rows", n, "inner")
    before, can = F.col("_before") - F.col("_start"), (F.col("size") > 0) & (F.col("_chance") > 1e-12) & (F.col("_rest") > 1e-6)
    ranked = ranked.withColumn("_can", can).withColumn("_fits", can & (before + F.col("size") <= F.col("_rest"))).withColumn("_in", can & (before + F.col("size") / 2.0 <= F.col("_rest"))).withColumn("_beyond", can & (before >= F.col("_rest")))
    drawn = _mended(store(ranked.withColumn("_at", F.monotonically_increasing_id()), "drawn"), n)
    copies = F.col("_certain") + F.col("_in").cast("long")
    return drawn.select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", "expected", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *row)


def _mended(drawn: DataFrame, n: int) -> DataFrame:
    """Change ``_in`` of the last documents of samples that miss by more than NEAR of the target.

    A sample of more than half of its source's words is mended by what it leaves
    out, from the other end of the order. What is read again are the documents of
    such sources alone, which are those whose targets are short beside a document.
    """
    words = lambda taken: F.sum(F.when(F.col(taken), F.col("size")).otherwise(0))
    heads = drawn.groupBy(*KEY).agg(words("_in").alias("_got"), words("_fits").alias("_fit"), words("_beyond").alias("_past"), words("_can").alias("_all"), F.first("_rest").alias("_of"), F.first("target").alias("_goal"), F.count("*").alias("_rows"))
    far = heads.filter(F.abs(F.col("_got") - F.col("_of")) > NEAR * F.col("_goal"))
    out = F.col("_of") > F.col("_all") / 2
    gap = F.when(out, F.col("_all") - F.col("_of") - F.col("_past")).otherwise(F.col("_of") - F.col("_fit"))
    far = store(far.select(*KEY, out.alias("_out"), gap.alias("_gap"), (NEAR * F.col("_goal")).alias("_near"), "_rows"), "far")
    if far.isEmpty():
        return drawn
    # _member: in the sample, or in what it leaves out
    further = attach(drawn.filter("_can"), far.withColumnRenamed("_rows", "_far_rows"), KEY, "_far_rows", n, "inner").filter(F.when(F.col("_out"), ~F.col("_beyond")).otherwise(~F.col("_fits")))
    along, member = F.when(F.col("_out"), -F.col("_rank")).otherwise(F.col("_rank")), F.col("_in") != F.col("_out")
    further = store(further.select("_at", "source", *KEY, along.alias("_rank"), "doc_id", "size", member.alias("_member"), "_gap", "_near"), "further")
    order = ["_rank", "doc_id", "size", "_at"]
    short = running_total_in(further.filter(F.col("size") <= F.col("_gap") / 2), "source", order, "size", "_sofar")
    short = store(short.filter(F.col("_sofar") + F.col("size") <= F.col("_gap")).select("_at", *KEY, "size", "_member"), "short")
    left = far.join(short.groupBy(*KEY).agg(F.sum("size").alias("_filled")), KEY, "left")
    left = left.select(*KEY, "_rows", (F.col("_gap") - F.coalesce("_filled", F.lit(0))).alias("_left"))
    last = attach(further.join(short.select("_at"), "_at", "left_anti"), left, KEY, "_rows", n, "inner")
    # the document that ends the sample: the first within NEAR, else the closest
    miss = F.abs(F.col("size") - F.col("_left"))
    last = last.filter((miss < F.col("_left")) & (F.col("_left") > F.col("_near")))
    last = last.groupBy(*KEY).agg(F.min(F.struct(F.when(miss > F.col("_near"), miss).otherwise(-1.0).alias("miss"), *order, "_member")).alias("end"))
    added = store(short.select("_at", "_member").unionByName(last.select("end._at", "end._member")), "added")
    # what was a member and isn't added goes, what is added and wasn't one comes
    gone = further.filter("_member").select("_at").join(added.select("_at"), "_at", "left_anti")
    flips = store(gone.unionByName(added.filter("NOT _member").select("_at")).withColumn("_flip", F.lit(True)), "flips")
    return drawn.join(flips, "_at", "left").withColumn("_in", F.col("_in") != F.coalesce("_flip", F.lit(False)))


def mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of the mix with all columns of ``docs``: a document appears once for each copy taken.

    Rows that share an id, or have none, are judged each for itself; which of equal
    rows are taken may change between reruns, how many doesn't. Null texts and
    sources are handled as by :func:`pareto_mix`; empty in, empty out.
    """
    # ids may repeat or be missing, so rows are numbered, and stored with their numbers since both sides of the join need the same ones
    rows = store(docs.withColumn("_sl_row", F.monotonically_increasing_id()), "rows")
    copies = pareto_mix(rows, id_col, **how, row_col="_sl_row").filter("copies > 0").select("_sl_row", F.col("copies").alias("_sl_copies"))
    return rows.join(copies.hint("shuffle_hash"), "_sl_row").withColumn("_sl_copy", F.explode(F.sequence(F.lit(1), F.col("_sl_copies")))).drop("_sl_row", "_sl_copies", "_sl_copy")
