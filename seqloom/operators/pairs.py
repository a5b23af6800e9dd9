"""Pairs of a query set with all rows, and other pairings, without a cross join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seqloom.operators.prefix import rank_in

#: Queries that meet a row in one block of an equi-join.
PER_BLOCK = 256
#: Queries and rows that meet as whole tables: n * m / 4,096 rows of either side are moved.
PER_TABLE = 4_096


def against(queries: DataFrame, corpus: DataFrame, key: str, length: str | None = None, within: int = 5, per_block: int = PER_BLOCK) -> DataFrame:
    """Every query with every row of the corpus: q_ and s_ columns, block by block.

    Queries are dealt into blocks and rows into slices by a hash of ``key``; a
    query goes to all slices of its block and a row to all blocks of its slice, so
    the work is an equi-join with as many even keys as blocks times slices. With
    ``length``, only pairs whose lengths differ by less than ``within`` meet.
    """
    spark = corpus.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // per_block))
    dealt = lambda df, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = dealt(queries, "_block", blocks, "_slice", slices)
    s = dealt(corpus, "_slice", slices, "_block", blocks)
    on = ["_block", "_slice"]
    if length:
        bucket = F.floor(F.col(length) / within).cast("long")
        q = q.withColumn("_bucket", F.explode(F.sequence(bucket - 1, bucket + 1)))
        s = s.withColumn("_bucket", bucket)
        on.append("_bucket")
    q = q.select(*on, *[F.col(c).alias(f"q_{c}") for c in queries.columns])
    s = s.select(*on, *[F.col(c).alias(f"s_{c}") for c in corpus.columns])
    out = q.join(s, on).drop(*on)
    return out.filter(F.abs(F.col(f"q_{length}") - F.col(f"s_{length}")) < within) if length else out


def pieces(table: pa.Table, rows: int):
    """The table in parts of ``rows`` rows at most, so that what a part makes with a slice is bounded."""
    return (table.slice(at, rows) for at in range(0, table.num_rows, rows))


def in_blocks(queries: DataFrame, corpus: DataFrame, key: str, meet, schema: str, per_block: int = PER_TABLE, per_slice: int = PER_TABLE, meetings: DataFrame | None = None) -> DataFrame:
    """What ``meet`` makes of two Arrow tables with rows, for every block of queries with every slice of rows: as :func:`against`, but whole blocks at once.

    Blocks and slices hold about ``per_block`` and ``per_slice`` rows, whatever the
    size of the tables; ``meet`` takes the queries in :func:`pieces` where the product of both would be too much.
    Where both tables come dealt (``_block`` of queries, ``_slice`` of rows), ``meetings`` has those of them that meet.
    """
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return meet(a, b.rename_columns([c[2:] for c in b.column_names])) if a.num_rows and b.num_rows else nothing

    if meetings is not None:
        q, s = queries.join(F.broadcast(meetings), "_block"), corpus.join(F.broadcast(meetings), "_slice")  # a row for 4,096 rows of either
        return _met(q, s, parts, both, schema)
    blocks, slices = max(1, -(-queries.count() // per_block)), max(4 * parts, -(-corpus.count() // per_slice))
    dealt = lambda df, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q, s = dealt(queries, "_block", blocks, "_slice", slices), dealt(corpus, "_slice", slices, "_block", blocks)
    return _met(q, s, parts, both, schema)


def _met(q: DataFrame, s: DataFrame, parts: int, both, schema: str) -> DataFrame:
    # new names, since a query set made of the corpus has its attributes, and column pruning would take one side's for the other's
    s = s.select(*[F.col(c).alias(f"s_{c}") for c in s.columns])
    # a pair of tables is little data and much work, so partitions must not be put together by size
    q, s = q.repartition(parts, "_block", "_slice"), s.repartition(parts, "s__block", "s__slice")
    return q.groupBy("_block", "_slice").cogroup(s.groupBy("s__block", "s__slice")).applyInArrow(both, schema)


def nearest_by_cosine(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """q_ and s_ columns of pairs among which are each query's k nearest rows by cosine, itself left out.

    A block meets a slice as one matrix product, which hands on a query's k best
    (and what ties with them to nine places), so that slices times k rows a query
    are ranked. All vectors have one length, but null ones and those that have no
    cosine (all zero, or with null or non-finite components) are left out.
    """
    columns = queries.columns, corpus.columns
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    queries, corpus = queries.filter(usable), corpus.filter(usable)

    def unit(t: pa.Table) -> np.ndarray:
        x = t[vector].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
        x = x / np.abs(x).max(1, keepdims=True)  # else squares of small numbers vanish
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, found = unit(b), []
        for piece in pieces(a, PER_BLOCK):
            near = unit(piece) @ rows.T
            near[piece[key].to_numpy()[:, None] == b[key].to_numpy()] = -np.inf
            last = np.partition(near, max(0, near.shape[1] - k), 1)[:, max(0, near.shape[1] - k)]
            i, j = np.nonzero((near >= last[:, None] - 1e-9) & (near > -np.inf))
            sides = (("q", piece.take(pa.array(i)), columns[0]), ("s", b.take(pa.array(j)), columns[1]))
            found.append(pa.table({f"{side}_{c}": t[c] for side, t, names in sides for c in names}))
        return pa.concat_tables(found)

    fields = ", ".join(f"{side}_{f.name} {f.dataType.simpleString()}" for side, df in (("q", queries), ("s", corpus)) for f in df.schema)
    return in_blocks(queries, corpus, key, best, fields)


def in_interval(points: DataFrame, spans: DataFrame, part: str, at: str = "t", start: str = "start", stop: str = "stop", width: int = 64) -> DataFrame:
    """Points with the half-open spans of their part that hold them: an equi-join on stretches of ``width`` that a span touches."""
    stretch = F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor((F.col(stop) - 1) / width).cast("long")))
    s = spans.filter(F.col(stop) > F.col(start)).withColumn("_stretch", stretch)
    p = points.withColumn("_stretch", F.floor(F.col(at) / width).cast("long"))
    return p.join(s, [part, "_stretch"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_stretch")


def triplets(df: DataFrame, key: str, label: str, seed: int = 2_654_435_761) -> DataFrame:
    """anchor, positive (the next row of the label in a mixed order) and negative (a row of the next label); labels of one row have none."""
    from pyspark.sql.window import Window

    mixed = F.pmod(F.col(key) * seed, F.lit(1 << 32))
    r = rank_in(df.select(F.col(key).alias("id"), F.col(label).alias("label"), mixed.alias("_mixed")), "label", ["_mixed", "id"], "r").drop("_mixed")
    sizes = r.groupBy("label").agg(F.count("*").alias("n"))
    ring = sizes.withColumn("next", F.coalesce(F.lead("label").over(Window.orderBy("label")), F.first("label").over(Window.orderBy("label"))))  # a row for each label
    ring = ring.join(sizes.select(F.col("label").alias("next"), F.col("n").alias("next_n")), "next")
    a = r.join(F.broadcast(ring), "label").filter((F.col("n") > 1) & (F.col("next") != F.col("label")))
    a = a.select(F.col("id").alias("anchor"), "label", ((F.col("r") + 1) % F.col("n")).alias("rp"), F.col("next"), (F.col("r") % F.col("next_n")).alias("rn"))
    pos, neg = (r.select(F.col("id").alias(x), F.col("label").alias(f"l_{x}"), F.col("r").alias(f"r_{x}")) for x in ("positive", "negative"))
    out = a.join(pos, (F.col("label") == F.col("l_positive")) & (F.col("rp") == F.col("r_positive")))
    return out.join(neg, (F.col("next") == F.col("l_negative")) & (F.col("rn") == F.col("r_negative"))).select("anchor", "positive", "negative")
