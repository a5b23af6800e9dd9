"""A partition tree over time series under dynamic time warping, grown on the whole table.

A node with more series than a bucket holds has two pivots: one drawn among its
series, the other drawn in proportion to the squared distance from the first. A
series goes left if it is no farther from the left pivot when the tree is grown,
and if it is strictly nearer when the tree is searched. A query returns its leaf's
bucket, which holds ``bucket`` series at most unless they are all alike.

Large nodes are split level by level, all nodes of a level in a few jobs; a node
that one task can hold is grown to its leaves there. Draws depend on the seed, the
node and the series' id alone, so that the tree doesn't depend on where it is grown.
A node is named by the way to it: ``r`` and an ``L`` or ``R`` for each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.distance import dtw, warped_distances
from seqloom.storage import remove, store

#: A node with so many series at most is grown to its leaves by one task.
LOCAL = 8_192
#: Trees with so many inner nodes at most are broadcast whole; of larger ones TIER levels at a time are searched, 2 ** TIER - 1 inner nodes a group.
SHARED, TIER = 1_024, 9
#: Series that are searched in one group at most, on average.
CHUNK = 8_192

NODES = "node string, left_ts long, right_ts long, left array<double>, right array<double>, span long"


def _draw(seed: int, node: str, side: str, ids) -> np.ndarray:
    """A number from 0 to 2 ** 32 - 1 for each series, as :func:`_drawn` gives it."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}{node}{side}{i}".encode(), 42) >> 32 for i in ids], np.int64)  # 42 is the seed of Spark's function


def _drawn(seed: int, side: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(str(seed)), F.col("node"), F.lit(side), F.col("ts_id").cast("string"))), 32)


def far_pivot(ids: np.ndarray, distance: np.ndarray, draws: np.ndarray) -> int | None:
    """Place of a series drawn with a probability in proportion to its squared distance: the first to come of waiting times that are exponential with these rates."""
    some = np.flatnonzero(distance > 0)
    if not len(some):
        return None
    wait = -np.log((draws[some] + 0.5) / 2.0**32) / distance[some] ** 2
    return int(some[np.lexsort((ids[some], wait))[0]])


def _grown(node: str, ids: np.ndarray, series: list[np.ndarray], bucket: int, dim: int, seed: int) -> Iterator[tuple]:
    """(node, left_ts, right_ts, left, right, span) of all nodes below; leaves have no pivots."""
    level = [(node, np.arange(len(ids)))]
    while level:  # all nodes of a level in two batches of distances
        large = [(at, members) for at, members in level if len(members) > bucket]
        yield from ((at, None, None, None, None, len(members)) for at, members in level if len(members) <= bucket)
        level = []
        if not large:
            return
        left = [members[np.lexsort((ids[members], _draw(seed, at, "l", ids[members])))[0]] for at, members in large]
        near = _batched(series, large, left, dim)
        far = [far_pivot(ids[members], d, _draw(seed, at, "r", ids[members])) for (at, members), d in zip(large, near, strict=True)]
        yield from ((at, None, None, None, None, len(members)) for (at, members), f in zip(large, far, strict=True) if f is None)
        split = [(at, members, x, members[f], d) for (at, members), x, f, d in zip(large, left, far, near, strict=True) if f is not None]
        further = _batched(series, [(at, members) for at, members, *_ in split], [y for *_, y, _ in split], dim)
        for (at, members, x, y, d), e in zip(split, further, strict=True):
            yield at, int(ids[x]), int(ids[y]), series[x].tolist(), series[y].tolist(), len(members)
            level += [(at + "L", members[d <= e]), (at + "R", members[d > e])]


def _batched(series: list[np.ndarray], nodes: list[tuple[str, np.ndarray]], pivots: list[int], dim: int) -> list[np.ndarray]:
    """Distances of each node's members from its pivot, computed at once."""
    if not nodes:
        return []
    d = warped_distances([series[m] for _, members in nodes for m in members], [series[p] for (_, members), p in zip(nodes, pivots, strict=True) for _ in members], dim)
    return np.split(d, np.cumsum([len(members) for _, members in nodes])[:-1])


def grow(series: DataFrame, bucket: int, dim: int, seed: int, local: int | None = None) -> DataFrame:
    """All nodes of the tree over a stored table (ts_id, ts); ids are distinct. Empty series count as alike."""
    local = max(bucket, local if local is not None else LOCAL)
    state, parts = series.withColumn("node", F.lit("r")), []
    owned = None
    while True:
        sizes = store(state.groupBy("node").agg(F.count("*").alias("span")), "sizes")
        if not sizes.filter(F.col("span") > local).head(1):
            break
        # large nodes are few: fewer than rows / local
        large = sizes.filter(F.col("span") > local)
        rows = state.join(F.broadcast(large.select("node")) if large.count() <= SHARED else large.select("node"), "node")
        first = rows.groupBy("node").agg(F.min_by(F.struct("ts_id", "ts"), F.struct(_drawn(seed, "l"), "ts_id")).alias("l"))
        first = store(first, "left-pivots")
        near = store(rows.join(first, "node").select("node", "ts_id", "ts", dtw(F.col("ts"), F.col("l.ts"), dim).alias("d")), "near")
        wait = -F.log((_drawn(seed, "r") + 0.5) / 2.0**32) / (F.col("d") * F.col("d"))
        second = near.filter("d > 0").groupBy("node").agg(F.min_by(F.struct("ts_id", "ts"), F.struct(wait, "ts_id")).alias("r"))
        second = store(second, "right-pivots")
        split = first.join(second, "node", "left").join(large, "node")
        nodes = split.select("node", F.when(F.col("r").isNotNull(), F.col("l.ts_id")).alias("left_ts"), F.col("r.ts_id").alias("right_ts"), F.when(F.col("r").isNotNull(), F.col("l.ts")).alias("left"), F.col("r.ts").alias("right"), "span")
        parts.append(store(nodes, "nodes"))
        side = F.when(F.col("d") <= dtw(F.col("ts"), F.col("r.ts"), dim), "L").otherwise("R")
        moved = near.join(second, "node").select(F.concat("node", side).alias("node"), "ts_id", "ts")  # nodes whose series are all alike end here
        rest = state.join(large.select("node"), "node", "left_anti").select("node", "ts_id", "ts")
        new = store(moved.unionByName(rest), "tree-rows")
        remove(near, first, second, *([owned] if owned is not None else []))
        state = owned = new

    def below(t: pa.Table) -> pa.Table:
        t = t.sort_by("ts_id")
        x = [np.asarray(v if v is not None else [], np.float64) for v in t["ts"].to_pylist()]
        rows = list(_grown(t["node"][0].as_py(), t["ts_id"].to_numpy(), x, bucket, dim, seed))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in NODES.split(", ")])

    out = state.select("node", "ts_id", "ts").groupBy("node").applyInArrow(below, NODES)
    for p in parts:
        out = out.unionByName(p)
    return store(out, "tree")


class _Search:
    """Descends from node to node among those that it has."""

    def __init__(self, nodes: pa.Table, dim: int):
        self.pivots = {n: (np.array(x), np.array(y)) for n, x, y in zip(nodes["node"].to_pylist(), nodes["left"].to_pylist(), nodes["right"].to_pylist(), strict=True)}
        self.dim = dim

    def __call__(self, node: np.ndarray, series: list[np.ndarray]) -> np.ndarray:
        out, here = node.copy(), np.arange(len(node))
        while True:  # a step of all series at once
            here = np.array([i for i in here if out[i] in self.pivots], np.int64)
            if not len(here):
                return out
            pairs = [self.pivots[n] for n in out[here]]
            some = [series[i] for i in here]
            to_left, to_right = (warped_distances(some, [p[k] for p in pairs], self.dim) for k in (0, 1))
            out[here] = [n + ("L" if left else "R") for n, left in zip(out[here], to_left < to_right, strict=True)]


def _series(column) -> list[np.ndarray]:
    return [np.asarray(v if v is not None else [], np.float64) for v in column.to_pylist()]


def descend(series: DataFrame, inner: DataFrame, dim: int) -> DataFrame:
    """leaf_id and ts_id of every series (ts_id, ts), under inner nodes (node, left, right), which are stored.

    The top of the tree, or all of a small one, is broadcast. What goes on below
    meets the next TIER levels of its own part of the tree in groups; series that
    are many in one part are dealt over several groups.
    """
    spark: SparkSession = series.sparkSession
    small = inner.limit(SHARED + 1).count() <= SHARED
    top = (inner if small else inner.filter(F.length("node") <= TIER)).select("node", "left", "right").toArrow()  # SHARED nodes, or those of TIER levels
    shared = spark.sparkContext.broadcast(_Search(top, dim))

    def first(batches):
        for b in batches:
            at = shared.value(np.full(b.num_rows, "r", object), _series(b.column("ts")))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.string()), b.column("ts_id"), b.column("ts")], names=["leaf_id", "ts_id", "ts"])

    kind = "leaf_id string, ts_id long, ts array<double>"
    out = series.select(F.col("ts_id").cast("long").alias("ts_id"), F.col("ts").cast("array<double>").alias("ts")).mapInArrow(first, kind)
    if small:
        return out.select("leaf_id", "ts_id")
    deepest = inner.agg(F.max(F.length("node"))).first()[0]
    for begin in range(TIER + 1, deepest + 1, TIER):
        below = inner.filter(F.length("node").between(begin, begin + TIER - 1)).select(F.substring("node", 1, begin).alias("part"), "node", "left", "right")
        rows = store(out, "tier")
        parts = rows.filter(F.length("leaf_id") == begin).groupBy("leaf_id").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        parts = parts.join(below.select(F.col("part").alias("leaf_id")).distinct(), "leaf_id", "left_semi")
        dealt = rows.join(parts, "leaf_id").withColumn("chunk", F.pmod(F.xxhash64("ts_id"), F.col("chunks")).cast("int"))
        copies = below.join(parts.select(F.col("leaf_id").alias("part"), F.col("chunks").alias("pieces")), "part").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))

        def further(a: pa.Table, b: pa.Table) -> pa.Table:
            at = _Search(b, dim)(np.array(a["leaf_id"].to_pylist(), object), _series(a["ts"])) if a.num_rows else []
            return pa.table({"leaf_id": pa.array(at, pa.string()), "ts_id": a["ts_id"], "ts": a["ts"]})

        gone_on = dealt.groupBy("leaf_id", "chunk").cogroup(copies.groupBy("part", "piece")).applyInArrow(further, kind)
        out = gone_on.unionByName(rows.join(parts, "leaf_id", "left_anti"))
    return out.select("leaf_id", "ts_id")


class SeriesIndex:
    """An immutable index: tables of ``nodes`` and ``buckets`` (leaf_id, ts_id). Rebuilding makes a new one."""

    def __init__(self, nodes: DataFrame, buckets: DataFrame, dim: int):
        self.nodes, self.buckets, self.dim = nodes, buckets, dim

    @classmethod
    def build(cls, series: DataFrame, bucket: int = 10, dim: int = 1, ts_id: str = "ts_id", ts: str = "ts", seed: int = 1, local: int | None = None) -> "SeriesIndex":
        """Grows the tree on all series and files each in the leaf that a search for it ends in."""
        rows = store(series.select(F.col(ts_id).cast("long").alias("ts_id"), F.col(ts).cast("array<double>").alias("ts")), "series")
        index = cls(grow(rows, bucket, dim, seed, local), None, dim)
        index.buckets = store(descend(rows, index.inner, dim), "buckets")
        return index

    @property
    def inner(self) -> DataFrame:
        return self.nodes.filter("left_ts IS NOT NULL")

    def insert(self, more: DataFrame, ts_id: str = "ts_id", ts: str = "ts") -> "SeriesIndex":
        """A version with more series filed under the same tree."""
        more = more.select(F.col(ts_id).alias("ts_id"), F.col(ts).alias("ts"))
        return SeriesIndex(self.nodes, self.buckets.unionByName(descend(more, self.inner, self.dim)), self.dim)

    def query(self, queries: DataFrame, ts_id: str = "ts_id", ts: str = "ts") -> DataFrame:
        """q and the ids in its bucket, unranked."""
        found = descend(queries.select(F.col(ts_id).alias("ts_id"), F.col(ts).alias("ts")), self.inner, self.dim)
        return found.withColumnRenamed("ts_id", "q").join(self.buckets, "leaf_id").select("q", "ts_id", "leaf_id")

    def depth(self) -> int:
        """Nodes on the longest way from the root to a leaf."""
        return self.nodes.agg(F.max(F.length("node"))).first()[0] or 0

    def save(self, path: str) -> None:
        self.nodes.withColumn("dim", F.lit(self.dim)).write.mode("overwrite").parquet(f"{path}/nodes")
        self.buckets.write.mode("overwrite").parquet(f"{path}/buckets")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SeriesIndex":
        nodes = spark.read.parquet(f"{path}/nodes")
        first = nodes.select("dim").head()
        return cls(nodes.drop("dim"), spark.read.parquet(f"{path}/buckets"), first.dim if first else 1)


def votes(hits: DataFrame, k: int = 10) -> DataFrame:
    """q, sequence, n, score, rank: sequences by how often a query's windows met theirs; score 1 / n."""
    from pyspark.sql.window import Window

    counted = hits.groupBy("q", "sequence").agg(F.count("*").alias("n"))
    w = Window.partitionBy("q").orderBy(F.desc("n"), "sequence")
    return counted.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).withColumn("score", 1 / F.col("n"))
