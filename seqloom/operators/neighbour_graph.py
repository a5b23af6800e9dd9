"""Approximate nearest neighbours by cosine: a graph that descends from rough lists to good ones.

Rough lists come from groups of vectors on the same side of some planes. Then, in
rounds, the neighbours of a vector, those it is a neighbour of, and itself meet in
a group, where everyone may find a nearer neighbour; neighbours of neighbours are
likely neighbours. Rounds end when lists hardly improve. Work is rows times the
square of the length of a list a round, not the square of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.storage import remove, store

#: Entries of a list, rounds at most, and the gain in mean similarity below which rounds end.
LIST, ROUNDS, GAIN = 24, 10, 1e-3
#: Sets of planes for the first lists; vectors of one group, and groups that one task call handles, about.
PLANES, GROUP, TOGETHER = 8, 1_024, 32
_MEMBERS = "g string, id long, x array<double>"
_LISTS = "id long, near array<struct<far: double, id: long>>"


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and x (length 1) of vectors that have a cosine."""
    v = F.col(vector)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = df.filter(F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda e: e != 0), F.lit(False))).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("x"))
    good = good.withColumn("x", F.transform("x", lambda e: e / F.array_max(F.transform("x", lambda y: F.abs(y)))))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))
    return good.withColumn("length", length).select("id", F.transform("x", lambda e: e / F.col("length")).alias("x"))


def _meet(k: int):
    """The ``k`` nearest others of every member of every group, and none farther than what ends its list already (``worst``)."""

    def best(t: pa.Table) -> pa.Table:
        t = t.sort_by([("g", "ascending"), ("id", "ascending")]).combine_chunks()
        ids, x = t["id"].to_numpy(), t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        worst = t["worst"].to_numpy()
        g = t["g"].combine_chunks().dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero(np.diff(g)) + 1
        own, far, other, counts = [], [], [], []
        for lo, hi in zip([0, *edges], [*edges, len(g)], strict=True):
            if hi - lo < 2:
                continue
            d = 1 - x[lo:hi] @ x[lo:hi].T
            np.fill_diagonal(d, np.inf)
            m = min(k, hi - lo - 1)
            at = np.argpartition(d, m - 1, 1)[:, :m]
            found = np.round(np.take_along_axis(d, at, 1), 12) + 0.0
            keep = found <= worst[lo:hi, None]
            own.append(ids[lo:hi])
            far.append(found[keep])
            other.append(ids[lo:hi][at][keep])
            counts.append(keep.sum(1))
        if not own:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())])))})
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(far)), pa.array(np.concatenate(other))], ["far", "id"])
        return pa.table({"id": np.concatenate(own), "near": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), pa.int32()), flat)})

    return best


def _nearest(k: int):
    """The ``k`` nearest entries of each list, each id once with the least distance that it was found at; ties by id."""

    def cut(batches):
        for b in batches:
            near = b.column("near")
            entries, owner = near.flatten(), np.repeat(np.arange(b.num_rows), near.value_lengths().to_numpy(zero_copy_only=False))
            far, other = (entries.field(f).to_numpy(zero_copy_only=False) for f in ("far", "id"))
            order = np.lexsort((far, other, owner))
            owner, far, other = owner[order], far[order], other[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])])[: len(owner)]
            owner, far, other = owner[new], far[new], other[new]
            order = np.lexsort((other, far, owner))
            owner, far, other = owner[order], far[order], other[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            owner, far, other = (x[place < k] for x in (owner, far, other))
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(far), pa.array(other)], ["far", "id"])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "near"])

    return cut


def _lists(members: DataFrame, n: int, k: int, before: DataFrame | None = None) -> DataFrame:
    """id and near: the k nearest of all that a vector met in its groups (g, id, x, worst) and had before. Stored."""
    calls = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TOGETHER))
    met = members.withColumn("call", F.pmod(F.xxhash64("g"), F.lit(calls))).groupBy("call").applyInArrow(lambda t: _meet(k)(t.drop_columns(["call"])), _LISTS)
    met = met if before is None else met.unionByName(before)
    # a vector is in few groups: its own, and those of its list and of as many that have it in theirs; products of
    # two vectors differ in their last places from group to group, so an entry is known by its id alone
    one = met.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near")).mapInArrow(_nearest(k), _LISTS)
    return store(one, "lists")


def neighbour_graph(vectors: DataFrame, key: str, vector: str, k: int = LIST, seed: int = 1) -> DataFrame:
    """id and near (far: 1 - cosine, id), nearest first: about the ``k`` nearest others of every vector that has a cosine; all of one length.

    A vector that is in very many lists meets only ``k`` of their owners in its own
    group, drawn by hash anew in each round.
    """
    nodes = store(usable_vectors(vectors, key, vector), "nodes")
    n = nodes.count()
    dim = (nodes.select(F.size("x")).head() or [0])[0]
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / GROUP))))
    planes = np.random.default_rng(seed).normal(size=(PLANES, bits, dim))
    shared = nodes.sparkSession.sparkContext.broadcast(planes)  # the logarithm of the number of rows

    def sides(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            for s, p in enumerate(shared.value):
                side = (x @ p.T > 0).astype(np.int64) @ (1 << np.arange(len(p)))
                yield pa.RecordBatch.from_arrays([pa.array([f"{s}-{v}" for v in side]), b.column("id"), b.column("x")], names=["g", "id", "x"])

    first = nodes.mapInArrow(sides, _MEMBERS) if n else nodes.select(F.lit("").alias("g"), "id", "x")
    sizes = first.groupBy("g").agg(F.ceil(F.count("*") / (2 * GROUP)).cast("int").alias("parts")).filter("parts > 1")  # fewer than PLANES * n / GROUP rows
    split = first.join(sizes, "g", "left").withColumn("g", F.when(F.col("parts").isNull(), F.col("g")).otherwise(F.concat_ws("/", "g", F.pmod(F.xxhash64("id"), F.col("parts"))))).drop("parts")
    lists, last = _lists(split.withColumn("worst", F.lit(float("inf"))), n, k), None
    for step in range(ROUNDS):
        now = lists.agg(F.avg(F.aggregate("near", F.lit(0.0), lambda a, e: a + e["far"]) / F.size("near"))).first()[0]
        if now is None or (last is not None and last - now <= GAIN * max(last, 1e-12)):
            break
        last = now
        edges = lists.select(F.col("id").alias("a"), F.explode("near.id").alias("b"))
        some = Window.partitionBy("b").orderBy(F.xxhash64("a", F.lit(step)), "a")
        back = edges.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= k).select(F.col("b").alias("g"), F.col("a").alias("id"))
        pairs = edges.select(F.col("a").alias("g"), F.col("b").alias("id")).unionByName(back).unionByName(lists.select(F.col("id").alias("g"), "id")).distinct()
        worst = F.when(F.size("near") < k, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["far"])
        known = nodes.join(lists.select("id", worst.alias("worst")), "id", "left")
        members = pairs.join(known, "id").select(F.col("g").cast("string").alias("g"), "id", "x", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        new = _lists(members, n, k, lists)
        remove(lists)
        lists = new
    return lists


def graph_search(queries: DataFrame, vectors: DataFrame, graph: DataFrame, key: str, vector: str, k: int = 10, width: int = 48, entries: int = 256, rounds: int = 12) -> DataFrame:
    """q, s, far and rank: about the ``k`` nearest vectors of queries that are not in the graph.

    A query begins at ``entries`` vectors drawn by hash and goes on, in rounds, from the
    ``width`` nearest that it has found to their neighbours, until nothing nearer turns up.
    """
    asked = store(usable_vectors(queries, key, vector).select(F.col("id").alias("q"), F.col("x").alias("qx")), "asked")
    nodes = store(usable_vectors(vectors, key, vector).select(F.col("id").alias("s"), "x"), "nodes")
    far = F.lit(1.0) - F.aggregate(F.zip_with("qx", "x", lambda a, b: a * b), F.lit(0.0), lambda a, e: a + e)
    best = Window.partitionBy("q").orderBy("far", "s")
    begin = nodes.orderBy(F.xxhash64("s"), "s").limit(entries).select("s")  # ``entries`` rows
    met = asked.select("q").withColumn("s", F.explode(F.lit([r.s for r in begin.collect()] or None).cast("array<long>")))
    found = None
    for _ in range(rounds):
        scored = met.join(nodes, "s").join(asked, "q").select("q", "s", F.round(far, 12).alias("far"), F.lit(False).alias("done"))
        merged = scored if found is None else scored.unionByName(found.withColumn("done", F.lit(True)))
        new = store(merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= width), "found")
        found = new.select("q", "s", "far")
        open_ones = new.filter(~F.col("done")).select("q", "s")
        if open_ones.isEmpty():
            break
        steps = open_ones.join(graph.select(F.col("id").alias("s"), F.explode("near.id").alias("t")), "s").select("q", F.col("t").alias("s")).distinct()
        met = steps.join(found.select("q", "s"), ["q", "s"], "left_anti")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
