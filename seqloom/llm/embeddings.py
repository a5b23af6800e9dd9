"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), nearest first.
The inverted list of a pivot holds the vectors that have it at the front of their
description; two vectors that meet in a list are compared if their descriptions
share enough pivots, and verified by their cosine in double precision. A pair is
counted in the first of the lists that it meets in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import connected_components
from seqloom.llm.groups import attach
from seqloom.storage import remove, store

#: Pivots grow with the root of the number of vectors between these bounds. The index is fitted on a sample of SAMPLE vectors
#: for each pivot, so on 16,384 at most.
FEWEST, MOST, SAMPLE = 64, 8_192, 2
#: A vector stands in the lists of FRONT pivots, or of as many as the pivots' number has binary digits; its description is DEPTH
#: times as long, and pairs share so many pivots of it at least.
FRONT, DEPTH, SHARED = 8, 3, 3
#: Lists with more vectors are compared block by block.
BLOCK = 1_500
#: Vectors whose distances from all pivots are held at once.
ROWS = 256
#: Groups of so many vectors at most are compared together with others, larger ones each as a matrix.
SMALL = 24


def usable(vector: str):
    """Vectors that can have a cosine: not null, no null or non-finite component, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def pivot_count(vectors: int) -> int:
    """Eight times the root of the number of vectors as a power of two, so that lists grow with the root too."""
    return min(MOST, max(FEWEST, 1 << round(math.log2(8 * math.sqrt(max(vectors, 1))))))


class Pivots:
    """Unit rows of reference vectors, shorter ones ending in zeros, and what each one's cosine with the sample's mean is."""

    def __init__(self, rows: np.ndarray, mean: np.ndarray):
        self.rows, self.bias = rows, rows @ mean
        self.front = min(len(rows), max(FRONT, math.ceil(math.log2(max(len(rows), 1)))))
        self.depth = min(len(rows), DEPTH * self.front)
        self.shared = min(SHARED, len(rows))

    def describe(self, column: pa.Array) -> np.ndarray:
        """The nearest pivots of each vector, nearest first. What vectors have in common (their mean) makes no pivot nearer than another."""
        out = np.zeros((len(column), self.depth), np.int16)
        for at, x in _vectors(column):
            k = min(x.shape[1], self.rows.shape[1])
            for lo in range(0, len(at), ROWS):
                far = self.bias - unit(x[lo : lo + ROWS])[:, :k] @ self.rows[:, :k].T
                near = np.argpartition(far, self.depth - 1, 1)[:, : self.depth]
                out[at[lo : lo + ROWS]] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), 1, kind="stable"), 1)
        return out


def pick_pivots(vectors: DataFrame, pivots: int, apart: float = 0.9) -> Pivots:
    """``pivots`` vectors at most, of a sample of SAMPLE times as many, in the order of a hash of their content.

    One whose cosine with one picked before is ``apart`` or more is passed over:
    a group of near copies, however large, gives one pivot, and so its members
    agree on their nearest ones.
    """
    column = vectors.orderBy(F.xxhash64("embedding")).select("embedding").limit(SAMPLE * pivots).toArrow().column("embedding")
    parts = _vectors(column) if len(column) else []
    x = np.zeros((len(column), max((part.shape[1] for _, part in parts), default=0)))
    for at, part in parts:
        x[at, : part.shape[1]] = unit(part)
    picked = np.zeros((min(pivots, len(x)), x.shape[1]))
    n = 0
    for row in x:
        if n < len(picked) and (not n or (picked[:n] @ row).max() < apart):
            picked[n] = row
            n += 1
    return Pivots(picked[:n], x.mean(0) if len(x) else np.zeros(0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(n)
    out = []
    for k in np.unique(n):
        at = np.flatnonzero(n == k)
        out.append((at, flat[(ends[at] - k)[:, None] + np.arange(k)]))
    return out


def described(classes: DataFrame, pivots: Pivots) -> DataFrame:
    """vec, times, embedding, perm (nearest pivots in order, two bytes each) and lists of every class."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # MOST vectors at most

    def index(batches):
        pivots = shared.value
        for b in batches:
            perm = pivots.describe(b.column("embedding"))
            packed = pa.array([p.tobytes() for p in perm.astype("<i2")], pa.binary())
            # vectors of different length may share a list, so that there are a bounded number of lists
            kind = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False).astype(np.int32) % 16 * MOST
            front = (perm[:, : pivots.front] + kind[:, None]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(front) + 1) * pivots.front, pa.int32()), pa.array(front.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec"), b.column("times"), b.column("embedding"), packed, lists], names=["vec", "times", "embedding", "perm", "lists"])

    return classes.select("vec", "times", "embedding").mapInArrow(index, f"vec long, times long, embedding {classes.schema['embedding'].dataType.simpleString()}, perm binary, lists array<int>")


class _Rows:
    """Sorted rows of some lists, with vectors of one length."""

    def __init__(self, table: pa.Table, at: np.ndarray, x: np.ndarray, front: int):
        take = lambda c: table[c].to_numpy()[at]
        self.vec, self.times, self.block = take("vec"), take("times"), take("block")
        self.list, self.one, self.two = take("list"), take("one"), take("two")
        self.perm = np.frombuffer(b"".join(table["perm"].to_pylist()), np.int16).reshape(table.num_rows, -1)[at]
        self.front = self.perm[:, :front]
        self.least = self.front.min(1)
        self.pivot = self.list % MOST
        self.x = unit(x)


def _few(r: _Rows, start: np.ndarray, size: np.ndarray, threshold: float, shared: int):
    """Links of many small groups at once: rows are compared with the row d places on, for every d inside a group."""
    group = np.repeat(np.arange(len(size)), size)
    rows = np.repeat(start, size) + np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    out = []
    for d in range(1, int(size.max()) if len(size) else 0):
        at = np.flatnonzero(group[:-d] == group[d:])
        i, j = rows[at], rows[at + d]
        split = r.one[i] != r.two[i]  # of two blocks, only pairs across count
        ok = ~(split & (r.block[i] == r.block[j])) & (r.vec[i] != r.vec[j])
        i, j = i[ok], j[ok]
        near = np.einsum("ij,ij->i", r.x[i], r.x[j]) >= threshold
        i, j = i[near], j[near]
        enough = (r.perm[i][:, :, None] == r.perm[j][:, None, :]).sum((1, 2)) >= shared
        both = np.where((r.front[i][:, :, None] == r.front[j][:, None, :]).any(2), r.front[i], MOST)
        first = enough & (both.min(1) == r.pivot[i])
        i, j = i[first], j[first]
        low = np.minimum(r.vec[i], r.vec[j])
        out += [(r.vec[i], r.times[j], low), (r.vec[j], r.times[i], low)]
    return out


def _in_common(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """How many pivots each two rows have in common; a row holds none twice, and -1 is none."""
    both = np.intersect1d(a[a >= 0], z[z >= 0])
    place = np.full(MOST + 1, len(both))  # the last column is for pivots that only one side has
    place[both] = np.arange(len(both))
    bits = [np.zeros((len(p), len(both) + 1), np.float32) for p in (a, z)]
    for b, p in zip(bits, (a, z), strict=True):
        b[np.arange(len(p))[:, None], place[p]] = 1
    return bits[0][:, :-1] @ bits[1][:, :-1].T


def _many(r: _Rows, lo: int, hi: int, threshold: float, shared: int):
    """Links of one group as matrices; of its links only a spanning forest is handed on, with the number of links of each vector.

    Rows whose first list is the same one, and another than this, have met there,
    so that copies in great number are compared in one of their lists only.
    """
    at, pivot = np.arange(lo, hi), int(r.pivot[lo])
    one, two = r.one[lo], r.two[lo]
    a, z = at[r.block[lo:hi] == one], at[r.block[lo:hi] == two]
    kinds, n = np.unique(r.least[a], return_counts=True)
    crowds = kinds[(n > SMALL) & (kinds != pivot)]
    parts = [(a[r.least[a] == k], z[r.least[z] != k]) for k in crowds] + [(a[~np.isin(r.least[a], crowds)], z)]
    found = []
    shares = lambda i, j: _in_common(r.perm[i], r.perm[j]) >= shared
    near = lambda i, j: r.x[i] @ r.x[j].T >= threshold
    # a link passes both; the wider product is left for the rows and columns that the narrower one leaves
    first, second = (near, shares) if 2 * r.x.shape[1] < len(np.unique(r.perm[lo:hi])) else (shares, near)
    for rows, columns in parts:
        linked = first(rows, columns)
        linked &= r.vec[rows][:, None] != r.vec[columns]
        i, j = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(i):
            continue
        rows, columns, linked = rows[i], columns[j], linked[np.ix_(i, j)]
        linked &= second(rows, columns)
        before = [np.where(r.front[i] < pivot, r.front[i], -1) for i in (rows, columns)]
        linked &= _in_common(*before) == 0  # no pivot before this one is at the front of both
        found.append((rows, columns, linked))
    vec, links = r.vec[lo:hi], np.zeros(hi - lo, np.int64)
    root, big = vec.copy(), np.iinfo(np.int64).max
    for rows, columns, linked in found:
        links[rows - lo] += linked @ r.times[columns]
        if one != two:
            links[columns - lo] += linked.T @ r.times[rows]
    while found:
        new = root.copy()
        for rows, columns, linked in found:
            i, j = rows - lo, columns - lo
            new[i] = np.minimum(new[i], np.where(linked, new[j], big).min(1))
            new[j] = np.minimum(new[j], np.where(linked, new[i][:, None], big).min(0))
        if (new == root).all():
            break
        root = new
    keep = links > 0
    return [(vec[keep], links[keep], root[keep])]


def _verified(threshold: float, front: int, shared: int):
    """Verify lists that come sorted by list and block pair; a list's rows are held until its last one has come."""

    def whole_groups(table: pa.Table):
        for at, x in _vectors(table["embedding"]):
            r = _Rows(table, at, x, front)
            edge = np.flatnonzero((np.diff(r.list) != 0) | (np.diff(r.one) != 0) | (np.diff(r.two) != 0)) + 1
            start = np.concatenate([[0], edge])
            size = np.diff(np.append(start, len(at)))
            small = size <= SMALL
            out = _few(r, start[small], size[small], threshold, shared)
            for s, n in zip(start[~small], size[~small], strict=True):
                out += _many(r, s, s + n, threshold, shared)
            if out:
                vec, links, root = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(vec), pa.array(links), pa.array(root)], names=["vec", "links", "root"])

    def verify(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("list", "one", "two")])
            last = np.flatnonzero((keys != keys[:, -1:]).any(0))
            cut = int(last[-1]) + 1 if len(last) else 0  # where the batch's last group begins
            if held and (cut or tuple(held[-1].column(c)[-1].as_py() for c in ("list", "one", "two")) != tuple(int(k) for k in keys[:, 0])):
                yield from whole_groups(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield from whole_groups(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield from whole_groups(pa.Table.from_batches(held))

    return verify


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Links join pairs of vectors of one length with cosine >= ``threshold``; null,
    all-zero and non-finite vectors link with nothing, whatever the threshold.
    Equal vectors are compared once for all their rows. Rows that repeat an id, or
    have none, count as vectors of their own; a group of rows without any id has a
    null component. Other columns are ignored; empty in, empty out.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).withColumn("ok", usable("embedding"))
    # a class of equal vectors is a node, numbered when it is stored; ids may repeat or be null
    classes = known.filter("ok").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    classes = store(classes.withColumn("vec", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    pivots = pick_pivots(classes, pivot_count(n), threshold)
    links, comps = (spark.createDataFrame([], s) for s in ("vec long, links long", "node long, component long"))
    if n:
        rowed = store(described(classes, pivots), "described")
        # as many lists as pivots, 16 times as many at most: 131,072 rows
        sizes = rowed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("size")).filter("size > 1")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        met = rowed.select("vec", "times", "embedding", "perm", F.explode("lists").alias("list")).join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.hash("vec"), blocks).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        met = met.select("list", "vec", "times", "embedding", "perm", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
        ordered = met.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two")
        found = store(ordered.mapInArrow(_verified(threshold, pivots.front, pivots.shared), "vec long, links long, root long"), "found")
        remove(rowed)
        links = found.groupBy("vec").agg(F.sum("links").alias("links"))
        comps = connected_components(found.filter("vec <> root"), "vec", "root")
    nodes = classes.select("times", "least", "vec").join(links, "vec", "left").join(comps, F.col("vec") == F.col("node"), "left")
    nodes = store(nodes.select("vec", "least", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "vec").alias("of")), "nodes")
    smallest = store(nodes.groupBy("of").agg(F.min("least").alias("component"), F.count("*").alias("_nodes")), "components")
    named = classes.select("vec", "times", "embedding").join(attach(nodes, smallest, "of", "_nodes", n, "inner").select("vec", "n_links", "component"), "vec").drop("vec")
    # rows without a usable vector have no class; each is alone
    alone = known.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # the hash comes first, so that sorting seldom compares whole vectors
    hashed = lambda df: df.withColumn("hash", F.xxhash64("embedding"))
    joined = attach(hashed(known.filter("ok").select("vec_id", "embedding")), store(hashed(named), "vector-classes"), ["hash", "embedding"], "times", known.count())
    out = joined.select("vec_id", "n_links", F.col("component").alias("component_id")).unionByName(alone)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
