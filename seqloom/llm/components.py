"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.groups import attach
from seqloom.storage import remove, store


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node it reaches) for every node that has a link.

    Each round hangs the larger neighbours of every node on its smallest one
    (large star), then its smaller neighbours (small star), until nothing moves;
    the number of rounds grows with the logarithm of the number of nodes. Rounds
    are stored, so a lost executor repeats one of them. Null ends and loops are
    ignored. Neighbourhoods are never gathered in one place: a hot node is a sum
    of partial minima, and its edges meet a broadcast row.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v AND u IS NOT NULL AND v IS NOT NULL").distinct()
    edges = store(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = store(attach(both, least, "u", "n", mark[0], "inner").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = attach(large, least, "u", "n", mark[0], "inner")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = store(small, "edges")
        now = _mark(nxt)
        remove(edges, large)
        edges = nxt
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Tells one edge set from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
