"""Exact deduplication with a cuckoo-filter index over live digests.

Texts are reduced to the SHA-256 of their normalised form. Every task indexes the
digests it reads, so that copies meet before the shuffle; shards of the digest
space then index what the tasks found. An index is a cuckoo filter (buckets of
four 16-bit fingerprints) above bucketed content: a filter hit is verified
against the full digests stored in the digest's home bucket, and a full filter
doubles and refills from those stored keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.groups import attach
from seqloom.storage import store

SLOTS, KICKS = 4, 64
#: Digests a task indexes before it hands them on; bounds its memory.
TASK_KEYS = 50_000
#: Rows of the corpus a shard stands for; a shard's distinct digests fit in a worker.
SHARD_ROWS = 20_000


class CuckooIndex:
    """Live 32-byte digests with, for each, the smallest id and the number of live rows."""

    def __init__(self, buckets: int = 64):
        self._empty(buckets)
        self.keys: list[bytes] = []
        self.least: list[int | None] = []
        self.live: list[int] = []

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [[] for _ in range(buckets)]
        self.content: list[list[int]] = [[] for _ in range(buckets)]
        self.count, self.turn = 0, 0

    def _home(self, key: bytes) -> tuple[int, int]:
        """(fingerprint, home bucket): bytes of the digest, which are uniform as they stand."""
        return int.from_bytes(key[:2], "little") or 1, int.from_bytes(key[2:8], "little") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, key: bytes) -> int | None:
        """Entry of a live digest: a filter hit, verified against the content of its home bucket."""
        mark, home = self._home(key)
        if mark not in self.prints[home] and mark not in self.prints[self._other(home, mark)]:
            return None
        return next((e for e in self.content[home] if self.keys[e] == key), None)

    def _place(self, mark: int, bucket: int) -> bool:
        for b in (bucket, self._other(bucket, mark)):
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                return True
        for _ in range(KICKS):
            self.turn = (self.turn + 1) % SLOTS
            mark, self.prints[b][self.turn] = self.prints[b][self.turn], mark
            b = self._other(b, mark)
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                return True
        return False

    def _resize(self) -> None:
        """Double until all live digests fit again, from the stored keys."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._empty(buckets)
            if all(self._link(e) for e, n in enumerate(self.live) if n):
                return

    def _link(self, entry: int) -> bool:
        mark, home = self._home(self.keys[entry])
        self.content[home].append(entry)
        self.count += 1
        return self._place(mark, home)

    def insert(self, key: bytes, row_id: int | None, rows: int = 1) -> None:
        entry = self.find(key)
        if entry is not None:
            self.live[entry] += rows
            if row_id is not None and (self.least[entry] is None or row_id < self.least[entry]):
                self.least[entry] = row_id
            return
        self.keys.append(key)
        self.least.append(row_id)
        self.live.append(rows)
        if self.count >= 0.9 * SLOTS * (self.mask + 1) or not self._link(len(self.keys) - 1):
            self._resize()

    def delete(self, key: bytes, rows: int = 1) -> bool:
        """Take rows of a digest away; the last one takes its fingerprint out. False if it wasn't live."""
        entry = self.find(key)
        if entry is None:
            return False
        self.live[entry] = max(0, self.live[entry] - rows)
        if not self.live[entry]:
            mark, home = self._home(key)
            bucket = home if mark in self.prints[home] else self._other(home, mark)
            self.prints[bucket].remove(mark)
            self.content[home].remove(entry)
            self.count -= 1
        return True

    def entries(self):
        """(digest, smallest id, live rows) of the live digests."""
        return ((k, i, n) for k, i, n in zip(self.keys, self.least, self.live, strict=True) if n)


_FOUND = "digest binary, keep_id long, group_size long"


def _batch(index: CuckooIndex) -> pa.RecordBatch:
    rows = list(index.entries())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
        names=["digest", "keep_id", "group_size"],
    )


def _index_task(batches):
    index = CuckooIndex()
    for b in batches:
        for key, row_id, rows in zip(b.column("digest").to_pylist(), b.column("keep_id").to_pylist(), b.column("group_size").to_pylist(), strict=True):
            index.insert(key, row_id, rows)
            if len(index.keys) >= TASK_KEYS:
                yield _batch(index)
                index = CuckooIndex()
    if index.keys:
        yield _batch(index)


def _index_shard(table: pa.Table) -> pa.Table:
    index = CuckooIndex(1 << max(6, int(table.num_rows / 3).bit_length()))
    for b in table.to_batches():
        for key, row_id, rows in zip(b.column("digest").to_pylist(), b.column("keep_id").to_pylist(), b.column("group_size").to_pylist(), strict=True):
            index.insert(key, row_id, rows)
    return pa.Table.from_batches([_batch(index)])


def normalised(text: Column) -> Column:
    """Each run of white space (0x20, 0x09-0x0D) as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def shard_groups(found: DataFrame, total: int) -> DataFrame:
    """One row a digest (keep_id, group_size) from partial rows of the same columns."""
    shards = max(1, -(-total // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards))
    return found.mapInArrow(_index_task, _FOUND).groupBy(shard.alias("_shard")).applyInArrow(_index_shard, _FOUND)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Of equal normalised texts the smallest id stays; null text equals empty text.
    Null ids come last (a group with null ids only keeps null). Rows that repeat
    the id that stays are all kept, since an id names one document. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = store(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")), "digests")
    total = rows.count()
    groups = store(shard_groups(rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")), total), "groups")
    out = attach(rows, groups.filter("group_size > 1"), "digest", "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("doc_id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def update_index(index: DataFrame, changes: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """Apply changes (digest, row_id, rows: positive to insert, negative to delete) to an index (digest, keep_id, group_size).

    Deletions follow insertions; a digest leaves when its last row goes. ``rows``
    (digest, row_id) are the live rows after the changes: a digest that changed
    keeps the smallest id of its live ones, null if none has an id. Deleting a
    digest that isn't live changes nothing; empty tables are allowed everywhere.
    """
    shards = max(1, -(-total // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("_shard")

    def apply(old: pa.Table, new: pa.Table) -> pa.Table:
        live = CuckooIndex(1 << max(6, int(old.num_rows / 3).bit_length()))
        for r in old.to_pylist():
            live.insert(r["digest"], r["keep_id"], r["group_size"])
        for r in sorted(new.to_pylist(), key=lambda r: -r["rows"]):
            if r["rows"] > 0:
                live.insert(r["digest"], r["row_id"], r["rows"])
            else:
                live.delete(r["digest"], -r["rows"])
        return pa.Table.from_batches([_batch(live)])

    live = index.groupBy(shard).cogroup(changes.groupBy(shard)).applyInArrow(apply, _FOUND)
    # only digests that lost a row can have lost the one that stays; ids are taken as partial minima, however large a group is
    lost = changes.filter("rows < 0").select("digest").distinct()
    least = lost.join(rows, "digest", "left").groupBy("digest").agg(F.min("row_id").alias("_least"), F.lit(True).alias("_lost"))
    return live.join(least, "digest", "left").select("digest", F.when(F.col("_lost"), F.col("_least")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no row with a smaller id has, all columns as they are.

    Null text equals empty text. A row without an id goes if its text has a row
    with one; rows that repeat the id that stays, or share a text and have no id,
    all stay, since nothing tells them apart. An empty table stays empty.
    """
    gone = exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("_sl_id"), F.unhex("text_sha256").alias("_sl_digest")).distinct()
    marked = docs.withColumn("_sl_key", digest(F.col(text_col)))
    # hashing the few columns of what goes spares sorting whole texts
    return marked.join(gone.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_sl_id")) & (F.col("_sl_key") == F.col("_sl_digest")), "left_anti").drop("_sl_key")
