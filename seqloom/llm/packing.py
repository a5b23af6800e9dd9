"""Packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``capacity`` ids. Packing sees only how
many pieces of each length there are: lengths are placed longest first, each into
the shortest packs that have room, and packs that look alike are one pattern with
a count. The patterns' places then join back to the pieces by rank within length.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.word_tokens import encoder
from seqloom.operators.prefix import running_total
from seqloom.storage import store

CAPACITY = 1024


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order of place) with how many sequences have each.

    The work and the result depend on the capacity, not on the number of pieces:
    every step uses up a length or a pattern.
    """
    room: dict[int, list[tuple[tuple | None, int]]] = {}  # free places -> packs as (chain of lengths, count)
    emptiest: list[int] = []  # heap of negated free places

    def put(free: int, chain: tuple, n: int) -> None:
        if free not in room:
            room[free] = []
            heapq.heappush(emptiest, -free)
        room[free].append((chain, n))

    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left = counts[length]
        while left:
            while emptiest and not room[-emptiest[0]]:
                del room[-heapq.heappop(emptiest)]
            if emptiest and -emptiest[0] >= length:
                free = -emptiest[0]
                chain, n = room[free].pop()
                use = min(n, left)
                if n > use:
                    room[free].append((chain, n - use))
                put(free - length, (length, chain), use)
                left -= use
                continue
            # no pack has room: new ones, each of which is the shortest until this length no longer fits
            each = min(capacity // length, left)
            chain = None
            for _ in range(each):
                chain = (length, chain)
            put(capacity - each * length, chain, left // each)
            left %= each
    patterns = []
    for packs in room.values():
        for chain, n in packs:
            lengths = []
            while chain is not None:
                lengths.append(chain[0])
                chain = chain[1]
            patterns.append((lengths[::-1], n))
    return patterns


def cut_tokens(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every text's ids with ``end_id`` behind them: doc_id, start, length, ids_crc32, doc_tokens.

    A document is cut from its start at every ``capacity`` ids; null text is empty.
    """

    def cut(batches):
        for b in batches:
            doc_ids = b.column("doc_id")
            for lo, hi, ids, lens in encoder(tokenizer).encode(b.column("text")):
                ids = np.insert(ids, np.cumsum(lens), np.uint32(end_id))
                lens = lens + 1
                pieces = -(-lens // capacity)
                row = np.repeat(np.arange(len(lens)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * capacity
                length = np.minimum(capacity, lens[row] - start)
                first = (np.cumsum(lens) - lens)[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row + lo)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(lens[row])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    Sequences are numbered from 0 and filled gaplessly from offset 0. Rows that
    repeat are packed each for itself; a null or empty text is its end id alone;
    other columns are ignored; an empty table has no pieces.
    """
    spark = docs.sparkSession
    pieces = store(cut_tokens(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    # at most `capacity` rows
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    below, total = {}, 0
    for length in sorted(counts):
        below[length], total = total, total + counts[length]
    spans, sequence, taken = [], 0, dict(below)
    for lengths, n in pack_histogram(counts, capacity):
        offset = 0
        for length in lengths:
            spans.append((taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    spans.sort()
    table = np.array(spans, np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast(table)  # patterns' places: bounded by the capacity

    @F.arrow_udf("sequence_id long, offset long")
    def place(rank: pa.Array) -> pa.Array:
        t, r = shared.value, rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(t[:, 0], r, "right") - 1
        return pa.StructArray.from_arrays([pa.array(t[at, 1] + r - t[at, 0]), pa.array(t[at, 2])], names=["sequence_id", "offset"])

    ranked = running_total(pieces.withColumn("_one", F.lit(1)), ["length", "doc_id", "start"], "_one", "_rank")
    placed = ranked.withColumn("_at", place("_rank"))
    return placed.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
