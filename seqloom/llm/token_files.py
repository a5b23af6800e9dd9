"""Token-id files of directly addressable codes.

Ids are numbered by how often they occur in the file and the numbers are cut into
chunks of 8 bits, lowest first. Level 0 has a chunk for every id, level k one for
every id that goes on beyond its k lower chunks; a bitmap per level marks those,
and a rank directory (ones before every 512 bits) tells where an id goes on. So
any id is read from one byte, one bit and one directory entry per level.

A file, little-endian: magic, numbers of documents, ids, codes and levels (int64
each); document ids (int64) with a null mask (uint8 each); where documents start
(int64, one more than documents); the id of each code (uint32); then for each
level its number of chunks (int64), chunks, bitmap and directory (uint32), every
part padded to 8 bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.word_tokens import encoder
from seqloom.operators.prefix import running_total
from seqloom.storage import scratch_path, store

MAGIC = b"SLDAC001"
BLOCK = 512
#: A file ends with the document that brings it to so many ids.
FILE_IDS = 2_000_000


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def encode_file(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file with these documents, in order."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    book = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint32)
    number = np.zeros(len(counts), np.uint32)
    number[book] = np.arange(len(book), dtype=np.uint32)
    codes, levels = number[ids], []
    while True:
        goes_on = codes > 0xFF
        bitmap = np.packbits(goes_on, bitorder="little")
        whole = np.zeros(-(-len(codes) // BLOCK) * (BLOCK // 8), np.uint8)
        whole[: len(bitmap)] = bitmap
        ones = np.bitwise_count(whole.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32) if len(ones) else ones
        levels.append(struct.pack("<q", len(codes)) + _pad((codes & 0xFF).astype(np.uint8).tobytes()) + _pad(bitmap.tobytes()) + _pad(ranks.tobytes()))
        if not goes_on.any():
            break
        codes = codes[goes_on] >> 8
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    starts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    head = MAGIC + struct.pack("<qqqq", len(doc_ids), len(ids), len(book), len(levels))
    return head + np.array([d or 0 for d in doc_ids], np.int64).tobytes() + _pad(nulls.tobytes()) + starts.tobytes() + _pad(book.tobytes()) + b"".join(levels)


class TokenFile:
    """Reads a file through ``fetch(offset, size)``; only what an access needs is fetched."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch = fetch
        head = fetch(0, 40)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, n_codes, n_levels = struct.unpack("<qqqq", head[8:])
        self._docs = 40
        self._nulls = self._docs + 8 * self.n_docs
        self._starts = self._nulls + self.n_docs + -self.n_docs % 8
        self._book = self._starts + 8 * (self.n_docs + 1)
        at = self._book + 4 * n_codes + -4 * n_codes % 8
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack("<q", fetch(at, 8))
            bits, blocks = -(-n // 8), -(-n // BLOCK)
            chunks = at + 8
            bitmap = chunks + n + -n % 8
            ranks = bitmap + bits + -bits % 8
            self.levels.append((n, chunks, bitmap, ranks))
            at = ranks + 4 * blocks + -4 * blocks % 8

    @classmethod
    def of(cls, raw: bytes) -> "TokenFile":
        view = memoryview(raw)
        return cls(lambda at, size: view[at : at + size])

    def doc_ids(self) -> list[int | None]:
        nulls = np.frombuffer(self.fetch(self._nulls, self.n_docs), np.uint8)
        found = np.frombuffer(self.fetch(self._docs, 8 * self.n_docs), np.int64)
        return [None if x else int(d) for d, x in zip(found, nulls, strict=True)]

    def starts(self) -> np.ndarray:
        return np.frombuffer(self.fetch(self._starts, 8 * (self.n_docs + 1)), np.int64)

    def id_at(self, i: int) -> int:
        """One id by its place in the file, without reading its neighbours."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        code = 0
        for k, (n, chunks, bitmap, ranks) in enumerate(self.levels):
            code |= self.fetch(chunks + i, 1)[0] << (8 * k)
            block = i // BLOCK
            first = block * (BLOCK // 8)
            bits = int.from_bytes(self.fetch(bitmap + first, i // 8 - first + 1), "little")
            if not bits >> (i % BLOCK) & 1:
                break
            i = struct.unpack("<I", self.fetch(ranks + 4 * block, 4))[0] + (bits & ((1 << (i % BLOCK)) - 1)).bit_count()
        return struct.unpack("<I", self.fetch(self._book + 4 * code, 4))[0]

    def ids(self) -> np.ndarray:
        """All ids of the file."""
        codes = np.zeros(0, np.uint32)
        for n, chunks, bitmap, _ in reversed(self.levels):
            here = np.frombuffer(self.fetch(chunks, n), np.uint8).astype(np.uint32)
            goes_on = np.unpackbits(np.frombuffer(self.fetch(bitmap, -(-n // 8)), np.uint8), count=n, bitorder="little").view(bool)
            here[goes_on] |= codes << np.uint32(8)
            codes = here
        return np.frombuffer(self.fetch(self._book, 4 * (int(codes.max()) + 1 if len(codes) else 0)), np.uint32)[codes]


def _put(fs: pa_fs.FileSystem, path: str, raw: bytes) -> None:
    """Write beside and move, so that a task that runs again leaves one whole file."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(beside) as f:
        f.write(raw)
    fs.move(beside, path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, append ``end_id`` and write files in ascending id order; returns their list (part, seq, path, n_docs, n_ids).

    ``folder`` is a URI that the driver and all executors reach. Null ids come
    first, null texts are empty, rows that share an id follow one another in
    unspecified order, and an empty table writes nothing.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        fs, root = pa_fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        docs_in, lens_in, ids_in, held = [], [], [], 0

        def flush():
            path = f"{root}/part-{part:06d}-{seq:06d}.dac"
            lens, ids = np.concatenate(lens_in), np.concatenate(ids_in)
            _put(fs, path, encode_file(docs_in, lens, ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([path.rsplit("/", 1)[1]]), pa.array([len(docs_in)]), pa.array([len(ids)])], names=["part", "seq", "path", "n_docs", "n_ids"])

        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for lo, hi, ids, lens in encoder(tokenizer).encode(b.column("text")):
                ids = np.insert(ids, np.cumsum(lens), np.uint32(end_id))
                lens = lens + 1
                upto = np.concatenate([[0], np.cumsum(lens)])
                a = 0
                while a < len(lens):
                    z = min(max(a + 1, int(np.searchsorted(upto, upto[a] + file_ids - held))), len(lens))
                    docs_in += doc_ids[lo + a : lo + z]
                    lens_in.append(lens[a:z])
                    ids_in.append(ids[upto[a] : upto[z]])
                    held += int(upto[z] - upto[a])
                    a = z
                    if held >= file_ids:
                        yield flush()
                        docs_in, lens_in, ids_in, held, seq = [], [], [], 0, seq + 1
        if docs_in:
            yield flush()

    return store(ordered.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the files."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = running_total(files, ["part", "seq"], "n_ids", "first").select("path", "first").repartition(n)

    def read(batches):
        fs, root = pa_fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{path}") as f:
                    file = TokenFile.of(f.read())
                starts, raw = file.starts(), file.ids().astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids(), pa.int64()), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_at(files: DataFrame, folder: str, places: DataFrame) -> DataFrame:
    """place (long, over all files) and its id (token) for a table of places, read by random access.

    Null places and places outside are left out, repeated ones repeat; columns
    beside ``place`` are ignored; without files or places nothing is found.
    """
    placed = running_total(files, ["part", "seq"], "n_ids", "first").select("path", "first", (F.col("first") + F.col("n_ids")).alias("end"), "n_ids")
    # places are dealt to files by blocks of FILE_IDS places, which a file covers as whole or part
    block = files.agg(F.max("n_ids")).first()[0] or 1
    spans = placed.filter("n_ids > 0").withColumn("_block", F.explode(F.sequence((F.col("first") / block).cast("long"), ((F.col("end") - 1) / block).cast("long"))))
    wanted = places.select(F.col("place").cast("long")).withColumn("_block", (F.col("place") / block).cast("long"))
    found = wanted.join(spans, "_block").filter("place >= first AND place < end").select("path", (F.col("place") - F.col("first")).alias("at"), "place")

    def look(batches):
        fs, root = pa_fs.FileSystem.from_uri(folder)
        for b in batches:
            out = []
            for path, at in zip(b.column("path").to_pylist(), b.column("at").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{path}") as f:

                    def fetch(offset, size, f=f):
                        f.seek(offset)
                        return f.read(size)

                    out.append(TokenFile(fetch).id_at(at))
            yield pa.RecordBatch.from_arrays([b.column("place"), pa.array(out, pa.int64())], names=["place", "token"])

    return found.mapInArrow(look, "place long, token long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write token files (to the shared folder where none is given) and return what is read back from them: doc_id, start, n_tokens and ids_crc32 of every row.

    A null or empty text is its end id alone; rows without an id come first, rows
    that share one follow one another in unspecified order; very long texts are
    written whole; other columns are ignored; an empty table gives no rows.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder, id_col, text_col), folder)
