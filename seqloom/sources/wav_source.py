"""Recordings as a data source: ``spark.read.format("wav")`` reads a folder of WAV files in splits, however long a file is."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from seqloom.sources.recordings import unpack_samples, wav_format

#: Frames of one row, bytes of one split, and bytes in front of the samples that are looked through for the header at once.
FRAMES, SPLIT, HEAD = 4_096, 1 << 25, 1 << 16
#: Tasks that small splits are dealt to; more where they would have more than SPLIT bytes each.
TASKS = 256
SCHEMA = "path string, sample_rate int, bits int, channels int, frames long, start long, samples array<long>"


@dataclass
class Header:
    rate: int
    bits: int
    channels: int
    wide: int
    at: int  # byte of the first sample
    frames: int


def read_header(f: pa.NativeFile, size: int) -> Header:
    """Walks from chunk to chunk without reading the samples; a file that ends before its data says so has the frames that are there."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            form = wav_format(f.read(min(length, 64)))
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            channels, rate, bits, wide = form
            return Header(rate, bits, channels, wide, at + 8, min(length, size - at - 8) // (wide * channels))
        at += 8 + length + length % 2
    raise ValueError("no data")


@dataclass
class Split(InputPartition):
    """Bytes ``lo`` to ``hi`` of a file of ``size`` bytes: the rows whose first byte lies there."""

    path: str
    size: int
    lo: int
    hi: int

    def __init__(self, path: str, size: int, lo: int, hi: int):
        self.path, self.size, self.lo, self.hi = path, size, lo, hi


@dataclass
class Splits(InputPartition):
    """Splits that one task reads."""

    of: list[Split]

    def __init__(self, of: list[Split]):
        self.of = of


class WavReader(DataSourceReader):
    """The driver lists files and their sizes; headers are read by the tasks."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.channel = options.get("channel", "0")
        self.rows, self.split, self.strict = int(options.get("frames", FRAMES)), int(options.get("split", SPLIT)), options.get("strict", "false") == "true"
        # frames that are asked for; as options, since filters that Spark pushes into a Python source stay there for other queries of the same table
        self.least, self.most = max(0, int(options.get("first", 0)) - self.rows + 1), int(options["last"]) if "last" in options else None

    def partitions(self):
        fs, root = pa_fs.FileSystem.from_uri(self.root)
        info = fs.get_file_info([root])[0]
        files = [info] if info.is_file else fs.get_file_info(pa_fs.FileSelector(root, recursive=True))
        named = [f for f in files if f.is_file and f.path.lower().endswith(".wav")]
        splits = [Split(f.path, f.size, lo, min(lo + self.split, f.size)) for f in named for lo in range(0, max(f.size, 1), self.split)]
        each = max(1, -(-len(splits) // max(TASKS, sum(p.hi - p.lo for p in splits) // SPLIT)))  # else a folder of many short files is as many tasks
        return [Splits(splits[i : i + each]) for i in range(0, len(splits), each)] or [Splits([])]

    def read(self, part: Splits) -> Iterator[pa.RecordBatch]:
        fs, _ = pa_fs.FileSystem.from_uri(self.root)
        for split in part.of:
            yield from self._rows(fs, split)

    def _rows(self, fs: pa_fs.FileSystem, part: Split) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(part.path) as f:
            try:
                h = read_header(f, part.size)
                if not (self.channel == "sum" or 0 <= int(self.channel) < h.channels):
                    raise ValueError(f"no channel {self.channel}")
            except (ValueError, struct.error) as e:
                if self.strict:
                    raise ValueError(f"{part.path}: {e}") from e
                if not part.lo:  # one row without samples says that there was a file
                    yield self._batch(part.path, None, [0], [np.zeros(0, np.int64)])
                return
            align = h.wide * h.channels
            row = align * self.rows
            # the row that begins at byte h.at + k * row belongs to the split that holds this byte
            first, end = max(0, -(-(part.lo - h.at) // row)), max(0, -(-(part.hi - h.at) // row))
            first = max(first, -(-self.least // self.rows))
            end = min(end, -(-h.frames // self.rows), end if self.most is None else max(self.most, -1) // self.rows + 1)
            if not h.frames and part.lo <= h.at <= part.hi and not self.least:
                yield self._batch(part.path, h, [0], [np.zeros(0, np.int64)])
            for k in range(first, end):
                n = min(self.rows, h.frames - k * self.rows)
                f.seek(h.at + k * row)
                x = unpack_samples(f.read(n * align), h.wide, h.bits).reshape(-1, h.channels)
                yield self._batch(part.path, h, [k * self.rows], [x.sum(1) if self.channel == "sum" else x[:, int(self.channel)]])

    def _batch(self, path: str, h: Header | None, start: list[int], samples: list[np.ndarray]) -> pa.RecordBatch:
        known = (h.rate, h.bits, h.channels, h.frames) if h else (None, None, None, None)
        cols = [pa.array([path]), *[pa.array([v], t) for v, t in zip(known, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], pa.array(start, pa.int64()), pa.array(samples, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["path", "sample_rate", "bits", "channels", "frames", "start", "samples"])


class WavSource(DataSource):
    """Options: ``path`` (a file or folder that all workers can open), ``channel`` (a number from 0, or or ``sum`` for all channels together),
    ``frames`` of a row, bytes of a ``split``, ``first`` and ``last`` frame (rows without any frame between are not read), ``strict`` (else a file that can't be read gives one row without samples)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WavReader:
        return WavReader({k.lower(): v for k, v in self.options.items()})


def read_recordings(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of FRAMES frames of every recording below a path, with the frame where each begins."""
    spark.dataSource.register(WavSource)
    reader = spark.read.format("wav")
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load(path)


def samples_of(rows: DataFrame) -> DataFrame:
    """path, t and x of every sample."""
    return rows.select("path", "start", F.posexplode("samples").alias("i", "x")).select("path", (F.col("start") + F.col("i")).alias("t"), "x")


def view(spark: SparkSession, path: str, first: int, size: int, backward: bool = False, **options) -> DataFrame:
    """path and samples of ``size`` frames of every recording from frame ``first`` on, or the ``size`` frames before it with ``backward``.

    Only the rows that overlap the view are read. Views that reach over an end are shorter.
    """
    lo, hi = (first - size, first) if backward else (first, first + size)
    rows = read_recordings(spark, path, first=lo, last=hi - 1, **options)
    inside = samples_of(rows).filter((F.col("t") >= lo) & (F.col("t") < hi))
    return inside.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("l")).select("path", F.col("l.x").alias("samples"))
