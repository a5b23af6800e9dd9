"""Recordings and feature files as binary tables: WAV in and out, spectrograms, feature files for sequence tools."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the spectrogram: window, step, and the bins kept of the upper half of the transform.
WINDOW, STEP, LOW, HIGH = 512, 128, 100, 230
RATE = 44_100


def wav_format(body: bytes) -> tuple[int, int, int, int]:
    """(channels, rate, bits, bytes a sample) of a format chunk."""
    if len(body) < 16:
        raise ValueError("the format is cut short")
    kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", body)
    if kind not in (1, 0xFFFE) or not 2 <= bits <= 64 or channels < 1 or align != channels * -(-bits // 8):
        raise ValueError("not linear PCM of 2 to 64 bits")
    return channels, rate, bits, align // channels


def unpack_samples(body: bytes, wide: int, bits: int) -> np.ndarray:
    """Samples of ``wide`` bytes as longs; one byte is unsigned."""
    cells = np.frombuffer(body, np.uint8, len(body) // wide * wide).reshape(-1, wide)
    full = np.zeros((len(cells), 8), np.uint8)
    full[:, :wide] = cells
    if wide > 1:
        full[:, wide:] = np.where(cells[:, -1:] & 0x80, 0xFF, 0)
    values = full.view("<i8").ravel()
    return values - (1 << (bits - 1)) if wide == 1 else values


def parse_wav(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(sample rate, valid bits, samples [frames, channels]) of PCM data; chunks that aren't known are skipped. 8 bits and fewer are unsigned."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = wav_format(body)
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            channels, rate, bits, wide = form
            n = len(body) // (wide * channels)
            return rate, bits, unpack_samples(body[: n * channels * wide], wide, bits).reshape(n, channels)
        at += 8 + size + size % 2
    raise ValueError("no data")


def make_wav(samples: np.ndarray, rate: int = RATE, bits: int = 16) -> bytes:
    """RIFF bytes of [frames, channels] integer samples, little-endian and padded to whole words. A sample that ``bits`` can't hold is an error."""
    samples = np.asarray(samples, np.int64)
    samples = samples[:, None] if samples.ndim == 1 else samples
    top = 1 << (bits - 1)
    if samples.size and not (samples.min() >= -top and samples.max() < top):
        raise ValueError(f"samples from {samples.min()} to {samples.max()} don't fit {bits} bits")
    wide = -(-bits // 8)
    stored = samples + top if wide == 1 else samples
    body = np.ascontiguousarray(stored.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
    channels = samples.shape[1]
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * wide, channels * wide, bits)
    padded = body + bytes(len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(head) + 8 + len(padded)) + b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + padded


def read_wavs(spark: SparkSession, path: str, mix: bool = False, strict: bool = False) -> DataFrame:
    """path, sample_rate, bits, n and samples of every ``.wav`` under a folder: the first channel, or with ``mix`` the channels' mean scaled to -1..1.

    Files that can't be read have no samples and n = 0, unless ``strict``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(path)
    kind = "array<double>" if mix else "array<long>"

    def parse(batches):
        for b in batches:
            rows = []
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rate, bits, x = parse_wav(raw)
                    x = (x.mean(1) / (1 << (bits - 1))) if mix else x[:, 0]
                except (ValueError, struct.error):
                    if strict:
                        raise
                    rate, bits, x = None, None, np.zeros(0, np.int64)
                rows.append((p, rate, bits, len(x), x))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64() if mix else pa.int64())), strict=True)] if rows else None
            if cols:
                yield pa.RecordBatch.from_arrays(cols, names=["path", "sample_rate", "bits", "n", "samples"])

    return files.select("path", "content").mapInArrow(parse, f"path string, sample_rate int, bits int, n long, samples {kind}")


def write_wavs(recordings: DataFrame, folder: str, rate: int = RATE, bits: int = 16, channels: int = 1) -> None:
    """A WAV file for each row (name, samples) in a folder that all workers can open; channels behind the first are silent; null samples are an empty recording. A task that runs again replaces its files."""

    def write(batches):
        fs, root = pa_fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        for b in batches:
            for name, x in zip(b.column("name").to_pylist(), b.column("samples").to_pylist(), strict=True):
                samples = np.zeros((len(x or []), channels), np.int64)
                samples[:, 0] = x or []
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(make_wav(samples, rate, bits))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    recordings.select("name", "samples").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def wav_bytes(samples: Column, rate: int = RATE, bits: int = 16) -> Column:
    """The WAV file of a column of sample arrays."""

    @F.arrow_udf("binary")
    def make(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else make_wav(np.array(x, np.int64), rate, bits) for x in column.to_pylist()], pa.binary())

    return make(samples)


def joined(parts: DataFrame, group: str, order: str, samples: str = "samples", gap: int = 0) -> DataFrame:
    """One row a group: its parts in order, laid end to end with ``gap`` zeros between, and where each starts and stops."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(samples).alias("x"))))
    g = parts.groupBy(group).agg(listed.alias("parts"))
    zero = F.array_repeat(F.lit(0).cast("long"), gap)
    laid = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["x"]).otherwise(F.concat(zero, p["x"]))))
    begin = lambda a: F.coalesce(F.get(F.slice(a["stop"], -1, 1), F.lit(0)) + gap, F.lit(0).cast("long"))
    spans = F.aggregate("parts", F.array().cast("array<struct<start:long,stop:long>>"), lambda a, p: F.array_append(a, F.struct(begin(a).alias("start"), (begin(a) + F.size(p["x"])).alias("stop"))))
    return g.select(group, laid.alias("samples"), spans.alias("spans"))


def spectrogram(samples: np.ndarray, window: int = WINDOW, step: int = STEP, low: int = LOW, high: int = HIGH, normalise: bool = True) -> np.ndarray:
    """[frames, high - low] magnitudes of Hann-windowed transforms, each frame normalised by (x - mean) / (deviation + 1) over all bins first."""
    x = np.asarray(samples, float)
    frames = [x[i : i + window] for i in range(0, len(x) - window, step)]
    if not frames:
        return np.zeros((0, high - low))
    full = np.abs(np.fft.fft(np.array(frames) * np.hanning(window)))
    if normalise:
        full = (full - full.mean(1, keepdims=True)) / (full.std(1, keepdims=True) + 1)
    return full[:, window // 2 :][:, low:high]


def falling_spectrogram(samples: np.ndarray, window: int = WINDOW, step: int = STEP) -> np.ndarray:
    """[frames, window / 2] magnitudes from the highest frequency down, of windows whose first half is weighed by 0.54 + 0.46 cos and whose second half is silent.

    The last magnitude is that of the mean and of the frequency beyond the highest together.
    """
    x, half = np.asarray(samples, float), window // 2
    frames = [x[i : i + window] for i in range(0, len(x) - window, step)]
    if not frames:
        return np.zeros((0, half))
    weight = np.where(np.arange(window) < half, 0.54 + 0.46 * np.cos(2 * np.pi * np.arange(window) / window), 0)
    full = np.fft.rfft(np.array(frames) * weight)
    return np.concatenate([np.abs(full[:, half - 1 : 0 : -1]), np.hypot(full[:, :1].real, full[:, half : half + 1].real)], 1)


def slices(recordings: DataFrame, regions: DataFrame) -> DataFrame:
    """path, starts, stops and samples of every region (path, starts, stops) of recordings (path, samples); regions that reach over the end are cut, empty ones left out."""
    size = F.col("stops") - F.col("starts")
    cut = F.slice("samples", (F.col("starts") + 1).cast("int"), size.cast("int"))
    return regions.filter("starts >= 0 AND stops > starts").join(recordings.select("path", "samples"), "path").select("path", "starts", "stops", cut.alias("samples")).filter(F.size("samples") > 0)


def frames_of(recordings: DataFrame, falling: bool = False, **how) -> DataFrame:
    """path, t and bins of every frame of recordings (path, samples)."""
    make = falling_spectrogram if falling else spectrogram

    def expand(batches):
        for b in batches:
            for p, x in zip(b.column("path").to_pylist(), b.column("samples").to_pylist(), strict=True):
                s = make(np.array(x or []), **how).astype(np.float32)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(s)), pa.array(np.arange(len(s))), pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), s.shape[1]).cast(pa.list_(pa.float32()))], names=["path", "t", "bins"])

    return recordings.select("path", "samples").mapInArrow(expand, "path string, t long, bins array<float>")


def feature_bytes(frames: np.ndarray, normalise: bool = True) -> bytes:
    """Big-endian feature file: number of frames, period 1, bytes a frame, kind 9, then floats; frames are z-normed one by one."""
    x = np.asarray(frames, float)
    if normalise:
        x = (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-8)
    return struct.pack(">iihh", len(x), 1, 4 * x.shape[1], 9) + x.astype(">f4").tobytes()


def parse_features(raw: bytes) -> np.ndarray:
    n, _, size, _ = struct.unpack_from(">iihh", raw)
    return np.frombuffer(raw, ">f4", offset=12).reshape(n, size // 4).astype(np.float32)


def series_bytes(ts_id: int, ts: np.ndarray, dim: int) -> bytes:
    """A series as stored on its own: id, length and dimension, then floats, little-endian."""
    x = np.asarray(ts, "<f4")
    return struct.pack("<iii", ts_id, len(x) // dim, dim) + x.tobytes()


def parse_series(raw: bytes) -> tuple[int, np.ndarray, int]:
    ts_id, length, dim = struct.unpack_from("<iii", raw)
    return ts_id, np.frombuffer(raw, "<f4", length * dim, 12), dim
