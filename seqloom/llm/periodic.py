"""Periodic stretches of words (runs) by string synchronising sets.

At a scale t, a window of t words is known by a hash of its content. A position is
selected if the least hash of the windows that begin in the t + 1 places from it
is that of the first or the last one; windows with a period of t/3 at most have
no say. So the selection depends on the 2t words of the context alone, and is
empty over t places only where 3t - 1 words have a period of t/3 at most.

A run with period q in [2t, 4t) holds a selected position twice at a distance of
q: pairs of selected positions with equal contexts propose the periods, and each
proposal is extended to both sides as far as words q apart agree. Windows with
short periods, which are omitted, lie in runs of shorter periods: those of
smaller scales, and below the smallest scale regions that are found directly.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.text_arrays import mix, runs

#: A run repeats its period three times and has 24 words at least.
TIMES, LEAST = 3, 24
#: Periods below this are found by comparing words so far apart; the smallest scale is half of it.
DIRECT = 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2^64, up to n at least."""
    if len(_powers[0]) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for i, base in enumerate((_BASE, inverse)):
            steps = np.full(n + n // 4 + 1, base)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class _Text:
    """Prefix sums of a sequence, so that two stretches can be compared in one step; unequal sums prove unequal stretches."""

    def __init__(self, word: np.ndarray):
        self.word, self.n = word, len(word)
        self.power, self.inverse = _grown(self.n + 1)
        terms = mix(word.astype(np.uint64) + np.uint64(1)) * self.power[: self.n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of ``size`` words."""
        return mix((self.sums[at + size] - self.sums[at]) * self.inverse[at])

    def equal(self, a: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` words from ``a`` are those q places on, as far as sums tell."""
        return (self.sums[a + size] - self.sums[a]) * self.power[q] == self.sums[a + q + size] - self.sums[a + q]

    def stretch(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch with period q around each p."""
        fore, back = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        step = 1 << max(self.n.bit_length() - 1, 0)
        while step:
            fits = np.flatnonzero(p + fore + q + step <= self.n)
            fits = fits[self.equal(p[fits] + fore[fits], q[fits], step)]
            fore[fits] += step
            fits = np.flatnonzero(p - back - step >= 0)
            fits = fits[self.equal(p[fits] - back[fits] - step, q[fits], step)]
            back[fits] += step
            step >>= 1
        return p - back, p + q + fore


def _direct(word: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every stretch of TIMES * q words and more whose words q apart agree."""
    same = np.concatenate([[False], word[:-q] == word[q:], [False]]) if len(word) > q else np.zeros(2, bool)
    turn = np.flatnonzero(same[1:] != same[:-1])
    start, end = turn[::2], turn[1::2] + q
    enough = end - start >= TIMES * q
    return start[enough], end[enough]


def selected(text: _Text, size: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising positions at a scale of ``size`` words; ``periodic`` marks windows without a say."""
    if text.n < 2 * size:
        return np.zeros(0, np.int64)
    window = text.windows(np.arange(text.n - size + 1), size)
    window[periodic[: len(window)]] = _NONE
    least, wide = window, 1
    while wide < size:  # size is a power of two
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[:-1], least[1:])
    return np.flatnonzero((least != _NONE) & ((least == window[: len(least)]) | (least == window[size:])))


def _proposed(text: _Text, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions with equal contexts, 2 to 4 times ``size`` apart: (position, distance)."""
    context = text.windows(at, 2 * size)
    order = np.argsort(context, kind="stable")
    context, at = context[order], at[order]
    ps, qs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # windows with a say are more than size / 3 apart where they agree, so that a dozen steps exhaust the pairs
    d = 1
    while d < len(at):
        far = at[d:] - at[:-d]
        near = (context[d:] == context[:-d]) & (far < 4 * size)
        if not near.any():
            break
        near &= far >= 2 * size
        ps.append(at[:-d][near])
        qs.append(far[near])
        d += 1
    return np.concatenate(ps), np.concatenate(qs)


def periodic_stretches(word: np.ndarray, longest: int, part: np.ndarray) -> np.ndarray:
    """start, end and smallest period of all stretches that repeat their period TIMES times and can't be extended.

    ``word`` holds the numbers of the words of many texts, each text followed by a
    number that occurs once; ``part`` is the number of words of the text that a
    place belongs to, ``longest`` its greatest value.
    """
    known: set[tuple[int, int]] = set()  # a stretch has one smallest period; multiples of it come later
    found = [np.zeros((0, 3), np.int64)]

    def add(start, end, q):
        order = np.argsort(q, kind="stable")
        fresh = []
        for s, e, p in zip(start[order].tolist(), end[order].tolist(), q[order].tolist(), strict=True):
            if (s, e) not in known:
                known.add((s, e))
                fresh.append((s, e, p))
        if fresh:
            found.append(np.array(fresh, np.int64))

    for q in range(1, DIRECT):
        start, end = _direct(word, q)
        add(start, end, np.full(len(start), q))
    size = DIRECT // 2
    while 2 * TIMES * size <= longest:
        pos = np.flatnonzero(part >= 2 * TIMES * size)  # texts that are long enough for this scale
        text = _Text(word[pos])
        so_far = np.concatenate(found)
        so_far = so_far[(TIMES * so_far[:, 2] <= size) & (so_far[:, 1] - so_far[:, 0] >= size)]
        edge = np.zeros(len(word) + 1, np.int64)
        np.add.at(edge, so_far[:, 0], 1)
        np.add.at(edge, so_far[:, 1] - size + 1, -1)
        periodic = (np.cumsum(edge)[:-1] > 0)[pos]
        p, q = _proposed(text, size, selected(text, size, periodic))
        if len(p):
            start, end = text.stretch(p, q)
            enough = end - start >= TIMES * q
            kept = np.unique(np.stack([start[enough], end[enough], q[enough], p[enough]], 1), axis=0) if enough.any() else np.zeros((0, 4), np.int64)
            first = np.ones(len(kept), bool)
            first[1:] = (kept[1:, :3] != kept[:-1, :3]).any(1)
            true = []
            for s, e, d, at in kept[first].tolist():
                if not np.array_equal(text.word[s : e - d], text.word[s + d : e]):  # sums agreed by chance
                    starts, ends = _direct(text.word, d)
                    s, e = next(((a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if a <= at < b - d), (0, 0))
                if e:
                    true.append((s, e, d))
            if true:
                start, end, q = np.array(true, np.int64).T
                add(pos[start], pos[end - 1] + 1, q)
        size *= 2
    return np.concatenate(found)


def _runs_of(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text its runs as (start, length, period), by start, then period."""
    number = defaultdict(count().__next__)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    some = [i for i, ws in enumerate(docs) if len(ws) >= LEAST]
    if not some:
        return out
    sizes = np.array([len(docs[i]) for i in some])
    starts = np.cumsum(sizes + 1) - sizes - 1
    word = np.empty(int((sizes + 1).sum()), np.int64)
    for i, at, n in zip(some, starts.tolist(), sizes.tolist(), strict=True):
        word[at : at + n] = np.fromiter(map(number.__getitem__, docs[i]), np.int64, n)
    word[starts + sizes] = len(number) + np.arange(len(some))
    all_found = periodic_stretches(word, int(sizes.max()), np.repeat(sizes, sizes + 1))
    all_found = all_found[all_found[:, 1] - all_found[:, 0] >= LEAST]
    of = np.searchsorted(starts, all_found[:, 0], "right") - 1
    for k, (s, e, q) in zip(of.tolist(), all_found.tolist(), strict=True):
        out[some[k]].append((s - int(starts[k]), e - s, q))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(batches):
    for b in batches:
        for lo, hi, buf, offs in runs(b.column("text")):
            data, offs = buf.tobytes(), offs.tolist()
            docs = [data[x:y].split() for x, y in zip(offs[:-1], offs[1:], strict=True)]  # splits at exactly 0x20 and 0x09-0x0D
            found = _runs_of(docs)
            flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(_RUN)))
            texts = pa.array([_collapsed(w, f).decode() for w, f in zip(docs, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array([len(w) for w in docs], pa.int64()), lists, texts], names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_words, runs (start, length, period; by start, then period) and collapsed text of every row.

    A run is a stretch of words with smallest period q and max(LEAST, TIMES * q)
    words at least that no neighbouring word extends. The collapsed text has the
    words, joined by one space, that no run contains after its first q words. Null
    counts as empty text, which has no runs; rows that repeat an id, or have none,
    are searched each for itself; other columns are ignored; empty in, empty out.
    Texts are searched whole, whatever their length, in one pass without a shuffle.
    """
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_search, "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def with_planted_periods(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text, where a tenth of the texts, by a hash of the id, end in repetitions of some of their own words.

    With h the crc32 of the decimal id and g = floor(h / 10), texts of n > 0 words
    with h % 10 = 0 keep their words up to a = g % n; the p = 1 + floor((n - a) / (3 + g % 8))
    words from there are repeated to the end. Texts without an id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    blanks = "\x20\x09\x0a\x0b\x0c\x0d"
    words = F.split(F.btrim(F.col(text_col), F.lit(blanks)), "[\\x20\\x09-\\x0D]+")
    rare = rows.select(F.col(id_col), F.col(text_col).alias("text"), F.when((h % 10 == 0) & (F.length(F.btrim(F.col(text_col), F.lit(blanks))) > 0), words).alias("w"), g.alias("g"))
    n = F.size("w").cast("long")
    a = F.col("g") % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("g") % 8))
    root = F.slice("w", (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    changed = F.concat_ws(" ", F.concat(F.slice("w", F.lit(1), a.cast("int")), tail))
    return rare.select(F.col(id_col), F.when(F.col("w").isNotNull(), changed).otherwise(F.col("text")).alias(text_col))


def with_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_runs, the run with the greatest length / period (ties: smallest start, then period; nulls without runs) and hashes of runs and collapsed text."""
    better = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"])  # noqa: E731  # runs come by start, then period, so ties keep the earlier
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda acc, r: F.when(better(r, acc), r).otherwise(acc))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * _best.length div _best.period").alias("exponent_milli")
    return out.select(id_col, "n_runs", "_best.start", "_best.length", "_best.period", milli, "runs_sha256", "collapsed_sha256")
