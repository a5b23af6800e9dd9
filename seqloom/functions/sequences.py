"""Column expressions over arrays of symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(symbols: Column, n: int = 2, sep: str = "", include_tail: bool = False) -> Column:
    """Joined runs of ``n`` symbols, in order. Unless asked, the last symbol of a sequence is in none of them."""
    last = F.size(symbols) - n + (1 if include_tail else 0)
    symbols = F.transform(symbols, lambda x: F.coalesce(x, F.lit(""))) if n == 1 else symbols
    grams = F.slice(symbols, F.lit(1), last)
    for j in range(1, n):  # one pass for each further symbol, rather than a slice for each gram
        grams = F.zip_with(grams, F.slice(symbols, F.lit(1 + j), last), lambda a, b: F.concat_ws(sep, a, b))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def phrases(symbols: Column, longest: int = 7, sep: str = " ", include_tail: bool = False) -> Column:
    """All runs of 1 to ``longest`` symbols, shorter ones first, duplicates kept."""
    return F.flatten(F.array(*[ngrams(symbols, n, sep, include_tail) for n in range(1, longest + 1)]))


def overlaps(start_a: Column, stop_a: Column, start_b: Column, stop_b: Column) -> Column:
    """Closed intervals that share a point."""
    return F.greatest(start_a, start_b) <= F.least(stop_a, stop_b)


def silence_class(length: Column, short: int = 35, middle: int = 80) -> Column:
    """Name of a silence by its length in frames."""
    return F.when(length < short, "_").when(length < middle, "__").otherwise("___")


def digits_to_letters(number: Column) -> Column:
    """12 becomes bc: names without digits, for tools that allow none."""
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def letters_to_digits(name: Column) -> Column:
    """The number behind a name; leading letters a are lost like leading zeros."""
    return F.translate(name, "abcdefghij", "0123456789").cast("long")


def clock(samples: Column, rate: int = 44_100) -> Column:
    """Sample offset as h:m:s without leading zeros."""
    seconds = F.floor(samples / rate)
    return F.format_string("%d:%d:%d", F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), (seconds % 60).cast("long"))


def sample_to_frame(sample: Column, window: int = 512, step: int = 128) -> Column:
    return F.floor((sample - window) / step).cast("long")


def frame_to_sample(frame: Column, window: int = 512, step: int = 128) -> Column:
    return (frame * step + window).cast("long")


def bin_to_hz(place: Column, window: int, rate: int = 44_100) -> Column:
    """Frequency of a bin of a transform of ``window`` samples."""
    return place * rate / float(window)
