"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams are summed by language over a bounded sample of
labelled rows; the matrix of smoothed log-probabilities (BUCKETS rows, a column a
language) is broadcast, and every text is scored whole by gathering its n-grams'
rows and summing them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.text_arrays import runs

#: n-gram buckets; the model has so many rows.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: About so many labelled rows are sampled to fit the model.
SAMPLE_ROWS = 20_000
#: Texts are undetermined without a letter.
UNDETERMINED = "und"

_LOWER: np.ndarray | None = None
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # (BUCKETS + 1, languages); the last row is 0 and stands for no n-gram


def _lower_case() -> np.ndarray:
    """The small letter of every code point for itself; one whose small form is longer keeps its case."""
    global _LOWER
    if _LOWER is None:
        _LOWER = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x20000):  # capitals end far before
            c = chr(i).lower()
            if len(c) == 1:
                _LOWER[i] = ord(c)
    return _LOWER


def gram_buckets(buf: np.ndarray, offs: np.ndarray):
    """(bucket of the n-gram at each character, start of each row in characters) for each order; BUCKETS where none fits in the row.

    Every character is lower-cased for itself, so that a text's n-grams don't depend on the texts beside it.
    """
    code = _lower_case()[np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)]
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]
    for n in ORDERS:
        h = np.full(len(code), np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF))
        for j in range(n):
            h[: len(code) - j] = (h[: len(code) - j] ^ code[j:]) * _FACTORS[j]
        bucket = (h >> np.uint32(16)).astype(np.int64)
        for j in range(1, n):
            e = at[1:] - j
            bucket[e[e >= at[:-1]]] = BUCKETS
        yield bucket, at


def _counts(texts: pa.Array) -> np.ndarray:
    total = np.zeros(BUCKETS + 1, np.int64)
    for _, _, buf, offs in runs(texts):
        for bucket, _ in gram_buckets(buf, offs):
            total += np.bincount(bucket, minlength=BUCKETS + 1)
    return total[:BUCKETS]


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, partitions: int = 12) -> LanguageModel:
    """Fit on about ``sample_rows`` rows with text and language, chosen by a hash of the id, so that copies are drawn each for itself.

    Rows with a null language or text teach nothing. Without any row to learn
    from, the model has no language and every text stays undetermined.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    n = known.select("lang").count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            langs = b.column("lang").to_numpy(zero_copy_only=False)
            for x in np.unique(langs.astype(str)):
                pick = langs == x
                sums[x] = sums.get(x, 0) + _counts(b.column("text").filter(pa.array(pick)))
                rows[x] = rows.get(x, 0) + int(pick.sum())
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([rows[k] for k in keys]), pa.array([sums[k].tobytes() for k in keys])], names=["lang", "rows", "sums"])

    def add(part):
        import pandas as pd

        total = sum(np.frombuffer(x, np.int64) for x in part["sums"])
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "rows": [int(part["rows"].sum())], "sums": [total.tobytes()]})

    schema = "lang string, rows long, sums binary"
    got = known.select("lang", "text").repartition(partitions).mapInArrow(count, schema).groupBy("lang").applyInPandas(add, schema).collect()
    got.sort(key=lambda r: r.lang)
    if not got:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS + 1, 0), np.float32))
    sums = np.stack([np.frombuffer(r.sums, np.int64) for r in got], 1) + 0.5
    prob = np.zeros((BUCKETS + 1, len(got)), np.float32)
    prob[:BUCKETS] = np.log(sums / sums.sum(0))
    rows = np.array([r.rows for r in got], float)
    return LanguageModel([r.lang for r in got], np.log(rows / rows.sum()), prob)


def score(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the likeliest language, its posterior probability) of each text."""
    best, sure = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    if not model.langs:
        return best, sure
    columns = [np.ascontiguousarray(model.log_prob[:, c], np.float64) for c in range(len(model.langs))]
    for lo, hi, buf, offs in runs(texts):
        total = np.tile(model.log_prior, (hi - lo, 1))
        for bucket, at in gram_buckets(buf, offs):
            full = at[1:] > at[:-1]
            if full.any():
                for c, column in enumerate(columns):
                    total[full, c] += np.add.reduceat(column[bucket], at[:-1][full])
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        best[lo:hi] = p.argmax(1)
        sure[lo:hi] = p.max(1) / p.sum(1)
    return best, sure


def lettered(text: Column) -> Column:
    """Texts with a letter; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def language(text: Column, model: LanguageModel, spark) -> Column:
    """struct(lang string, score double): the likeliest language, or ``und`` with score 0 where the text is null or has no letter."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.value
        best, sure = score(m, texts)
        names = pa.array(m.langs or [UNDETERMINED]).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(sure)], names=["lang", "score"])

    found = predict(F.coalesce(text, F.lit("")))
    return F.when(lettered(text), found).otherwise(F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score")))


def held_out(id_col: str) -> Column:
    """Rows kept out of learning: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learning only from rows that aren't held out.

    Null and letterless texts get ``und`` and score 0; other columns are ignored;
    a null id isn't held out. Repeated rows repeat; an empty table stays empty.
    """
    spark = docs.sparkSession
    model = fit(docs.filter(~held_out(id_col)), lang_col, text_col, id_col)
    found = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), language(F.col(text_col), model, spark).alias("_found"))
    return found.select(id_col, "held_out", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))
