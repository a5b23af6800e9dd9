"""From raw documents to packed training sequences, in five stages.

Each stage is one function of (spark, docs, sf_dir) that returns a DataFrame; its
result is written to the shared folder and read again as the next one's docs. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import exact, language, mixing, neardup, packing
from seqloom.llm.groups import for_texts
from seqloom.session import ship_code
from seqloom.storage import store


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of undetermined language: null texts and texts without a letter.

    Whatever is in a learned language or like one stays, repeated rows and rows
    without an id too. Without any label to learn from, all that have a letter stay.
    """
    for_texts(spark)
    model = language.fit(docs.filter(~language.held_out("doc_id")))
    if not model.langs:
        return docs.filter(language.lettered(F.col("text")))
    found = docs.withColumn("_sl_found", language.language(F.col("text"), model, spark))
    return found.filter(F.col("_sl_found.lang") != language.UNDETERMINED).drop("_sl_found")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose normalised texts are equal, the one with the smallest id stays.

    Null text equals empty text. Rows that repeat the id that stays all stay; rows
    without an id stay only where none of their copies has one.
    """
    for_texts(spark)
    return exact.drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id stays.

    Texts without words stay; rows that share an id are judged each by its own text.
    """
    for_texts(spark)
    return neardup.drop_near_duplicates(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the mix's proportions: a document stands once for each copy taken, or not at all.

    A null source is a source of its own; texts without words go in as often as
    whole copies say; rows that share an id are drawn each for itself.
    """
    for_texts(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids at most.

    A null or empty text is its end id alone; repeated rows are packed each for
    itself; very long texts are cut into as many pieces as they need.
    """
    for_texts(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES = [
    ("language", keep_known_languages),
    ("exact copies", drop_copies),
    ("near duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL has neither the tokenizer nor the sampling hash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = ship_code(spark).read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
