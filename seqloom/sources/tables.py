"""Text tables: annotations, regions, labelled series, master label files, selection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqloom.operators.prefix import at_ranks
from seqloom.storage import exists, store

ANNOTATIONS = "offset long, annotation string, source_file string, source_start long, source_stop long"
#: Samples of an annotated window.
RAW = 5_120


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation CSV with a header; blanks around values go, lines without exactly five fields are dropped."""
    return spark.read.csv(path, schema=ANNOTATIONS, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="DROPMALFORMED", enforceSchema=True)


def labelled_windows(annotations: DataFrame) -> DataFrame:
    """start, stop (RAW samples on), annotation and its id in order of first appearance."""
    first = annotations.groupBy("annotation").agg(F.min("offset").alias("first"))
    ids = first.withColumn("label_id", (F.row_number().over(Window.orderBy("first", "annotation")) - 1).cast("long"))  # a row for each label
    return annotations.join(F.broadcast(ids.drop("first")), "annotation").select(F.col("offset").alias("start"), (F.col("offset") + RAW).alias("stop"), "annotation", "label_id")


def upsert_annotations(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes replace annotations of the same file, start and stop; a null label deletes."""
    key = ["source_file", "source_start", "source_stop"]
    return annotations.join(changes, key, "left_anti").unionByName(changes.filter("annotation IS NOT NULL"), allowMissingColumns=True)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region CSV (starts, stops)."""
    return spark.read.csv(path, schema="starts long, stops long", header=True, ignoreLeadingWhiteSpace=True)


def read_tokens(spark: SparkSession, path: str, step: int = 1) -> DataFrame:
    """CSV of decoded tokens (filename, start, stop, label): file without its ending, start and stop in samples of ``step`` a frame."""
    t = spark.read.csv(path, schema="filename string, start long, stop long, label string", header=True)
    return t.select(F.regexp_replace("filename", r"\.wav$", "").alias("file"), (F.col("start") * step).alias("start"), (F.col("stop") * step).alias("stop"), "label")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """TSV of a class and its series on each line: label, ts."""
    cells = F.split("value", "\t")
    return spark.read.text(path).select(F.element_at(cells, 1).cast("double").cast("int").alias("label"), F.slice(cells, 2, F.size(cells)).cast("array<float>").alias("ts"))


def read_label_file(spark: SparkSession, path: str) -> DataFrame:
    """Master label file: file, start, stop, label, ll. Lines that name a .rec open a file; other labels than ``sil`` are letters for digits."""
    from seqloom.functions.sequences import letters_to_digits

    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"), F.input_file_name().alias("src"))
    header = F.regexp_extract("value", r'([^/"]+)\.rec', 1)
    w = Window.partitionBy("src").orderBy("line")
    named = lines.withColumn("file", F.last(F.when(F.col("value").contains(".rec"), header), True).over(w))
    cells = F.split(F.trim("value"), r"\s+")
    data = named.filter(F.col("file").isNotNull() & (F.size(cells) >= 3) & ~F.col("value").contains(".rec"))
    label = F.element_at(cells, 3)
    return data.select("file", F.element_at(cells, 1).cast("long").alias("start"), F.element_at(cells, 2).cast("long").alias("stop"), F.when(label == "sil", label).otherwise(letters_to_digits(label).cast("string")).alias("label"), F.when(F.size(cells) > 3, F.element_at(cells, 4).cast("double")).alias("ll"))


def write_label_file(df: DataFrame, path: str) -> None:
    """The same file back, one text partition for each file's lines."""
    from seqloom.functions.sequences import digits_to_letters

    name = F.when(F.col("label") == "sil", F.col("label")).otherwise(digits_to_letters(F.col("label")))
    line = F.concat_ws(" ", F.col("start"), F.col("stop"), name, F.col("ll"))
    per_file = df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", line.alias("line")))).alias("lines"))
    per_file.select(F.concat(F.lit('"*/'), "file", F.lit('.rec"\n'), F.array_join("lines.line", "\n"), F.lit("\n.")).alias("value")).write.mode("overwrite").text(path)


def likely(df: DataFrame, part: float = 0.01) -> DataFrame:
    """Annotations whose likelihood is above the one at rank floor(n * part); nulls rank first and are never above."""
    stored = store(df, "annotations")
    place = stored.sparkSession.createDataFrame([(int(stored.count() * part),)], "rank long")
    edge = at_ranks(stored, "ll", place)  # one row
    return stored.crossJoin(F.broadcast(edge.select(F.col("at").alias("_edge")))).filter(F.col("ll") > F.col("_edge")).drop("_edge")


def selections(tokens: DataFrame, part: str = "rec", step: int = 128, rate: int = 44_100) -> DataFrame:
    """Selection table: two views of each token that isn't silence, in seconds; numbers count silences too."""
    w = Window.partitionBy(part).orderBy("start")
    numbered = tokens.withColumn("selection", F.row_number().over(w).cast("long")).filter(~F.col("cls").startswith("_"))
    second = lambda c: F.col(c) * step / float(rate)
    return numbered.select(part, "selection", F.explode(F.array(F.lit("Waveform 1"), F.lit("Spectrogram 1"))).alias("view"), F.lit(1).cast("long").alias("channel"), second("start").alias("begin_s"), second("stop").alias("end_s"), F.col("cls").alias("annotation"))


def write_selections(table: DataFrame, path: str, part: str = "rec") -> None:
    """One folder of tab-separated files for each recording."""
    table.write.mode("overwrite").partitionBy(part).csv(path, sep="\t", header=True)


SEQUENCE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
    T.StructField("sequence", T.ArrayType(T.StructType([T.StructField("cls", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("id", T.IntegerType())]))),
    T.StructField("proba_ids", T.ArrayType(T.IntegerType())),
])


#: Folders that decoded sequences are dealt over.
FOLDERS = 256


def write_sequences(df: DataFrame, path: str) -> None:
    """Decoded sequences with their encounter (the file's stem), dealt over FOLDERS folders by it; a run again replaces its encounters only.

    A folder for each encounter would cost a few files each, which take longer to
    list and open than to read. A folder that a run meets is written anew with what it held
    of other encounters, so runs into one path must follow each other.
    """
    spark = df.sparkSession
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    new = df.select(*SEQUENCE.names).withColumn("encounter_id", stem).withColumn("folder", F.pmod(F.xxhash64("encounter_id"), F.lit(FOLDERS)).cast("int"))
    if exists(spark, path):
        new = store(new, "sequences")
        mine = new.select(F.col("encounter_id").alias("_mine")).distinct()
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(new.select("folder").distinct()), "folder", "left_semi")
        kept = store(old.join(mine, F.col("encounter_id").eqNullSafe(F.col("_mine")), "left_anti"), "kept")
        new = new.unionByName(kept)
    new.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """All decoded sequences but those of queries."""
    schema = T.StructType([*SEQUENCE.fields, T.StructField("encounter_id", T.StringType())])
    return spark.read.schema(schema).parquet(path).select(*schema.names).filter(~F.col("encounter_id").startswith("query"))
