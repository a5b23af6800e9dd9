"""Queries that write what the readers read, in a scratch folder, and read it back: recordings, label files, tables, indexes, streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.functions import sequences as fs
from seqloom.functions import vectors as fv
from seqloom.operators import labels, tokens, windows
from seqloom.operators.series_index import SeriesIndex
from seqloom.plans import query
from seqloom.plans.vectors import DIM
from seqloom.plans.views import CLASSES, FRAMES, SEQUENCES, SERIES, TOKENS, event_sequences, frames, queries_of, series, table
from seqloom.plans.views import tokens as token_view
from seqloom.sources import recordings, tables, texts, wav_source
from seqloom.storage import scratch_path, store
from seqloom.streaming import ingest

R = 6


@query("sequence_files", f"WITH {TOKENS} SELECT 'rec-' || rec AS encounter, cls, start, stop, cid AS id FROM tokens")
def sequence_files(spark, sf):
    """Decoded sequences, written with their recordings and read back."""
    path = scratch_path(spark, "sequences")
    t = token_view(spark, sf).withColumn("path", F.format_string("store/rec-%d.wav", "rec"))
    row = F.struct("cls", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("cid").cast("int").alias("id"))
    d = t.groupBy("path").agg(F.min("start").cast("int").alias("start"), F.max("stop").cast("int").alias("stop"), F.collect_list(row).alias("sequence"), F.array().cast("array<int>").alias("proba_ids"))
    tables.write_sequences(d, path)
    out = tables.read_sequences(spark, path).select(F.col("encounter_id").alias("encounter"), F.explode("sequence").alias("t"))
    return out.select("encounter", "t.cls", *[F.col(f"t.{c}").cast("long").alias(c) for c in ("start", "stop", "id")])


_NOTES = "notes AS (SELECT event_id AS \"offset\", event_type AS annotation, 'f' || (user_id % 7) || '.wav' AS source_file, event_id * 10 AS source_start, event_id * 10 + 5 AS source_stop FROM events)"


def _notes(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("offset"), F.col("event_type").alias("annotation"), F.format_string("f%d.wav", F.col("user_id") % 7).alias("source_file"), (F.col("event_id") * 10).alias("source_start"), (F.col("event_id") * 10 + 5).alias("source_stop"))


def _stored_notes(spark, sf):
    path = scratch_path(spark, "annotations")
    _notes(spark, sf).write.csv(path, header=True)
    return tables.read_annotations(spark, path)


@query("annotation_file", f"WITH {_NOTES} SELECT * FROM notes")
def annotation_file(spark, sf):
    return _stored_notes(spark, sf)


@query("annotated_windows", f"WITH {_NOTES}, i AS (SELECT annotation, row_number() OVER (ORDER BY min(\"offset\"), annotation) - 1 AS label_id FROM notes GROUP BY annotation) SELECT \"offset\" AS start, \"offset\" + 5120 AS stop, annotation, label_id FROM notes JOIN i USING (annotation)")
def annotated_windows(spark, sf):
    return tables.labelled_windows(_stored_notes(spark, sf))


@query("annotation_upsert", f"WITH {_NOTES} SELECT \"offset\", CASE WHEN \"offset\" % 7 = 0 THEN 'CHANGED' ELSE annotation END AS annotation, source_file, source_start, source_stop FROM notes WHERE \"offset\" % 7 = 0 OR \"offset\" % 11 <> 0")
def annotation_upsert(spark, sf):
    """Some annotations relabelled, some deleted, in one table of changes."""
    n = _notes(spark, sf)
    label = F.when(F.col("offset") % 7 == 0, F.lit("CHANGED"))
    return tables.upsert_annotations(n, n.filter("offset % 7 = 0 OR offset % 11 = 0").withColumn("annotation", label))


@query("token_csv", f"WITH {TOKENS} SELECT 'rec-' || rec AS file, start * 128 AS start, stop * 128 AS stop, cls FROM tokens")
def token_csv(spark, sf):
    """Tokens as CSV with recordings' names, read back in samples."""
    path = scratch_path(spark, "tokens")
    t = token_view(spark, sf).select(F.format_string("rec-%d.wav", "rec").alias("filename"), "start", "stop", F.col("cls").alias("label"))
    t.write.csv(path, header=True)
    return tables.read_tokens(spark, path, 128).withColumnRenamed("label", "cls")


_LABELLED = f"{TOKENS}, lab AS (SELECT 'r' || rec AS file, start, stop, CASE WHEN cid = 0 THEN 'sil' ELSE CAST(cid AS VARCHAR) END AS label, CAST(-(start % 97) AS DOUBLE) AS ll FROM tokens)"


def _label_file(spark, sf):
    t = token_view(spark, sf).select(F.format_string("r%d", "rec").alias("file"), "start", "stop", F.when(F.col("cid") == 0, "sil").otherwise(F.col("cid").cast("string")).alias("label"), (-(F.col("start") % 97)).cast("double").alias("ll"))
    path = scratch_path(spark, "labels")
    tables.write_label_file(t, path)
    return tables.read_label_file(spark, path)


@query("label_file", f"WITH {_LABELLED} SELECT * FROM lab")
def label_file(spark, sf):
    """Master label file written and read back: names without digits in the file, numbers outside."""
    return _label_file(spark, sf)


@query("label_spans", f"WITH {_LABELLED} SELECT file, start * 640 AS start, stop * 640 AS stop, label FROM lab WHERE label <> 'sil' AND ll > (SELECT ll FROM lab ORDER BY ll LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.01) AS BIGINT) FROM lab))")
def label_spans(spark, sf):
    """Likely labels of a label file but silences, in samples: a frame is half of ten steps of 128."""
    d = tables.likely(_label_file(spark, sf)).filter("label <> 'sil'")
    return d.select("file", (F.col("start") * (10 // 2 * 128)).alias("start"), (F.col("stop") * (10 // 2 * 128)).alias("stop"), "label")


@query("label_names", f"WITH {_LABELLED} SELECT label, CAST(count(*) AS BIGINT) AS n FROM lab GROUP BY label")
def label_names(spark, sf):
    return _label_file(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query("label_result_pairs", f"WITH {_LABELLED}, f AS (SELECT file, arg_min(label, start) AS label FROM lab GROUP BY file) SELECT file AS truth, CASE WHEN label = 'sil' THEN label ELSE translate(label, '0123456789', 'abcdefghij') END AS predicted FROM f")
def label_result_pairs(spark, sf):
    """The truth in a result file's names beside the first label below each."""
    t = token_view(spark, sf).select(F.format_string("r%d", "rec").alias("file"), "start", "stop", F.when(F.col("cid") == 0, "sil").otherwise(F.col("cid").cast("string")).alias("label"), F.lit(0.0).alias("ll"))
    path = scratch_path(spark, "results")
    tables.write_label_file(t, path)
    return texts.result_pairs(spark, path)


_WORDS = f"WITH {_LABELLED}, w AS (SELECT DISTINCT translate(label, '0123456789', 'abcdefghij') AS w FROM lab WHERE label <> 'sil')"


@query("label_grammar", f"{_WORDS} SELECT '$unit = ' || string_agg(w, ' | ' ORDER BY w) || ';' || chr(10) || '( < $unit | sil > )' AS value FROM w")
def label_grammar(spark, sf):
    return texts.grammar(_label_file(spark, sf), continuous=True)


@query("label_words", f"{_WORDS} SELECT w || ' ' || w AS value FROM (SELECT w FROM w UNION SELECT 'sil')")
def label_words(spark, sf):
    return texts.word_list(_label_file(spark, sf))


@query("series_file", f"WITH {SERIES} SELECT label, i, round(sum(CAST(CAST(ts[i + 1] AS FLOAT) AS DOUBLE)), 4) AS total, CAST(count(*) AS BIGINT) AS n FROM series, (SELECT unnest(range(64)) AS i) GROUP BY label, i")
def series_file(spark, sf):
    """Series as tab-separated text with their class in front, read back and added up place by place."""
    path = scratch_path(spark, "series")
    s = series(spark, sf).select(F.concat_ws("\t", F.col("label").cast("string"), F.array_join(F.col("ts").cast("array<float>").cast("array<string>"), "\t")).alias("value"))
    s.write.text(path)
    out = tables.read_series(spark, path).select(F.col("label").cast("long").alias("label"), F.posexplode("ts").alias("i", "v"))
    return out.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.sum(F.col("v").cast("double")), 4).alias("total"), F.count("*").alias("n"))


@query("saved_index", f"WITH {SERIES} SELECT ts_id, true AS same_leaf FROM series")
def saved_index(spark, sf):
    """An index saved and loaded files every series in the leaf it was filed in before."""
    s = series(spark, sf)
    index, path = SeriesIndex.build(s, dim=DIM), scratch_path(spark, "index")
    index.save(path)
    loaded = SeriesIndex.load(spark, path)
    now = loaded.query(s).filter("q = ts_id").select(F.col("q").alias("ts_id"), F.col("leaf_id").alias("now"))
    return index.buckets.join(now, "ts_id").select("ts_id", (F.col("leaf_id") == F.col("now")).alias("same_leaf"))


@query("grown_index", f"WITH {SERIES} SELECT ts_id, true AS found FROM series")
def grown_index(spark, sf):
    """An index of the even series into which the odd ones are inserted under the same tree holds all, each where a search for it ends."""
    s = series(spark, sf)
    index = SeriesIndex.build(s.filter("ts_id % 2 = 0"), dim=DIM).insert(s.filter("ts_id % 2 = 1"))
    hits = index.query(s).filter("q = ts_id").select("ts_id", F.lit(True).alias("hit"))
    return index.buckets.join(hits, "ts_id", "left").select("ts_id", F.coalesce("hit", F.lit(False)).alias("found"))


def _recorded(spark, sf, name="recordings"):
    """Each user's values in hundredths as a recording of 24 bits and two channels, the second silent, written as WAV files."""
    path = scratch_path(spark, name)
    f = frames(spark, sf).withColumn("x", F.round(F.col("value") * 100).cast("long"))
    s = f.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("l")).select(F.format_string("r%d.wav", "rec").alias("name"), F.col("l.x").alias("samples"))
    recordings.write_wavs(s, path, bits=24, channels=2)
    return path


_SAMPLES = f"{FRAMES}, samples AS (SELECT 'r' || rec || '.wav' AS name, t, CAST(round(value * 100) AS BIGINT) AS x FROM frames)"


def _name(path="path"):
    return F.element_at(F.split(path, "/"), -1)


@query("wav_files", f"WITH {_SAMPLES} SELECT name, t, x, CAST(44100 AS BIGINT) AS rate FROM samples")
def wav_files(spark, sf):
    """First channel of a folder of recordings."""
    d = recordings.read_wavs(spark, _recorded(spark, sf)).filter("n > 0")
    return d.select(_name().alias("name"), F.posexplode("samples").alias("t", "x"), F.col("sample_rate").cast("long").alias("rate")).withColumn("t", F.col("t").cast("long"))


@query("wav_splits", f"WITH {_SAMPLES} SELECT name, t, x, count(*) OVER (PARTITION BY name) AS frames FROM samples")
def wav_splits(spark, sf):
    """The same by the data source, in rows of sixteen frames and splits of 300 bytes, so that many tasks share a file."""
    rows = wav_source.read_recordings(spark, _recorded(spark, sf), frames=16, split=300)
    sizes = rows.filter("start = 0").select("path", "frames")
    return wav_source.samples_of(rows).join(sizes, "path").select(_name().alias("name"), "t", "x", "frames")


_VIEW = f"WITH {_SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY t) AS r FROM samples WHERE t >= {{lo}} AND t < {{hi}}) SELECT name, list(x ORDER BY t) AS samples FROM n GROUP BY name"


@query("wav_forward", f"SELECT name, array_to_string(samples, ' ') AS samples FROM ({_VIEW.format(lo=25, hi=45)})")
def wav_forward(spark, sf):
    """Twenty frames of every recording from frame 25 on; only rows that overlap them are read."""
    v = wav_source.view(spark, _recorded(spark, sf), 25, 20, frames=8)
    return v.select(_name().alias("name"), F.array_join(F.col("samples").cast("array<string>"), " ").alias("samples"))


@query("wav_backward", f"SELECT name, array_to_string(samples, ' ') AS samples FROM ({_VIEW.format(lo=5, hi=25)})")
def wav_backward(spark, sf):
    """The twenty frames before frame 25."""
    v = wav_source.view(spark, _recorded(spark, sf), 25, 20, backward=True, frames=8)
    return v.select(_name().alias("name"), F.array_join(F.col("samples").cast("array<string>"), " ").alias("samples"))


@query("wav_mixdown", f"WITH {_SAMPLES} SELECT name, CAST(count(*) AS BIGINT) AS n, round(sum(x / 2.0 / 8388608), 6) AS total FROM samples GROUP BY name")
def wav_mixdown(spark, sf):
    """Mean of both channels, scaled to -1..1."""
    d = recordings.read_wavs(spark, _recorded(spark, sf), mix=True)
    return d.select(_name().alias("name"), "n", F.round(fv.total(F.col("samples")), R).alias("total"))


_DFT = " + ".join(f"w[{i + 1}] * {float(0.5 - 0.5 * np.cos(2 * np.pi * i / 15))!r} * {{f}}(2 * pi() * k * {i} / 16.0)" for i in range(16))


@query(
    "wav_spectrogram",
    f"""WITH {_SAMPLES}, s AS (SELECT name, list(x ORDER BY t) AS xs FROM samples GROUP BY name), o AS (SELECT name, xs, unnest(range(0, len(xs) - 16, 8)) AS a FROM s WHERE len(xs) > 16),
c AS (SELECT name, a // 8 AS t, xs[a + 1:a + 16] AS w, unnest(range(16)) AS k FROM o), m AS (SELECT name, t, k, sqrt(({_DFT.format(f='cos')}) ** 2 + ({_DFT.format(f='sin')}) ** 2) AS m FROM c),
z AS (SELECT *, (m - avg(m) OVER p) / (stddev_pop(m) OVER p + 1) AS z FROM m WINDOW p AS (PARTITION BY name, t)) SELECT name, t, k - 8 AS bin, round(z, 3) + 0.0 AS z FROM z WHERE k >= 8""",
)
def wav_spectrogram(spark, sf):
    """Hann-windowed frames of sixteen samples, eight apart, and the upper half of their bins."""
    f = recordings.frames_of(recordings.read_wavs(spark, _recorded(spark, sf)), window=16, step=8, low=0, high=8)
    return f.select(_name().alias("name"), "t", F.posexplode("bins").alias("bin", "z")).select("name", "t", F.col("bin").cast("long").alias("bin"), (F.round(F.col("z").cast("double"), 3) + 0.0).alias("z"))


@query("snippet_export", f"WITH {TOKENS} SELECT rec, cls AS annotation, start AS source_start, stop AS source_stop, (row_number() OVER (PARTITION BY rec ORDER BY start) - 1) * 5120 AS \"offset\" FROM tokens")
def snippet_export(spark, sf):
    """Snippets of one length laid end to end: where each token's begins in its recording's export."""
    t = token_view(spark, sf).select("rec", F.col("cls").alias("annotation"), F.col("start").alias("source_start"), F.col("stop").alias("source_stop"), F.lit(tables.RAW).cast("long").alias("length"))
    return windows.running_offset(t, "length", "rec", ["source_start"]).select("rec", "annotation", "source_start", "source_stop", F.col("start").alias("offset"))


def _through(spark, column, make, kind):
    """A column passed through Python bytes and back."""

    @F.arrow_udf(kind)
    def there_and_back(values: pa.Array) -> pa.Array:
        return pa.array([make(np.array(v, float)) for v in values.to_pylist()])

    return there_and_back(column)


@query("feature_file", f"WITH {SERIES}, f AS (SELECT ts_id, i, unnest(range(4)) AS k, ts[i * 4 + 1:i * 4 + 4] AS w FROM (SELECT ts_id, ts, unnest(range(16)) AS i FROM series)) SELECT ts_id, i * 4 + k AS i, round(CAST(CAST((w[k + 1] - list_avg(w)) / (list_stddev_pop(w) + 1e-8) AS FLOAT) AS DOUBLE), 3) + 0.0 AS v FROM f")
def feature_file(spark, sf):
    """Frames of four channels as a big-endian feature file, z-normed one by one."""
    back = _through(spark, F.col("ts"), lambda x: recordings.parse_features(recordings.feature_bytes(x.reshape(-1, DIM))).ravel().tolist(), "array<float>")
    return series(spark, sf).select("ts_id", F.posexplode(back).alias("i", "v")).select("ts_id", F.col("i").cast("long").alias("i"), (F.round(F.col("v").cast("double"), 3) + 0.0).alias("v"))


@query("series_bytes", f"WITH {SERIES} SELECT ts_id, unnest(range(64)) AS i, round(CAST(CAST(unnest(ts) AS FLOAT) AS DOUBLE), 6) AS v FROM series")
def series_bytes(spark, sf):
    """Series in the little-endian form of a stored index."""
    back = _through(spark, F.col("ts"), lambda x: recordings.parse_series(recordings.series_bytes(0, x, DIM))[1].tolist(), "array<float>")
    return series(spark, sf).select("ts_id", F.posexplode(back).alias("i", "v")).select("ts_id", F.col("i").cast("long").alias("i"), F.round(F.col("v").cast("double"), R).alias("v"))


@query("snapshot", f"WITH {SEQUENCES} SELECT seq_id, array_to_string(symbols, ' ') AS symbols FROM sequences")
def snapshot(spark, sf):
    """The search corpus as a stored table."""
    return store(event_sequences(spark, sf), "snapshot").select("seq_id", F.array_join("symbols", " ").alias("symbols"))


@query("finite_series", f"WITH {SERIES}, v AS (SELECT ts_id, unnest(range(64)) AS i, unnest(ts) AS x FROM series) SELECT ts_id, i, CASE WHEN x < 0 THEN 0 ELSE round(sqrt(x), 6) END AS v FROM v")
def finite_series(spark, sf):
    """Roots of series, where those of negative numbers become 0."""
    root = F.transform("ts", lambda x: F.sqrt(x))
    return series(spark, sf).select("ts_id", F.posexplode(fv.finite_or_zero(root)).alias("i", "v")).select("ts_id", F.col("i").cast("long").alias("i"), F.round("v", R).alias("v"))


@query("view_annotations", f"WITH {TOKENS} SELECT rec, start, stop, cls FROM tokens WHERE start >= 10 AND stop <= 40")
def view_annotations(spark, sf):
    """Tokens that lie inside the frames 10 to 40."""
    return labels.in_view(token_view(spark, sf), 10, 40).select("rec", "start", "stop", "cls")


@query("point_annotations", f"WITH {TOKENS} SELECT rec, start, stop, cls FROM tokens WHERE 25 BETWEEN start AND stop")
def point_annotations(spark, sf):
    return labels.at_point(token_view(spark, sf), 25).select("rec", "start", "stop", "cls")


@query("frame_page", f"WITH {FRAMES}, n AS (SELECT rec FROM frames WHERE t >= 20 AND t < 40 GROUP BY rec HAVING count(*) >= 15) SELECT rec, t, cid FROM frames SEMI JOIN n USING (rec) WHERE t >= 20 AND t < 40")
def frame_page(spark, sf):
    """The second screen of twenty frames of each recording that has fifteen of them at least; shorter views are skipped."""
    p = labels.page(frames(spark, sf), 1, 20)
    return labels.full_views(p, "rec", 15).select("rec", "t", "cid")


_DECODED = f"""{SERIES}, p AS (SELECT ts_id, t, list_transform(range(1, 5), lambda k: abs(ts[t * 4 + k])) AS v FROM (SELECT ts_id, ts, unnest(range(16)) AS t FROM series)),
q AS (SELECT ts_id, t, k, v[k + 1] / (v[1] + v[2] + v[3] + v[4]) AS p FROM p, (SELECT unnest(range(4)) AS k)),
m AS (SELECT ts_id, t, k, sum(p) OVER (PARTITION BY ts_id, k ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 * CASE WHEN k = 0 THEN {{damp}} ELSE 1 END AS p FROM q),
d AS (SELECT ts_id AS rec, t, CASE WHEN max(p) < {{least}} THEN 0 ELSE arg_max(k, (round(p, 12), -k)) END AS cid FROM m GROUP BY ts_id, t),
turns AS (SELECT *, CASE WHEN t > 0 AND cid = lag(cid) OVER (PARTITION BY rec ORDER BY t) THEN 0 ELSE 1 END AS turn FROM d), runs AS (SELECT *, sum(turn) OVER (PARTITION BY rec ORDER BY t) - 1 AS run FROM turns)
SELECT rec, CAST(run AS BIGINT) AS run, CAST(any_value(cid) AS BIGINT) AS cid, min(t) AS start, max(t) + 1 AS stop FROM runs GROUP BY rec, run"""


def _decoded(spark, sf, damp: float, least: float):
    """Series as frames of four class probabilities: smoothed by a box, class 0 damped, unlikely frames class 0, equal neighbours one token."""
    s = series(spark, sf).withColumn("v", F.transform("ts", lambda x: F.abs(x)))
    f = s.select("ts_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("v", t * DIM + 1, F.lit(DIM)))).alias("t", "w"))
    p = f.withColumn("sum", fv.total(F.col("w")))
    smooth = [windows.smooth_same(F.col("w")[k] / F.col("sum"), "ts_id", ["t"], windows.box(4)) * (damp if k == 0 else 1.0) for k in range(DIM)]
    d = p.select(F.col("ts_id").alias("rec"), F.col("t").cast("long").alias("t"), F.array(*smooth).alias("p"))
    cid = F.when(F.array_max("p") < least, F.lit(0).cast("long")).otherwise(fv.argmax(F.transform("p", lambda x: F.round(x, 12))))
    return tokens.run_tokens(d.select("rec", "t", cid.alias("cid"))).select("rec", "run", "cid", "start", "stop")


@query("decoded_frames", "WITH " + _DECODED.format(damp=0.01, least=0.0))
def decoded_frames(spark, sf):
    """Frames to tokens with the noise class all but silenced."""
    return _decoded(spark, sf, 0.01, 0.0)


@query("decoded_gated", "WITH " + _DECODED.format(damp=0.5, least=0.35))
def decoded_gated(spark, sf):
    """The same with another damping and a gate on the best class."""
    return _decoded(spark, sf, 0.5, 0.35)


_NAMES = {0: "BURST", 1: "ECHO", 2: "UP", 3: "DOWN"}


@query("discrete_symbols", "SELECT rec, start, stop, CASE cid WHEN 0 THEN 'B' WHEN 1 THEN 'E' WHEN 2 THEN 'U' WHEN 3 THEN 'D' END || chr(CAST(97 + rec % 5 AS INT)) AS symbol FROM (WITH " + _DECODED.format(damp=0.01, least=0.0) + ")")
def discrete_symbols(spark, sf):
    """Tokens named by class and cluster."""
    d = _decoded(spark, sf, 0.01, 0.0)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv]), F.col("cid").cast("int"))
    return d.select("rec", "start", "stop", labels.short_name(name, (F.col("rec") % 5 + 1).cast("int")).alias("symbol"))


@query("gated_tiles", "SELECT CAST(floor(epoch(ts) / 18000) AS BIGINT) AS tile, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS score FROM events GROUP BY tile HAVING sum(value) > 500")
def gated_tiles(spark, sf):
    """Tiles of five hours whose score passes a gate."""
    e = table(spark, sf, "events").withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp")))
    tiles = windows.tumbling(e, "second", 18_000).groupBy(F.col("chunk").alias("tile")).agg(F.count("*").alias("n"), F.sum("value").alias("score"))
    return tiles.filter("score > 500").withColumn("score", F.round("score", 4))


@query("stream_decoded", f"WITH {TOKENS}, kept AS (SELECT rec FROM tokens GROUP BY rec HAVING count(*) FILTER (cid > 0) > 8) SELECT rec, start, stop, cid AS id FROM tokens SEMI JOIN kept USING (rec)")
def stream_decoded(spark, sf):
    """Frame files read as a stream, decoded batch by batch; a recording lies in one file."""
    source, target, state = (scratch_path(spark, n) for n in ("frames", "decoded", "stream"))
    frames(spark, sf).select("rec", "t", "cid", "cls").repartition(4, "rec").write.parquet(source)
    ingest.ingest(spark, source, target, state, files=2).awaitTermination()
    out = spark.read.parquet(f"{target}/batch=*").select("rec", F.explode("sequence").alias("t"))
    return out.select("rec", "t.start", "t.stop", F.col("t.id").alias("id"))


@query("history_log", "SELECT 'q' || o_orderkey AS query_string FROM orders ORDER BY o_orderkey DESC LIMIT 3")
def history_log(spark, sf):
    """Three queries appended to the history, newest first: a top-k report."""
    path = scratch_path(spark, "history")
    for key in [r.o_orderkey for r in table(spark, sf, "orders").orderBy(F.desc("o_orderkey")).limit(3).collect()][::-1]:
        texts.append_history(spark, path, f"q{key}")
    return texts.latest_history(spark, path, 3).select("query_string")
