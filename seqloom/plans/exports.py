"""Queries over cluster exports, region slices, spectra in other forms, label lookups and carried streams."""

from __future__ import annotations

import contextlib
import math

from pyspark.sql import functions as F

from seqloom.functions import sequences as fs
from seqloom.operators import labels, tokens, windows
from seqloom.operators.neighbour_graph import neighbour_graph
from seqloom.plans import query
from seqloom.plans.files import _SAMPLES, _name, _recorded
from seqloom.plans.sequences import _GRAPH, _graph
from seqloom.plans.views import QUERIES, SERIES, TOKENS, frames, series, table
from seqloom.plans.views import tokens as token_view
from seqloom.sources import recordings, texts, versions
from seqloom.storage import scratch_path, store
from seqloom.streaming import ingest, queue

R = 6
#: Samples of a region, and frames of a window of its spectrogram.
REGION, WIDE = 40, 2

#: Tokens as snippets: cluster by length, truth by whether the token is short.
_MEMBERS = f"""{TOKENS}, members AS (SELECT cls AS label, (stop - start) % 3 AS cluster, CASE WHEN rec % 4 = 0 THEN 'Ea' ELSE cls END AS truth, rec * 100000 + start AS start,
  list_transform(range(start, stop), lambda t: rec * 7 + t) AS samples FROM tokens)"""


def _members(spark, sf):
    t = token_view(spark, sf)
    samples = F.transform(F.sequence(F.col("start"), F.col("stop") - 1), lambda t: F.col("rec") * 7 + t)
    return t.select(F.col("cls").alias("label"), ((F.col("stop") - F.col("start")) % 3).alias("cluster"), F.when(F.col("rec") % 4 == 0, "Ea").otherwise(F.col("cls")).alias("truth"), (F.col("rec") * 100_000 + F.col("start")).alias("start"), samples.alias("samples"))


def _heard(spark, exported, name):
    """What the exported files hold: samples, and their sum weighted by place."""
    path = scratch_path(spark, name)
    recordings.write_wavs(exported.select(F.concat("name", F.lit(".wav")).alias("name"), "samples"), path, bits=32)
    d = recordings.read_wavs(spark, path).select(F.regexp_replace(_name(), r"\.wav$", "").alias("name"), F.posexplode("samples").alias("i", "x"))
    return d.groupBy("name").agg(F.count("*").alias("n"), F.sum((F.col("i") + 1) * F.col("x")).alias("weighted"))


_HEARD = "SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(sum((i + 1) * x) AS BIGINT) AS weighted FROM (SELECT name, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS i FROM l) GROUP BY name"


@query(
    "label_exports",
    f"""WITH {_MEMBERS}, g AS (SELECT label || '_' || cluster AS name, start, 0 AS own, samples FROM members WHERE NOT starts_with(label, '_')
  UNION ALL SELECT label || '_' || truth, start, 1, samples FROM members WHERE NOT starts_with(label, '_') AND truth <> label),
l AS (SELECT name, flatten(list(samples ORDER BY start)) AS xs FROM g GROUP BY name) {_HEARD}""",
)
def label_exports(spark, sf):
    """A recording for each label and cluster, and for each label that stands for another truth, written and read back."""
    return _heard(spark, texts.label_recordings(_members(spark, sf).filter(~F.col("label").startswith("_")), silent="_"), "label-exports")


@query(
    "cluster_exports",
    f"""WITH {_MEMBERS}, m AS (SELECT label, start % 23 AS cluster, start, samples FROM members WHERE label <> 'Da' AND NOT starts_with(label, '_')), s AS (SELECT label, cluster, count(*) AS n FROM m GROUP BY ALL),
g AS (SELECT CASE WHEN n >= 4 THEN label || '_' || cluster ELSE 'unmerged' END AS name, label, cluster, start, samples FROM m JOIN s USING (label, cluster)),
o AS (SELECT name, start, label, cluster, row_number() OVER (PARTITION BY name ORDER BY start, label, cluster) AS r, samples FROM g),
l AS (SELECT name, flatten(list(CASE WHEN r > 1 THEN list_concat([0, 0], samples) ELSE samples END ORDER BY r)) AS xs FROM o GROUP BY name) {_HEARD}""",
)
def cluster_exports(spark, sf):
    """Clusters of four members at least as recordings with two zeros between members, the others together in one."""
    m = _members(spark, sf).filter(~F.col("label").startswith("_")).withColumn("cluster", F.col("start") % 23)  # Spark passes over files whose name begins with _
    return _heard(spark, texts.cluster_parts(m, least=4, silent="Da", gap=2), "cluster-exports")


_REGION_FRAMES = " + ".join(f"w[{i + 1}] * {0.5 - 0.5 * math.cos(2 * math.pi * i / 15)!r} * {{f}}(2 * pi() * k * {i} / 16.0)" for i in range(16))
_SLICES = f"""{_SAMPLES}, s AS (SELECT name, t // {REGION} AS region, list(x ORDER BY t) AS xs FROM samples GROUP BY ALL), o AS (SELECT name, region, xs, unnest(range(0, len(xs) - 16, 8)) AS a FROM s WHERE len(xs) > 16)"""


@query(
    "region_frames",
    f"""WITH {_SLICES}, c AS (SELECT name, region, a // 8 AS t, xs[a + 1:a + 16] AS w, unnest(range(16)) AS k FROM o), m AS (SELECT name, region, t, k, sqrt(({_REGION_FRAMES.format(f='cos')}) ** 2 + ({_REGION_FRAMES.format(f='sin')}) ** 2) AS m FROM c),
z AS (SELECT *, (m - avg(m) OVER p) / (stddev_pop(m) OVER p + 1) AS z FROM m WINDOW p AS (PARTITION BY name, region, t)) SELECT name, region, t, k - 8 AS bin, round(z, 3) + 0.0 AS z FROM z WHERE k >= 8""",
)
def region_frames(spark, sf):
    """Spectrogram frames of the regions of each recording, sliced out by their starts and stops."""
    f = _region_frames(spark, sf)
    return f.select("name", "region", "t", F.posexplode("bins").alias("bin", "z")).select("name", "region", "t", F.col("bin").cast("long").alias("bin"), (F.round(F.col("z").cast("double"), 3) + 0.0).alias("z"))


def _region_frames(spark, sf):
    d = recordings.read_wavs(spark, _recorded(spark, sf))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REGION).cast("long")))
    regions = d.filter("n > 0").select("path", starts.alias("starts")).withColumn("stops", F.col("starts") + REGION)
    f = recordings.frames_of(recordings.slices(d, regions).withColumn("path", F.concat_ws("#", _name(), (F.col("starts") / REGION).cast("long"))), window=16, step=8, low=0, high=8)
    return f.select(F.split("path", "#")[0].alias("name"), F.split("path", "#")[1].cast("long").alias("region"), "t", "bins")


@query("region_frame_windows", f"WITH {_SLICES}, n AS (SELECT name, region, count(*) AS frames FROM o GROUP BY ALL) SELECT name, region, e - {WIDE} AS start, e AS stop FROM (SELECT name, region, unnest(range({WIDE}, frames, {WIDE // 2})) AS e FROM n WHERE frames > {WIDE})")
def region_frame_windows(spark, sf):
    """Windows of two frames over each region's spectrogram; regions that are empty or too short have none."""
    n = _region_frames(spark, sf).groupBy("name", "region").agg(F.count("*").alias("frames"))
    return windows.sliding(n, "frames", WIDE, WIDE // 2).select("name", "region", "start", "stop")


_HALF = " + ".join(f"w[{i + 1}] * {0.54 + 0.46 * math.cos(2 * math.pi * i / 16)!r} * {{f}}(2 * pi() * {{k}} * {i} / 16.0)" for i in range(8))


@query(
    "wav_falling_bins",
    f"""WITH {_SAMPLES}, s AS (SELECT name, list(x ORDER BY t) AS xs FROM samples GROUP BY name), o AS (SELECT name, xs, unnest(range(0, len(xs) - 16, 8)) AS a FROM s WHERE len(xs) > 16),
c AS (SELECT name, a // 8 AS t, xs[a + 1:a + 16] AS w, unnest(range(8)) AS bin FROM o)
SELECT name, t, bin, round(CAST(CAST(CASE WHEN bin = 7 THEN sqrt(({_HALF.format(f='cos', k='0')}) ** 2 + ({_HALF.format(f='cos', k='8')}) ** 2)
  ELSE sqrt(({_HALF.format(f='cos', k='(7 - bin)')}) ** 2 + ({_HALF.format(f='sin', k='(7 - bin)')}) ** 2) END AS FLOAT) AS DOUBLE), 1) + 0.0 AS m FROM c""",
)
def wav_falling_bins(spark, sf):
    """The other spectrogram: a raised cosine over the first half of a window, magnitudes from the highest frequency down."""
    f = recordings.frames_of(recordings.read_wavs(spark, _recorded(spark, sf)), window=16, step=8, falling=True)
    return f.select(_name().alias("name"), "t", F.posexplode("bins").alias("bin", "m")).select("name", "t", F.col("bin").cast("long").alias("bin"), (F.round(F.col("m").cast("double"), 1) + 0.0).alias("m"))


@query("peak_frequencies", f"WITH {SERIES}, f AS (SELECT ts_id, unnest(range(64)) AS bin, unnest(ts) AS v FROM series) SELECT ts_id, round(arg_max(bin, (abs(v), -bin)) * 44100 / 512.0, {R}) AS hz FROM f GROUP BY ts_id")
def peak_frequencies(spark, sf):
    """The frequency of the strongest place of each series, taken as bins of a transform of 512 samples."""
    f = series(spark, sf).select("ts_id", F.posexplode("ts").alias("bin", "v"))
    best = f.groupBy("ts_id").agg(F.max_by("bin", F.struct(F.abs("v"), -F.col("bin"))).alias("bin"))
    return best.select("ts_id", F.round(fs.bin_to_hz(F.col("bin"), 512), R).alias("hz"))


@query("raster_labels", f"WITH {TOKENS}, l AS (SELECT rec, list(cls ORDER BY start) AS labels, max(stop) AS n FROM tokens GROUP BY rec) SELECT rec, CAST(t AS BIGINT) AS t, labels[t // (n // len(labels)) + 1] AS label FROM (SELECT rec, labels, n, unnest(range(least(n, n // len(labels) * len(labels)))) AS t FROM l)")
def raster_labels(spark, sf):
    """Each recording's token names spread over its frames in bins of one size."""
    t = token_view(spark, sf).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("start", "cls"))).alias("l"), F.max("stop").alias("frames"))
    return labels.rasterise(t.select("rec", F.col("l.cls").alias("labels"), "frames"), "frames").select("rec", "t", "label")


_CLUSTERS = "n AS (SELECT source AS label, 1 + count(DISTINCT lang) AS n FROM documents GROUP BY source), m AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM n)"


@query("cluster_names", f"WITH {_CLUSTERS}, i AS (SELECT vec_id, 1 + vec_id % (SELECT sum(n) FROM n) AS id FROM embeddings) SELECT vec_id, CAST(id AS BIGINT) AS id, label, CAST(id - first AS BIGINT) AS cluster FROM i JOIN m ON id > first AND id <= first + n")
def cluster_names(spark, sf):
    """Ids of clusters, laid end to end by label, back to label and cluster."""
    n = table(spark, sf, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("label")).agg((1 + F.countDistinct("lang")).alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    ids = table(spark, sf, "embeddings").join(F.broadcast(total)).select("vec_id", (1 + F.col("vec_id") % F.col("total")).alias("id"))
    return labels.from_id(ids, labels.prefixes(n)).select("vec_id", "id", "label", "cluster")


@query("neighbour_list", f"{_GRAPH} SELECT q, s, round(dist, 6) AS dist, rank FROM graph WHERE q = (SELECT min(q) FROM graph)")
def neighbour_list(spark, sf):
    """The neighbours of the first sequence that has any."""
    g = _graph(spark, sf)
    key = g.agg(F.min("q")).first()[0]
    return labels.neighbourhood(g, key).withColumn("dist", F.round("dist", R))


@query(
    "noisy_sample",
    f"""WITH {SERIES}, r AS (SELECT ts_id, label, ts, row_number() OVER (PARTITION BY label ORDER BY ts_id * 2654435761 % 4294967296, ts_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM series),
d AS (SELECT label, unnest(range(20)) AS draw FROM (SELECT DISTINCT label FROM series)), x AS (SELECT d.label, d.draw, r.ts FROM d JOIN r ON r.label = d.label AND r.r = d.draw % r.n)
SELECT a.label, a.draw, round(list_sum(CASE WHEN a.label = 0 THEN a.ts ELSE list_transform(list_zip(a.ts, b.ts), lambda z: (z[1] + z[2]) / 2) END), 4) AS total FROM x a JOIN x b ON b.draw = a.draw AND b.label = 0""",
)
def noisy_sample(spark, sf):
    """Twenty draws of each label, mixed half and half with the draws of label 0: a sampling operator."""
    drawn = labels.balanced(series(spark, sf), "label", "ts_id", 20).select("label", "draw", "ts")
    mixed = labels.noisy(drawn, drawn.filter("label = 0"), "label", 0, "ts")
    return mixed.select("label", "draw", F.round(F.aggregate("ts", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("stream_runs", f"WITH {TOKENS} SELECT rec, run, cid, start, stop, cls FROM tokens")
def stream_runs(spark, sf):
    """Frames cut over several files, thirty at a time, and decoded as a stream that carries the run that is open at a cut: the tokens of the whole table."""
    source, target, state = (scratch_path(spark, n) for n in ("frames", "runs", "stream"))
    f = store(frames(spark, sf).select("rec", "t", "cid", "cls"), "numbered")  # else every file numbers all frames anew, in one task
    for part in range(f.agg(F.floor(F.max("t") / 30)).first()[0] + 1):  # files come one after the other, as a recorder writes them
        f.filter(F.floor(F.col("t") / 30) == part).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_carried(spark, source, target, state).awaitTermination()
    return ingest.carried_runs(spark, target, short=2, middle=3).select("rec", "run", "cid", "start", "stop", "cls")


@query("stream_windows", "SELECT CAST(floor(epoch(ts) / 10800) AS BIGINT) * 10800 - k * 10800 AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL")
def stream_windows(spark, sf):
    """Events read as a stream, counted in sliding windows of event time; the last batch has all windows."""
    source, target, state = (scratch_path(spark, n) for n in ("events", "windows", "stream"))
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    for part in range(3):
        e.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(ingest.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    counted = ingest.event_windows(events, "6 hours", "3 hours", late="400 days")  # events lie in no order, so none is late
    counted.writeStream.outputMode("complete").foreachBatch(lambda d, _: d.write.mode("overwrite").parquet(target)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select(F.unix_seconds("window.start").alias("start"), "event_type", "n")


@query("queue_decoded", f"WITH {TOKENS} SELECT rec, start, stop, cid AS id, CAST(rec % 3 AS BIGINT) AS batch, CAST(CASE WHEN rec % 3 = 0 THEN 0 ELSE 2 END AS BIGINT) AS indexed FROM tokens")
def queue_decoded(spark, sf):
    """Recordings enqueued in three sets, the first and third with a rebuild behind them, decoded by a worker that dies once: each token once, with the batch of its set and of the rebuild that first held it."""
    todo, target, index, state = (scratch_path(spark, n) for n in ("queue", "decoded", "indexed", "stream"))
    f = frames(spark, sf).select("rec", "t", "cid", "cls")
    for part in range(3):
        queue.enqueue(spark, todo, f.filter(F.col("rec") % 3 == part).select(F.col("rec").alias("item")).distinct(), reindex=part != 1)
    died = []

    def work(items, number):
        decoded = tokens.run_tokens(f.join(items.select(F.col("item").cast("long").alias("rec")), "rec")).select("rec", "start", "stop", F.col("cid").alias("id"))
        decoded.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("the worker dies behind its data")

    def reindex(number):
        spark.read.parquet(f"{target}/batch=*").select("rec").distinct().write.mode("overwrite").parquet(f"{index}/version={number}")

    with contextlib.suppress(Exception):  # the death above
        queue.drain(spark, todo, state, work, reindex).awaitTermination()
    queue.drain(spark, todo, state, work, reindex).awaitTermination()
    first = spark.read.option("basePath", index).parquet(f"{index}/version=*").groupBy("rec").agg(F.min("version").cast("long").alias("indexed"))
    return spark.read.option("basePath", target).parquet(f"{target}/batch=*").withColumn("batch", F.col("batch").cast("long")).join(first, "rec")


@query(
    "versioned_annotations",
    f"WITH {TOKENS}, v AS (SELECT rec, start, stop, cls FROM tokens WHERE NOT (rec % 2 = 0 AND cid = 1) UNION ALL SELECT rec, start, stop, 'new' FROM tokens WHERE rec % 2 = 0 AND cid = 1 AND start % 2 = 0) SELECT rec, start, stop, cls, (SELECT count(*) FROM tokens) AS before, true AS refused FROM v",
)
def versioned_annotations(spark, sf):
    """Annotations renamed and deleted in a second version, read beside the first, which stays; a writer that began with the first is refused."""
    v = versions.Versions(spark, scratch_path(spark, "annotations"))
    one = v.commit(token_view(spark, sf).select("rec", "start", "stop", "cls", "cid"), 0)
    old = v.read(one)
    changed = (F.col("rec") % 2 == 0) & (F.col("cid") == 1)
    renamed = old.filter(changed & (F.col("start") % 2 == 0)).withColumn("cls", F.lit("new"))
    v.commit(old.filter(~changed).unionByName(renamed), one)
    try:
        v.commit(old.limit(0), one)
        refused = False
    except versions.Conflict:
        refused = True
    return v.read().select("rec", "start", "stop", "cls", F.lit(v.read(one).count()).cast("long").alias("before"), F.lit(refused).alias("refused"))


@query("cosine_graph")
def cosine_graph(spark, sf):
    """The ten nearest series of each query by cosine, from the neighbour graph of all series; approximate."""
    s = series(spark, sf)
    near = neighbour_graph(s, "ts_id", "ts").filter(F.col("id") % QUERIES == 0)
    return near.select(F.col("id").alias("q"), F.posexplode(F.slice("near", 1, 10)).alias("rank", "n")).select("q", F.col("n.id").alias("s"), F.round(1 - F.col("n.far"), R).alias("cos"), (F.col("rank") + 1).cast("long").alias("rank"))
