"""Queries over series, distances, indexes, clusters and scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import vectors as fv
from seqloom.operators import clustering, labels, linkage
from seqloom.operators.chain import nearest_chain
from seqloom.operators.distance import Edited, Warped, dtw
from seqloom.operators.pairs import in_interval, nearest_by_cosine, triplets
from seqloom.operators.prefix import percentiles, running_total
from seqloom.operators.refine import nearest_series, series_distances, series_pairs
from seqloom.operators.search import suppressed
from seqloom.operators.series_index import SeriesIndex, votes
from seqloom.operators.statistics import confusion, dampener_sweep, ordered_sum
from seqloom.plans import query
from seqloom.plans.views import FRAMES, SERIES, TOKENS, frames, queries_of, series, table
from seqloom.plans.views import tokens as token_view
from seqloom.storage import store

R, DIM = 6, 4  # places of rounded doubles; channels of a series, 16 frames long
STRETCH = 256  # frames of a spectrogram that one task sees together


def _dtw_sql(x: str, y: str, norm: bool = False, band: float = 0.1) -> str:
    """DuckDB's fold for the distance of two lists of 16 frames with 4 channels; all have one length, so the band is a constant."""
    cost = " + ".join(f"({x}[(i - 1) * 4 + {d}] - {y}[(j - 1) * 4 + {d}]) ** 2" for d in (1, 2, 3, 4))
    w = int(16 * band) + 2
    cell = f"{'sqrt' if norm else ''}({cost}) + least(prev[j], prev[j + 1], row[j])"
    if norm:
        cell = f"CASE WHEN j >= i - {w} AND j < i + {w} THEN {cell} ELSE 'inf'::DOUBLE END"
    fold = f"list_reduce(range(1, 17), lambda prev, i: list_reduce(range(1, 17), lambda row, j: list_append(row, {cell}), ['inf'::DOUBLE]), list_concat([0.0::DOUBLE], list_transform(range(16), lambda e: 'inf'::DOUBLE)))[17]"
    return f"{fold} / 256" if norm else fold


_QS = f"WITH {SERIES}, p AS (SELECT x.ts_id AS q, y.ts_id AS s, x.label AS ql, y.label AS sl, x.ts AS xs, y.ts AS ys FROM series x, series y WHERE x.ts_id % 50 = 0)"


def _pairs(spark, sf, distances):
    s = series(spark, sf)
    return series_pairs(queries_of(s, "ts_id"), s, "ts_id", "ts", distances).select("q", "s", F.round("dist", R).alias("dist"))


def _ids(df, *more):
    return df.select(F.col("q_ts_id").alias("q"), F.col("s_ts_id").alias("s"), *more)


@query("dtw_sq_pairs", f"{_QS} SELECT q, s, round({_dtw_sql('xs', 'ys')}, 6) AS dist FROM p")
def dtw_sq_pairs(spark, sf):
    return _pairs(spark, sf, Warped(DIM))


@query("dtw_norm_pairs", f"{_QS} SELECT q, s, round({_dtw_sql('xs', 'ys', True)}, 6) AS dist FROM p")
def dtw_norm_pairs(spark, sf):
    return _pairs(spark, sf, Warped(DIM, squared=False))


_PERCENTS = [i / 100 for i in range(1, 99)]


@query("distance_percentiles", f"{_QS}, d AS (SELECT {_dtw_sql('xs', 'ys', True)} AS dist FROM p), a AS (SELECT quantile_cont(dist, {_PERCENTS}) AS v FROM d) SELECT generate_subscripts(v, 1) AS percent, round(unnest(v), 6) AS dist FROM a")
def distance_percentiles(spark, sf):
    s = series(spark, sf)
    d = store(series_distances(queries_of(s, "ts_id"), s, "ts_id", "ts", Warped(DIM, squared=False)).select("dists"), "distances")
    return percentiles(d, "dists", list(range(1, 99))).withColumn("dist", F.round("dist", R))


@query(
    "neardup_topk",
    f"""{_QS}, d AS (SELECT q, s, {_dtw_sql('xs', 'ys', True, 0.01)} AS dist FROM p WHERE q <> s),
r AS (SELECT q, s, dist, row_number() OVER (PARTITION BY q ORDER BY dist, s) AS rank FROM d WHERE dist < (SELECT quantile_cont(dist, 0.5) FROM d))
SELECT q, s, round(dist, 6) AS dist, rank FROM r WHERE rank <= 10""",
)
def neardup_topk(spark, sf):
    """Of series whose lengths differ by less than five frames, the ten nearest below the median of all distances."""
    s = series(spark, sf)
    d = store(series_distances(queries_of(s, "ts_id"), s, "ts_id", "ts", Warped(DIM, squared=False, band=0.01), 10, 5, apart=True), "distances")  # read twice
    edge = percentiles(d, "dists", [50]).select(F.col("dist").alias("edge"))  # one row
    near = d.select("q", F.inline("near")).crossJoin(F.broadcast(edge)).filter("dist < edge")
    w = Window.partitionBy("q").orderBy("dist", "s")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("q", "s", F.round("dist", R).alias("dist"), "rank")


@query("euclid_frames", f"WITH {SERIES}, f AS (SELECT ts_id, ts, unnest(range(15)) AS i FROM series) SELECT ts_id, i, round(" + " + ".join(f"(ts[i * 4 + {d}] - ts[i * 4 + {d + 4}]) ** 2" for d in (1, 2, 3, 4)) + ", 6) AS dist FROM f")
def euclid_frames(spark, sf):
    """Squared distance of each frame from the next."""
    frame = lambda i: F.slice("ts", i * DIM + 1, F.lit(DIM))
    d = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: fv.squared_distance(frame(i), frame(i + 1)))
    return series(spark, sf).select("ts_id", F.posexplode(d).alias("i", "dist")).select("ts_id", F.col("i").cast("long").alias("i"), F.round("dist", R).alias("dist"))


_KNN = f"{_QS}, d AS (SELECT q, s, ql, sl, list_cosine_similarity(xs, ys) AS cos FROM p WHERE q <> s), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cos DESC, s) AS rank FROM d) WHERE rank <= 10)"


def _cosine_nn(spark, sf):
    near = nearest_by_cosine(queries_of(series(spark, sf), "ts_id"), series(spark, sf), "ts_id", "ts", 10)
    d = _ids(near, F.col("q_label").alias("ql"), F.col("s_label").alias("sl"), fv.cosine(F.col("q_ts"), F.col("s_ts")).alias("cos"))
    w = Window.partitionBy("q").orderBy(F.desc("cos"), "s")
    return d.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10")


@query("cosine_knn", f"{_KNN} SELECT q, s, round(cos, 6) AS cos, rank FROM nn")
def cosine_knn(spark, sf):
    return _cosine_nn(spark, sf).select("q", "s", F.round("cos", R).alias("cos"), "rank")


_VOTE = ", v AS (SELECT q, ql, sl, count(*) AS n FROM nn GROUP BY ALL), w AS (SELECT q, ql AS truth, arg_max(sl, (n, -sl)) AS predicted FROM v GROUP BY q, ql)"


def _majority(nn):
    """The commonest label among the neighbours of each query, the smallest of equals."""
    v = nn.groupBy("q", "ql", "sl").agg(F.count("*").alias("n"))
    return v.groupBy("q", F.col("ql").alias("truth")).agg(F.max_by("sl", F.struct("n", -F.col("sl"))).alias("predicted"))


@query("knn_vote", f"{_KNN}{_VOTE} SELECT q, truth, predicted FROM w")
def knn_vote(spark, sf):
    return _majority(_cosine_nn(spark, sf))


@query("confusion_matrix", f"{_KNN}{_VOTE} SELECT truth, predicted, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY ALL")
def confusion_matrix(spark, sf):
    return confusion(_majority(_cosine_nn(spark, sf)), "truth", "predicted")


@query("accuracy", f"{_KNN}{_VOTE} SELECT round(avg(CAST(truth = predicted AS INT)), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM w")
def accuracy(spark, sf):
    return _majority(_cosine_nn(spark, sf)).agg(F.round(F.avg((F.col("truth") == F.col("predicted")).cast("int")), R).alias("accuracy"), F.count("*").alias("n"))


@query("dtw_baseline", f"{_QS}, d AS (SELECT q, s, ql, sl, {_dtw_sql('xs', 'ys', True)} AS dist FROM p WHERE s % 50 <> 0), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, s) AS rank FROM d) WHERE rank <= 3){_VOTE} SELECT q, truth, predicted FROM w")
def dtw_baseline(spark, sf):
    """Labels of the held-out series by their three nearest others under time warping, of which blocks compute only those within reach of a bound."""
    s = series(spark, sf)
    near = nearest_series(queries_of(s, "ts_id"), s.filter("ts_id % 50 <> 0"), "ts_id", "ts", 3, DIM)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "s"))).filter("rank <= 3")
    label = lambda key, name: s.select(F.col("ts_id").alias(key), F.col("label").alias(name))
    return _majority(ranked.join(label("q", "ql"), "q").join(label("s", "sl"), "s"))


@query(
    "pivot_partition",
    f"""WITH {SERIES}, l AS (SELECT s.ts_id, s.ts AS xs, p.ts AS ys FROM series s, (SELECT ts FROM series WHERE ts_id = (SELECT min(ts_id) FROM series)) p),
dl AS (SELECT ts_id, xs, {_dtw_sql('xs', 'ys')} AS d FROM l), f AS (SELECT arg_max(ts_id, (d, ts_id)) AS far FROM dl),
r AS (SELECT dl.ts_id, dl.d, dl.xs, s.ts AS ys FROM dl, f JOIN series s ON s.ts_id = f.far), dr AS (SELECT ts_id, d, {_dtw_sql('xs', 'ys')} AS e FROM r)
SELECT ts_id, CASE WHEN d <= e THEN 'L' ELSE 'R' END AS side, round(d, 6) AS left_dist, round(e, 6) AS right_dist FROM dr""",
)
def pivot_partition(spark, sf):
    """One level of the tree: the smallest id and the series farthest from it as pivots; ties go left."""
    s = series(spark, sf)
    left = s.orderBy("ts_id").limit(1).select(F.col("ts").alias("left"))
    d = s.join(F.broadcast(left)).select("ts_id", "ts", dtw(F.col("ts"), F.col("left"), DIM).alias("d"))  # pivots are one row
    right = d.agg(F.max_by("ts", F.struct("d", "ts_id")).alias("right"))
    e = d.join(F.broadcast(right)).select("ts_id", "d", dtw(F.col("ts"), F.col("right"), DIM).alias("e"))
    return e.select("ts_id", F.when(F.col("d") <= F.col("e"), "L").otherwise("R").alias("side"), F.round("d", R).alias("left_dist"), F.round("e", R).alias("right_dist"))


@query("tree_leaves")
def tree_leaves(spark, sf):
    return SeriesIndex.build(series(spark, sf), dim=DIM).buckets


@query("bucket_query")
def bucket_query(spark, sf):
    s = series(spark, sf)
    return SeriesIndex.build(s, dim=DIM).query(queries_of(s, "ts_id"))


@query("tree_stats")
def tree_stats(spark, sf):
    index = SeriesIndex.build(series(spark, sf), dim=DIM)
    leaf = F.col("left_ts").isNull()
    n = index.nodes.agg(F.count("*").alias("nodes"), F.count_if(leaf).alias("leaves"), F.max(F.when(leaf, F.col("span"))).alias("widest"), F.max(F.length("node")).cast("long").alias("depth"))
    return n.join(index.buckets.agg(F.count("*").alias("series")))


@query("relaxed_votes")
def relaxed_votes(spark, sf):
    """Series searched by their windows of eight frames, four frames apart: sequences by bucket hits."""
    s = series(spark, sf)
    w = s.select("ts_id", F.posexplode(F.transform(F.array(F.lit(1), F.lit(17), F.lit(33)), lambda i: F.slice("ts", i, F.lit(32)))).alias("k", "window"))
    w = w.select((F.col("ts_id") * 3 + F.col("k")).alias("win"), "ts_id", "window")
    index = SeriesIndex.build(w, dim=DIM, ts_id="win", ts="window")
    hits = index.query(queries_of(w, "ts_id"), "win", "window")
    return votes(hits.select(F.floor(F.col("q") / 3).alias("q"), F.floor(F.col("ts_id") / 3).alias("sequence")).filter("q <> sequence"))


_PROBS = f"WITH {SERIES}, a AS (SELECT ts_id, label, list_transform(ts, lambda v: abs(v)) AS v FROM series), p AS (SELECT ts_id, label, list_transform(v, lambda e: e / list_sum(v)) AS p FROM a)"


def _probabilities(spark, sf):
    """Every component's share of a series' magnitude: a distribution over 64 classes."""
    return series(spark, sf).withColumn("v", F.transform("ts", lambda x: F.abs(x))).withColumn("all", fv.total(F.col("v"))).select("ts_id", "label", F.transform("v", lambda e: e / F.col("all")).alias("p"))


@query("argmax_reject", f"{_PROBS} SELECT ts_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS cls, CAST(CASE WHEN list_max(p) < 0.05 THEN 0 ELSE list_position(p, list_max(p)) - 1 END AS BIGINT) AS kept, round(list_max(p), 6) AS prob FROM p")
def argmax_reject(spark, sf):
    cls, top = fv.argmax(F.col("p")), F.array_max("p")
    return _probabilities(spark, sf).select("ts_id", cls.alias("cls"), F.when(top < 0.05, F.lit(0).cast("long")).otherwise(cls).alias("kept"), F.round(top, R).alias("prob"))


_DAMP = [0.5, 1.0, 1.0, 0.0] * 16


@query("class_damping", f"{_PROBS}, d AS (SELECT ts_id, list_transform(range(1, 65), lambda i: p[i] * {_DAMP}[i]) AS p FROM p) SELECT ts_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS cls, round(list_max(p), 6) AS prob FROM d")
def class_damping(spark, sf):
    """Some classes halved and some silenced before the decision."""
    d = _probabilities(spark, sf).withColumn("p", F.zip_with("p", F.array(*map(F.lit, _DAMP)), lambda a, b: a * b))
    return d.select("ts_id", fv.argmax(F.col("p")).alias("cls"), F.round(F.array_max("p"), R).alias("prob"))


@query("dampener_sweep", "SELECT step, step / 100.0 AS dampener, round(avg(CAST((k * 100 > (1000 - k) * step) = (quality = 1) AS INT)), 6) AS accuracy FROM (SELECT n_chars % 1000 AS k, quality FROM documents JOIN labels USING (doc_id)), (SELECT unnest(range(100)) AS step) GROUP BY step")
def dampener_sweep_query(spark, sf):
    k = F.col("n_chars") % 1000
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(k.cast("double").alias("signal"), (1000 - k).cast("double").alias("noise"), "quality")
    return dampener_sweep(df, "noise", "signal", "quality").select("step", "dampener", F.round("accuracy", R).alias("accuracy"))


@query("minmax_normalise", f"WITH {FRAMES} SELECT rec, t, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled FROM frames WINDOW w AS (PARTITION BY rec)")
def minmax_normalise(spark, sf):
    ends = frames(spark, sf).groupBy("rec").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = (F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return frames(spark, sf).join(ends, "rec").select("rec", "t", F.round(scaled, R).alias("scaled"))


@query(
    "maxabs_downsample",
    f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM frames) SELECT rec, least(t // greatest(n // 10, 1), 9) AS bucket, arg_max(value - 20, (abs(value - 20), -t)) AS peak FROM n GROUP BY ALL",
)
def maxabs_downsample(spark, sf):
    f = frames(spark, sf)
    n = f.groupBy("rec").agg(F.count("*").alias("n"))
    width = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    b = f.join(n, "rec").withColumn("bucket", F.least(F.floor(F.col("t") / width), F.lit(9)).cast("long")).withColumn("v", F.col("value") - 20)
    return b.groupBy("rec", "bucket").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("t"))).alias("peak"))


@query("frame_znorm", f"WITH {SERIES}, z AS (SELECT ts_id, generate_subscripts(ts, 1) - 1 AS i, unnest(ts) AS v, list_avg(ts) AS m, list_stddev_pop(ts) AS d FROM series) SELECT ts_id, i, round((v - m) / (d + 1), 6) AS z FROM z")
def frame_znorm(spark, sf):
    z = F.transform("ts", lambda v: (v - F.col("m")) / (F.col("d") + 1))
    s = series(spark, sf).withColumn("m", fv.mean(F.col("ts"))).withColumn("d", fv.deviation(F.col("ts")))
    return s.select("ts_id", F.posexplode(z).alias("i", "z")).select("ts_id", F.col("i").cast("long").alias("i"), F.round("z", R).alias("z"))


_S = "((sqrt(1 + 4 * 64.0 * 64.0) - 1) / (2 * 64.0 * 64.0))"


@query(
    "pcen",
    f"""WITH {SERIES}, e AS (SELECT ts_id, list_transform(ts, lambda v: abs(v)) AS x FROM series),
m AS (SELECT ts_id, x, list_reduce(range(2, 65), lambda a, i: list_append(a, {_S} * x[i] + (1 - {_S}) * a[len(a)]), [0.0::DOUBLE]) AS m FROM e),
o AS (SELECT ts_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS x, unnest(m) AS m FROM m)
SELECT ts_id, i, CASE WHEN i = 0 THEN 0.0 ELSE round(pow(x / pow(1e-6 + m, 0.8) + 2, 0.5) - pow(2, 0.5), 6) END AS gain FROM o""",
)
def pcen(spark, sf):
    """Per-channel energy normalisation of the series' magnitudes."""
    n = F.size("ts").cast("double")
    smoothing = (F.sqrt(1 + 4 * n * n) - 1) / (2 * n * n)
    s = series(spark, sf).select("ts_id", smoothing.alias("s"), F.transform("ts", lambda v: F.abs(v)).alias("x"))
    return s.select("ts_id", F.posexplode(fv.ema_gain(F.col("x"), F.col("s"))).alias("i", "gain")).select("ts_id", F.col("i").cast("long").alias("i"), F.round("gain", R).alias("gain"))


@query(
    "interest_points",
    f"""WITH {SERIES}, c AS (SELECT ts_id AS t, generate_subscripts(ts, 1) - 1 AS f, unnest(ts) AS s, row_number() OVER (ORDER BY ts_id) - 1 AS row, count(*) OVER () AS n FROM series),
w AS (SELECT *, sum(s) OVER (PARTITION BY f ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) - s AS sum_t, sum(s) OVER (PARTITION BY t ORDER BY f ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) - s AS sum_f,
  greatest(max(s) OVER (PARTITION BY f ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), max(s) OVER (PARTITION BY f ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS max_t,
  greatest(max(s) OVER (PARTITION BY t ORDER BY f ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), max(s) OVER (PARTITION BY t ORDER BY f ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS max_f FROM c)
SELECT t, f, round(s, 6) AS s FROM w WHERE row >= 3 AND row < n - 3 AND f >= 3 AND f < 61 AND s > max_t AND s > max_f AND s > least(sum_t, sum_f) / 6 + 0.05""",
)
def interest_points(spark, sf):
    """Cells above all neighbours within three frames or channels and above the mean of the quieter direction."""
    s = series(spark, sf).select("ts_id", "ts")
    ids = store(s.select("ts_id", F.lit(1).alias("one")), "ids")
    ranked = s.join(running_total(ids, ["ts_id"], "one", "row").select("ts_id", "row"), "ts_id")
    # stretches of frames, each with the three frames before and behind it; frames stay whole, so that they are dealt once
    stretch = lambda r: F.floor(r / STRETCH).cast("long")
    dealt = ranked.withColumn("part", F.explode(F.array_distinct(F.array(*[stretch(F.col("row") + k) for k in (-3, 0, 3)]))))
    w = Window.partitionBy("part").orderBy("row")
    around = dealt.select("part", "row", F.col("ts_id").alias("t"), "ts", *[F.lag("ts", k).over(w).alias(f"before{k}") for k in (1, 2, 3)], *[F.lead("ts", k).over(w).alias(f"after{k}") for k in (1, 2, 3)])
    inside = around.filter((stretch(F.col("row")) == F.col("part")) & F.col("before3").isNotNull() & F.col("after3").isNotNull())

    def cell(f):
        s, along_t = F.get("ts", f), [F.get(c, f) for c in ("before3", "before2", "before1", "after1", "after2")]
        along_f = [F.get("ts", f + k) for k in (-3, -2, -1, 1, 2)]
        low = F.least(sum(along_t[1:], along_t[0]), sum(along_f[1:], along_f[0]))
        return F.when((s > F.greatest(*along_t, *along_f)) & (s > low / 6 + 0.05), F.struct(f.cast("long").alias("f"), s.alias("s")))

    found = inside.select("t", F.explode(F.filter(F.transform(F.sequence(F.lit(3), F.lit(60)), cell), lambda x: x.isNotNull())).alias("x"))
    return found.select("t", "x.f", F.round("x.s", R).alias("s"))


@query("label_counts", f"WITH {SERIES} SELECT label, CAST(count(*) AS BIGINT) AS n FROM series GROUP BY label")
def label_counts(spark, sf):
    return series(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "cluster_label_vote",
    f"{_PROBS}, m AS (SELECT label AS cluster, i, avg(p[i + 1]) AS mean FROM p, (SELECT unnest(range(64)) AS i) GROUP BY ALL) SELECT cluster, arg_max(i, (mean, -i)) AS cls, round(max(mean), 6) AS mean FROM m GROUP BY cluster",
)
def cluster_label_vote(spark, sf):
    """The class with the highest mean probability in each cluster."""
    m = _probabilities(spark, sf).select("label", F.posexplode("p").alias("i", "p")).groupBy(F.col("label").alias("cluster"), F.col("i").cast("long").alias("i")).agg(F.avg("p").alias("mean"))
    return m.groupBy("cluster").agg(F.max_by("i", F.struct("mean", -F.col("i"))).alias("cls"), F.round(F.max("mean"), R).alias("mean"))


@query("state_lengths", f"WITH {TOKENS} SELECT cid, CAST(floor(avg((stop - start) // 3)) AS BIGINT) AS states FROM tokens GROUP BY cid")
def state_lengths(spark, sf):
    """Mean number of three-frame states of each class's tokens."""
    return token_view(spark, sf).groupBy("cid").agg(F.floor(F.avg(F.floor((F.col("stop") - F.col("start")) / 3))).cast("long").alias("states"))


@query("cluster_sizes", "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS rank, round(ln(n), 6) AS log_n FROM (SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source HAVING count(*) >= 2)")
def cluster_sizes(spark, sf):
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).filter("n >= 2")
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("long")).withColumn("log_n", F.round(F.log("n"), R))


@query("interval_join", f"WITH {TOKENS}, spans AS (SELECT rec, run, start, stop FROM tokens WHERE cid > 0) SELECT s.rec, s.run, CAST(count(*) AS BIGINT) AS n, round(sum(f.value), 4) AS total FROM frames f JOIN spans s ON f.rec = s.rec AND f.t >= s.start AND f.t < s.stop GROUP BY ALL")
def interval_join(spark, sf):
    """Frames under each token that isn't silence."""
    spans = token_view(spark, sf).filter("cid > 0").select("rec", "run", "start", "stop")
    return in_interval(frames(spark, sf).select("rec", "t", "value"), spans, "rec").groupBy("rec", "run").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("noise_ratio", f"WITH {FRAMES}, r AS (SELECT rec, t // 20 AS region, avg(CAST(cid = 0 AS INT)) AS noise FROM frames GROUP BY ALL) SELECT rec, region, round(noise, 6) AS noise FROM r WHERE noise < 0.9")
def noise_ratio(spark, sf):
    """Regions of twenty frames that aren't nearly all noise."""
    r = frames(spark, sf).groupBy("rec", F.floor(F.col("t") / 20).cast("long").alias("region")).agg(F.avg((F.col("cid") == 0).cast("int")).alias("noise"))
    return r.filter("noise < 0.9").select("rec", "region", F.round("noise", R).alias("noise"))


@query("one_hot", f"WITH {SERIES} SELECT ts_id, CAST(label = 0 AS BIGINT) AS c0, CAST(label = 1 AS BIGINT) AS c1, CAST(label = 2 AS BIGINT) AS c2 FROM series")
def one_hot(spark, sf):
    return series(spark, sf).select("ts_id", *[(F.col("label") == i).cast("long").alias(f"c{i}") for i in range(3)])


@query("train_test_split", f"WITH {SERIES} SELECT ts_id, ts_id * 2654435761 % 4294967296 % 100 < 33 AS test FROM series")
def train_test_split(spark, sf):
    return series(spark, sf).select("ts_id", (F.pmod(F.col("ts_id") * 2_654_435_761, F.lit(1 << 32)) % 100 < 33).alias("test"))


@query(
    "triplets",
    f"""WITH {SERIES}, r AS (SELECT ts_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY ts_id * 2654435761 % 4294967296, ts_id) - 1 AS r FROM series),
n AS (SELECT label, count(*) AS n FROM r GROUP BY label), g AS (SELECT label, n, coalesce(lead(label) OVER (ORDER BY label), (SELECT min(label) FROM n)) AS next FROM n),
a AS (SELECT r.id, r.label, (r.r + 1) % g.n AS rp, g.next, r.r % m.n AS rn FROM r JOIN g USING (label) JOIN n m ON m.label = g.next WHERE g.n > 1 AND g.next <> r.label)
SELECT a.id AS anchor, p.id AS positive, q.id AS negative FROM a JOIN r p ON p.label = a.label AND p.r = a.rp JOIN r q ON q.label = a.next AND q.r = a.rn""",
)
def triplet_rows(spark, sf):
    return triplets(series(spark, sf), "ts_id", "label")


@query("kmeans_assign")
def kmeans_assign(spark, sf):
    _, out = clustering.kmeans(series(spark, sf), 10)
    return out.select("ts_id", F.col("cluster").cast("long").alias("cluster"))


@query("bic_curve")
def bic_curve(spark, sf):
    return clustering.bic_curve(series(spark, sf), list(range(2, 26)))


_warped = Warped(DIM, squared=False)


@query("complete_linkage")
def complete_linkage(spark, sf):
    """Complete linkage of series by time warping, cut at the percentiles 1 to 98 of their distances."""
    return linkage.complete_linkage(series(spark, sf), "ts_id", "ts", _warped)


@query("greedy_chain")
def greedy_chain(spark, sf):
    """Series in the order of the chain of nearest neighbours by time warping."""
    return nearest_chain(series(spark, sf), "ts_id", "ts", _warped)


def _strings(spark, sf):
    """Tokens of each recording in order."""
    t = token_view(spark, sf).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("start", "cls"))).alias("l"))
    return t.select("rec", F.col("l.cls").alias("symbols"))


def _sized(spark, sf):
    """Recordings of 2 to 99 tokens, which is what this query's SQL asks for."""
    return _strings(spark, sf).filter(F.size("symbols").between(2, 99))


@query("sized_sequences", f"WITH {TOKENS}, s AS (SELECT rec, list(cls ORDER BY start) AS symbols FROM tokens GROUP BY rec) SELECT rec, array_to_string(symbols, ' ') AS sequence FROM s WHERE len(symbols) BETWEEN 2 AND 99")
def sized_sequences(spark, sf):
    return _sized(spark, sf).select("rec", F.array_join("symbols", " ").alias("sequence"))


@query("string_linkage")
def string_linkage(spark, sf):
    """Complete linkage of symbol strings by edit distance, cut at the percentiles 1 to 98."""
    return linkage.complete_linkage(_strings(spark, sf), "rec", "symbols", Edited())


@query("decode_chain")
def decode_chain(spark, sf):
    """Decoded recordings in the order of the chain of nearest neighbours by edit distance, with their tokens."""
    s = _strings(spark, sf)
    return nearest_chain(s, "rec", "symbols", Edited()).join(s, "rec").select("place", "rec", F.array_join("symbols", " ").alias("sequence"))


#: Frames of a region, and the part of all regions that counts as unlikely.
REGION, UNLIKELY = 20, 0.01
_REGIONS = f"""{FRAMES}, r AS (SELECT rec, t // {REGION} AS region, arg_max(cls, (n, cls)) AS cls, sum(noise) / sum(n) AS noise, sum(total) / sum(n) AS ll
  FROM (SELECT rec, t // {REGION} * {REGION} AS t, cls, count(*) AS n, count(*) FILTER (cid = 0) AS noise, sum(value) AS total FROM frames GROUP BY ALL) GROUP BY rec, t),
judged AS (SELECT *, cls = '_' OR noise >= 0.9 OR ll <= (SELECT ll FROM r ORDER BY ll LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * {UNLIKELY}) AS BIGINT) FROM r)) AS suppressed FROM r)"""


def _regions(spark, sf):
    """Regions of REGION frames with their commonest class, part of noise, mean value, and whether they are silent, noisy or unlikely."""
    f = frames(spark, sf).groupBy("rec", F.floor(F.col("t") / REGION).cast("long").alias("region"), "cls").agg(F.count("*").alias("n"), F.count_if(F.col("cid") == 0).alias("noise"), ordered_sum("value", "t").alias("total"), F.min("t").alias("first"))
    # classes are added up as they appear, as the SQL does in one thread; with more its last bits change from run to run
    r = f.groupBy("rec", "region").agg(F.max_by("cls", F.struct("n", "cls")).alias("cls"), (F.sum("noise") / F.sum("n")).alias("noise"), (ordered_sum("total", "first") / F.sum("n")).alias("ll"))
    return suppressed(r, "cls", "_", "noise", "ll", UNLIKELY)


@query("suppression", f"WITH {_REGIONS} SELECT rec, region, cls, round(noise, 6) AS noise, suppressed FROM judged")
def suppression(spark, sf):
    return _regions(spark, sf).select("rec", "region", "cls", F.round("noise", R).alias("noise"), "suppressed")


@query("sequencing", f"WITH {_REGIONS}, s AS (SELECT rec, list(cls ORDER BY region) AS symbols FROM judged WHERE NOT suppressed GROUP BY rec) SELECT rec, array_to_string(symbols, ' ') AS sequence FROM s WHERE len(symbols) BETWEEN 2 AND 99")
def sequencing(spark, sf):
    """What suppression leaves of each recording, in order."""
    return _kept_regions(spark, sf).select("rec", F.array_join("symbols", " ").alias("sequence"))


def _kept_regions(spark, sf):
    s = _regions(spark, sf).filter(~F.col("suppressed")).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("region", "cls"))).alias("l"))
    return s.select("rec", F.col("l.cls").alias("symbols")).filter(F.size("symbols").between(2, 99))


@query("sequencing_chain")
def sequencing_chain(spark, sf):
    """The sequences that suppression leaves, in the order of their chain by edit distance."""
    s = _kept_regions(spark, sf)
    return nearest_chain(s, "rec", "symbols", Edited()).join(s, "rec").select("place", "rec", F.array_join("symbols", " ").alias("sequence"))


@query("kept_recordings", f"WITH {FRAMES} SELECT rec, CAST(count(*) FILTER (cid > 0) AS BIGINT) AS n FROM frames WHERE t < 10000 GROUP BY rec HAVING count(*) FILTER (cid > 0) > 3")
def kept_recordings(spark, sf):
    """Recordings with more than three frames of signal among their first 10,000; that cap is the feature."""
    n = frames(spark, sf).filter("t < 10000").groupBy("rec").agg(F.count_if(F.col("cid") > 0).alias("n"))
    return n.filter("n > 3")


@query(
    "balanced_sample",
    f"""WITH {SERIES}, r AS (SELECT ts_id, label, row_number() OVER (PARTITION BY label ORDER BY ts_id * 2654435761 % 4294967296, ts_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM series),
d AS (SELECT label, unnest(range(50)) AS draw FROM (SELECT DISTINCT label FROM series)) SELECT d.label, d.draw, r.ts_id FROM d JOIN r ON r.label = d.label AND r.r = d.draw % r.n""",
)
def balanced_sample(spark, sf):
    """Fifty draws with replacement from each label, a sampling operator."""
    return labels.balanced(series(spark, sf).select("ts_id", "label"), "label", "ts_id", 50).select("label", "draw", "ts_id")
