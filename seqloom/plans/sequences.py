"""Queries over frames, tokens and symbol sequences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import sequences as fs
from seqloom.operators import labels, search, tokens, windows
from seqloom.plans import oracle_sql, query
from seqloom.plans.views import FRAMES, GRAMS, SEQUENCES, TOKENS, event_sequences, frames, queries_of, table
from seqloom.plans.views import tokens as token_view
from seqloom.storage import store

R = 6  # places to which doubles are rounded


@query("rle_tokens", f"WITH {TOKENS} SELECT rec, run, cid, start, stop, cls FROM tokens")
def rle_tokens(spark, sf):
    return token_view(spark, sf).select("rec", "run", "cid", "start", "stop", "cls")


@query("silence_classes", f"WITH {TOKENS} SELECT cls, CAST(count(*) AS BIGINT) AS n, CAST(sum(stop - start) AS BIGINT) AS frames FROM tokens WHERE starts_with(cls, '_') GROUP BY cls")
def silence_classes(spark, sf):
    t = token_view(spark, sf).filter(F.col("cls").startswith("_"))
    return t.groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).cast("long").alias("frames"))


@query("speech_tokens", f"WITH {TOKENS} SELECT rec, CAST(count(*) AS BIGINT) AS n FROM tokens WHERE cid > 0 GROUP BY rec HAVING count(*) > 8")
def speech_tokens(spark, sf):
    """Recordings with more than eight tokens that aren't silence."""
    return token_view(spark, sf).filter("cid > 0").groupBy("rec").agg(F.count("*").alias("n")).filter("n > 8")


_ANNOTATIONS = """notes AS (SELECT user_id AS rec, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(round(value * 600) AS BIGINT) AS stop, event_type AS label, event_id, value AS ll FROM events)"""


@query(
    "annotation_merge",
    f"""WITH {_ANNOTATIONS},
o AS (SELECT *, lag(stop) OVER w AS before, lag(label) OVER w AS kind FROM notes WINDOW w AS (PARTITION BY rec ORDER BY start, stop)),
i AS (SELECT *, sum(CASE WHEN start <= before AND label = kind THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY start, stop) AS island FROM o)
SELECT rec, CAST(island AS BIGINT) AS island, min(start) AS start, arg_max(stop, (start, stop)) AS stop, any_value(label) AS label, round(sum(ll), 6) AS ll FROM i GROUP BY rec, island""",
)
def annotation_merge(spark, sf):
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    notes = table(spark, sf, "events").select(F.col("user_id").alias("rec"), second.alias("start"), (second + F.round(F.col("value") * 600).cast("long")).alias("stop"), F.col("event_type").alias("label"), F.col("value").alias("ll"))
    out = tokens.merge_annotations(notes, "rec")
    return out.select("rec", F.col("island").cast("long").alias("island"), "start", "stop", "label", F.round("ll", R).alias("ll"))


_FOLDED = f"""WITH {TOKENS},
folded AS (SELECT rec, start, CASE WHEN starts_with(cls, '_') THEN '_' ELSE cls END AS prev FROM tokens),
pairs AS (SELECT prev, lead(prev) OVER (PARTITION BY rec ORDER BY start) AS next FROM folded)"""


@query("transition_counts", f"{_FOLDED} SELECT prev, next, CAST(count(*) AS BIGINT) AS n FROM pairs WHERE next IS NOT NULL GROUP BY prev, next")
def transition_counts(spark, sf):
    return tokens.transitions(token_view(spark, sf), number="run")


_SYMBOLS = ["_", "Bb", "Da", "Ea", "Ua"]


@query("transition_pivot", f"{_FOLDED} SELECT prev, " + ", ".join(f"CAST(count(*) FILTER (next = '{s}') AS BIGINT) AS \"{'sil' if s == '_' else s}\"" for s in _SYMBOLS) + " FROM pairs WHERE next IS NOT NULL GROUP BY prev")
def transition_pivot(spark, sf):
    wide = tokens.transitions(token_view(spark, sf), number="run").groupBy("prev").pivot("next", _SYMBOLS).agg(F.sum("n"))
    return wide.select("prev", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("long").alias("sil" if s == "_" else s) for s in _SYMBOLS])


@query("vocabulary", f"WITH {TOKENS}, v AS (SELECT DISTINCT CASE WHEN starts_with(cls, '_') THEN '_' ELSE cls END AS cls FROM tokens) SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS id FROM v")
def vocabulary(spark, sf):
    v = token_view(spark, sf).select(F.when(F.col("cls").startswith("_"), "_").otherwise(F.col("cls")).alias("cls")).distinct()
    return v.withColumn("id", (F.row_number().over(Window.orderBy("cls")) - 1).cast("long"))


def _gram_sql(n: int, sep: str) -> str:
    return GRAMS.format(s="symbols", n=n, sep=sep)


@query("bigram_postings", f"WITH {SEQUENCES}, g AS (SELECT seq_id, unnest({_gram_sql(2, '|')}) AS gram FROM sequences) SELECT gram, seq_id, CAST(count(*) AS BIGINT) AS n_occ FROM g GROUP BY gram, seq_id")
def bigram_postings(spark, sf):
    return tokens.postings(event_sequences(spark, sf), fs.ngrams(F.col("symbols"), 2, "|"))


_PHRASES = " UNION ALL ".join(f"SELECT seq_id, unnest({_gram_sql(n, ' ')}) AS phrase FROM sequences" for n in range(1, 8))


@query("substring_postings", f"WITH {SEQUENCES}, g AS ({_PHRASES}) SELECT phrase, seq_id, CAST(count(*) AS BIGINT) AS n_occ FROM g GROUP BY phrase, seq_id")
def substring_postings(spark, sf):
    return tokens.postings(event_sequences(spark, sf), fs.phrases(F.col("symbols")), name="phrase")


@query("find_phrase", f"WITH {SEQUENCES}, g AS ({_PHRASES}) SELECT s.seq_id, s.start, s.stop, CAST(count(*) AS BIGINT) AS n_occ FROM g JOIN sequences s USING (seq_id) WHERE phrase = 'click view' GROUP BY ALL")
def find_phrase(spark, sf):
    s = event_sequences(spark, sf)
    hits = tokens.postings(s, fs.phrases(F.col("symbols")), name="phrase").filter(F.col("phrase") == "click view")
    return hits.join(s, "seq_id").select("seq_id", "start", "stop", "n_occ")


_WINDOWS = "SELECT doc_id, generate_subscripts(e, 1) - 1 AS win_id, unnest(e) - {size} AS start, unnest(e) AS stop FROM (SELECT doc_id, range({size}, n_chars, {hop}) AS e FROM documents WHERE n_chars > {size})"


@query("sliding_windows", _WINDOWS.format(size=360, hop=180))
def sliding_windows(spark, sf):
    return windows.sliding(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 360, 180).select("doc_id", "win_id", "start", "stop")


@query("prob_windows_insert", _WINDOWS.format(size=100, hop=50))
def prob_windows_insert(spark, sf):
    return windows.sliding(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 100, 50).select("doc_id", "win_id", "start", "stop")


@query("prob_windows_query", _WINDOWS.format(size=100, hop=10))
def prob_windows_query(spark, sf):
    return windows.sliding(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 100, 10).select("doc_id", "win_id", "start", "stop")


@query(
    "split_regions",
    """SELECT doc_id, unnest(e) - 1000 AS start, unnest(e) AS stop FROM (SELECT doc_id, range(1000, n_chars, 500) AS e FROM documents WHERE n_chars > 1000)
UNION ALL SELECT doc_id, CAST(0 AS BIGINT), n_chars FROM documents WHERE n_chars < 1000""",
)
def split_regions(spark, sf):
    return windows.split_regions(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 1000, 500).select("doc_id", "start", "stop")


@query("tumbling_chunks", f"WITH {FRAMES} SELECT rec, t // 20 AS chunk, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM frames GROUP BY ALL")
def tumbling_chunks(spark, sf):
    return windows.tumbling(frames(spark, sf), "t", 20).groupBy("rec", "chunk").agg(F.count("*").alias("n"), F.round(F.avg("value"), R).alias("mean"))


@query(
    "positional_ngrams",
    f"""WITH {TOKENS}, w AS (SELECT rec, start, cls || '|' || lead(cls) OVER p || '|' || lead(cls, 2) OVER p AS gram, lead(stop, 2) OVER p AS stop FROM tokens WINDOW p AS (PARTITION BY rec ORDER BY start))
SELECT rec, gram, start, stop FROM w WHERE stop IS NOT NULL""",
)
def positional_ngrams(spark, sf):
    """Trigrams with the start of their first token and the stop of their last."""
    p = Window.partitionBy("rec", "_stretch").orderBy("run")
    t = windows.with_halo(token_view(spark, sf), "run", 0, 2)
    out = t.select("rec", F.concat_ws("|", "cls", F.lead("cls").over(p), F.lead("cls", 2).over(p)).alias("gram"), "start", F.lead("stop", 2).over(p).alias("stop"), "_stretch", "_own")
    return windows.own(out).filter(F.col("stop").isNotNull())


@query(
    "running_offsets",
    "SELECT source, doc_id, CAST(sum(n_chars) OVER w - n_chars AS BIGINT) AS start, CAST(sum(n_chars) OVER w AS BIGINT) AS stop FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)",
)
def running_offsets(spark, sf):
    """Where each document of a source begins when they are joined end to end."""
    return windows.running_offset(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "n_chars", "source", ["doc_id"]).select("source", "doc_id", "start", "stop")


@query("moving_average_valid", f"WITH {FRAMES} SELECT rec, t, round(a, 6) AS average FROM (SELECT rec, t, avg(value) OVER (PARTITION BY rec ORDER BY t ROWS 4 PRECEDING) AS a FROM frames) WHERE t >= 4")
def moving_average_valid(spark, sf):
    return windows.moving_average(frames(spark, sf), "value", "rec", ["t"], 5).select("rec", "t", F.round("average", R).alias("average"))


@query("box_smooth_same", f"WITH {FRAMES} SELECT rec, t, round(sum(value) OVER (PARTITION BY rec ORDER BY t ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8, 6) AS smooth FROM frames")
def box_smooth_same(spark, sf):
    return windows.smoothed(frames(spark, sf), "value", "rec", "t", windows.box(8), "smooth").select("rec", "t", F.round("smooth", R).alias("smooth"))


_TRIANGLE = " + ".join(f"coalesce({'lag' if 4 - j >= 0 else 'lead'}(value, {abs(4 - j)}) OVER w, 0) * {w!r}" for j, w in enumerate(windows.triangle(8)))


@query("triangular_smooth", f"WITH {FRAMES} SELECT rec, t, round({_TRIANGLE}, 8) AS smooth FROM frames WINDOW w AS (PARTITION BY rec ORDER BY t)")
def triangular_smooth(spark, sf):
    return windows.smoothed(frames(spark, sf), "value", "rec", "t", windows.triangle(8), "smooth").select("rec", "t", F.round("smooth", 8).alias("smooth"))


#: Candidates share two symbols in a row; the trigram_* queries take three, which loses candidates but spares comparisons.
GRAM, LONGER = 2, 3
_CANDIDATES = f"""{SEQUENCES},
g AS (SELECT seq_id, unnest(list_distinct({_gram_sql(GRAM, '|')})) AS gram FROM sequences),
c AS (SELECT DISTINCT a.seq_id AS q, b.seq_id AS s FROM g a JOIN g b USING (gram) WHERE a.seq_id % 50 = 0)"""
_DISTANCE = """CASE WHEN len(x.symbols) > 0 AND len(y.symbols) > 0 THEN
  list_reduce(range(1, len(x.symbols) + 1), lambda prev, i: list_reduce(range(1, len(y.symbols) + 1), lambda row, j:
    list_append(row, CASE WHEN j >= i - w AND j < i + w THEN least(prev[j + 1] + 1, row[j] + 1, prev[j] + CASE WHEN x.symbols[i] = y.symbols[j] THEN 0.0 ELSE 1.0 END) ELSE 'inf'::DOUBLE END),
    ['inf'::DOUBLE]), list_concat([0.0::DOUBLE], list_transform(y.symbols, lambda e: 'inf'::DOUBLE)))[len(y.symbols) + 1] / (len(x.symbols) * len(y.symbols)) END"""
_PAIRS = f"""{_CANDIDATES},
p AS (SELECT q, s, x.symbols AS xs, y.symbols AS ys, x.encounter AS xe, y.encounter AS ye, x.start AS x0, x.stop AS x1, y.start AS y0, y.stop AS y1,
             greatest(CAST(floor(greatest(len(x.symbols), len(y.symbols)) * 0.1) AS BIGINT), abs(len(x.symbols) - len(y.symbols))) + 2 AS w
      FROM c JOIN sequences x ON x.seq_id = q JOIN sequences y ON y.seq_id = s),
d AS (SELECT *, {_DISTANCE.replace('x.symbols', 'xs').replace('y.symbols', 'ys')} AS dist FROM p)"""
_APART = "NOT (xe = ye AND greatest(x0, y0) <= least(x1, y1))"


def _corpus(spark, sf):
    s = store(event_sequences(spark, sf), "sequences")  # counted, dealt and joined, so read several times
    return queries_of(s, "seq_id"), s


def _pairs(spark, sf, n=GRAM, **how):
    """With five symbols there are 25 bigrams, too few for join keys: kinds of queries meet all kinds of sequences in blocks."""
    return search.pairs_by_kind(*_corpus(spark, sf), n, places=R, **how)


def _graph(spark, sf, n=GRAM, elsewhere=True):
    return search.nearest_by_kind(*_corpus(spark, sf), 10, n, elsewhere)


_RANKED = "SELECT q, s, dist, row_number() OVER (PARTITION BY q ORDER BY dist, s DESC) AS rank FROM d"
_GRAPH = f"WITH {_PAIRS}, graph AS (SELECT * FROM ({_RANKED} WHERE {_APART}) WHERE rank <= 10)"
_DENSITY = f"""{_GRAPH},
density AS (SELECT x.seq_id AS q, CASE WHEN count(g.s) >= 10 THEN 1 / (1 + max(g.dist)) ELSE 1e-8 END AS density FROM sequences x LEFT JOIN graph g ON g.q = x.seq_id WHERE x.seq_id % 50 = 0 GROUP BY x.seq_id),
cdf AS (SELECT q, density, sum(density) OVER (ORDER BY q) / sum(density) OVER () AS cdf FROM density)"""


@query("ngram_candidates", f"WITH {_CANDIDATES} SELECT q, s FROM c")
def ngram_candidates(spark, sf):
    return _pairs(spark, sf, distance=False).select("q", "s")


@query("overlap_reject_pairs", f"WITH {_PAIRS} SELECT q, s FROM p WHERE {_APART}")
def overlap_reject_pairs(spark, sf):
    return _pairs(spark, sf, elsewhere=True, distance=False).select("q", "s")


@query("edit_distance_pairs", f"WITH {_PAIRS} SELECT q, s, round(dist, 6) AS dist FROM d")
def edit_distance_pairs(spark, sf):
    return _pairs(spark, sf)


@query("knn_strict", f"WITH {_PAIRS} SELECT q, s, round(dist, 6) AS dist, rank FROM ({_RANKED}) WHERE rank <= 10")
def knn_strict(spark, sf):
    return _graph(spark, sf, elsewhere=False).withColumn("dist", F.round("dist", R))


@query("discovery_graph", f"{_GRAPH} SELECT q, s, round(dist, 6) AS dist, rank FROM graph")
def discovery_graph(spark, sf):
    return _graph(spark, sf).withColumn("dist", F.round("dist", R))


def _density(spark, sf, n=GRAM):
    return search.density(_corpus(spark, sf)[0], _graph(spark, sf, n))


@query("density", f"{_DENSITY} SELECT q, round(density, 6) AS density FROM density")
def density(spark, sf):
    return _density(spark, sf).withColumn("density", F.round("density", R))


@query("density_cdf", f"{_DENSITY} SELECT q, round(cdf, 6) AS cdf FROM cdf")
def density_cdf(spark, sf):
    return search.cumulative(_density(spark, sf)).select("q", F.round("cdf", R).alias("cdf"))


_POINTS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("weighted_sample", f"{_DENSITY} SELECT i - 1 AS draw, u, min(q) AS q FROM cdf JOIN (SELECT unnest({_POINTS}) AS u, generate_subscripts({_POINTS}, 1) AS i) ON cdf >= u GROUP BY ALL")
def weighted_sample(spark, sf):
    return search.draw(search.cumulative(_density(spark, sf)), _POINTS)


def _trigram(name: str):
    """The query ``name`` over candidates that share a trigram; its SQL is the other's with n = 3."""
    return query(f"trigram_{name}", oracle_sql()[name].replace(_gram_sql(GRAM, "|"), _gram_sql(LONGER, "|")))


@_trigram("ngram_candidates")
def trigram_ngram_candidates(spark, sf):
    return _pairs(spark, sf, LONGER, distance=False).select("q", "s")


@_trigram("overlap_reject_pairs")
def trigram_overlap_reject_pairs(spark, sf):
    return _pairs(spark, sf, LONGER, elsewhere=True, distance=False).select("q", "s")


@_trigram("edit_distance_pairs")
def trigram_edit_distance_pairs(spark, sf):
    return _pairs(spark, sf, LONGER)


@_trigram("knn_strict")
def trigram_knn_strict(spark, sf):
    return _graph(spark, sf, LONGER, elsewhere=False).withColumn("dist", F.round("dist", R))


@_trigram("discovery_graph")
def trigram_discovery_graph(spark, sf):
    return _graph(spark, sf, LONGER).withColumn("dist", F.round("dist", R))


@_trigram("density")
def trigram_density(spark, sf):
    return _density(spark, sf, LONGER).withColumn("density", F.round("density", R))


@_trigram("density_cdf")
def trigram_density_cdf(spark, sf):
    return search.cumulative(_density(spark, sf, LONGER)).select("q", F.round("cdf", R).alias("cdf"))


@_trigram("weighted_sample")
def trigram_weighted_sample(spark, sf):
    return search.draw(search.cumulative(_density(spark, sf, LONGER)), _POINTS)


@query("history_latest", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def history_latest(spark, sf):
    """The latest twenty entries of the history, a top-k report."""
    o = table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("name_codec", "SELECT doc_id, translate(CAST(doc_id AS VARCHAR), '0123456789', 'abcdefghij') AS name, doc_id AS number FROM documents")
def name_codec(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", fs.digits_to_letters(F.col("doc_id")).alias("name"))
    return d.withColumn("number", fs.letters_to_digits(F.col("name")))


@query(
    "view_rows",
    f"""WITH {SEQUENCES} SELECT seq_id, 'rec' || encounter AS id, 'rec' || encounter || '_' || start || '_' || stop || '.wav' AS audio, array_to_string(symbols, ' ') AS sequence,
  ((stop - start) // 3600) || ':' || ((stop - start) % 3600 // 60) || ':' || ((stop - start) % 60) AS span FROM sequences""",
)
def view_rows(spark, sf):
    s = event_sequences(spark, sf).withColumn("path", F.format_string("store/rec-%d.wav", "encounter"))
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.wav$", ""), "[^a-zA-Z0-9_ ]+", "")
    audio = F.format_string("%s_%d_%d.wav", name, F.col("start"), F.col("stop"))
    return s.select("seq_id", name.alias("id"), audio.alias("audio"), F.array_join("symbols", " ").alias("sequence"), fs.clock(F.col("stop") - F.col("start"), 1).alias("span"))


@query(
    "label_mapping",
    "SELECT lang, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_id FROM (SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY lang)",
)
def label_mapping(spark, sf):
    """Ids of clusters laid end to end by class: a class's first id is one more than the clusters of the classes before it."""
    n = table(spark, sf, "documents").groupBy("lang").agg(F.countDistinct("source").alias("n"))
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("first_id", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).cast("long"))


@query(
    "selection_table",
    f"""WITH {TOKENS}, n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start) AS selection FROM tokens)
SELECT rec, selection, view, CAST(1 AS BIGINT) AS channel, round(start * 128 / 44100.0, 6) AS begin_s, round(stop * 128 / 44100.0, 6) AS end_s, cls AS annotation
FROM n, (VALUES ('Waveform 1'), ('Spectrogram 1')) v(view) WHERE NOT starts_with(cls, '_')""",
)
def selection_table(spark, sf):
    """Two rows for each token that isn't silence; numbers keep gaps."""
    from seqloom.sources.tables import selections

    return selections(token_view(spark, sf)).withColumn("begin_s", F.round("begin_s", R)).withColumn("end_s", F.round("end_s", R))


@query("event_tumbling", "SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")


@query("event_sliding", "SELECT (CAST(floor(epoch(ts) / 10800) AS BIGINT) - k) * 10800 AS start, CAST(count(*) AS BIGINT) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL")
def event_sliding(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "6 hours", "3 hours")).agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("start"), "n")


@query(
    "event_session",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM o)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY user_id, session""",
)
def event_session(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_seconds("session_window.start").alias("start"), "n")


@query(
    "gapped_ngrams",
    f"""WITH {TOKENS}, w AS (SELECT rec, start, array_to_string(list(cls) OVER p, '_') AS gram, max(stop) OVER p AS stop, avg(1.0 / (stop - start)) OVER p AS prob, count(*) OVER p AS n FROM tokens
WINDOW p AS (PARTITION BY rec ORDER BY start ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT rec, gram, start, stop, round(prob, 6) AS prob FROM w WHERE n = 3 AND prob >= 0.75""",
)
def gapped_ngrams(spark, sf):
    """Trigrams of tokens that are likely on average."""
    t = token_view(spark, sf).withColumn("prob", 1 / (F.col("stop") - F.col("start")))
    return labels.gapped_ngrams(t, 3, "rec", 0.75, 1).withColumn("prob", F.round("prob", R)).select("rec", "gram", "start", "stop", "prob")


@query(
    "region_windows",
    """SELECT doc_id, CAST(0 AS BIGINT) AS start, n_chars AS stop FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, unnest(e) - 400, unnest(e) FROM (SELECT doc_id, range(400, n_chars, 200) AS e FROM documents WHERE n_chars > 400 AND lang IS DISTINCT FROM 'en')""",
)
def region_windows(spark, sf):
    """Regions of one class stay whole, others become half-overlapping windows."""
    return labels.rewindow(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "n_chars", F.col("lang") == "en", 400).select("doc_id", "start", "stop")
