"""Queries that compare groups by their n-grams, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import sequences as fs
from seqloom.operators import statistics, windows
from seqloom.operators.prefix import consecutive
from seqloom.plans import query
from seqloom.plans.views import GRAMS, TOKENS, frames, queries_of, table
from seqloom.plans.views import tokens as token_view
from seqloom.storage import store

R = 9
#: n-grams are counted up to this length.
LONGEST = 9

_STRINGS = f"""{TOKENS},
l1 AS (SELECT rec, list(cls ORDER BY t) AS w FROM frames GROUP BY rec), l2 AS (SELECT rec, list(cls ORDER BY start) AS w FROM tokens GROUP BY rec),
strings AS (SELECT rec, left(CAST(rec AS VARCHAR), 1) AS label, 1 AS level, w FROM l1 UNION ALL SELECT rec, left(CAST(rec AS VARCHAR), 1), 2, w FROM l2)"""
_EACH = ", ".join(GRAMS.format(s="w", n=n, sep=" ") for n in range(1, LONGEST + 1))
_COUNTS = f"WITH RECURSIVE {_STRINGS}, g AS (SELECT label, unnest(flatten([{_EACH}])) AS gram FROM strings), c AS (SELECT label, gram, count(*) AS n FROM g GROUP BY ALL)"
_FREQ = f"{_COUNTS}, kept AS (SELECT gram FROM c GROUP BY gram HAVING sum(n) >= 3), f AS (SELECT label, gram, n / sum(n) OVER (PARTITION BY label) AS freq FROM c JOIN kept USING (gram))"
_PAIRED = f"""{_FREQ}, l AS (SELECT DISTINCT label FROM f), grid AS (SELECT x.label AS kx, y.label AS ky FROM l x JOIN l y ON x.label <> y.label),
x AS (SELECT kx, ky, gram, freq AS fx FROM f JOIN grid ON kx = label), y AS (SELECT kx, ky, gram, freq AS fy FROM f JOIN grid ON ky = label),
p AS (SELECT kx, ky, gram, coalesce(fx, 0) AS fx, coalesce(fy, 0) AS fy FROM x FULL JOIN y USING (kx, ky, gram)),
chi AS (SELECT kx, ky, sum(CASE WHEN fy > 0 THEN (fx - fy) ** 2 / fy END) AS statistic, count(*) AS grams, count(*) FILTER (fy = 0) AS absent FROM p GROUP BY kx, ky)"""
# the lower tail of chi-square with grams - 1 degrees of freedom as a series; far above its mean it is 1
_TAIL = """CASE WHEN absent > 0 OR statistic > 4 * grams + 1000 THEN 0 ELSE 1 - coalesce(exp(-statistic / 2 + (grams - 1) / 2 * ln(statistic / 2) - lgamma((grams - 1) / 2 + 1))
  * list_sum(list_transform(range(0, 4000), lambda n: exp(n * ln(statistic / 2) + lgamma((grams - 1) / 2 + 1) - lgamma((grams - 1) / 2 + 1 + n)))), 0) END"""
_TOP = f"{_PAIRED}, differing AS (SELECT kx, ky FROM chi WHERE {_TAIL} < 0.001), t AS (SELECT kx, ky, gram, fx - fy AS diff, row_number() OVER (PARTITION BY kx, ky ORDER BY round(abs(fx - fy), 12) DESC, gram) AS rank FROM p JOIN differing USING (kx, ky))"


def placed_grams(spark, sf):
    """rec, label (first character of the recording's name), level, pos and the n-grams of 1 to LONGEST symbols that begin there, over frames (level 1) and tokens (2).

    Symbols come from the rows ahead, stretch by stretch, so that no recording is
    gathered as an array or ordered whole; its last symbol is in no n-gram.
    """

    def level(df, order, n):
        w = Window.partitionBy("rec", "_stretch").orderBy(order)
        dealt = windows.with_halo(df.select("rec", order, "cls"), order, 0, LONGEST)
        rows = windows.own(dealt.select("rec", order, F.col(order).alias("pos"), "cls", "_stretch", "_own", *[F.lead("cls", k).over(w).alias(f"_{k}") for k in range(1, LONGEST + 1)]))
        grams = [F.when(F.col(f"_{k}").isNotNull(), F.concat_ws(" ", "cls", *[f"_{j}" for j in range(1, k)])) for k in range(1, LONGEST + 1)]
        return rows.select("rec", F.lit(n).alias("level"), "pos", F.array_compact(F.array(*grams)).alias("grams"))

    both = level(frames(spark, sf), "t", 1).unionByName(level(token_view(spark, sf), "run", 2))
    return both.withColumn("label", F.left(F.col("rec").cast("string"), F.lit(1)))


def _counts(spark, sf):
    """Occurrences of n-grams by label, both levels together."""
    return statistics.gram_counts(placed_grams(spark, sf), "label", F.col("grams"))


def _frequencies(spark, sf):
    return statistics.frequencies(_counts(spark, sf))


def _top(spark, sf, k=25):
    p = store(statistics.paired(_frequencies(spark, sf)), "paired")
    differ = F.broadcast(statistics.differing(p))  # pairs of labels
    return statistics.most_differing(p.join(differ, ["kx", "ky"]), k).withColumn("diff", F.col("fx") - F.col("fy"))


@query("ngram_counts", f"{_COUNTS} SELECT label, gram, CAST(n AS BIGINT) AS n FROM c")
def ngram_counts(spark, sf):
    return _counts(spark, sf)


@query("ngram_freq_vectors", f"{_FREQ} SELECT label, gram, round(freq, 9) AS freq FROM f")
def ngram_freq_vectors(spark, sf):
    return _frequencies(spark, sf).select("label", "gram", F.round("freq", R).alias("freq"))


@query("chi2_statistic", f"{_PAIRED} SELECT kx, ky, round(statistic, 6) AS statistic, CAST(grams AS BIGINT) AS grams, CAST(absent AS BIGINT) AS absent FROM chi")
def chi2_statistic(spark, sf):
    return statistics.chi_square(statistics.paired(_frequencies(spark, sf))).select("kx", "ky", F.round("statistic", 6).alias("statistic"), "grams", "absent")


@query("top_differences", f"{_TOP} SELECT kx, ky, gram, round(diff, 9) AS diff, rank, CASE WHEN diff > 0 THEN kx ELSE ky END AS label FROM t WHERE rank <= 25")
def top_differences(spark, sf):
    """For labels that differ significantly, the 25 n-grams whose frequencies differ most, with the label that has more: a top-k report."""
    return _top(spark, sf).select("kx", "ky", "gram", F.round("diff", R).alias("diff"), "rank", F.when(F.col("diff") > 0, F.col("kx")).otherwise(F.col("ky")).alias("label"))


@query(
    "pattern_positions",
    f"""{_TOP}, d AS (SELECT DISTINCT gram, CASE WHEN diff > 0 THEN kx ELSE ky END AS label FROM t WHERE rank <= 25),
o AS (SELECT rec, label, level, unnest(gs) AS gram, generate_subscripts(gs, 1) - 1 AS pos FROM ({" UNION ALL ".join(f"SELECT rec, label, level, {GRAMS.format(s='w', n=n, sep=' ')} AS gs FROM strings" for n in range(1, LONGEST + 1))}))
SELECT rec, label, level, gram, CAST(pos AS BIGINT) AS pos FROM o JOIN d USING (label, gram)""",
)
def pattern_positions(spark, sf):
    """Where the most different n-grams stand in the strings of the label that has more of them."""
    top = _top(spark, sf).select("gram", F.when(F.col("diff") > 0, F.col("kx")).otherwise(F.col("ky")).alias("label")).distinct()  # 25 rows a pair of labels
    at = placed_grams(spark, sf).select("rec", "label", "level", F.col("pos").cast("long").alias("pos"), F.explode("grams").alias("gram"))
    return at.join(F.broadcast(top), ["label", "gram"]).select("rec", "label", "level", "gram", "pos")


@query("file_groups", "WITH o AS (SELECT doc_id, source, CASE WHEN source IS NOT DISTINCT FROM lag(source) OVER (ORDER BY doc_id) AND row_number() OVER (ORDER BY doc_id) > 1 THEN 0 ELSE 1 END AS fresh FROM documents), g AS (SELECT doc_id, source, sum(fresh) OVER (ORDER BY doc_id) - 1 AS grp FROM o) SELECT CAST(grp AS BIGINT) AS grp, any_value(source) AS source, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM g GROUP BY grp")
def file_groups(spark, sf):
    """Neighbouring documents of one source, the last group included."""
    g = consecutive(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", "grp")
    return g.groupBy("grp").agg(F.min("source").alias("source"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))


@query("files_in_both", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de'")
def files_in_both(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter("lang = 'en'").select("source").intersect(d.filter("lang = 'de'").select("source"))


@query("not_found", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def not_found(spark, sf):
    return table(spark, sf, "documents").select("doc_id").distinct().join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("posting_union", "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id FROM labels WHERE quality = 0)")
def posting_union(spark, sf):
    la = table(spark, sf, "labels")
    return la.filter("toxic = 1").select("doc_id").union(la.filter("quality = 0").select("doc_id")).distinct()


@query("bag_union", "SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang AS k, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT source, count(*) FROM documents GROUP BY source) GROUP BY k")
def bag_union(spark, sf):
    d = table(spark, sf, "documents")
    counts = d.groupBy(F.col("lang").alias("k")).agg(F.count("*").alias("n")).unionByName(d.groupBy(F.col("source").alias("k")).agg(F.count("*").alias("n")))
    return counts.groupBy("k").agg(F.sum("n").alias("n"))


@query("support_limits", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE r <= 25 AND n >= 10")
def support_limits(spark, sf):
    """The first 25 instances of each source that has ten at least; the cap on instances is the feature."""
    d = table(spark, sf, "documents").select("source", "doc_id")
    first = d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("r <= 25")
    return first.join(d.groupBy("source").agg(F.count("*").alias("n")).filter("n >= 10"), "source").select("source", "doc_id")


@query("frame_positions", "SELECT doc_id, CAST(floor((n_chars - 512) / 128.0) AS BIGINT) AS frame, CAST(floor((n_chars - 512) / 128.0) AS BIGINT) * 128 + 512 AS sample, (n_chars // 3600) || ':' || (n_chars % 3600 // 60) || ':' || (n_chars % 60) AS clock FROM documents")
def frame_positions(spark, sf):
    d = table(spark, sf, "documents")
    frame = fs.sample_to_frame(F.col("n_chars"))
    return d.select("doc_id", frame.alias("frame"), fs.frame_to_sample(frame).alias("sample"), fs.clock(F.col("n_chars"), 1).alias("clock"))


@query("url_paths", "SELECT page_id, split_part(split_part(url, '?', 1), '/', -1) AS last, regexp_replace(split_part(split_part(url, '?', 1), '/', -1), '[^a-zA-Z0-9_ ]+', '', 'g') AS clean FROM pages")
def url_paths(spark, sf):
    """Last part of a path and its cleaned name."""
    last = F.element_at(F.split(F.element_at(F.split("url", r"\?"), 1), "/"), -1)
    return table(spark, sf, "pages").select("page_id", last.alias("last"), F.regexp_replace(last, "[^a-zA-Z0-9_ ]+", "").alias("clean"))


@query("role_sequences", "WITH r AS (SELECT conv_id, string_agg(left(role, 1), '' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT roles, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY roles")
def role_sequences(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.left("role", F.lit(1)).alias("role"))))
    r = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(turns["role"], "").alias("roles"))
    return r.groupBy("roles").agg(F.count("*").alias("n"))


@query("rank_quantile", "SELECT doc_id, n_chars FROM documents WHERE n_chars > (SELECT n_chars FROM documents ORDER BY n_chars LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.01) AS BIGINT) FROM documents))")
def rank_quantile(spark, sf):
    """Rows above the value at rank floor(n / 100)."""
    from seqloom.sources.tables import likely

    return likely(table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("ll"))).select("doc_id", F.col("ll").alias("n_chars"))


@query(
    "levenshtein_bound",
    "WITH r AS (SELECT conv_id, string_agg(left(role, 1), '' ORDER BY turn) AS x FROM conversations GROUP BY conv_id) SELECT a.conv_id AS q, b.conv_id AS s, CAST(CAST(left(a.x, 1) <> left(b.x, 1) AS INT) + levenshtein(substr(a.x, 2), substr(b.x, 2)) AS BIGINT) AS bound FROM r a JOIN r b ON abs(length(a.x) - length(b.x)) < 5 WHERE a.conv_id % 50 = 0",
)
def levenshtein_bound(spark, sf):
    """A lower bound of the anchored edit distance from the built-in one, for role sequences of like length."""
    from seqloom.operators.pairs import against

    turns = F.array_sort(F.collect_list(F.struct("turn", F.left("role", F.lit(1)).alias("role"))))
    r = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(turns["role"], "").alias("x")).withColumn("n", F.length("x"))
    p = against(queries_of(r, "conv_id"), r, "conv_id", "n", 5)
    tail = lambda c: F.expr(f"substring({c}, 2)")
    bound = (F.left("q_x", F.lit(1)) != F.left("s_x", F.lit(1))).cast("long") + F.levenshtein(tail("q_x"), tail("s_x"))
    return p.select(F.col("q_conv_id").alias("q"), F.col("s_conv_id").alias("s"), bound.cast("long").alias("bound"))
