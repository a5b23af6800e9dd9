"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of 64-bit hashes of its word shingles; since these are
random numbers, the smallest of them are a sample of the set (its sketch). Equal
sets become one class. A class retains the RETAINED smallest values; inverted
lists hold, under a retained value, the classes that retain it. Two classes that
are to link overlap in so many retained values (see overlap) that they meet in a
list of one of their rarest ones already, so that only those lists are made: a
passage that many documents share makes no list where documents have enough of
their own. Classes that meet are compared by their union sketch, and those that
pass by exact Jaccard similarity on full sets.

No list is expanded into all its pairs. First every class is compared with the
smallest class of its lists only (a star). Lists whose members then lie in one
component are done; in the others, classes of different components are compared
block by block, and the largest component of a list never with itself. What a
comparison passes is confirmed in one task too, as its pairs can be as many as
the square of a group's size: only links that join components leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import connected_components
from seqloom.llm.groups import attach, batches_of
from seqloom.llm.text_arrays import mix, runs, shingles, word_hashes, words
from seqloom.storage import remove, store

#: Values that a set retains for the inverted lists, and the chance that a pair at the threshold overlaps in fewer than its lists take for granted.
RETAINED, MISS = 32, 1e-7
#: Hashes in a sketch (their upper 32 bits). Sets that fit are compared exactly, others pass with a margin of 5.9 standard deviations or more.
SKETCH, MARGIN = 384, 0.12
#: Classes of a list that are compared with as many others in one task.
BLOCK = 2_000
#: Pairs with their sets that go to a worker at once.
WIDE_ROWS = 500
#: Rows and sketch values that a comparison holds as a matrix at once.
ROWS, COLUMNS = 512, 1024
#: Pairs whose lists are compared at once.
PAIRS = 4_096
#: Bits of the filter that keeps texts without a partner out of the shuffle; a full filter only lets more texts through.
FILTER_BITS = 1 << 23


def _sets(batches, size: int):
    """(batch, first row, sets of its rows) for runs of texts."""
    for b in batches:
        for lo, hi, buf, offs in runs(b.column("text")):
            first, end, row = words(buf, offs)
            yield b, lo, hi, shingles(word_hashes(buf, first, end), row, hi - lo, size)


def overlap(percent: int) -> int:
    """Retained values that two large sets at the threshold have in common, but for a chance of MISS.

    The RETAINED smallest values of the union are a sample of it without
    replacement, and both sets retain what the sample holds of their intersection;
    with replacement (binomial) fewer would be in common.
    """
    p, below, c = percent / 100, 0.0, 0
    while c < RETAINED:
        below += math.comb(RETAINED, c) * p**c * (1 - p) ** (RETAINED - c)
        if below > MISS:
            break
        c += 1
    return max(c, 1)


def rarest(n: Column, percent: int) -> Column:
    """How many of its rarest retained values a set of n shingles is listed under: two sets with c values in common share one that is not among the c - 1 most frequent of either.

    A set so small that its partners retain all their values needs no chance: it
    shares ``percent`` of its own values with each.
    """
    whole = n * 100 <= RETAINED * percent
    common = F.when(whole, F.ceil(n * percent / 100)).otherwise(F.lit(overlap(percent)))
    return (F.least(n, F.lit(RETAINED)) - common + 1).cast("int")


def text_mark(text: Column) -> Column:
    """SHA-256 of a text as it stands, which tells rows of one id, or of none, apart."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def shingled(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (of the text), n (set size), sig (equal for equal sets) and kept (retained values) of every row."""

    def make(batches):
        for b, lo, hi, sets in _sets(batches, size):
            sig = [np.array([len(s), np.sum(s, dtype=np.uint64), np.sum(mix(s), dtype=np.uint64)], np.uint64).tobytes() for s in sets]
            keys = [s[:RETAINED].view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, keys)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("mark").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), flat], names=["doc_id", "mark", "n", "sig", "kept"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_mark(F.col(text_col)).alias("mark"))
    return texts.mapInArrow(make, "doc_id long, mark binary, n long, sig binary, kept array<long>")


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """key (a retained value), doc (a class's node), leader (the list's smallest doc) of the lists of two classes or more.

    A class stands under its rarest retained values; values that no other class
    retains are the rarest of all and make no list.
    """
    # the values that a class need not be listed under are its most frequent ones, so they are counted from that end
    values = classes.select("node", (F.size("kept") - rarest(F.col("n"), percent)).alias("spare"), F.explode("kept").alias("key"))
    often = store(values.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    ranked = attach(values, often, "key", "often", classes.count(), "inner").groupBy("node", "spare").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("found"))  # RETAINED values a class at most
    first = F.slice("found", F.lit(1), F.greatest(F.size("found") - F.col("spare"), F.lit(0)))
    lists = store(ranked.select(F.col("node").alias("doc"), F.explode(first).alias("value")).select("doc", F.col("value.key").alias("key")), "lists")
    leaders = store(lists.groupBy("key").agg(F.min("doc").alias("leader"), F.count("*").alias("size")).filter("size > 1"), "leaders")
    out = store(attach(lists, leaders, "key", "size", lists.count(), "inner").select("key", "doc", "leader"), "stars")
    remove(often, lists, leaders)
    return out


def _some_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node and text of the rows of ``docs`` (doc_id, text) that ``ids`` (doc, mark, node) names: a fixed-size filter on ids first, then a join; one text a node."""
    seeds = (1, 2, 3)

    def bits(batches):
        field = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            for s in seeds:
                at = (mix(b.column("doc").to_numpy().view(np.uint64) + np.uint64(s)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([field.tobytes()], pa.binary())], names=["bits"])

    parts = ids.repartition(8).mapInArrow(bits, "bits binary").collect()  # 8 fields of a megabyte
    field = np.bitwise_or.reduce([np.frombuffer(p.bits, np.uint8) for p in parts]) if parts else np.zeros(FILTER_BITS // 8, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("boolean")
    def perhaps(doc: pa.Array) -> pa.Array:
        d = doc.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        ok = np.ones(len(d), bool)
        for s in seeds:
            at = (mix(d + np.uint64(s)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            ok &= (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return pa.array(ok)

    marked = docs.filter(perhaps("doc_id")).withColumn("_mark", text_mark(F.col("text")))
    kept = marked.join(ids.hint("shuffle_hash"), (F.col("doc_id") == F.col("doc")) & (F.col("_mark") == F.col("mark")))
    return kept.groupBy("doc", "mark").agg(F.min("node").alias("node"), F.min("text").alias("text")).select("node", "text")


def _full_sets(texts: DataFrame, size: int) -> DataFrame:
    """doc (the class), n, sketch and full set of texts (node, text)."""

    def make(batches):
        for b, lo, hi, sets in _sets(batches, size):
            sketch = [(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "n", "sketch", "full"])

    return texts.mapInArrow(make, "doc long, n long, sketch binary, full binary")


def union_estimate(shared, upto_a, upto_b):
    """Similarity from the values of either sketch up to the smaller one's end; exact where both hold their whole sets."""
    return shared / np.maximum(upto_a + upto_b - shared, 1)


def _may_link(percent: int, shared, upto_a, upto_b, n_a, n_b):
    exact = (n_a <= SKETCH) & (n_b <= SKETCH)
    near = np.where(exact, 100 * shared >= percent * (upto_a + upto_b - shared), union_estimate(shared, upto_a, upto_b) >= percent / 100 - MARGIN)
    return near & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def _end(sketch: np.ndarray, n) -> float:
    return float(sketch[-1]) if n > SKETCH else np.inf


def _star_filter(percent: int):
    def keep(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            n_a, n_b = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            for i, (x, y) in enumerate(zip(b.column("sketch_a"), b.column("sketch_b"), strict=True)):
                if 100 * min(n_a[i], n_b[i]) < percent * max(n_a[i], n_b[i]):
                    continue
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                end = min(_end(x, n_a[i]), _end(y, n_b[i]))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                ok[i] = _may_link(percent, int((x[at] == y).sum()), np.searchsorted(x, end, "right"), np.searchsorted(y, end, "right"), n_a[i], n_b[i])
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    return keep


def _exact_filter(percent: int):
    def keep(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("full_a"), b.column("full_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    return keep


def _with_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    for end in ("a", "b"):
        side = sets.select(F.col("doc").alias(f"_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(side, F.col(end) == F.col(f"_{end}")).drop(f"_{end}")
    return pairs


def _cross(percent: int):
    def compare(table: pa.Table) -> pa.Table:
        """One list, or two blocks of one: the docs of pairs of different components that pass the union sketch, each with its partners in ``others``.

        A pair passes in the first list that it shares, and stands with one of its docs.
        """
        listed = [np.asarray(k, np.int64) for k in table["keys"].to_pylist()]
        keys = np.full((len(listed), max(map(len, listed))), np.iinfo(np.int64).max)
        for i, k in enumerate(listed):
            keys[i, : len(k)] = k
        doc, comp, n, block = (table[c].to_numpy() for c in ("doc", "comp", "n", "block"))
        sketch = [np.frombuffer(s, np.uint32) for s in table["sketch"].to_pylist()]
        a, z = (np.flatnonzero(block == table[c][0].as_py()) for c in ("one", "two"))
        same = table["one"][0].as_py() == table["two"][0].as_py()
        if same:  # the largest component, which may be among them, has nothing to compare in itself
            found, times = np.unique(comp[a], return_counts=True)
            bulk = comp == found[times.argmax()]
            a = a[~bulk[a]]
        sizes = np.array([len(s) for s in sketch])
        ends = np.array([_end(s, k) for s, k in zip(sketch, n, strict=True)])
        value, column, count = np.unique(np.concatenate(sketch), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        row, column = np.repeat(np.arange(len(doc)), sizes), column.ravel()
        shown = count[column] > 1
        row, column = row[shown], place[column[shown]]
        by_column = np.argsort(column, kind="stable")
        row, column = row[by_column], column[by_column]
        width = int(column[-1]) + 1 if len(column) else 0
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(a), ROWS):
            some = a[lo : lo + ROWS]
            shared = np.zeros((len(some), len(z)), np.float32)
            for c in range(0, width, COLUMNS):
                part = slice(*np.searchsorted(column, [c, c + COLUMNS]))
                hold = np.zeros((len(doc), min(COLUMNS, width - c)), np.float32)
                hold[row[part], column[part] - c] = 1
                shared += hold[some] @ hold[z].T
            upto_a = np.stack([np.searchsorted(sketch[i], ends[z], "right") for i in some])
            upto_b = np.stack([np.searchsorted(sketch[j], ends[some], "right") for j in z], 1)
            ok = _may_link(percent, shared, upto_a, upto_b, n[some][:, None], n[z]) & (comp[some][:, None] != comp[z])
            if same:
                ok &= bulk[z] | (doc[some][:, None] < doc[z])
            i, j = np.nonzero(ok)
            first = [np.where((keys[some[i[c]]][:, :, None] == keys[z[j[c]]][:, None, :]).any(2), keys[some[i[c]]], np.iinfo(np.int64).max).min(1) == table["key"][0].as_py() for c in (slice(k, k + PAIRS) for k in range(0, len(i), PAIRS))]
            i, j = (x[np.concatenate(first)] if first else x for x in (i, j))
            out_a.append(some[i]), out_b.append(z[j])
        x, y = np.concatenate(out_a), np.concatenate(out_b)
        y = y[np.argsort(x, kind="stable")]
        met = np.union1d(x, y)
        ends = np.searchsorted(np.sort(x), np.append(met, len(doc))).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(ends), pa.array(doc[y]))
        return pa.table({**{c: table[c].take(pa.array(met)) for c in ("key", "one", "two", "doc", "comp")}, "others": others})

    return compare


def _confirm(percent: int):
    def confirm(table: pa.Table) -> pa.Table:
        """Links, on full sets, of what one comparison passed: of those between two components, however many, as few as join them."""
        doc, comp = table["doc"].to_pylist(), table["comp"].to_pylist()
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["full"]]
        place, above, out = {d: i for i, d in enumerate(doc)}, {}, []

        def top(c: int) -> int:
            while c in above:
                above[c] = c = above.get(above[c], above[c])
            return c

        for i, others in enumerate(table["others"]):
            for d in others.as_py():
                j = place[d]
                one, two = top(comp[i]), top(comp[j])
                if one == two:
                    continue
                x, y = full[i], full[j]
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    above[one] = two
                    out.append((min(doc[i], d), max(doc[i], d)))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return confirm


def _dealt(members: DataFrame) -> DataFrame:
    """key, doc, comp, block, one and two: members (key, doc, comp) of lists of several components, once for each pair of blocks to be compared.

    The largest component of a list has blocks of its own (below 0) that meet the
    others' blocks only, so that a large group of copies and a few strangers in
    its lists are as many comparisons as the product of both. Where both are one
    block, they are one comparison, and every member goes there once.
    """
    kinds = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "comp"))
    lists = kinds.groupBy("key").agg(most.alias("most"), F.sum("n").alias("size"), F.count("*").alias("kinds")).filter("kinds > 1 AND size > 2")
    lists = store(lists.select("key", "size", F.col("most.comp").alias("bulk"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("bulks"), F.ceil((F.col("size") - F.col("most.n")) / BLOCK).cast("int").alias("others")), "open-lists")
    met = attach(members, lists, "key", "size", members.count(), "inner")
    of_bulk = (F.col("comp") == F.col("bulk")) & ((F.col("bulks") > 1) | (F.col("others") > 1))
    first = F.when(of_bulk | ((F.col("bulks") == 1) & (F.col("others") == 1)), F.lit(0)).otherwise(-F.col("bulks"))
    block = F.when(of_bulk, -1 - F.pmod(F.hash("doc"), F.col("bulks"))).otherwise(F.pmod(F.hash("doc"), F.col("others")))
    met = met.withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(first, F.col("others") - 1)))
    return met.select("key", "doc", "comp", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))


def _placed(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """doc_id, mark, n and component_id of every row. A class of equal sets is a node of its own, whatever ids its rows share with other classes."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = store(shingled(texts, size, "doc_id", "text"), "shingled")
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("least"), F.count("*").alias("times"), F.any_value("n").alias("n"), F.any_value("kept").alias("kept"))
    classes = classes.filter("least IS NOT NULL").select("sig", F.monotonically_increasing_id().alias("node"), F.col("least.doc_id").alias("doc"), F.col("least.mark").alias("mark"), "times", "n", "kept")
    classes = store(classes, "classes")
    stars = inverted_lists(classes, percent)
    listed = stars.select(F.col("doc").alias("node")).distinct()
    sets = store(_full_sets(_some_of(texts, classes.select("node", "doc", "mark").join(listed, "node", "left_semi")), size), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        return _with_both(pairs, sets, "full").mapInArrow(_exact_filter(percent), "a long, b long")

    met = stars.filter("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    passed = _with_both(met, sets, "n", "sketch").mapInArrow(_star_filter(percent), "a long, b long")
    with batches_of(docs.sparkSession, WIDE_ROWS):
        links = store(verified(passed), "star-links")
    comps = store(connected_components(links), "star-components")
    members = stars.select("key", "doc").join(comps, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    members = store(members, "members")
    listed = sets.select("doc", "n", "sketch").join(members.groupBy("doc").agg(F.collect_list("key").alias("keys")), "doc")  # RETAINED keys at most
    crossed = _dealt(members).join(listed, "doc").groupBy("key", "one", "two").applyInArrow(_cross(percent), "key long, one int, two int, doc long, comp long, others array<long>")
    # pairs stay inside their comparison: a row is a doc there, and its full set comes once for all its pairs
    crossed = store(crossed, "crossed")
    more = store(crossed.join(sets.select("doc", "full"), "doc").groupBy("key", "one", "two").applyInArrow(_confirm(percent), "a long, b long"), "cross-links")
    remove(crossed)
    comps = store(connected_components(links.unionByName(more)), "components")
    # a component takes the smallest id of its classes; large ones are kept out of the shuffle
    named = comps.join(classes.select("node", "doc"), "node")
    least = store(named.groupBy("component").agg(F.min("doc").alias("least"), F.count("*").alias("members")), "least")
    joined = classes.select("sig", "times", "node", "doc").join(comps, "node", "left").select("sig", "times", "doc", F.coalesce("component", "node").alias("component"))
    placed = attach(joined, least, "component", "members", classes.count()).select("sig", "times", F.coalesce("least", "doc").alias("component"))
    remove(stars, sets, members)
    own = rows.filter("n > 0").select("doc_id", "mark", "n", "sig")
    found = attach(own, store(placed, "placed"), "sig", "times", rows.count()).select("doc_id", "mark", "n", F.coalesce("component", "doc_id").alias("component_id"))
    return found.unionByName(rows.filter("n = 0").select("doc_id", "mark", "n", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    A set holds the distinct runs of ``size`` words (a shorter text: the whole of
    it as one), A-Z lower-cased; documents link if 100 * intersection >= ``percent``
    * union. A text without words, or null, has an empty set and links with
    nothing. Rows that share an id but not a set are judged each by its own set;
    rows that repeat the id that stays are all kept; rows without an id link with
    their copies only. Other columns are ignored; an empty table gives an empty result.
    """
    out = _placed(docs, id_col, text_col, size, percent)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near-duplicates keeps its smallest id, all columns as they are.

    Null texts and texts without words always stay. A row without an id goes if
    its set equals or is near one of a row with an id; rows that share the id that
    stays are judged each by its own text, and rows that repeat it stay. Very long
    texts count whole; an empty table stays empty.
    """
    gone = _placed(docs, id_col, text_col, size, percent).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("_sl_id"), F.col("mark").alias("_sl_mark")).distinct()
    marked = docs.withColumn("_sl_key", text_mark(F.col(text_col)))
    return marked.join(gone.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_sl_id")) & (F.col("_sl_key") == F.col("_sl_mark")), "left_anti").drop("_sl_key")
