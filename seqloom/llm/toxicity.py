"""Toxicity by a lexicon that Levenshtein automata search, with scores from the context of each hit.

A lexicon of words and stems is learned from a bounded sample of labelled rows.
Its trie, intersected with the automata of all strings one edit away, becomes one
deterministic automaton that runs over all words of a batch at once. A hit counts
for as much as such hits (same term, or same form one edit away from it; quoted or
not) told in the sample, shifted by the words around it, and a text is judged by its plainest hit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.language import held_out
from seqloom.llm.text_arrays import LONG_WORD, mix, runs
from seqloom.storage import remove, store

#: About so many labelled rows are sampled to learn from.
SAMPLE_ROWS = 20_000
#: Lengths of stems; words from FUZZY characters on also match one edit away, shorter ones only as they are.
STEMS = (4, 5, 6)
FUZZY = 5
#: A term is learned if it stands in toxic rows at least so far (in standard deviations) beyond chance, in so many
#: families of texts (those with the same smallest word hash are one, as near copies mostly are), and if so large a part of its rows is toxic.
#: Nothing else bounds the lexicon than that each term takes that many rows of the sample.
BEYOND, FAMILIES, PURITY = 4.5, 6, 0.8
#: Words on each side of a hit that shift its score, and the buckets their hashes go to.
WINDOW, BUCKETS = 4, 1 << 12
#: Rows of the average toxic share that are added to a kind of hit's own: few rows prove little, and quoted hits,
#: a kind of their own, are taken for harmless until seen otherwise. A quoted hit one edit away loses QUOTE_SHIFT.
DOUBT, QUOTE_SHIFT = 8.0, 2.0
#: Context words that are added to those seen around toxic and around harmless hits, dealt over buckets like all context: a kind
#: of hit whose context was hardly seen shifts little.
CONTEXT_DOUBT = 1_000.0
#: A hit between quotation marks this many characters apart at most, on each side, is quoted.
QUOTED = 80

_QUOTES = np.array(sorted(map(ord, "\"«»“”„")), np.uint32)
_ALNUM: np.ndarray | None = None


def _word_chars() -> np.ndarray:
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _ALNUM


class Words:
    """The words (runs of letters and digits, lower-cased) of a run of texts as code-point arrays."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        texts = [buf[a:z].tobytes().decode().lower() for a, z in zip(offs[:-1], offs[1:], strict=True)]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])  # a gap after each text
        self.code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        inside = _word_chars()[self.code]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.rows = len(texts)

    def hashes(self) -> np.ndarray:
        n = self.end - self.start
        h = np.full(len(n), np.uint64(0xCBF29CE484222325))
        live = np.flatnonzero(n <= LONG_WORD)
        for i in range(LONG_WORD):
            live = live[n[live] > i]
            if not len(live):
                break
            h[live] = (h[live] ^ self.code[self.start[live] + i]) * np.uint64(0x100000001B3)
        for i in np.flatnonzero(n > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.code[self.start[i] : self.end[i]].tobytes())
        return mix(h)

    def text(self, i: int) -> str:
        return self.code[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")

    def quoted(self, at: np.ndarray) -> np.ndarray:
        marks = np.flatnonzero(np.isin(self.code, _QUOTES))
        if not len(marks) or not len(at):
            return np.zeros(len(at), bool)
        after = np.searchsorted(marks, self.start[at])
        left = np.where(after > 0, self.start[at] - marks[np.maximum(after - 1, 0)], QUOTED + 1)
        right = np.where(after < len(marks), marks[np.minimum(after, len(marks) - 1)] - self.end[at], QUOTED + 1)
        lines = np.concatenate([[0], np.cumsum(self.code == 10)])
        near = (left <= QUOTED) & (right <= QUOTED)
        same = lines[np.minimum(self.end[at] + np.minimum(right, QUOTED), len(self.code))] == lines[np.maximum(self.start[at] - np.minimum(left, QUOTED), 0)]
        return near & same

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, bucket) of the words within WINDOW words of each hit, in its own text."""
        steps = np.array([d for d in range(-WINDOW, WINDOW + 1) if d])
        near = at[:, None] + steps
        ok = (near >= 0) & (near < len(self.start))
        ok &= self.row[np.clip(near, 0, max(0, len(self.row) - 1))] == self.row[at][:, None] if len(at) else ok
        hit = np.broadcast_to(np.arange(len(at))[:, None], near.shape)[ok]
        return hit, (self.hashes()[near[ok]] & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # matches any word that begins with it


class TermAutomaton:
    """The lexicon's trie intersected with one-edit Levenshtein automata, made deterministic."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        child: list[dict[str, int]] = [{}]
        ends: list[tuple[int, bool] | None] = [None]  # term that ends here; stems win
        near = [False]  # a word that allows an edit goes through here
        for i, t in enumerate(terms):
            node, fuzzy = 0, not t.stem and len(t.text) >= FUZZY
            near[0] |= fuzzy
            for c in t.text:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({}), ends.append(None), near.append(False)
                node = child[node][c]
                near[node] |= fuzzy
            if ends[node] is None or t.stem:
                ends[node] = (i, t.stem)
        letters = sorted({c for t in terms for c in t.text})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)

        def closed(states: set) -> frozenset:
            out, todo = set(states), list(states)
            while todo:
                node, edits = todo.pop()
                if edits == 0:  # a letter of the term left out
                    for nxt in child[node].values():
                        if near[nxt] and (nxt, 1) not in out:
                            out.add((nxt, 1))
                            todo.append((nxt, 1))
            return frozenset((n, e) for n, e in out if e == 0 or (n, 0) not in out)

        def step(states: frozenset, c: str | None) -> frozenset:
            out = set()
            for node, edits in states:
                nxt = child[node].get(c) if c else None
                if nxt is not None and (edits == 0 or near[nxt]):
                    out.add((nxt, edits))
                if edits == 0 and near[node]:
                    out.add((node, 1))  # a letter too many
                    out.update((n, 1) for n in child[node].values() if near[n])  # another letter
            return closed(out)

        start = closed({(0, 0)})
        number, todo = {frozenset(): 0, start: 1}, [start]
        table: list[list[int]] = [[0] * (len(letters) + 1), []]
        accept, done = [-1, -1], [-1, -1]  # term * 2 + edits at the end of the word; stem reached on the way
        while todo:
            states = todo.pop(0)
            row = []
            for c in [None, *letters]:
                nxt = step(states, c)
                if nxt not in number:
                    number[nxt] = len(number)
                    table.append([]), accept.append(-1), done.append(-1)
                    todo.append(nxt)
                row.append(number[nxt])
            i = number[states]
            table[i] = row
            found = [(e, *ends[n]) for n, e in states if ends[n]]
            stems = [t for e, t, stem in found if stem and e == 0]
            whole = [(e, t) for e, t, stem in found if not stem and (e == 0 or len(terms[t].text) >= FUZZY)]
            if stems:
                done[i] = stems[0] * 2
            if whole:
                e, t = min(whole)
                accept[i] = t * 2 + e
        self.table, self.accept, self.done = np.array(table, np.int32), np.array(accept), np.array(done)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term * 2 + edits) of the words that match."""
        letter = self.letter[w.code]
        n = w.end - w.start
        live, state = np.arange(len(n)), np.ones(len(n), np.int32)
        words, kinds = [], []
        i = 0
        while len(live):  # a word that no term is near to dies within the length of the longest term
            ended = n[live] == i
            kind = np.where(ended, self.accept[state], -1)
            kind = np.where(self.done[state] >= 0, self.done[state], kind)
            got = kind >= 0
            words.append(live[got]), kinds.append(kind[got])
            go = ~ended & ~got & (state > 0)
            live, state = live[go], state[go]
            state = self.table[state, letter[w.start[live] + i]]
            i += 1
        if not words:
            return live, np.zeros(0, np.int64)
        words, kinds = np.concatenate(words), np.concatenate(kinds)
        order = np.argsort(words, kind="stable")
        return words[order], kinds[order]


@dataclass(frozen=True)
class ToxicityModel:
    automaton: TermAutomaton | None
    hit_logit: np.ndarray  # of exact hits: term * 2 + quoted
    forms: np.ndarray  # hashes of words known to be one edit away, sorted
    form_logit: np.ndarray  # of each, and last of any other
    context: np.ndarray  # shift of each bucket of words near a hit
    without: float  # toxic share of texts without a hit


def _terms_of(w: Words, toxic: np.ndarray) -> dict:
    """(term, family) -> [toxic rows, clean rows], where clean rows have no family; words are marked by a trailing blank."""
    found: dict[tuple[str, int | None], list[int]] = {}
    h = w.hashes().view(np.int64)
    lo = np.searchsorted(w.row, np.arange(w.rows))
    hi = np.searchsorted(w.row, np.arange(w.rows), "right")
    for r in range(w.rows):
        seen: set[str] = set()
        for i in range(lo[r], hi[r]):
            t = w.text(i)
            seen.update((t + " ", *(t[:k] for k in STEMS if k < len(t))))
        family = int(h[lo[r] : hi[r]].min()) if toxic[r] and hi[r] > lo[r] else None
        for key in seen:
            found.setdefault((key, family), [0, 0])[1 - int(toxic[r])] += 1
    return found


def learn_lexicon(sample: DataFrame, toxic_share: float) -> list[Term]:
    """Terms of the sample (text, toxic) that pass BEYOND, FAMILIES and PURITY, most frequent first."""

    def count(batches):
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in runs(b.column("text")):
                found = _terms_of(Words(buf, offs), toxic[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), *(pa.array([e[k] for e in found.values()], pa.int64()) for k in range(2))], names=["term", "family", "toxic", "clean"])

    counts = sample.mapInArrow(count, "term string, family long, toxic long, clean long").groupBy("term", "family").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("family").alias("families"))
    rows = F.col("toxic") + F.col("clean")
    expected = rows * float(toxic_share)
    far = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    # the sample's size bounds what is collected
    kept = counts.filter((far >= BEYOND) & (F.col("families") >= FAMILIES) & (F.col("toxic") / rows >= PURITY)).collect()
    toxic = {r.term: r.toxic for r in kept}
    words = [t for t in toxic if t.endswith(" ")]
    best: dict[str, str] = {}  # the most frequent word that begins with each stem
    for w in sorted(words, key=lambda w: (toxic[w], w)):
        best |= {w[:k]: w for k in STEMS if k < len(w)}
    stems: set[str] = set()
    chosen: set[Term] = set()
    for stem in sorted((t for t in toxic if not t.endswith(" ")), key=lambda t: (len(t), t)):
        if any(stem[:k] in stems for k in STEMS):
            continue
        # a stem that stands for one word nearly always is that word
        if stem in best and toxic[best[stem]] >= 0.9 * toxic[stem]:
            chosen.add(Term(best[stem].strip(), False))
        else:
            stems.add(stem)
            chosen.add(Term(stem, True))
    chosen |= {Term(w.strip(), False) for w in words if not any(w.strip()[:k] in stems for k in STEMS)}
    return sorted(chosen, key=lambda t: (-toxic.get(t.text if t.stem else t.text + " ", 0), t.text))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from about ``sample_rows`` labelled rows, chosen by a hash of the id. Null labels teach nothing; null texts are empty."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    # about sample_rows rows at most, whatever the input
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = store(texts.join(F.broadcast(known), "_id").select("text", F.col("toxic") == 1).toDF("text", "toxic").repartition(24), "labelled")
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    share = toxic / total if total else 0.0
    terms = learn_lexicon(sample, share) if toxic else []
    if not terms:
        remove(sample)
        return ToxicityModel(None, np.zeros(0), np.zeros(0, np.uint64), np.zeros(1), np.zeros(BUCKETS), share)
    automaton = TermAutomaton(terms)

    def tally(batches):
        kinds, context, clear = np.zeros((2, 2 * len(terms)), np.int64), np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        forms: dict[int, list[int]] = {}
        for b in batches:
            label = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, buf, offs in runs(b.column("text")):
                w = Words(buf, offs)
                at, kind = automaton.hits(w)
                row, exact = w.row[at], kind % 2 == 0
                pairs = np.unique(np.stack([row, kind // 2 * 2 + w.quoted(at)], 1)[exact], axis=0)  # a row counts once for a kind of hit
                np.add.at(kinds, (label[lo:hi][pairs[:, 0]], pairs[:, 1]), 1)
                for r, h in set(zip(row[~exact].tolist(), w.hashes()[at[~exact]].tolist(), strict=True)):
                    forms.setdefault(h, [0, 0])[int(label[lo + r])] += 1
                hit, bucket = w.windows(at[exact])
                np.add.at(context, (label[lo:hi][row[exact][hit]], bucket), 1)
                without = np.ones(hi - lo, bool)
                without[row[exact]] = False
                clear += np.bincount(label[lo:hi][without], minlength=2)
        seen = np.array([(h - (1 << 64) if h >> 63 else h, *n) for h, n in forms.items()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]) for a in (kinds, context, clear, seen)], names=["kinds", "context", "clear", "forms"])

    got = sample.mapInArrow(tally, "kinds binary, context binary, clear binary, forms binary").collect()  # one row a task of a bounded sample
    kinds, context, clear = (sum(np.frombuffer(r[k], np.int64) for r in got) for k in range(3))
    remove(sample)
    kinds, context = kinds.reshape(2, -1).astype(float), context.reshape(2, -1).astype(float)
    own = (kinds[1] + DOUBT * share) / (kinds.sum(0) + DOUBT)
    seen: dict[int, np.ndarray] = {}
    for r in got:
        for h, clean, bad in np.frombuffer(r.forms, np.int64).reshape(-1, 3):
            seen[int(h) % (1 << 64)] = seen.get(int(h) % (1 << 64), 0) + np.array([clean, bad], float)
    forms = np.array(sorted(seen), np.uint64)
    n = np.array([seen[h] for h in sorted(seen)]).reshape(-1, 2)
    once = n[n.sum(1) == 1].sum(0)
    fresh = (once[1] + share) / (once.sum() + 1)  # a form never seen tells what the forms seen once told
    known = (n[:, 1] + 2 * fresh) / (n.sum(1) + 2)
    usual = context.sum(0) / max(context.sum(), 1)
    rate = (context + CONTEXT_DOUBT * usual) / (context.sum(1, keepdims=True) + CONTEXT_DOUBT)
    shift = np.clip(np.log(np.where(usual > 0, rate[1], 1) / np.where(usual > 0, rate[0], 1)), -2, 2)
    return ToxicityModel(automaton, _logit(own), forms, _logit(np.append(known, fresh)), shift, (clear[1] + 0.5) / (clear.sum() + 1))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def score(model: ToxicityModel, texts: pa.Array) -> np.ndarray:
    """Probability that each text is toxic: that of its plainest hit and of the toxic share among texts without a hit, either being enough."""
    out = np.full(len(texts), model.without)
    if model.automaton is None:
        return out
    for lo, hi, buf, offs in runs(texts):
        w = Words(buf, offs)
        at, kind = model.automaton.hits(w)
        if not len(at):
            continue
        quoted, fuzzy = w.quoted(at), kind % 2 == 1
        logit = model.hit_logit[kind // 2 * 2 + quoted]
        h = w.hashes()[at[fuzzy]]
        place = np.searchsorted(model.forms, h)
        same = place < len(model.forms)
        same[same] = model.forms[place[same]] == h[same]
        form = np.minimum(model.form_logit[np.where(same, place, -1)], model.hit_logit[kind[fuzzy] // 2 * 2] - 1)  # an edit proves less than the term itself
        logit[fuzzy] = form - QUOTE_SHIFT * quoted[fuzzy]
        hit, bucket = w.windows(at)
        near = np.bincount(hit, minlength=len(at))
        logit += np.bincount(hit, model.context[bucket], len(at)) / np.maximum(near, 1)
        most = np.full(hi - lo, -np.inf)
        np.maximum.at(most, w.row[at], logit)
        out[lo:hi] = 1 - (1 - model.without) / (1 + np.exp(most))
    return out


def toxicity(text: Column, model: ToxicityModel, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.clip(score(shared.value, texts), 0.0, 1.0))

    return scored(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every row, learning only from labelled rows that aren't held out.

    Null text counts as empty and, like any text without a hit, scores the share
    of toxic rows among such texts; without labels the score is 0. Repeated rows
    repeat; other columns are ignored; an empty table stays empty.
    """
    model = fit(docs, labels.filter(~held_out(id_col)), id_col, text_col, label_col)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), toxicity(F.coalesce(F.col(text_col), F.lit("")), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
