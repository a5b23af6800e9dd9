"""Token counts by rank-synchronous array merging.

Pre-tokens stand one behind the other in a ragged array of symbols. Every round
finds each pre-token's lowest pair rank and merges all places of that pair at
once; a pre-token without a mergeable pair is done, and its count is the number
of symbols that survive. A worker merges each distinct word once.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.text_arrays import runs, word_hashes, words
from seqloom.llm.word_tokens import KNOWN_WORDS, RUN_BYTES, Grown, WordTable, odd_rows

_NONE = np.int64(1 << 40)

_counters: dict[str, "PairMerger"] = {}


def counter(path: str) -> "PairMerger":
    """This worker's merger for a tokenizer file."""
    if path not in _counters:
        _counters[path] = PairMerger(path)
    return _counters[path]


class PairMerger:
    """Counts tokens for a byte-level BPE file of the tokenizers library whose pieces never hold white space."""

    def __init__(self, path: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.piece = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        end = model["end_of_word_suffix"] or ""
        visible = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        chars = {}
        for b in range(256):  # the visible character of each byte, asked from the library
            raw = bytes([b]) if b < 128 else bytes([0xC2 + (b >> 6) - 2, b]) if b < 0xC0 else None
            if raw is not None:
                chars[b] = visible.pre_tokenize_str(raw.decode())[0][0][-1]
        for b in range(0xC0, 0x100):
            if (text := _text_with(b)) is not None:
                shown = visible.pre_tokenize_str(text)[0][0]
                chars[b] = shown[text.encode().index(b)]
        self.byte_of = {c: b for b, c in chars.items()}
        self.inner, self.last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for b, c in chars.items():
            self.inner[b], self.last[b] = vocab.get(c, -1), vocab.get(c + end, -1)
        self.size = len(vocab) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._reset()

    def _reset(self) -> None:
        self.table, self.counts = WordTable(), Grown(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each piece; no piece is empty.

        Merges of one rank run from left to right. Where one opens a pair of a
        lower rank beside it, the places behind it in its piece wait a round.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out, piece = np.ones(len(pieces), np.int64), np.flatnonzero(sizes > 1)
        n = sizes[piece]
        b = np.frombuffer(b"".join(pieces[i] for i in piece), np.uint8)
        s, end = self.inner[b], np.cumsum(n)
        s[end - 1] = self.last[b[end - 1]]
        r = np.full(len(s), _NONE)  # rank of each symbol with the next; the last of a piece has none
        r[:-1] = self.rank(s[:-1], s[1:])
        r[end - 1] = _NONE
        while len(piece):
            low = np.minimum.reduceat(r, end - n)
            if (low == _NONE).any():
                out[piece] = n
                go = low < _NONE
                stay = np.repeat(go, n)
                s, r, low, n, piece = s[stay], r[stay], low[go], n[go], piece[go]
                end = np.cumsum(n)
                if not len(piece):
                    break
            of = np.repeat(np.arange(len(n)), n)
            at = np.flatnonzero(r == low[of])
            # of places that overlap (a pair of equal symbols), every other one
            first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            rank, own = low[of[at]], of[at]
            new = self.result[rank]
            # what each merge sees as its neighbours when its turn comes: merged ones on its left only
            left = np.where(np.diff(at, prepend=-3) == 2, new, s[at - 1])
            right = s[np.minimum(at + 2, len(s) - 1)]
            opens = ((at > (end - n)[own]) & (self.rank(left, new) < rank)) | ((at + 2 < end[own]) & (self.rank(new, right) < rank))
            if opens.any():
                before = np.cumsum(opens) - opens
                keep = before == before[np.searchsorted(own, own)]
                at, new, own = at[keep], new[keep], own[keep]
            s[at] = new
            rest = np.ones(len(s), bool)
            rest[at + 1] = False
            s, r = s[rest], r[rest]
            n = n - np.bincount(own, minlength=len(n))
            end = np.cumsum(n)
            here = at - np.arange(len(at))
            for i, o in ((here, own), (here - 1, own)):
                inside = (i >= (end - n)[o]) & (i < end[o] - 1)
                r[i[inside]] = self.rank(s[i[inside]], s[i[inside] + 1])
            r[end - 1] = _NONE
        return out

    def _word_counts(self, found: list[str]) -> np.ndarray:
        """Tokens of words of plain characters."""
        split = [self.piece.findall(w.lower()) for w in found]
        n = np.fromiter(map(len, split), np.int64, len(split))
        pieces = [p.encode() for s in split for p in s]
        kinds = list(set(pieces))
        of = dict(zip(kinds, self.merge_counts(kinds), strict=True))
        each = np.fromiter((of[p] for p in pieces), np.int64, len(pieces))
        total = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(n)
        return total[ends] - total[ends - n]

    def text_count(self, text: str) -> int:
        """Tokens of any one text: special strings count one each, the library normalises and cuts the rest."""
        parts = re.split("|".join(map(re.escape, self.special)), text) if self.special else [text]
        pieces = []
        for part in parts:
            for shown, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                pieces.append(bytes(self.byte_of[c] for c in shown))
        return len(parts) - 1 + int(self.merge_counts(pieces).sum())

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        out = np.zeros(len(texts), np.int64)
        for lo, hi, buf, offs in runs(texts, RUN_BYTES):
            odd = odd_rows(buf, offs, np.zeros(len(buf), bool), [s.encode() for s in self.special])
            first, end, row = words(buf, offs)
            if odd.any():
                keep = ~odd[row]
                first, end, row = first[keep], end[keep], row[keep]
            h = word_hashes(buf, first, end, lower=False)
            new, one, back = np.unique(h, return_index=True, return_inverse=True)
            at, known = self.table.find(new)
            if not known.all():
                miss = np.flatnonzero(~known)
                if self.counts.n > KNOWN_WORDS:
                    self._reset()
                    miss = np.arange(len(new))
                n = self.counts.n
                self.counts.extend(self._word_counts([buf[first[i] : end[i]].tobytes().decode() for i in one[miss]]))
                self.table.add(new[miss], np.arange(n, n + len(miss)))
                at, _ = self.table.find(new)
            if len(row):
                out[lo:hi] = np.bincount(row, self.counts.a[at[back]], hi - lo)
            for i in np.flatnonzero(odd):
                out[lo + i] = self.text_count(buf[offs[i] : offs[i + 1]].tobytes().decode())
        return out


def _text_with(b: int) -> str | None:
    """A character whose UTF-8 bytes hold b, a leading byte."""
    for tail in (b"\x80", b"\xa0\x80", b"\x80\x80", b"\x90\x80\x80", b"\x80\x80\x80"):
        try:
            return (bytes([b]) + tail).decode()
        except UnicodeDecodeError:
            continue
    return None


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of each text by a byte-level BPE file of the tokenizers library."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).count(texts))

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    A null or empty text has 0 of both; repeated rows repeat; other columns of
    ``docs`` are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
