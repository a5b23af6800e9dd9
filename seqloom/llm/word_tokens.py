"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

Byte-level BPE cuts a text into pre-tokens before it merges, and no pre-token
reaches over the white space in front of a word. A text of plain characters
whose white space comes in runs of one or two is therefore the concatenation of
its items, an item being a white-space character (or the start of the text) with
the word that follows it, and a worker needs the library once for each distinct
item. Any other text goes to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from seqloom.llm.text_arrays import runs, word_hashes

#: Distinct words a worker remembers before it starts anew. It never changes a result.
KNOWN_WORDS = 1_000_000
#: Bytes of text handled at once, and new items that go to the library at once.
RUN_BYTES, NEW_ITEMS = 2 << 20, 8_192

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0D]] = True
# Bytes of visible ASCII, those four, and of UTF-8 for U+00A1 to U+024F.
_PLAIN = _WHITE.copy()
_PLAIN[0x21:0x7F] = True
_PLAIN[0x80:0xC0] = True
_PLAIN[0xC2:0xCA] = True

_encoders: dict[str, "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordTable:
    """Row numbers of known words, by the hash of the word: a sorted array, searched for a run's distinct words."""

    def __init__(self):
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each sorted hash, whether it is known)."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.rows[at], self.keys[at] == h

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        at = np.searchsorted(self.keys, h)
        self.keys, self.rows = np.insert(self.keys, at, h), np.insert(self.rows, at, rows)


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.a, self.n = np.zeros(1 << 16, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.a):
            self.a = np.concatenate([self.a, np.zeros_like(self.a)])
        self.a[self.n : self.n + len(more)] = more
        self.n += len(more)


def rows_with(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which rows have a flag set in their bytes."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offs[1:]] > total[offs[:-1]]


def odd_rows(buf: np.ndarray, offs: np.ndarray, white: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Rows that aren't the concatenation of their items."""
    if not len(buf):
        return np.zeros(len(offs) - 1, bool)
    nxt = np.append(buf[1:], np.uint8(0x20))
    bad = ~_PLAIN[buf] | ((buf == 0xC2) & (nxt < 0xA1)) | ((buf == 0xC9) & (nxt > 0x8F))
    if len(buf) > 2:
        run = np.append(white[:-2] & white[1:-1] & white[2:], [False, False])
        # a run that reaches into the next row isn't one; it only sends a row to the library for nothing
        bad |= run
    odd = rows_with(bad, offs)
    last = offs[1:] - 1
    two = (np.diff(offs) >= 2) & white[last] & white[np.maximum(last - 1, 0)]
    odd |= two
    if special:
        text = buf.tobytes()
        for m in re.finditer(b"|".join(map(re.escape, special)), text):
            odd[np.searchsorted(offs, m.start(), "right") - 1] = True
    return odd


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.feed = self.library.encode("\n", add_special_tokens=False).ids
        self._reset()

    def _reset(self) -> None:
        self.table, self.ids, self.start = WordTable(), Grown(np.uint32), Grown(np.int64)
        self.start.extend(np.zeros(1, np.int64))

    def _learn(self, items: list[bytes]) -> np.ndarray:
        """Row numbers of new items, whose ids are kept. They go to the library as lines of one text: a line feed in front of a word or a
        space is a token of its own, so it ends each item. An item of another white-space character alone goes by itself."""
        alone = np.fromiter((w[:1] in (b"\t", b"\r") or w in (b"\n", b" ") for w in items), bool, len(items))
        fed = np.fromiter((w[:1] == b"\n" for w in items), bool, len(items))[~alone]
        lines = [w[1:] if w[:1] == b"\n" else w for w, x in zip(items, alone, strict=True) if not x]
        flat = np.array(self.library.encode_batch_fast([b"\n".join([*lines, b""]).decode()], add_special_tokens=False)[0].ids if lines else [], np.uint32)
        ends = np.flatnonzero(flat == self.feed[0])
        assert len(ends) == len(lines), "a line feed is part of another token"
        sizes = np.diff(ends, prepend=-1) - 1
        flat = np.delete(flat, ends)
        flat = np.insert(flat, (np.cumsum(sizes) - sizes)[fed], np.uint32(self.feed[0]))  # the feed that a line began with
        sizes[fed] += 1
        own = [np.array(self.library.encode(w.decode(), add_special_tokens=False).ids, np.uint32) for w, x in zip(items, alone, strict=True) if x]
        sizes = np.concatenate([sizes, np.fromiter(map(len, own), np.int64, len(own))])
        first, used = self.start.n - 1, self.ids.n
        self.ids.extend(np.concatenate([flat, *own]))
        self.start.extend(used + np.cumsum(sizes))
        return first + np.where(alone, len(lines) + np.cumsum(alone) - 1, np.cumsum(~alone) - 1)

    def _run(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offs) - 1
        white = _WHITE[buf]
        odd = odd_rows(buf, offs, white, self.special)
        opens = white.copy()
        inside = offs[:-1][np.diff(offs) > 0]
        opens[inside] = True
        first = np.flatnonzero(opens)
        end = np.append(first[1:], len(buf))
        row = np.searchsorted(offs, first, "right") - 1
        if odd.any():
            keep = ~odd[row]
            first, end, row = first[keep], end[keep], row[keep]
        # an item at the start of a row has no white space in front unless the row begins with it
        h = word_hashes(buf, first, end, lower=False)
        new, one, back = np.unique(h, return_index=True, return_inverse=True)
        at, known = self.table.find(new)
        if not known.all():
            miss = np.flatnonzero(~known)
            if self.start.n > KNOWN_WORDS:
                self._reset()
                miss = np.arange(len(new))
            rows_of = [self._learn([buf[first[i] : end[i]].tobytes() for i in one[miss[k : k + NEW_ITEMS]]]) for k in range(0, len(miss), NEW_ITEMS)]
            self.table.add(new[miss], np.concatenate(rows_of))
            at, known = self.table.find(new)
        at = at[back]
        begin = self.start.a[at]
        sizes = self.start.a[at + 1] - begin
        ends = np.cumsum(sizes)
        ids = self.ids.a[np.repeat(begin - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        lens = np.bincount(row, sizes, rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
        if odd.any():
            upto = np.concatenate([[0], np.cumsum(lens)])
            text = [buf[offs[i] : offs[i + 1]].tobytes().decode() if odd[i] else "" for i in range(rows)]
            parts = [np.array(self.library.encode(text[i], add_special_tokens=False).ids, np.uint32) if odd[i] else ids[upto[i] : upto[i + 1]] for i in range(rows)]
            ids, lens = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, rows)
        return ids, lens

    def encode(self, texts: pa.Array):
        """Yields (first row, end row, ids of these texts in order, number of ids of each); null counts as empty."""
        for lo, hi, buf, offs in runs(texts, RUN_BYTES):
            ids, lens = self._run(buf, offs)
            yield lo, hi, ids, lens
