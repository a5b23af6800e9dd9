"""URL filters by a bit-parallel wildcard automaton.

All rules become globs over one canonical string per URL, packed side by side
into the bits of a few 64-bit words. One step of Shift-And advances every rule
for every URL of a batch at once; a ``*`` is a state that keeps its bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.text_arrays import runs

#: Between host and path in the canonical string; no host holds a slash, so what follows it in a rule is the path.
JOINT = "\0"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    def globs(self) -> list[str]:
        """The canonical string begins with a dot, so one glob fits the host and its subdomains."""
        quote = lambda s: "".join("\\" + c if c in "*?\\" else c for c in s)
        return [f"*.{quote(self.host)}{JOINT}{quote(self.path)}*"]


#: Verdicts for URLs that no rule fits: globs over ``.host`` JOINT ``path``; the first that fits gives it, else DEFAULT.
GENERAL = (("block", f"*.ads.*{JOINT}*"), ("block", f"*{JOINT}*/ads/*"), ("block", f"*{JOINT}*.exe"))
DEFAULT = "allow"


class WildcardAutomaton:
    """Globs (``*`` any run, ``?`` any byte, backslash quotes) in order of precedence, run over many strings at once."""

    def __init__(self, globs: list[str]):
        steps: list[tuple[int | None, bool]] = []  # of each state: the byte that leads into it (None: start), whether it stays
        self.first, accept, any_byte = [], [], []
        for g in globs:
            self.first.append(len(steps))
            steps.append((None, False))
            raw, i = g.encode(), 0
            while i < len(raw):
                c = raw[i]
                if c == ord("*"):
                    steps[-1] = (steps[-1][0], True)
                elif c == ord("?"):
                    any_byte.append(len(steps))
                    steps.append((-1, False))
                else:
                    if c == ord("\\") and i + 1 < len(raw):
                        i += 1
                        c = raw[i]
                    steps.append((c, False))
                i += 1
            accept.append(len(steps) - 1)
        self.words = -(-max(1, len(steps)) // 64)
        bits = lambda at: np.bitwise_or.reduce([_bit(i, self.words) for i in at], axis=0) if len(at) else np.zeros(self.words, np.uint64)
        self.start = bits(self.first)
        self.stay = bits([i for i, s in enumerate(steps) if s[1]])
        self.accept = bits(accept)
        self.into = np.tile(bits(any_byte), (256, 1))
        for i, (c, _) in enumerate(steps):
            if c is not None and c >= 0:
                self.into[c] |= _bit(i, self.words)
        self.glob_of = np.full(64 * self.words, -1, np.int64)
        self.glob_of[accept] = np.arange(len(globs))

    def match(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The first glob that fits each string, -1 where none does."""
        n = np.diff(offs)
        order = np.argsort(-n, kind="stable")
        s, left = offs[:-1][order], n[order]
        state = np.tile(self.start, (len(n), 1))
        live = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
        for i, k in enumerate(live):
            d = state[:k]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.into[buf[s[:k] + i]]) | (d & self.stay)
        state &= self.accept
        out = np.full(len(n), -1, np.int64)
        word = (state != 0).argmax(1)
        w = state[np.arange(len(n)), word]
        hit = np.flatnonzero(w)
        low = w[hit] & (~w[hit] + np.uint64(1))
        out[order[hit]] = self.glob_of[word[hit] * 64 + np.log2(low.astype(np.float64)).astype(np.int64)]
        return out


def _bit(i: int, words: int) -> np.ndarray:
    out = np.zeros(words, np.uint64)
    out[i // 64] = np.uint64(1) << np.uint64(i % 64)
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def url_verdicts(pages: DataFrame, rules: list[Rule], general=GENERAL, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row; of the rules that fit, the longest name wins, then the first given.

    A null URL, or one without ``://``, has an empty host and path, which no rule
    fits; where no rule fits, ``rule`` is null and ``general`` decides, else
    ``default``. Repeated rows repeat, other columns are ignored.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs, names, verdicts = [], [], []
    for r in ranked:
        for g in r.globs():
            globs.append(g), names.append(r.name), verdicts.append(r.verdict)
    for verdict, g in general:
        globs.append(g), names.append(None), verdicts.append(verdict)
    automaton = WildcardAutomaton(globs)
    names, verdicts = pa.array([*names, None], pa.string()), pa.array([*verdicts, default])

    @F.arrow_udf("rule string, verdict string")
    def judge(urls: pa.Array) -> pa.Array:
        found = np.full(len(urls), -1, np.int64)
        for lo, hi, buf, offs in runs(urls):
            found[lo:hi] = automaton.match(buf, offs)
        at = pa.array(np.where(found < 0, len(globs), found))
        return pa.StructArray.from_arrays([names.take(at), verdicts.take(at)], names=["rule", "verdict"])

    # a JOINT of the URL's own would let a path pass for a host
    plain = lambda c: F.replace(F.col(c), F.lit(JOINT), F.lit("\ufffd"))
    parts = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    judged = parts.withColumn("_found", judge(F.concat(F.lit("."), plain("host"), F.lit(JOINT), plain("path"))))
    return judged.select(id_col, "host", "path", F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("verdict"))
