"""Substring dedup with a compressed FM-index per shard: runs of WORDS words that stand in an earlier document.

Fragments that share a minimizer (see repeats) meet in a shard. The shard's index is the Burrows-Wheeler transform of its fragments, over word
numbers, in a wavelet matrix of packed bits with counts per 64. Documents' fragments stream through it from their last word to their first, all in step: a word is one
backward-search step, a match that cannot grow is shortened to the interval its common prefixes give (its parent), and one longer than WORDS to the interval of WORDS.
So every place gets its matching statistics, up to WORDS, in one pass; where they reach WORDS a window stands there, and the least document in its
interval, by a table of range minima, is the earliest that has it. Words are compared by 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quietlog.llm.bwt import common_prefixes, rotations
from quietlog.llm.repeats import Kind, all_with_spans, covered, runs_of
from quietlog.llm.substring_bwt import word_units
from quietlog.llm.textcore import Batch

WORDS, K = 50, 16


class WaveletMatrix:
    """Rank over integers: one bit a level, packed, with a count before every 64 bits."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bit.dtype)).astype(np.uint8), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1])
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.start = np.concatenate([[0], np.cumsum(np.bincount(values))]) if len(values) else np.zeros(1, np.int64)
        first = np.zeros(int(values.max()) + 2 if len(values) else 1, np.int64)
        seen, at = np.unique(values, return_index=True)
        first[seen] = at  # where each value's run begins in the last level
        self.first = first

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i are value."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = i >> 6
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((value >> level) & 1, self.zeros[k] + ones, i - ones)
        return i - self.first[value]


class FMIndex:
    """Of strings of positive integers. Matches are told apart up to `most` symbols."""

    def __init__(self, strings: list[np.ndarray], most: int = WORDS):
        size = np.array([len(s) + 1 for s in strings])
        self.at = np.concatenate([[0], np.cumsum(size)])
        text = np.zeros(self.at[-1], np.int64)
        for s, lo in zip(strings, self.at, strict=False):
            text[lo : lo + len(s)] = s
        levels: list[np.ndarray] = []
        order, before = rotations(text, self.at, levels)
        self.most = most
        self.of = np.repeat(np.arange(len(strings)), size)[order]
        self.matrix = WaveletMatrix(text[before[order]])
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.common = np.append(common_prefixes(order, self.at, levels, most), 0)  # with the place before; 0 at both ends
        self.minima = [self.common.astype(np.uint8 if most < 256 else np.int64)]
        while 2 ** len(self.minima) <= len(self.common):
            half = 2 ** (len(self.minima) - 1)
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))

    def extended(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more symbol before them."""
        known = symbol < len(self.less) - 1
        c = np.where(known, symbol, 0)
        start = self.less[c]
        return np.where(known, start + self.matrix.rank(c, lo), 0), np.where(known, start + self.matrix.rank(c, hi), 0)

    def widened(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest intervals around these in which all common prefixes have that depth."""
        n = int(self.at[-1])
        for k in range(len(self.minima) - 1, -1, -1):
            table, step = self.minima[k], 2**k
            at = lo - step + 1
            ok = (at >= 1) & (table[np.clip(at, 0, len(table) - 1)] >= depth)
            lo = np.where(ok, lo - step, lo)
            ok = (hi + step <= n) & (table[np.minimum(hi, len(table) - 1)] >= depth)
            hi = np.where(ok, hi + step, hi)
        return lo, hi

    def statistics(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, lo, hi) of every place: the longest match, of at most `most` symbols, that begins there, and its interval. Document d is text[first[d]:first[d+1]]; its matches end in it."""
        n = int(self.at[-1])
        length, low, high = (np.zeros(len(text), np.int64) for _ in range(3))
        size = np.diff(first)
        lanes = np.argsort(-size, kind="stable")
        longest = size[lanes]
        match, lo, hi = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64), np.full(len(lanes), n, np.int64)
        for back in range(int(longest[0]) if len(longest) else 0):
            on = int(np.searchsorted(-longest, -back, "left"))  # lanes whose document is longer than back
            at = first[lanes[:on] + 1] - 1 - back
            m, a, b = match[:on], lo[:on], hi[:on]
            symbol = text[at]
            new_a, new_b = self.extended(symbol, a, b)
            stuck = np.flatnonzero(new_a >= new_b)
            while len(stuck):
                # The parent interval: shorter by what does not let the match grow.
                depth = np.where(m[stuck] > 0, np.minimum(np.maximum(self.common[a[stuck]], self.common[b[stuck]]), m[stuck] - 1), -1)
                over = stuck[depth < 0]  # nothing begins with this symbol
                m[over], a[over], b[over], new_a[over], new_b[over] = -1, 0, n, 0, n
                stuck, depth = stuck[depth >= 0], depth[depth >= 0]
                a[stuck], b[stuck] = self.widened(a[stuck], b[stuck], depth)
                m[stuck] = depth
                new_a[stuck], new_b[stuck] = self.extended(symbol[stuck], a[stuck], b[stuck])
                stuck = stuck[new_a[stuck] >= new_b[stuck]]
            m += 1
            a[:], b[:] = new_a, new_b
            long = np.flatnonzero(m > self.most)
            if len(long):
                m[long] = self.most
                a[long], b[long] = self.widened(a[long], b[long], np.full(len(long), self.most))
            length[at], low[at], high[at] = m, a, b
        return length, low, high


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi], for lo < hi."""
    table = [values]
    while 2 ** len(table) <= len(values):
        half = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k in np.unique(level):
        of = level == k
        out[of] = np.minimum(table[k][lo[of]], table[k][hi[of] - 2**k])
    return out


def decide(parts: list[np.ndarray], n: np.ndarray, anchor: np.ndarray, weight: np.ndarray, did: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Per fragment, runs (from, to, least document) of windows."""
    if not parts:
        return []
    length = np.array([len(p) for p in parts])
    text = np.unique(np.concatenate(parts), return_inverse=True)[1].astype(np.int64) + 1
    first = np.concatenate([[0], np.cumsum(length)])
    index = FMIndex([text[a:b] for a, b in zip(first, first[1:], strict=False)], size)
    _, lo, hi = index.statistics(text, first)
    of = np.repeat(np.arange(len(parts)), n)
    start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)  # every one of them matches size words: its own, at least
    return runs_of(range_minima(did[index.of], lo[start], hi[start]), n, np.iinfo(np.int64).min)


WORD_RUNS = Kind("words", WORDS, K, word_units, word_units, decide, True)


def cut_words(pdf: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    """Per row: words, words removed, and the kept words joined by single spaces."""
    b = Batch(pdf.text.tolist())
    out = []
    for d, found in enumerate(pdf.spans):
        lo, hi = int(b.first[d]), int(b.first[d + 1])
        gone = covered(hi - lo, found)
        kept = np.flatnonzero(~gone) + lo
        out.append((hi - lo, int(gone.sum()), b" ".join([b.raw[s:e] for s, e in zip(b.start[kept], b.end[kept], strict=True)])))
    return out


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    Null, empty and blank texts have no words and the hash of nothing. Rows with one doc_id are one document to each other: only a smaller doc_id
    removes. A null doc_id counts as larger than any other. Other columns are not read."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in cut_words(part)]
                out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"]).astype({"kept_sha256": object})
                out.insert(0, "doc_id", part.doc_id.astype("Int64").to_numpy())
                yield out

    return all_with_spans(docs, WORD_RUNS).mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op2_fm_index_dedup(spark, sf_dir):
    """Repeats of 50 words or more of an earlier document, over all documents."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
