"""Vectorised words and hashes over batches of texts, for the Arrow side of the operators.

A batch of texts becomes one byte buffer; words, their hashes and their documents are arrays over it."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

U64 = np.uint64
#: The bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = np.zeros(256, bool)
GAP[[0x20, 9, 10, 11, 12, 13]] = True
#: Gaps of a split that leaves punctuation out as well: all of ASCII but letters, digits and the apostrophe.
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[[i for i in range(128) if not (chr(i).isalnum() or chr(i) == "'")]] = True
BASE = U64(0x9E3779B97F4A7C15)
#: Characters worked on at once, and rows that Arrow sends at once: what a Python worker holds is a small multiple of these and of its longest text.
BATCH, ARROW_ROWS = 1 << 18, 512
_POWERS = np.ones(1, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


#: Places of a word whose values are kept in a table.
PLACES = 64
SALTS = (U64(1), U64(0x5851F42D4C957F2D))
PLACED = [mix(np.arange(PLACES * 256, dtype=U64) * BASE + salt) for salt in SALTS]


def placed(code: np.ndarray, salt: int = 0) -> np.ndarray:
    """A random-looking value of each (place << 8 | byte). Sums of them tell strings apart with no structure that a repetitive text could meet by its make:
    a polynomial modulo 2^64 would give long strings of two letters in certain orders the same value."""
    out = PLACED[salt].take(code, mode="clip")
    far = np.flatnonzero(code >= PLACES * 256)
    if len(far):
        out[far] = mix(code[far].astype(U64) * BASE + SALTS[salt])
    return out


def contexts(raw: np.ndarray) -> np.ndarray:
    """A random-looking value of each byte with the seven after it (zeros beyond the end)."""
    padded = np.append(raw, np.zeros(7, np.uint8))
    return mix(np.ndarray((len(raw),), "<u8", padded, strides=(1,)) + BASE)


def powers(n: int) -> np.ndarray:
    """BASE to the power 0 .. n-1, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.full(max(n, 1 << 16), BASE, U64)
        _POWERS[0] = 1
        np.multiply.accumulate(_POWERS, out=_POWERS)
    return _POWERS[:n]


_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_INVERSES = np.ones(1, U64)


def inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        _INVERSES = np.full(max(n, 1 << 16), _INVERSE, U64)
        _INVERSES[0] = 1
        np.multiply.accumulate(_INVERSES, out=_INVERSES)
    return _INVERSES[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums P of values[j] * BASE^j, so that span() gives the hash of any stretch."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from start to end, whatever stands around them."""
    return mix((p[end] - p[start]) * inverses(len(p))[start])


class Batch:
    """Texts in one buffer, split into words. A null text has no words."""

    def __init__(self, texts: list[str | None], lower: bool = False, gaps: np.ndarray = GAP):
        self.gaps = gaps
        raw = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") if t is not None else b"" for t in texts]
        self.raw = b"\n".join(raw) + b"\n"
        self.n = len(raw)
        sizes = np.fromiter(map(len, raw), np.int64, self.n)
        self.doc_at = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # first byte of each text
        self.doc_end = self.doc_at + sizes
        self.bytes = np.frombuffer(self.raw, np.uint8)
        gap = gaps[self.bytes]
        inside = ~gap
        self.start = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]]))
        self.end = np.flatnonzero(inside & np.concatenate([gap[1:], [True]])) + 1
        #: For text d the words are first[d] .. first[d+1]-1.
        self.first = np.searchsorted(self.start, np.concatenate([self.doc_at, [len(self.raw)]]))
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self, most: int | None = None, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, or of its first most bytes; salt 0 or 1 gives independent ones."""
        if not len(self.start):
            return np.zeros(0, U64)
        lead = int(self.start[0])
        at = np.arange(len(self.bytes))
        at[:lead] = 0
        at[lead:] -= np.repeat(self.start, np.diff(np.append(self.start, len(self.bytes))))
        inside = ~self.gaps[self.bytes]
        if most:
            inside &= at < most
        at[~inside] = 0
        values = placed((at << 8) | self.bytes, salt)
        values[~inside] = 0
        return mix(np.add.reduceat(values, self.start))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k values in a row, for each start; len(h) - k + 1 of them."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * BASE + h[i : i + n]
    return mix(out)


def pieces(it: Iterator[pd.DataFrame], column: str = "text", most: int = BATCH) -> Iterator[pd.DataFrame]:
    """The batches cut into runs of rows with about most characters; a longer single text comes alone."""
    for pdf in it:
        size = np.fromiter((len(t) if isinstance(t, str) else 0 for t in pdf[column]), np.int64, len(pdf))
        run = np.cumsum(size) // most
        for _, at in pd.Series(np.arange(len(pdf))).groupby(run):
            yield pdf.iloc[at.to_numpy()]
    release()


_LIBC = ctypes.CDLL(None) if os.name == "posix" else None


def release() -> None:
    """Gives free memory back at the end of a task: an idle Python worker is kept for the next stage, its memory need not be."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def small_batches(spark) -> None:
    """Texts are long: no more than ARROW_ROWS of them go to a Python worker at once. Set on the session, since plans read it when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def objects(values) -> pd.Series:
    """A column of strings or arrays that stays one when it is empty or all of one length."""
    out = np.empty(len(values), dtype=object)
    for i, v in enumerate(values):
        out[i] = v
    return pd.Series(out, dtype=object)
