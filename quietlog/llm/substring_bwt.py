"""Suffix-array dedup: strings that stand twice, by merging shard Burrows-Wheeler transforms: of SIZE bytes, every copy of them, or of WORDS words, the copies
in all documents but the first.

Fragments that share a minimizer (see repeats) meet in a shard. Windows that are equal have their minimizers at equal
offsets, so the shard's texts are read as blocks of 8 bytes counted from the minimizer: a window is 49 or 50 whole blocks and up
to 8 bytes at its ends. The shard's fragments are cut into parts; each part's transform is built on its own, and the
parts are merged by interleave refinement, which also gives the common prefixes; intervals of the merged order with common prefixes
of 49 or 50 blocks are the repeated intervals, and the bytes at the ends are compared as they are. Words are symbols as they are (by their 64-bit hashes). In a shard no
hash of a stretch decides; a minimizer with one distinct fragment, or with more than repeats.HOT of them, never gets there: hashes decide those."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.bwt import merged, rotations
from quietlog.llm.repeats import SPANS, Kind, all_with_spans, covered, runs_of, with_spans
from quietlog.llm.textcore import Batch, contexts, objects

SIZE, K, BLOCK, PARTS = 400, 128, 8, 4
WORDS, WORDS_K = 50, 16


def raw_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in texts]
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=first[1:])
    return np.frombuffer(b"".join(raw), np.uint8), first


def byte_units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw, first = raw_bytes(texts)
    return contexts(raw), first


def decide(
    parts: list[np.ndarray], n: np.ndarray, anchor: np.ndarray, weight: np.ndarray, did: np.ndarray, size: int = SIZE, block: int = BLOCK, by_document: bool = False, many: int = PARTS
) -> list[np.ndarray]:
    """Per fragment, runs (from, to, value) of windows that stand twice or more in all fragments, with their weights; by_document: of all windows, with the least document."""
    if not parts:
        return []
    whole = size // block
    lead = anchor % block
    if block == 1:
        blocks = parts
    else:
        blocks = [p[o : o + (len(p) - o) // block * block].view("<u8") if (len(p) - o) >= block else np.zeros(0, np.uint64) for p, o in zip((np.ascontiguousarray(q) for q in parts), lead, strict=True)]
    symbol = np.unique(np.concatenate(blocks), return_inverse=True)[1].astype(np.int64) + 1
    count = np.array([len(b) for b in blocks])
    first = np.concatenate([[0], np.cumsum(count + 1)])  # each string ends with symbol 0
    text = np.zeros(first[-1], np.int64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    text[inside] = symbol
    shards = []
    for some in np.array_split(np.arange(len(parts)), min(many, len(parts))):
        lo, hi = first[some[0]], first[some[-1] + 1]
        order, before = rotations(text[lo:hi], first[some[0] : some[-1] + 2] - lo)
        shards.append((text[lo:hi][before[order]], order + lo))
    _, position, common = merged(shards, whole)
    interval = {}
    for depth in (whole - 1, whole):
        interval[depth] = np.empty(len(text), np.int64)
        interval[depth][position] = np.cumsum(common < depth)
    of = np.repeat(np.arange(len(parts)), n)
    w = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    number = -(-(w - lead[of]) // block)
    spot = first[of] + number
    if block == 1:
        ends, same = np.zeros(len(w), np.uint64), interval[whole][spot]
    else:
        left = lead[of] + block * number - w  # bytes before the first whole block, 0 to 7
        joined = np.concatenate(parts)
        at = (np.cumsum([len(p) for p in parts]) - [len(p) for p in parts])[of] + w
        ends = np.zeros(len(w), np.uint64)
        for b in range(block):
            byte = joined[np.where(b < left, at + b, at + size - block + b)].astype(np.uint64)
            ends |= np.where(left > 0, byte, 0) << np.uint64(8 * b)
        same = np.where(left > 0, interval[whole - 1][spot], interval[whole][spot]) * block + left
    order = np.lexsort((ends, same))
    edge = np.ones(len(order), bool)
    edge[1:] = (same[order][1:] != same[order][:-1]) | (ends[order][1:] != ends[order][:-1])
    group = np.cumsum(edge) - 1
    value = np.empty(len(w), np.int64)
    if by_document:
        value[order] = np.minimum.reduceat(did[of][order], np.flatnonzero(edge))[group]
        return runs_of(value, n, np.iinfo(np.int64).min)
    total = np.bincount(group, weights=weight[of][order]).astype(np.int64)
    value[order] = np.where(total[group] > 1, 2, 0)
    return runs_of(value, n, 0)


def word_units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    b = Batch(texts)
    return b.hashes(), b.first


def decide_words(parts: list[np.ndarray], n: np.ndarray, anchor: np.ndarray, weight: np.ndarray, did: np.ndarray) -> list[np.ndarray]:
    return decide(parts, n, anchor * 0, weight, did, WORDS, 1, True)


BYTES = Kind("bytes", SIZE, K, byte_units, raw_bytes, decide, False, ahead=7, sent="u1")
WORD_STRINGS = Kind("word-strings", WORDS, WORDS_K, word_units, word_units, decide_words, True)


def cut_bytes(text: str | None, spans: list | None) -> tuple[int, int, int, bytes]:
    """(bytes, bytes removed, runs removed, what is left)."""
    raw = text.encode("utf-8", "surrogatepass") if text is not None else b""
    if spans is None or not len(spans):
        return len(raw), 0, 0, raw
    gone = covered(len(raw), spans)
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes and the hash of nothing. Rows of one text, whatever their doc_id, are occurrences each, so a text of SIZE
    bytes or more that stands twice goes whole. A null doc_id stays null. Other columns are not read."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(n, gone, runs, hashlib.sha256(kept).hexdigest()) for n, gone, runs, kept in map(cut_bytes, pdf.text, pdf.spans)]
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"kept_sha256": object})
            out.insert(0, "doc_id", pdf.doc_id.astype("Int64").to_numpy() if len(pdf) else [])
            yield out

    return all_with_spans(docs, BYTES).mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_text(text: str | None, spans: list | None) -> str | None:
    """The text without the spans of bytes. A character of which a byte goes, goes."""
    if text is None or spans is None or not len(spans):
        return text
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    gone = np.bincount(char, weights=covered(len(raw), spans)) > 0
    return raw[~gone[char]].tobytes().decode("utf-8", "surrogatepass")


def cut_texts(text: pd.Series, spans: pd.Series) -> pd.Series:
    return objects([cut_text(t, s) for t, s in zip(text, spans, strict=True)])


def _with_cut(docs: DataFrame, kind: Kind, how) -> DataFrame:
    hit, rest = with_spans(docs, kind)
    hit = hit.withColumn("text", F.pandas_udf(how, "string")(F.col("text").cast("string"), F.col(SPANS))).drop(SPANS)
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return hit.select(*docs.columns).unionByName(rest.select(*docs.columns))


def cut(docs: DataFrame) -> DataFrame:
    """docs, all columns, without strings of SIZE bytes that stand twice anywhere, every copy of them; n_chars, if there is such a column, counted again.

    Rows stay, even those of which nothing is left; null and empty texts stay as they are. Rows that repeat in full are occurrences of their text each."""
    return _with_cut(docs, BYTES, cut_texts)


def cut_word_texts(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the spans of words: a run goes with the white space inside and after it, all other white space stays."""
    texts = [t if isinstance(t, str) else None for t in text]
    out: list[str | None] = []
    for t, found in zip(texts, spans, strict=True):
        if t is None or found is None or not len(found):
            out.append(t)
            continue
        b = Batch([t])
        gone = covered(len(b.start), found)
        step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        parts, at = [], 0
        for lo, hi in zip(np.flatnonzero(step > 0), np.flatnonzero(step < 0), strict=True):
            parts.append(b.raw[at : b.start[lo]])
            at = int(b.start[hi]) if hi < len(b.start) else int(b.end[hi - 1])
        parts.append(b.raw[at : b.doc_end[0]])
        out.append(b"".join(parts).decode("utf-8", "surrogatepass"))
    return objects(out)


def cut_later(docs: DataFrame) -> DataFrame:
    """docs, all columns, without runs of WORDS words that stand in a document with a smaller doc_id too: the first document keeps them. n_chars, if there is such a
    column, is counted again.

    Words are what stands between ASCII white space. Rows stay, even those of which nothing is left; null, empty and shorter texts stay as they are. A null doc_id counts
    as the largest; rows with one doc_id, repeated rows among them, do not cut each other."""
    return _with_cut(docs, WORD_STRINGS, cut_word_texts)


def op5_suffix_array_dedup(spark, sf_dir):
    """Repeats of 400 bytes or more, over all documents."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
