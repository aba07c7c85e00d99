"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items, by block-max WAND.

Passages are runs of words, STEPS times as long as the longest item at least, that begin every STEPS-th part of that, so that an item
lies whole in one even when other words between its parts make it three times as long. All items that score at or above their threshold are retrieved: an item's threshold is the least score
a passage can have that holds OVERLAP of the item's five-word shingles (at most that many words can be missing: the heaviest),
so none is missed.

The index is inverted: per term its postings, in blocks of BLOCK items, each block with its greatest weight. Work is skipped as in block-max WAND, for many passages at a
time: a passage whose terms' greatest weights do not add up to the least threshold is left at once; then the weights' block maxima, over the blocks that
its terms occur in, say which blocks can hold an item above its threshold (the live blocks); only postings in those are scored. Statistics
of BM25 (how many items hold a term, how many items, their mean length) and the length of passages are those of all items, so scores do not depend on how items are spread over indexes.
What is retrieved is verified: shingles of the item that stand in the passage, overall and for those that touch its question and its answer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.store import written
from quietlog.llm.textcore import BATCH, PUNCTUATED, Batch, grams, objects, pieces, small_batches

SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
K1, B_LENGTH = 1.2, 0.75
BLOCK = 8
#: Passages that hold a word.
STEPS = 4
#: Bytes of one index, as built and measured; more items make more indexes, each broadcast and run in its own pass. A byte of text makes about INDEX_GROWTH of them.
INDEX_BYTES, INDEX_GROWTH = 48 << 20, 16
#: Places that the work on live blocks of some passages may take at once.
WORK = 1 << 22
SENTENCE_END = re.compile(r"[.!?\n]\s*")


def shingles(h: np.ndarray) -> np.ndarray:
    """Five-word shingles; of fewer words, the one of all of them."""
    return grams(h, min(SHINGLE, len(h))) if len(h) else h


def answer_start(text: str) -> int:
    """Where the answer, the last sentence, begins; 0 with one sentence only."""
    ends = [m.end() for m in SENTENCE_END.finditer(text.rstrip(".!?\n\t "))]
    return ends[-1] if ends else 0


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: how many, their mean length and greatest length in words, and how many hold each term (terms in order)."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    holders: np.ndarray

    @staticmethod
    def of(words: list[np.ndarray]) -> Statistics:
        words = [w for w in words if len(w)]
        terms, holders = np.unique(np.concatenate([np.unique(w) for w in words] or [np.zeros(0, np.uint64)]), return_counts=True)
        return Statistics(len(words), float(np.mean([len(w) for w in words])) if words else 0.0, max(map(len, words), default=0), terms, holders)


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    b = Batch(texts, lower=True, gaps=PUNCTUATED)
    h = b.hashes()
    return [h[lo:hi] for lo, hi in zip(b.first, b.first[1:], strict=False)]


def expanded(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of start[1] and so on."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


@dataclass
class Index:
    """Items in order of length, in blocks of BLOCK. Term t has the block entries entry_at[t] .. entry_at[t+1]-1; entry e is of block[e], its greatest weight is
    peak[e], and its postings are posting_at[e] .. posting_at[e+1]-1."""

    terms: np.ndarray
    term_max: np.ndarray
    entry_at: np.ndarray
    block: np.ndarray
    peak: np.ndarray
    posting_at: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray
    block_threshold: np.ndarray
    shingles: list[np.ndarray]
    answers: list[int]
    sizes: list[int]
    ids: list
    window: int

    @staticmethod
    def of(items: list[tuple[object, str]], known: Statistics | None = None) -> Index | None:
        words = words_of([t for _, t in items])
        known = known or Statistics.of(words)
        kept = sorted((i for i in range(len(items)) if len(words[i])), key=lambda i: (len(words[i]), i))
        if not kept:
            return None
        answers = [len(w) for w in words_of([items[i][1][: answer_start(items[i][1])] for i in kept])]
        words = [words[i] for i in kept]
        size = np.array([len(w) for w in words])
        own = [np.unique(w, return_counts=True) for w in words]
        term = np.concatenate([t for t, _ in own])
        count = np.concatenate([c for _, c in own]).astype(np.float64)
        item = np.repeat(np.arange(len(words)), [len(t) for t, _ in own])
        holders = known.holders[np.searchsorted(known.terms, term)]
        idf = np.log1p((known.n - holders + 0.5) / (holders + 0.5))
        weight = (idf * count * (K1 + 1) / (count + K1 * (1 - B_LENGTH + B_LENGTH * size[item] / known.mean))).astype(np.float32)
        threshold = np.empty(len(words))
        found = [shingles(w) for w in words]
        for j, mine in enumerate(np.split(weight.astype(np.float64), np.cumsum([len(t) for t, _ in own])[:-1])):
            missing = len(found[j]) - int(np.ceil(OVERLAP * len(found[j]) - 1e-9))
            heaviest = np.sort(mine)[::-1]
            threshold[j] = (heaviest.sum() - heaviest[:missing].sum()) * (1 - 1e-5)
        order = np.lexsort((item, term))
        term, item, weight = term[order], item[order], weight[order]
        edge = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)]))
        peak = np.maximum.reduceat(weight, edge)
        first = np.flatnonzero(np.concatenate([[True], term[edge][1:] != term[edge][:-1]]))
        return Index(
            term[edge][first], np.maximum.reduceat(peak, first), np.append(first, len(edge)), (item[edge] // BLOCK).astype(np.int32), peak, np.append(edge, len(term)), item.astype(np.int32), weight,
            threshold, np.minimum.reduceat(threshold, np.arange(0, len(words), BLOCK)), found, answers, size.tolist(), [items[i][0] for i in kept], max(64, STEPS * known.longest),
        )

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.terms, self.term_max, self.entry_at, self.block, self.peak, self.posting_at, self.item, self.weight, self.threshold, self.block_threshold, *self.shingles)) + 200 * len(self.ids)

    def search(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, first word, end, item, score) of all passages and items at or above the item's threshold. Document d has words h[first[d]:first[d+1]]."""
        stride = self.window // STEPS
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == h)
        doc = np.searchsorted(first, known, "right") - 1
        base = np.cumsum(np.diff(first) // stride + 2) - (np.diff(first) // stride + 2)  # passages before each document's
        step = (known - first[doc]) // stride
        passage = base[doc] + step
        earlier = [step >= k for k in range(STEPS)]  # the passages that began up to STEPS - 1 steps earlier hold the word as well
        pair = np.unique(np.concatenate([(passage[e] - k) * len(self.terms) + at[known][e] for k, e in enumerate(earlier)]))
        passage, term = pair // len(self.terms), pair % len(self.terms)
        start = np.flatnonzero(np.diff(passage, prepend=-1))
        if not len(start):
            return
        hopeful = np.add.reduceat(self.term_max[term].astype(np.float64), start) >= self.threshold.min()
        size = np.diff(np.append(start, len(term)))
        term, passage, size = term[np.repeat(hopeful, size)], passage[start[hopeful]], size[hopeful]
        if not len(size):
            return
        blocks = len(self.block_threshold)
        entries = np.diff(self.entry_at)[term]
        cost = np.add.reduceat(entries, np.cumsum(size) - size) + blocks
        some = np.cumsum(cost) // WORK
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(some)) + 1, [len(size)]])
        term_at = np.concatenate([[0], np.cumsum(size)])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = slice(term_at[lo], term_at[hi])
            for p, item, score in self.scores(term[own], np.repeat(np.arange(hi - lo), size[lo:hi]), entries[own], hi - lo):
                d = int(np.searchsorted(base, passage[lo + p], "right") - 1)
                begin = int(first[d] + (passage[lo + p] - base[d]) * stride)
                yield d, begin, min(begin + self.window, int(first[d + 1])), item, score

    def scores(self, term: np.ndarray, row: np.ndarray, entries: np.ndarray, rows: int) -> Iterator[tuple[int, int, float]]:
        """(row, item, score) at or above the item's threshold, for rows of terms."""
        blocks = len(self.block_threshold)
        entry = expanded(self.entry_at[term], entries)
        cell = np.repeat(row, entries) * blocks + self.block[entry]
        bound = np.bincount(cell, weights=self.peak[entry], minlength=rows * blocks).reshape(rows, blocks)
        live = (bound >= self.block_threshold).ravel()
        if not live.any():
            return
        on = live[cell]
        entry, cell = entry[on], cell[on]
        count = np.diff(self.posting_at)[entry]
        posting = expanded(self.posting_at[entry], count)
        number = np.cumsum(live) - 1  # of the live cells
        place = np.repeat(number[cell], count) * BLOCK + self.item[posting] % BLOCK
        cells = np.flatnonzero(live)
        score = np.bincount(place, weights=self.weight[posting], minlength=len(cells) * BLOCK).reshape(-1, BLOCK)
        item = (cells % blocks)[:, None] * BLOCK + np.arange(BLOCK)
        hit = (item < len(self.ids)) & (score >= self.threshold[np.minimum(item, len(self.ids) - 1)])
        for i, j in zip(*np.nonzero(hit), strict=True):
            yield int(cells[i] // blocks), int(item[i, j]), float(score[i, j])

    def overlaps(self, item: int, h: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's shingles that stand in the words h: all, those that touch the question, those that touch the answer."""
        own, answer, k = self.shingles[item], self.answers[item], min(SHINGLE, self.sizes[item])
        found = np.isin(own, grams(h, k))
        if not len(found) or not answer or len(own) == 1:
            return (float(found.mean()) if len(found) else 0.0,) * 3
        return float(found.mean()), float(found[:answer].mean()), float(found[max(0, answer - k + 1) :].mean())


def item_terms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pieces(it):
        words = words_of(pdf.text.tolist())
        yield pd.DataFrame({"part": pdf.part.to_numpy(), "n_words": [len(w) for w in words], "terms": objects([np.unique(w).view(np.int64) for w in words])})


def built(items: list[tuple[object, str]], known: Statistics) -> list[list[Index]]:
    """Indexes of these items of at most INDEX_BYTES each, as measured; a single item larger than that has its own."""
    one = Index.of(items, known)
    if one is None:
        return []
    if one.nbytes() <= INDEX_BYTES or len(items) < 2:
        return [[one]]
    half = len(items) // 2
    return built(items[:half], known) + built(items[half:], known)


def indexes(spark, items: DataFrame) -> list:
    """Broadcast lists of Index over all items, of at most INDEX_BYTES each, however many items there are; one empty list without items.

    Statistics are aggregates over all items on the cluster; the driver holds the texts, terms and index of one part at a time."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    small_batches(spark)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total * INDEX_GROWTH // INDEX_BYTES))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    found = written(items.select("part", "text").mapInPandas(item_terms, "part long, n_words long, terms array<long>"), "items").where("n_words > 0")
    n, words, longest = found.agg(F.count(F.lit(1)), F.sum("n_words"), F.max("n_words")).first()
    holders = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    out: list = []
    for part in range(parts if n else 0):
        rows = items.where(F.col("part") == part).orderBy("item_id", "text").select("item_id", "text").collect()
        here = holders if parts == 1 else holders.join(found.where(F.col("part") == part).select(F.explode("terms").alias("term")).distinct(), "term")
        counts = here.toPandas()
        term = counts.term.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(term)
        known = Statistics(n, words / n, longest, term[order], counts.n.to_numpy(np.int64)[order])
        out += [spark.sparkContext.broadcast(one) for one in built([(r.item_id, r.text) for r in rows], known)]
    return out or [spark.sparkContext.broadcast([])]


def leaks(texts: list[str | None], index: list[Index | None]) -> dict[tuple[int, int, int], tuple[float, float, float, float]]:
    """(text, index, item): (overlap, score, question's overlap, answer's overlap), of the best passage, for all that leaked."""
    b = Batch(texts, lower=True, gaps=PUNCTUATED)
    h, found = b.hashes(), {}
    for k, one in enumerate(index):
        for d, lo, hi, item, score in one.search(h, b.first) if one else ():
            shares = one.overlaps(item, h[lo:hi])
            if shares[0] >= OVERLAP - 1e-9 and min(shares[1:]) >= PART_OVERLAP - 1e-9:
                found[d, k, item] = max(found.get((d, k, item), (0.0,)), (shares[0], score, *shares[1:]))
    return found


def matched(docs: DataFrame, items: DataFrame, carry: str = "doc_id") -> DataFrame:
    """Per document and item that leaked into it: doc_id, item_id, score, overlap, question_overlap, answer_overlap (of the best passage).

    Words are compared lower-cased, without ASCII punctuation. An item leaks where a passage holds OVERLAP of its shingles, and PART_OVERLAP of those of
    its question (all but the last sentence) and of its answer (the last); an item of one sentence is both. Items without words (null, empty) never
    leak; null and empty documents hold none. Repeated items are reported each, repeated rows give repeated results; a null doc_id stays null. Other columns are not read."""
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {kind}, score double, overlap double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(docs.sparkSession, items):

        def run(it: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in pieces(it, most=BATCH):
                found = leaks(pdf.text.tolist(), index.value)
                ids = pdf.doc_id.astype("Int64").array
                yield pd.DataFrame(
                    {"doc_id": pd.array([ids[d] for d, _, _ in found], dtype="Int64"), "item_id": [index.value[k].ids[i] for _, k, i in found], "score": [round(v[1], 6) for v in found.values()],
                     "overlap": [v[0] for v in found.values()], "question_overlap": [v[2] for v in found.values()], "answer_overlap": [v[3] for v in found.values()]}
                )

        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def leaked_into(index):
    """A test of texts: whether an item of this broadcast list of indexes leaked into it."""

    def leaked(text: pd.Series) -> pd.Series:
        out, at = np.zeros(len(text), bool), 0
        for part in pieces([pd.DataFrame({"text": text})], most=BATCH):
            out[[at + d for d, _, _ in leaks(part.text.tolist(), index.value)]] = True
            at += len(part)
        return pd.Series(out)

    return F.pandas_udf(leaked, "boolean")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, all columns, without the rows into which an item leaked, as matched() finds them.

    Null and empty texts stay, and so does everything where there are no items. Rows are judged one by one: of repeated rows all stay or all go, a null doc_id is no different."""
    for index in indexes(docs.sparkSession, items):
        docs = docs.where(~leaked_into(index)(F.col("text").cast("string")))
    return docs


def op1_bm25_decontamination(spark, sf_dir):
    """Leaks of all benchmark items into all documents."""
    return matched(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
