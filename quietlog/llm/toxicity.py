"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning sees a bounded sample of the labelled texts, one at a time: every coordinate has its own
rate, and the L1 term keeps most weights at exactly zero, so the model is a short list of (feature, weight) that is
broadcast (at most 2^BITS of them). Scoring is one pass over all texts, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.textcore import PUNCTUATED, U64, Batch, mix, objects, pieces, small_batches

BITS = 20
STEMS = (4, 5, 6)
MAX_TRAIN = 8000
THRESHOLD = 0.7


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of single words, word pairs, and pairs with one word between, lower-cased, without punctuation; repeats stay.

    A single word counts as itself and as its stems, its first 4, 5 and 6 bytes where it is longer: in inflected languages most forms of a word are rare."""
    b = Batch(texts, lower=True, gaps=PUNCTUATED)
    h, doc, size = b.hashes(), b.doc, b.end - b.start
    found, of = [h], [doc]
    for most in STEMS:
        longer = size > most
        found.append(mix(b.hashes(most)[longer] + U64(most)))
        of.append(doc[longer])
    for gap, salt in ((1, 0xA5A5A5A5), (2, 0x5A5A5A5B)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            found.append(mix(h[:-gap] * U64(0x9E3779B97F4A7C15 + 2 * salt) + h[gap:])[same])
            of.append(doc[:-gap][same])
    return np.concatenate(of), (np.concatenate(found) >> U64(64 - BITS)).astype(np.int64)


def learn(examples: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.0, epochs: int = 8) -> tuple[np.ndarray, float]:
    """FTRL-proximal weights of presence features, and the bias. examples: (features, label), in the order to learn in."""
    size = (1 << BITS) + 1  # the last is the bias, without a penalty
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for at, label in examples:
            at = np.append(at, size - 1)
            zz, nn = z[at], n[at]
            w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
            w[np.abs(zz) <= l1] = 0
            w[-1] = -zz[-1] / ((beta + np.sqrt(nn[-1])) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    w[np.abs(z) <= l1] = 0
    bias = float(-z[-1] / ((beta + np.sqrt(n[-1])) / alpha + l2))
    return w[:-1], bias


def training_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pieces(it):
        of, found = features(pdf.text.tolist())
        key = np.unique((of << BITS) | found)
        cut = np.searchsorted(key >> BITS, np.arange(len(pdf) + 1))
        found = (key & ((1 << BITS) - 1)).astype(np.int32)
        yield pd.DataFrame({"doc_id": pdf.doc_id.to_numpy(), "label": pdf.label.to_numpy(), "found": objects([found[a:b] for a, b in zip(cut, cut[1:], strict=False)])})


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, held_out_of: int | None = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight other than 0, their weights, and the bias.

    Learns from labelled documents but those held out (crc32 of the doc_id as text, modulo held_out_of, is 1). With more than
    max_train of them, from the max_train lowest by a hash of doc_id. Several labels of a document: the highest counts; null labels and labels without a
    document are left out. With labels of one kind or none, the score is their share for every text (0 without any)."""
    small_batches(docs.sparkSession)
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label is not null")
    if held_out_of:
        of = of.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of != 1)
    some = of.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(some), "doc_id").mapInPandas(training_rows, "doc_id long, label int, found array<int>")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf.doc_id, mix(pdf.doc_id.to_numpy(np.int64).astype(U64))))]
        w, bias = learn([(np.asarray(f, np.int64), int(y)) for f, y in zip(pdf.found, pdf.label, strict=True)])
        if pdf.label.nunique() < 2:
            w, bias = w * 0, 35.0 if pdf.label.max() else -35.0
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": np.append(at, -1), "weight": np.append(w[at], bias)})

    # One task by intent: max_train rows at most, so its size does not grow with the corpus.
    model = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "feature long, weight double").collect()
    bias = next((r.weight for r in model if r.feature == -1), -35.0)
    model = sorted((r.feature, r.weight) for r in model if r.feature >= 0)
    return np.array([f for f, _ in model], np.int64), np.array([w for _, w in model], np.float64), bias


def score_texts(texts: list[str | None], dense: np.ndarray, bias: float) -> np.ndarray:
    of, found = features(texts)
    w = dense[found]
    key = np.unique((of[w != 0] << BITS) | found[w != 0])
    total = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], carry: list[str], score: str = "score") -> DataFrame:
    """The columns carry of docs and the score of the text, 0 to 1. A null text scores as an empty one: by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*carry).schema.add(score, "double")
    as_is = [c for c in carry if c != "text"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for pdf in pieces(it):
            out = pdf[carry].copy()
            out[score] = score_texts(pdf.text.tolist(), dense, bias)
            yield out

    return docs.select("text", *as_is).mapInPandas(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. A null doc_id is not held out and not learnt from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored(rows, train(docs, labels), ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows whose text scores threshold or more."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for texts in parts:
            yield pd.Series(np.concatenate([score_texts(p.text.tolist(), dense, bias) for p in pieces([pd.DataFrame({"text": texts})])] or [np.zeros(0)]))

    return docs.where(score(F.col("text").cast("string")) < threshold)


def op4_ftrl_toxicity(spark, sf_dir):
    """Every document's toxicity."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
