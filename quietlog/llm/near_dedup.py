"""MinHash near-dedup with DartMinHash signatures.

A text is the set of its five-word shingles, each with a weight. Every unit cell of an element's weight is a region in which a hash throws darts: ranks
that arrive as a Poisson process, each with a weight coordinate, an identity and one of K coordinates of the signature. A dart counts where its
weight coordinate lies below the weight; the earliest per coordinate is kept. Darts depend on the element alone, so two texts keep the same dart with their
weighted Jaccard similarity as the chance; only ranks up to (K ln K + 2K) over the total weight are thrown, which fill nearly all coordinates at about that
many darts a text, however long it is; where one stays empty, the text throws twice as far.

Signatures join by bands. Texts with the same words are one node from the start. Buckets join nodes to candidate groups, without emitting pairs; a group is compared in one
task on the full shingle sets, exactly, and gives only the links that join its classes. A group too large for a task is compared bucket by bucket,
and a large bucket as pairs of blocks, so no task holds an unbounded group and no pair that shares a band
is left out. In a group that fits a task all pairs are compared, those that share no band too; in one too large only those that share a band."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietlog.llm.graph import components
from quietlog.llm.repeats import DID, LAST, TH, bitmap, keyed, named_rows, parted
from quietlog.llm.store import written
from quietlog.llm.textcore import BASE, PUNCTUATED, U64, Batch, grams, mix, objects, pieces, release, small_batches

SHINGLE, SIMILAR = 5, 0.8
K, BANDS, ROWS = 64, 16, 4
#: A candidate group up to this size is compared in one task; a task takes groups of about TASK_SHINGLES shingles.
GROUP_MEMBERS, GROUP_SHINGLES, TASK_SHINGLES, BLOCK_MEMBERS = 4096, 3_000_000, 400_000, 256


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) without repeats, ordered by text and shingle, and a hash of each text's words. Of fewer than k words, the one shingle of all."""
    b = Batch(texts, lower=True, gaps=PUNCTUATED)
    h = b.hashes()
    size = np.diff(b.first)
    g = grams(h, k)
    inside = b.doc[: len(g)] == b.doc[k - 1 :] if len(g) else np.zeros(0, bool)
    at, doc = np.flatnonzero(inside), b.doc[: len(g)][inside]
    short = [(d, grams(h[b.first[d] : b.first[d + 1]], int(size[d]))[0]) for d in np.flatnonzero((size > 0) & (size < k))]
    of = np.concatenate([doc, np.array([d for d, _ in short], np.int64)])
    found = np.concatenate([g[at], np.array([x for _, x in short], U64)])
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    edge = np.ones(len(of), bool)
    edge[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
    start = np.flatnonzero(edge)
    count = np.diff(np.append(start, len(of)))
    node = np.zeros(len(texts), U64)
    if len(h):
        place = np.arange(len(h)) - np.repeat(b.first[:-1], size)
        some = size > 0
        node[some] = np.add.reduceat(mix(h + mix(place.astype(U64) * BASE + U64(1))), b.first[:-1][some])
    return of[start], found[start], count, mix(node + size.astype(U64))


def darts(of: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """Signatures, n rows of k dart identities; a row without weight stays 0. of: each element's row."""
    out = np.zeros((n, k), U64)
    cells = np.ceil(weight).astype(np.int64)
    row, cell = np.repeat(of, cells), np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    region = mix(np.repeat(mix(element), cells) + cell.astype(U64) * BASE)
    part = np.repeat(weight, cells) - cell  # the share of the cell that the weight covers
    total = np.bincount(of, weights=weight, minlength=n)
    far = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        on = todo[row]
        r, c, p = row[on], region[on], part[on]
        rank = np.zeros(len(r))
        places, ids, ranks = [], [], []
        throw = 0
        while len(r):
            dart = mix(c + U64((throw * 0xD1B54A32D192ED03 + 1) % 2**64))
            rank = rank - np.log(((dart >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            near = rank <= far[r]
            r, c, p, rank, dart = r[near], c[near], p[near], rank[near], dart[near]
            more = mix(dart)
            hit = (more >> U64(32)).astype(np.float64) * 2.0**-32 < p
            places.append(r[hit] * k + ((more[hit] & U64(0xFFFFFFFF)) * U64(k) >> U64(32)).astype(np.int64))
            ids.append(mix(more[hit] + U64(7)))
            ranks.append(rank[hit])
            throw += 1
        place, name = np.concatenate(places), np.concatenate(ids)
        order = np.argsort(-np.concatenate(ranks), kind="stable")  # the earliest is written last, and stays
        flat = np.zeros(n * k, U64)
        seen = np.zeros(n * k, bool)
        flat[place[order]] = name[order]
        seen[place] = True
        full = seen.reshape(n, k).all(axis=1) & todo
        out[full] = flat.reshape(n, k)[full]
        todo &= ~full
        far[todo] *= 2
    return out


def bands(signature: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    parts = signature[:, : count * rows].reshape(len(signature), count, rows)
    key = np.zeros(parts.shape[:2], U64)
    for i in range(rows):
        key = key * BASE + parts[:, :, i]
    return mix(key + np.arange(count, dtype=U64) * U64(0xA24BAED4963EE407)).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """did, th (a hash of the text), node (a hash of the words) and bands (empty without words), a row per row."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(it):
            of, found, count, node = shingle_sets(pdf.text.tolist())
            keys = bands(darts(of, found, np.ones(len(of)), len(pdf)))
            some = np.bincount(of, minlength=len(pdf)) > 0
            yield pd.DataFrame({"did": pdf.did.to_numpy(), "th": pdf.th.to_numpy(), "node": node.view(np.int64), "bands": objects([k if s else k[:0] for k, s in zip(keys, some, strict=True)])})

    return keyed(docs).select("did", "th", "text").mapInPandas(run, "did long, th long, node long, bands array<long>")


def forest(names: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links (a, b) of sets with at least that Jaccard similarity, enough of them to join every class. All pairs are looked at, one set against all later
    ones at a time; pairs whose classes are joined already need no link."""
    size = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.cumsum(size) - size
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links, mark = [], np.zeros(int(code.max()) + 1 if len(code) else 1, np.int32)
    for i in range(len(sets) - 1):
        later = first[i + 1]
        mark[code[first[i] : later]] = 1
        common = np.add.reduceat(mark[code[later:]], first[i + 1 :] - later)
        mark[code[first[i] : later]] = 0
        for j in np.flatnonzero(common >= similar * (size[i] + size[i + 1 :] - common) - 1e-9) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(names[i]), int(names[j])))
    return links


def linked(groups: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) within groups (task, grp, node, shingles); a task holds several groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, part in pdf.groupby("grp", sort=False):
            if len(part) > 1:
                rows += forest(part.node.to_numpy(), [np.asarray(x, np.int64) for x in part.shingles], similar)
        release()
        return pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return groups.groupBy("task").applyInPandas(run, "a long, b long")


def classes(docs: DataFrame, similar: float = SIMILAR, group_members: int = GROUP_MEMBERS) -> DataFrame:
    """One row per row of docs: did (doc_id, null as the last), th (a hash of the text), class_did (the least did of its class) and class_node (the class).

    Words are compared lower-cased, without ASCII punctuation. Texts with the same words are one class; texts without words (null, empty, blank) are
    copies of each other. Two texts are linked at a Jaccard similarity of their five-word shingles of at least similar, and classes are what
    links join. Repeated rows and doc_ids are rows each. Other columns are not read."""
    small_batches(docs.sparkSession)
    every = written(signed(docs), "near-signed")
    nodes = written(every.groupBy("node").agg(F.min("did").alias("rep"), F.first("bands").alias("bands")), "near-nodes")
    spread = nodes.select("node", "rep", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("leader")).where("members > 1")
    buckets = written(spread.join(shared, "band"), "near-buckets")
    # Shingle sets of the nodes that meet another one, from one text of each.
    wanted = buckets.select("node", "rep").distinct()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(it):
            of, found, _, node = shingle_sets(pdf.text.tolist())
            cut = np.searchsorted(of, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"rep": pdf.did.to_numpy(), "node": node.view(np.int64), "shingles": objects([found[lo:hi].view(np.int64) for lo, hi in zip(cut, cut[1:], strict=False)])})

    held, _ = parted(keyed(docs).select("did", "text"), bitmap(wanted, "rep"), "did")
    sets = written(held.mapInPandas(run, "rep long, node long, shingles array<long>").join(wanted, ["rep", "node"]).dropDuplicates(["node"]).select("node", "shingles"), "near-sets")

    # Candidate groups: what buckets join, before any comparison. A node is in one group only, so sets move once.
    met = components(buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")))
    met = written(met.join(sets, "node"), "near-met")
    weight = met.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum(F.size("shingles")).alias("weight"))
    weight = written(weight.withColumn("large", (F.col("members") > group_members) | (F.col("weight") > GROUP_SHINGLES)), "near-groups")
    total, large = weight.agg(F.sum("weight"), F.count_if("large")).first()
    tasks = max(1, -(-(total or 0) // TASK_SHINGLES))
    small = met.join(weight.where("not large").select("label"), "label")
    links = linked(small.select(F.pmod(F.xxhash64("label"), F.lit(tasks)).alias("task"), F.col("label").alias("grp"), "node", "shingles"), similar)
    if large:
        # A group too large for a task goes bucket by bucket, a large bucket as pairs of blocks: each pair of nodes of a bucket meets in some task.
        own = met.join(weight.where("large").select("label"), "label").select("node", "shingles")
        place = F.row_number().over(Window.partitionBy("band").orderBy("node")) - 1
        size = min(BLOCK_MEMBERS, group_members)
        parts = buckets.join(own.select("node"), "node").withColumn("block", F.floor(place / size)).withColumn("blocks", F.ceil(F.col("members") / size))
        parts = parts.select("band", "node", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("other"))
        task = F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))
        links = links.unionByName(linked(parts.join(own, "node").select(task.alias("task"), task.alias("grp"), "node", "shingles"), similar))
    of = components(written(links, "near-links"))
    named = nodes.select("node", "rep").join(of, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("class_did"))
    named = named.join(least, "label").select("node", "class_did", F.col("label").alias("class_node"))
    return every.select("did", "th", "node").join(named, "node").drop("node")


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs, all columns, with one row of each class: that of the least doc_id, of equal ones the least by a hash of the text.

    Only rows that go, rows that repeat in full, and a few more are shuffled with their texts."""
    every = written(classes(docs, similar), "near-classes")
    first = every.groupBy("class_node").agg(F.min(F.struct("did", "th")).alias("first")).select("class_node", "first")
    marked = every.join(first, "class_node").select("did", "th", (F.struct("did", "th") == F.col("first")).alias("stays"))
    judged = marked.groupBy("did", "th").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    gone = written(judged.where("not stays or times > 1").select(F.col("did").alias(DID), F.col("th").alias(TH), "stays"), "near-gone")
    hit, rest = parted(named_rows(docs), bitmap(gone, DID, TH), DID, TH)
    hit = hit.join(gone.where("not stays").select(DID, TH), [DID, TH], "left_anti").dropDuplicates([DID, TH])
    return hit.select(*docs.columns).unionByName(rest.select(*docs.columns))


def op9_dart_minhash_dedup(spark, sf_dir):
    """Near-duplicate classes of all documents."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.nullif("did", F.lit(LAST)).alias("doc_id"), F.nullif("class_did", F.lit(LAST)).alias("class_id"))
