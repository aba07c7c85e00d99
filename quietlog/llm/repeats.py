"""The part that both substring operators share: which stretches of which documents may repeat, and where they meet.

A window is L units (bytes, or words) in a row. Its minimizer is the k-gram in it with the least hash, the leftmost of equals, so equal windows
have equal minimizers at equal offsets. Windows in a row with one minimizer make a fragment: every window lies in exactly one
fragment, and a window can only repeat in a fragment with the same minimizer, its key. So the work falls apart by key,
whatever the corpus size:

- Fragments whose key occurs once are done: nothing in them repeats. Only hashes have moved so far.
- Equal fragments, of copied documents, are one fragment with a weight.
- A key with one distinct fragment is decided by that weight.
- Other keys are spread over shards of bounded size. Each distinct fragment's units are read once and sent to its key's shard,
  where the operator's index decides (Burrows-Wheeler merge or FM-index).
- A key with more than HOT distinct fragments (a short passage in very many documents) would outgrow a shard: its fragments
  are split into single windows that meet by key, offset and window hash, pre-aggregated before they move.

Verdicts go back to every occurrence by (key, fragment); each document collects its own spans only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.store import written
from quietlog.llm.textcore import U64, mix, objects, pieces, prefix, release, small_batches, span

CHUNK = 1 << 18
HOT = 2048
PER_SHARD = 800
BITMAP = 1 << 22
LAST = 2**63 - 1
#: Names of our own columns beside a caller's.
DID, TH, SPANS, WORD, BITS_OF = "__quietlog_did", "__quietlog_th", "__quietlog_spans", "__quietlog_word", "__quietlog_bits"


def fragments(values: np.ndarray, first: np.ndarray, size: int, k: int, ahead: int = 0) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor, key, hash) of the fragments. values: 64-bit values of all units, one document after
    another; document d has first[d] .. first[d+1]-1. start is in the document; anchor, the minimizer's place, from start. A value may speak for
    the `ahead` units after its own too: then that many fewer of them make up a stretch."""
    width, found = size - k + 1, []
    total = len(values)
    for at in range(0, total, CHUNK):
        own = values[at : at + CHUNK + size - 1]
        if len(own) < size:
            break
        doc = np.searchsorted(first, np.arange(at, at + len(own)), "right") - 1
        room = first[doc + 1] - at - np.arange(len(own))  # units to the end of the document
        p = prefix(own)
        g = span(p, np.arange(len(own) - k + 1), np.arange(k - ahead, len(own) + 1 - ahead))
        least = (g & ~U64((1 << 24) - 1)) | np.arange(len(g), dtype=U64)
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        least = least[:CHUNK]
        n = len(least)
        place = (least & U64((1 << 24) - 1)).astype(np.int64)
        ok = room[:n] >= size
        at_start = ok & np.concatenate([[True], (place[1:] != place[:-1]) | ~ok[:-1] | (doc[1:n] != doc[: n - 1])])
        start = np.flatnonzero(at_start)
        stop = np.flatnonzero(ok & np.concatenate([at_start[1:] | ~ok[1:], [True]])) + 1
        found.append((doc[start], start + at - first[doc[start]], stop - start, place[start] - start, g[place[start]].view(np.int64), span(p, start, stop - 1 + size - ahead).view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


@dataclass(frozen=True)
class Kind:
    """What an operator's windows are made of, and how its shards decide."""

    name: str
    size: int
    k: int
    #: texts -> (64-bit values of all units, first unit of each document)
    units: Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]
    #: texts -> (units as they are sent to a shard, first unit of each document)
    payload: Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]
    #: (units of each fragment, windows, anchor, weight, least document) -> per fragment rows (from, to, value) of windows
    decide: Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]
    #: whether the value of a window is the least document with it (else its weight, of 2 or more)
    by_document: bool
    #: units after its own that a unit's value speaks for too
    ahead: int = 0
    #: numpy's type of a unit as it is sent
    sent: str = "<u8"


def keyed(docs: DataFrame) -> DataFrame:
    """did (doc_id, null as the last), th (a hash of the text) and the text: what tells rows apart. Rows equal in both have equal results."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("th"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def bitmap(df: DataFrame, *columns: str) -> np.ndarray:
    """BITMAP bits, set where a row's hash points: a first filter of constant size. Where it fills up, nothing is filtered, and nothing is lost."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(BITMAP))
    rows = df.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(columns)}), {BITMAP}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(BITMAP // 64, np.int64)
    got = rows.toPandas()  # at most BITMAP / 64 rows
    out[got.word.to_numpy(np.int64)] = got.bits.to_numpy(np.int64)
    return out


def parted(rows: DataFrame, bits: np.ndarray, *on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose bit is set by a hash of the columns on, and the others. All other columns stay, whatever their names."""
    spark = rows.sparkSession
    words = np.flatnonzero(bits)
    table = F.broadcast(spark.createDataFrame(pd.DataFrame({WORD: words, BITS_OF: bits[words]}), f"{WORD} long, {BITS_OF} long"))
    spot = F.pmod(F.xxhash64(*on), F.lit(BITMAP))
    marked = rows.join(table, F.shiftright(spot, 6) == F.col(WORD), "left").drop(WORD)
    test = F.expr(f"coalesce(shiftright({BITS_OF}, cast(pmod(xxhash64({', '.join(on)}), {BITMAP}) & 63 as int)) & 1, 0) = 1")
    return marked.where(test).drop(BITS_OF), marked.where(~test).drop(BITS_OF)


def fragment_table(docs: DataFrame, kind: Kind) -> DataFrame:
    """One row per fragment: key, frag, did, th, s, n, a. Written once, a row per document."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(it):
            doc, s, n, a, key, frag = fragments(*kind.units(pdf.text.tolist()), kind.size, kind.k, kind.ahead)
            cut = np.searchsorted(doc, np.arange(len(pdf) + 1))
            some = np.flatnonzero(np.diff(cut))
            part = lambda x: objects([x[cut[d] : cut[d + 1]] for d in some])  # noqa: B023, E731
            yield pd.DataFrame({"did": pdf.did.to_numpy()[some], "th": pdf.th.to_numpy()[some], "key": part(key), "frag": part(frag), "s": part(s.astype(np.int32)), "n": part(n.astype(np.int32)), "a": part(a.astype(np.int32))})

    rows = keyed(docs).select("did", "th", "text").mapInPandas(run, "did long, th long, key array<long>, frag array<long>, s array<int>, n array<int>, a array<int>")
    rows = written(rows, f"{kind.name}-fragments")
    return rows.select("did", "th", F.explode(F.arrays_zip("key", "frag", "s", "n", "a")).alias("f")).select("did", "th", "f.*")


def runs_of(value: np.ndarray, n: np.ndarray, none: int) -> list[np.ndarray]:
    """Per fragment, rows (from, to, value) of windows with one value; none stands for no match. value: of all windows, fragment after fragment."""
    first = np.concatenate([[0], np.cumsum(n)])
    edge = np.zeros(len(value), bool)
    edge[first[:-1][n > 0]] = True
    edge[1:] |= value[1:] != value[:-1]
    start = np.flatnonzero(edge)
    stop = np.append(start[1:], len(value))
    ok = value[start] != none
    start, stop = start[ok], stop[ok]
    of = np.searchsorted(first, start, "right") - 1
    rows = np.stack([start - first[of], stop - first[of], value[start]], axis=1)
    return np.split(rows, np.searchsorted(of, np.arange(1, len(n))))


RUNS = "runs array<struct<lo:int,hi:int,val:long>>"


def as_runs(rows: list[np.ndarray]) -> list[list[dict]]:
    return [[{"lo": int(a), "hi": int(b), "val": int(v)} for a, b, v in r] for r in rows]


def verdicts(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """(occurrences of fragments that may repeat: key, frag, did, th, s; their verdicts: key, frag, runs)."""
    small_batches(docs.sparkSession)
    every = fragment_table(docs, kind)
    # Keys that occur once are out; what stays is written, so that AQE may split a hot key's side of this join.
    twice = every.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    live = written(every.join(twice, "key", "inner"), f"{kind.name}-live")
    distinct = live.groupBy("key", "frag").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("did", "th", "s")).alias("rep"), F.first("n").alias("n"), F.first("a").alias("a"))
    distinct = written(distinct, f"{kind.name}-distinct")
    per_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    value = "rep.did" if kind.by_document else "weight"
    met = distinct.join(per_key, "key")
    alone = met.where("kinds = 1" + ("" if kind.by_document else " and weight > 1")).select("key", "frag", F.expr(f"array(named_struct('lo', 0, 'hi', n, 'val', {value}))").alias("runs"))
    met = written(met.where("kinds > 1"), f"{kind.name}-met")
    n_met, n_hot = met.agg(F.count(F.lit(1)), F.count(F.when(F.col("kinds") > HOT, 1))).first()
    if not n_met:
        return live, alone
    shards = max(1, -(-n_met // PER_SHARD))
    wanted = met.groupBy("rep.did", "rep.th").agg(F.collect_list(F.struct("key", "frag", F.col("rep.s").alias("s"), "n", "a", "weight", "kinds")).alias("want"))
    holders, _ = parted(keyed(docs).select("did", "th", "text"), bitmap(met.select("rep.did", "rep.th"), "did", "th"), "did", "th")
    holders = holders.join(wanted, ["did", "th"])
    fields = "key long, frag long, n int, a int, weight long, did long"

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, list[np.ndarray], np.ndarray]]:
        """Per batch: a row per wanted fragment, with its units and whether it is of a hot key."""
        for pdf in pieces(it):
            units, first = kind.payload(pdf.text.tolist())
            rows = [(w["key"], w["frag"], w["n"], w["a"], w["weight"], did, w["kinds"] > HOT, f + w["s"]) for did, f, want in zip(pdf.did, first, pdf.want, strict=False) for w in want]
            out = pd.DataFrame(rows, columns=["key", "frag", "n", "a", "weight", "did", "hot", "at"])
            yield out, units, out.pop("at").to_numpy(np.int64), out.pop("hot").to_numpy(bool)

    def cold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out, units, at, hot in cut(it):
            out["payload"] = objects([units[p : p + n - 1 + kind.size].tobytes() for p, n in zip(at, out.n, strict=True)])
            yield out[~hot]

    def windows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out, units, at, hot in cut(it):
            out, at = out[hot], at[hot]
            if not len(out):
                continue
            n = out.n.to_numpy()
            of = np.repeat(np.arange(len(out)), n)
            w = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            hashes = []
            for p, m in zip(at, n, strict=True):
                own = units[p : p + m - 1 + kind.size]
                hashes.append(span(prefix(mix(own.astype(U64) + U64(1))), np.arange(m), np.arange(m) + kind.size))
            yield pd.DataFrame({"key": out.key.to_numpy()[of], "frag": out.frag.to_numpy()[of], "w": w.astype(np.int32), "rel": (w - out.a.to_numpy()[of]).astype(np.int32), "wh": np.concatenate(hashes).view(np.int64), "weight": out.weight.to_numpy()[of], "did": out.did.to_numpy()[of]})

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["key", "frag"])
        parts = [np.frombuffer(x, kind.sent) for x in pdf.payload]
        runs = kind.decide(parts, pdf.n.to_numpy(np.int64), pdf.a.to_numpy(np.int64), pdf.weight.to_numpy(np.int64), pdf.did.to_numpy(np.int64))
        out = pd.DataFrame({"key": pdf.key.to_numpy(), "frag": pdf.frag.to_numpy(), "runs": objects(as_runs(runs))})
        del parts, runs
        release()
        return out

    sent = holders.mapInPandas(cold, fields + ", payload binary").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    found = alone.unionByName(sent.groupBy("shard").applyInPandas(decide, f"key long, frag long, {RUNS}"))
    if n_hot:
        # Rows that repeat in full are one fragment each: distinct before weights are added up.
        single = holders.mapInPandas(windows, "key long, frag long, w int, rel int, wh long, weight long, did long").dropDuplicates(["key", "frag", "w"])
        single = written(single, f"{kind.name}-windows")
        shared = single.groupBy("key", "rel", "wh").agg(F.sum("weight").alias("total"), F.min("did").alias("least")).where("total > 1")
        back = single.join(shared, ["key", "rel", "wh"]).groupBy("key", "frag").agg(F.sort_array(F.collect_list(F.struct(F.col("w").alias("lo"), (F.col("w") + 1).alias("hi"), F.col("least" if kind.by_document else "total").alias("val")))).alias("runs"))
        found = found.unionByName(back)
    return live, found


def spans(docs: DataFrame, kind: Kind) -> DataFrame:
    """did, th, spans: per document with something to remove, stretches (lo, hi) of units that windows cover, unordered, that may overlap."""
    live, found = verdicts(docs, kind)
    rows = live.join(found, ["key", "frag"]).select("did", "th", "s", F.explode("runs").alias("r"))
    rows = rows.where(F.col("r.val") < F.col("did")) if kind.by_document else rows.where("r.val > 1")
    # Equal rows of the table give equal spans: one set is enough.
    rows = rows.select("did", "th", (F.col("s") + F.col("r.lo")).alias("lo"), (F.col("s") + F.col("r.hi") - 1 + kind.size).alias("hi"))
    return written(rows.groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), f"{kind.name}-spans")


def covered(n: int, found: list | None) -> np.ndarray:
    """Which of n units the spans cover."""
    step = np.zeros(n + 1, np.int64)
    if found is not None and len(found):
        lo = np.fromiter((x["lo"] for x in found), np.int64, len(found))
        hi = np.fromiter((x["hi"] for x in found), np.int64, len(found))
        np.add.at(step, lo, 1)
        np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0


def named_rows(docs: DataFrame) -> DataFrame:
    """docs, all columns, with DID and TH, as keyed() has them."""
    return docs.withColumns({DID: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), TH: F.xxhash64(F.col("text").cast("string"))})


def with_spans(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """Rows of docs, all columns, that may lose something, with SPANS (null: nothing), and the rows that lose nothing. Only the first are shuffled."""
    found = spans(docs, kind)
    hit, rest = parted(named_rows(docs), bitmap(found, "did", "th"), DID, TH)
    found = found.select(F.col("did").alias(DID), F.col("th").alias(TH), F.col("spans").alias(SPANS))
    return hit.join(found, [DID, TH], "left").drop(DID, TH), rest.drop(DID, TH)


def all_with_spans(docs: DataFrame, kind: Kind) -> DataFrame:
    """doc_id, text, spans of every row."""
    hit, rest = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), kind)
    return hit.withColumnRenamed(SPANS, "spans").unionByName(rest.withColumn("spans", F.lit(None).cast("array<struct<lo:int,hi:int>>")))
