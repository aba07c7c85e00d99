"""Best-fit packing of tokenised documents by linear grouping.

Documents become token ids; longer ones than a sequence are cut. Packing needs only how many pieces have
each length, at most 2047 counts, so the plan is made on the driver whatever the corpus size:

1. Large lengths are put in groups of equal cardinality, each rounded up to the largest length in its group.
2. The few sizes left make a cutting-stock problem: column generation over configurations (which sizes share a
   sequence), knapsack pricing by dynamic programming; whole multiples are kept, the rest goes by best fit.
3. Actual documents take the places of the rounded sizes, the longest first, so runs of sequences
   that hold the same lengths are planned as one.
4. Small lengths go by best fit, the longest first, into the room that is left, then into new sequences.

The plan says, per length, which stretch of that length's pieces goes to which run of sequences at which
offset; pieces find their place by their number within their length, in one join with that small table.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietlog.llm.store import written
from quietlog.llm.textcore import BATCH, U64, Batch, mix, pieces, small_batches

CAPACITY = 2048
NUMBER_BUCKETS = 512
#: Chunks, and tokens of chunks, that a generation of kept ids holds at most.
CHUNKS_KEPT, TOKENS_KEPT = 650_000, 4_000_000
#: Chunks of printable ASCII and precomposed Latin letters: no normal form or case mapping changes them once they are in lower case.
PLAIN = regex.compile("[\x21-\x7e\u00c0-\u024f]+")
#: How the vocabulary's own rules cut a chunk before merging: each piece is merged by itself, and the last token of a piece alone ends with END_MARK.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END_MARK = "</w>"
BETWEEN = np.zeros(256, bool)
BETWEEN[[0x20, 0x0A]] = True


class Kept:
    """Ids of chunks by 128 bits of hash: an open table in numpy arrays, some 50 bytes a chunk, that finds many chunks at a time."""

    def __init__(self, most: int = CHUNKS_KEPT):
        self.most = most
        slots = 1 << max(4, int(most * 1.5).bit_length())
        self.shift = U64(64 - slots.bit_length() + 1)
        self.key, self.check = np.zeros(slots, U64), np.zeros(slots, U64)
        self.start, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        #: The first token, 0, closes documents.
        self.tokens, self.used, self.n = np.zeros(1 << 12, np.uint32), 1, 0

    def full(self) -> bool:
        return self.n > self.most or self.used > TOKENS_KEPT

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slots of chunks; -1 for those that are not there. A key is never 0."""
        out = np.full(len(key), -1)
        todo = np.arange(len(key))
        at = (key >> self.shift).astype(np.int64)
        while len(todo):
            there = self.key[at]
            hit = (there == key[todo]) & (self.check[at] == check[todo])
            out[todo[hit]] = at[hit]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.key) - 1)
        return out

    def add(self, key: np.ndarray, check: np.ndarray, tokens: np.ndarray, size: np.ndarray) -> None:
        """Chunks that are not there yet, each once, their tokens one after another. The table grows as it must: full() says when to begin another."""
        need = self.used + len(tokens)
        if need > len(self.tokens):
            self.tokens = np.append(self.tokens, np.zeros(max(need, 2 * len(self.tokens)) - len(self.tokens), np.uint32))
        self.tokens[self.used : need] = tokens
        start = self.used + np.cumsum(size) - size
        self.used, self.n = need, self.n + len(key)
        while 4 * self.n > 3 * len(self.key):
            self.grow()
        todo = np.arange(len(key))
        at = (key >> self.shift).astype(np.int64)
        while len(todo):
            free = self.key[at] == 0
            self.key[at[free]] = key[todo[free]]  # of several that want one place the last gets it
            own = free & (self.key[at] == key[todo])
            # Two chunks with one key and different checks: the slot holds the check that was written last.
            self.check[at[own]] = check[todo[own]]
            own &= self.check[at] == check[todo]
            self.start[at[own]], self.size[at[own]] = start[todo[own]], size[todo[own]]
            todo, at = todo[~own], (at[~own] + 1) & (len(self.key) - 1)

    def grow(self) -> None:
        old = np.flatnonzero(self.key)
        key, check, start, size = self.key[old], self.check[old], self.start[old], self.size[old]
        slots = 2 * len(self.key)
        self.shift -= U64(1)
        self.key, self.check = np.zeros(slots, U64), np.zeros(slots, U64)
        self.start, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        todo, at = np.arange(len(key)), (key >> self.shift).astype(np.int64)
        while len(todo):
            free = self.key[at] == 0
            self.key[at[free]], self.check[at[free]] = key[todo[free]], check[todo[free]]
            own = free & (self.key[at] == key[todo]) & (self.check[at] == check[todo])
            self.start[at[own]], self.size[at[own]] = start[todo[own]], size[todo[own]]
            todo, at = todo[~own], (at[~own] + 1) & (len(self.key) - 1)

    def gathered(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of these slots one after another, how many of each). Slot -1: the closing token."""
        size = np.where(slot < 0, 1, self.size[slot])
        start = np.where(slot < 0, 0, self.start[slot])
        at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        return self.tokens[at], size


class Encoder:
    """Token ids of texts. No token spans white space in these vocabularies, so ids of the chunks between spaces and line feeds are kept and used again, in two
    generations: a chunk that is not used during one is forgotten."""

    def __init__(self, path: str, chunks: int = CHUNKS_KEPT):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_file(path), None
        how = json.loads(self.tokenizer.to_str())
        steps = (how["pre_tokenizer"] or {}).get("pretokenizers", [])
        if len(steps) == 2 and steps[0].get("pattern") == {"Regex": PIECE.pattern} and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and how["model"].get("end_of_word_suffix") == END_MARK:
            # The vocabulary cuts as PIECE does, so pieces of plain chunks need its merges only.
            self.merger = Tokenizer(self.tokenizer.model)
            self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(END_MARK)]] = True
        self.now, self.before = Kept(chunks), Kept(0)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks one after another, how many of each), by the tokenizer itself."""
        found = [np.array(e.ids, np.uint32) for at in range(0, len(chunks), 1000) for e in self.tokenizer.encode_batch_fast(chunks[at : at + 1000], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces, many in one call: the token that closes a piece tells where it ends."""
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(self.merger.encode_batch_fast([" ".join(pieces[at : at + 1000])], add_special_tokens=False)[0].ids, np.uint32) for at in range(0, len(pieces), 1000))])
        size = np.diff(np.flatnonzero(self.closes[ids]) + 1, prepend=0)
        return (ids, size) if len(size) == len(pieces) and size.sum() == len(ids) else self.encode(pieces)

    def learn(self, b: Batch, key: np.ndarray, check: np.ndarray, new: np.ndarray) -> None:
        """Keeps the chunks `new` of a batch. Plain ones of several pieces are put together from those."""
        text = [b.raw[s:e].decode("utf-8", "surrogatepass") for s, e in zip(b.start[new].tolist(), b.end[new].tolist(), strict=True)]
        parts = [None if not self.merger or not PLAIN.fullmatch(w) or "<|" in w else [w] if w.isalpha() else PIECE.findall(w) for w in text]
        kind = np.fromiter((0 if p is None else min(len(p), 2) for p in parts), np.int64, len(parts))
        for own, by in ((kind == 0, self.encode), (kind == 1, self.merge)):
            if own.any():
                self.now.add(key[new[own]], check[new[own]], *by([text[i] for i in np.flatnonzero(own)]))
        several = [parts[i] for i in np.flatnonzero(kind == 2)]
        if several:
            pieces = Batch([" ".join(p for own in several for p in own)], gaps=BETWEEN)
            slot = self.known(pieces)
            ids, size = self.now.gathered(slot)
            # A chunk that is a piece of another new one may be there by now.
            at = new[kind == 2]
            self.now.add(key[at], check[at], ids, np.add.reduceat(size, np.cumsum([0, *map(len, several)])[:-1]))

    def known(self, b: Batch) -> np.ndarray:
        """The slot of each chunk of the batch; those that are new are encoded first."""
        key, check = b.hashes() | U64(1), b.hashes(salt=1)
        slot = self.now.find(key, check)
        lost = np.flatnonzero(slot < 0)
        if len(lost):
            lost = lost[np.unique(key[lost] ^ mix(check[lost]), return_index=True)[1]]
            old = self.before.find(key[lost], check[lost])
            again, new = lost[old >= 0], lost[old < 0]
            if len(again):
                self.now.add(key[again], check[again], *self.before.gathered(old[old >= 0]))
            if len(new):
                self.learn(b, key, check, new)
            slot = self.now.find(key, check)
        return slot

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(little-endian unsigned 32-bit ids of all texts, each with a closing 0; how many of each text)."""
        long = [i for i, t in enumerate(texts) if t is not None and len(t) > BATCH and "<|" not in t]
        ids, count = self.short([None if i in long else t for i, t in enumerate(texts)] if long else texts)
        if long:
            # A long text goes stretch by stretch, so that working memory does not grow with it; no chunk crosses a space or a line feed.
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in long:
                parts[i] = np.concatenate([*(self.short([part])[0][:-1] for part in stretches(texts[i])), np.zeros(1, "<u4")])
            ids, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, count

    def short(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """flat() in one go."""
        # The vocabulary lower-cases one character at a time: the same as Python, but for a last sigma; and special tokens are found before that.
        odd = [i for i, t in enumerate(texts) if t is not None and ("<|" in t or "\u03a3" in t)]
        b = Batch([None if t is None or "<|" in t or "\u03a3" in t else t for t in texts] if odd else texts, lower=True, gaps=BETWEEN)
        if self.now.full():
            self.now, self.before = Kept(self.now.most), self.now
        slot = np.insert(self.known(b), b.first[1:], -1)
        ids, size = self.now.gathered(slot)
        last = b.first[1:] + np.arange(len(texts))  # the places of the closing tokens
        end = np.cumsum(size)[last]
        count = np.diff(end, prepend=0)
        if odd:
            parts = np.split(ids, end[:-1])
            for i in odd:
                parts[i] = np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, 0], np.uint32)
            ids, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids.astype("<u4", copy=False), count


    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, count = self.flat(texts)
        return [x[:-1].tobytes() for x in np.split(ids, np.cumsum(count)[:-1])] if len(count) else []


def stretches(text: str, most: int = BATCH) -> Iterator[str]:
    """The text in stretches of at most `most` characters that end at a space or a line feed, which is left out; a longer word is a stretch of its own."""
    lo = 0
    while len(text) - lo > most:
        cut = max(text.rfind(" ", lo, lo + most), text.rfind("\n", lo, lo + most))
        if cut <= lo:
            ends = [x for x in (text.find(" ", lo + most), text.find("\n", lo + most)) if x >= 0]
            cut = min(ends, default=len(text))
        yield text[lo:cut]
        lo = cut + 1
    if lo < len(text):
        yield text[lo:]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(tokenizer_path: str, capacity: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer_path)
        for pdf in pieces(it):
            ids, count = encoder.flat([t if isinstance(t, str) else None for t in pdf.text])
            parts = -(-count // capacity)
            of = np.repeat(np.arange(len(pdf)), parts)
            number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = number * capacity
            length = np.minimum(count[of] - start, capacity)
            at = ((np.cumsum(count) - count)[of] + start) * 4
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[lo : lo + 4 * n]) for lo, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64").array[of], "piece": number.astype(np.int32), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64)})

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with a closing 0, cut at capacity."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        encoded(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations of the few sizes and how often each is used: column generation on the covering program,
    whole parts kept. What they leave of the demand is up to the caller."""
    m, d = len(sizes), np.array(demand, float)
    columns = [[capacity // s if i == j else 0 for i in range(m)] for j, s in enumerate(sizes)]
    basis = list(range(m))
    for _ in range(60 * m):
        matrix = np.array([columns[j] for j in basis], float).T
        inverse = np.linalg.inv(matrix)
        x, duals = inverse @ d, inverse.sum(axis=0)
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            if duals[i] <= 1e-12:
                continue
            for room in range(s, capacity + 1):
                if best[room - s] + duals[i] > best[room] + 1e-12:
                    best[room], last[room] = best[room - s] + duals[i], i
        room = int(np.argmax(best))
        if best[room] <= 1 + 1e-9:
            break
        new = [0] * m
        while room > 0 and last[room] >= 0:
            i = int(last[room])
            new[i] += 1
            room -= sizes[i]
        way = inverse @ np.array(new, float)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        columns.append(new)
        basis[int(np.argmin(ratio))] = len(columns) - 1
    matrix = np.array([columns[j] for j in basis], float).T
    return [(columns[j], int(v + 1e-9)) for j, v in zip(basis, np.linalg.solve(matrix, d), strict=True) if v >= 1 - 1e-9]


def plan(counts: dict[int, int], capacity: int = CAPACITY, shares: tuple[float, ...] = (0.125, 0.25, 0.4, 0.5)) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan with the fewest sequences of those that take lengths above some share of the capacity as large: rounding costs most where
    large pieces are many and small ones too few to fill what it leaves."""
    return min((plan_with(counts, capacity, small_share=share) for share in shares), key=lambda p: p[1])


def plan_with(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 24, small_share: float = 0.125) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first, n, sequence, offset): pieces first .. first+n-1 of that length go to sequences
    sequence .. sequence+n-1 at that offset; and the number of sequences."""
    rows: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = dict.fromkeys(counts, 0)
    runs: list[list[int]] = []  # [room left, first sequence, n]
    total = 0

    def put(length: int, n: int, run: list[int]) -> None:
        rows.append((length, used[length], n, run[1], capacity - run[0]))
        used[length] += n
        run[0] -= length

    if counts.get(capacity):
        rows.append((capacity, 0, counts[capacity], 0, 0))
        total = counts[capacity]
    large = sorted((s for s in counts if s < capacity and s > small_share * capacity), reverse=True)
    many = sum(counts[s] for s in large)
    left = {s: counts[s] for s in large}
    if large:
        # Groups of equal cardinality; a length that many pieces have may lie in several.
        per, sizes, demand, stretch = max(1, -(-many // groups)), [], [], []
        queue = [[s, counts[s]] for s in large]
        while queue:
            want, own = per, []
            while want and queue:
                take = min(want, queue[0][1])
                own.append([queue[0][0], take])
                queue[0][1] -= take
                want -= take
                if not queue[0][1]:
                    queue.pop(0)
            if sizes and sizes[-1] == own[0][0]:
                demand[-1] += per - want
                stretch[-1] += own
            else:
                sizes.append(own[0][0])
                demand.append(per - want)
                stretch.append(own)
        for columns, times in configurations(sizes, demand, capacity):
            todo = [[capacity, total, times]]
            total += times
            for j in range(len(sizes)):
                for _ in range(columns[j]):
                    # One document of group j for each of these sequences, the longest first: runs split where the length changes.
                    split: list[list[int]] = []
                    for run in todo:
                        while run[2]:
                            if not stretch[j]:
                                split.append(run)
                                break
                            s, n = stretch[j][0]
                            n = min(n, run[2])
                            part = [run[0], run[1], n]
                            put(s, n, part)
                            left[s] -= n
                            split.append(part)
                            run = [run[0], run[1] + n, run[2] - n]
                            stretch[j][0][1] -= n
                            if not stretch[j][0][1]:
                                stretch[j].pop(0)
                    todo = split
            runs += todo
    rest = [(s, left[s]) for s in large if left[s]] + [(s, counts[s]) for s in sorted(counts, reverse=True) if s <= small_share * capacity]
    runs.sort()
    for s, n in rest:
        while n:
            # Best fit: the run with the least room that is enough; as many at once as that run has sequences, or as one sequence holds.
            at = bisect.bisect_left(runs, [s])
            if at == len(runs):
                fits = capacity // s
                full, over = divmod(n, fits)
                for many_in, times in ((fits, full), (over, 1)):
                    if many_in and times:
                        run = [capacity, total, times]
                        total += times
                        for _ in range(many_in):
                            put(s, times, run)
                        bisect.insort(runs, run)
                n = 0
            else:
                run = runs.pop(at)
                take = min(n, run[2])
                part = [run[0], run[1], take]
                if take < run[2]:
                    bisect.insort(runs, [run[0], run[1] + take, run[2] - take])
                put(s, take, part)
                n -= take
                bisect.insort(runs, part)
    return rows, total


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id 0. Repeated rows are packed each; a null doc_id stays null. Other
    columns are not read. Only lengths' counts (at most capacity of them) reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(token_pieces(docs, tokenizer_path, capacity), "pieces")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(NUMBER_BUCKETS)))
    some = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))  # at most capacity * NUMBER_BUCKETS rows
    counts = {r[0]: r[1] for r in some.groupBy("length").agg(F.sum("n")).collect()}
    places, _ = plan(counts, capacity)
    firsts = some.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first_in"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("row_in", F.row_number().over(inside) - 1).join(firsts, ["length", "bucket"]).withColumn("number", F.col("first_in") + F.col("row_in"))
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 0)], "at_length long, first long, n long, sequence long, at_offset long")
    found = rows.join(F.broadcast(table), (F.col("length") == F.col("at_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), F.col("at_offset").alias("offset"))


def op6_best_fit_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
