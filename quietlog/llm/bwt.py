"""Burrows-Wheeler transforms of small collections of strings, and their merge."""

from __future__ import annotations

import numpy as np


def rotations(symbols: np.ndarray, first: np.ndarray, levels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, before): positions in the order of the circular strings that begin there, ties by position, and each
    position's predecessor in its string. String i is symbols[first[i]:first[i+1]]; by prefix doubling. levels, if given, gets each round's ranks: by 1, 2, 4, ... symbols."""
    n = len(symbols)
    size = np.repeat(np.diff(first), np.diff(first))
    base = np.repeat(first[:-1], np.diff(first))
    at = np.arange(n) - base
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step, longest = 1, int(np.diff(first).max()) if n else 0
    while step < longest and n and rank.max() < n - 1:
        if levels is not None:
            levels.append(rank)
        pair = rank * (n + 1) + rank[base + (at + step) % size]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    if levels is not None:
        levels.append(rank)
    return np.argsort(rank, kind="stable"), base + (at - 1) % size


def common_prefixes(order: np.ndarray, first: np.ndarray, levels: list[np.ndarray], most: int) -> np.ndarray:
    """Common prefix of each place of the order with the one before it, at most `most`; 0 for the first. levels: ranks by 1, 2, 4, ... symbols, as rotations gives them."""
    n = len(order)
    common = np.zeros(n, np.int64)
    if n < 2:
        return common
    size = np.repeat(np.diff(first), np.diff(first))
    base = np.repeat(first[:-1], np.diff(first))
    shift = lambda p, by: base[p] + (p - base[p] + by) % size[p]
    one, two = order[:-1], order[1:]
    found = common[1:]
    top = 1
    while top * 2 <= most:
        top *= 2
    step = top
    while step:
        # A level that was never made was not needed: all ranks, or all whole rotations, were told apart before.
        rank = levels[min(step.bit_length() - 1, len(levels) - 1)]
        same = rank[shift(one, found)] == rank[shift(two, found)]
        found[same] += step
        step //= 2
    return np.minimum(common, most)


def merged(parts: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the transforms of several shards without sorting suffixes again.

    parts: (transform, positions) of each shard. The interleave, which shard each place of the merged order comes from, starts with the shards
    one after another. A round reads the transforms in the interleave's order and sorts the sources stably by
    symbol: after h rounds the interleave is right for prefixes of h symbols. A place where a class of equal prefixes splits in
    round h has a common prefix of h-1 symbols with its predecessor. Stops when nothing splits any more, or at depth.
    Returns (source, position, common prefix with the predecessor, at most depth) in merged order."""
    source = np.repeat(np.arange(len(parts)), [len(b) for b, _ in parts]).astype(np.uint8 if len(parts) < 256 else np.int32)
    n = len(source)
    common = np.full(n, depth, np.int64)
    if n:
        common[0] = 0
    top = max((int(b.max()) for b, _ in parts if len(b)), default=0)
    kind = np.uint16 if top < 1 << 16 else np.int32  # numpy sorts 16-bit integers by radix
    parts_b = [b.astype(kind) for b, _ in parts]
    split = np.zeros(n, bool)
    if n:
        split[0] = True
    for h in range(depth):
        read = np.empty(n, kind)
        for s, b in enumerate(parts_b):
            read[source == s] = b
        order = np.argsort(read, kind="stable")
        group = np.cumsum(split)[order]
        symbol = read[order]
        now = np.ones(n, bool)
        now[1:] = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
        new = now & ~split
        common[new] = h
        after = source[order]
        if h and not new.any() and np.array_equal(after, source):
            break
        source, split = after, now
    position = np.empty(n, np.int64)
    for s, (_, p) in enumerate(parts):
        position[source == s] = p
    return source, position, common
