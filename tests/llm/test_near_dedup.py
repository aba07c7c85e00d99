import random
import re

import numpy as np
import pytest

from quietlog.llm import near_dedup
from quietlog.llm.textcore import U64

SPLIT = re.compile(r"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def sets(text):
    w = SPLIT.findall((text or "").lower())
    k = min(5, len(w)) or 1
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {()}


def brute(docs, similar=0.8):
    s = [sets(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(s[i] & s[j]) >= similar * len(s[i] | s[j]) - 1e-9:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(2**63 - 1 if d is None else d)
    return sorted((d if d is not None else 2**63 - 1, min(groups[root(i)])) for i, (d, _) in enumerate(docs))


def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice("lorem ipsum dolor sit amet sed do".split()) + str(rng.randrange(300))
    base = [[word() for _ in range(150)] for _ in range(6)]
    docs = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(60):  # a chain of copies: each like the one before, the last unlike the first
        b = base[0] if i < 30 else base[1]
        b[rng.randrange(150)] = word()
        docs.append((10 + i, " ".join(b)))
    docs += [(90, docs[2][1].upper() + "!"), (91, docs[2][1]), (92, None), (93, ""), (94, " . "), (95, "one two"), (96, "One, two."), (97, "one two three"), (None, docs[3][1]), (98, "la " * 30000)]
    return docs


@pytest.mark.parametrize("members", [4096, 3])
def test_classes_as_brute_force(make, members):
    docs = corpus()
    got = sorted((r.did, r.class_did) for r in near_dedup.classes(make(docs), group_members=members).collect())
    assert got == brute(docs)


def test_one_of_each_keeps_the_first(make):
    docs = corpus() + [(91, corpus()[2][1])]
    kept = near_dedup.one_of_each(make(docs))
    assert kept.columns == make([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(docs)})


def test_empty_table(make):
    assert near_dedup.classes(make([])).collect() == []
    assert near_dedup.one_of_each(make([])).collect() == []


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    weight = {x: float(rng.integers(1, 4)) + float(rng.random()) * 0.5 for x in range(1, 400)}
    a, b = list(range(1, 300)), list(range(100, 400))
    pack = lambda xs: (np.array(xs, U64) * U64(0x9E3779B97F4A7C15), np.array([weight[x] for x in xs]))
    (ea, wa), (eb, wb) = pack(a), pack(b)
    k = 2048
    s = near_dedup.darts(np.repeat([0, 1], [len(ea), len(eb)]), np.concatenate([ea, eb]), np.concatenate([wa, wb]), 2, k)
    both = sum(weight[x] for x in set(a) & set(b)) / sum(weight[x] for x in set(a) | set(b))
    assert abs((s[0] == s[1]).mean() - both) < 0.05
    assert (s != 0).all()


def test_weights_that_grow_keep_the_darts_of_the_smaller():
    e = np.arange(1, 50, dtype=U64) * U64(0x9E3779B97F4A7C15)
    s = near_dedup.darts(np.repeat([0, 1], 49), np.concatenate([e, e]), np.concatenate([np.full(49, 1.0), np.full(49, 2.0)]), 2, 1024)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.07
