"""Substring operators against brute force, on the cluster path, hot keys included."""

import hashlib
import random
import re

import numpy as np
import pytest

from quietlog.llm import repeats, substring_bwt, substring_fm
from quietlog.llm.bwt import merged, rotations
from quietlog.llm.textcore import Batch

random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "ein", "été", "ñu", "x"]
PROSE = lambda n, seed: " ".join(random.Random(seed).choice(WORDS) + str(random.Random(seed * 7 + i).randrange(900)) for i in range(n))


def corpus():
    base = [PROSE(200, i) for i in range(8)]
    passage = PROSE(120, 99)
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(20 + i, base[0]) for i in range(3)] + [(30, base[1][:700] + " changed " + base[1][700:]), (31, "pre " + passage + " " + base[2][:50]), (32, passage), (33, base[3][10:] + passage)]
    docs += [(40, None), (41, ""), (42, "   \n\t "), (43, "ab" * 900), (44, "z" * 1000), (45, "é" * 700), (46, " ".join(["la"] * 400)), (None, base[4]), (None, None), (5, base[5]), (47, base[6]), (47, base[7] + base[6])]
    docs += [(100 + i, PROSE(30, 500 + i) + " " + passage + " " + PROSE(30, 900 + i)) for i in range(12)]
    return docs


def brute_bytes(docs, size=400):
    raw = [(t or "").encode() for _, t in docs]
    seen = {}
    for r in raw:
        for j in range(len(r) - size + 1):
            seen[r[j : j + size]] = seen.get(r[j : j + size], 0) + 1
    out = []
    for (d, _), r in zip(docs, raw, strict=True):
        gone = bytearray(len(r))
        for j in range(len(r) - size + 1):
            if seen[r[j : j + size]] > 1:
                gone[j : j + size] = b"\x01" * size
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((d, len(r), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(docs, size=50):
    last = 2**63 - 1
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = {}
    for (d, _), w in zip(docs, words, strict=True):
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            seen[key] = min(seen.get(key, last), last if d is None else d)
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if seen[tuple(w[j : j + size])] < (last if d is None else d):
                gone[j : j + size] = [True] * size
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [512, 2])
def test_bytes_as_brute_force(make, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus()
    assert sorted(map(tuple, substring_bwt.digest(make(docs)).collect()), key=repr) == brute_bytes(docs)


@pytest.mark.parametrize("hot", [512, 2])
def test_words_as_brute_force(make, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus()
    assert sorted(map(tuple, substring_fm.digest(make(docs)).collect()), key=repr) == brute_words(docs)


def test_empty_tables(make):
    assert substring_bwt.digest(make([])).collect() == []
    assert substring_fm.digest(make([])).collect() == []


def test_cut_keeps_whole_characters_and_columns(make):
    passage = "é" * 300
    df = make([(1, "a" + passage), (2, "b" + passage + "c"), (3, None), (4, "short")])
    rows = {r.doc_id: r for r in substring_bwt.cut(df).collect()}
    assert df.columns == list(rows[1].asDict())
    assert (rows[1].text, rows[2].text, rows[3].text, rows[4].text) == ("a", "bc", None, "short")
    assert (rows[1].n_chars, rows[2].n_chars, rows[4].did) == (1, 2, 7)


def test_merge_gives_the_order_and_common_prefixes_of_all_rotations():
    rng = np.random.default_rng(3)
    strings = [np.append(rng.integers(1, 4, rng.integers(3, 30)), 0) for _ in range(20)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    text = np.concatenate(strings)
    parts = []
    for some in np.array_split(np.arange(20), 3):
        lo, hi = first[some[0]], first[some[-1] + 1]
        order, before = rotations(text[lo:hi], first[some[0] : some[-1] + 2] - lo)
        parts.append((text[lo:hi][before[order]], order + lo))
    _, position, common = merged(parts, 64)
    of = np.searchsorted(first, np.arange(len(text)), "right") - 1
    rotation = lambda p: np.resize(np.roll(strings[of[p]], -(p - first[of[p]])), 64)
    for a, b, c in zip(position, position[1:], common[1:], strict=False):
        ra, rb = rotation(a), rotation(b)
        differ = np.flatnonzero(ra != rb)
        assert tuple(ra) <= tuple(rb)
        assert min(64, int(differ[0]) if len(differ) else 64) == c


def test_matching_statistics_as_brute_force():
    rng = np.random.default_rng(4)
    strings = [rng.integers(1, 5, rng.integers(1, 60)) for _ in range(12)] + [np.full(40, 2), np.full(25, 2)]
    docs = [*strings[:4], rng.integers(1, 7, 80), np.concatenate([strings[0], [6], strings[1]]), np.zeros(0, np.int64), np.full(30, 2)]
    for most in (3, 16, 50):
        index = substring_fm.FMIndex(strings, most)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        text = np.concatenate(docs)
        length, lo, hi = index.statistics(text, first)
        for d, doc in enumerate(docs):
            for i in range(len(doc)):
                want = 0
                while want < most and i + want < len(doc) and any(tuple(s[j : j + want + 1]) == tuple(doc[i : i + want + 1]) for s in strings for j in range(len(s) - want)):
                    want += 1
                at = first[d] + i
                assert length[at] == want
                if want:
                    assert hi[at] - lo[at] == sum(tuple(s[j : j + want]) == tuple(doc[i : i + want]) for s in strings for j in range(len(s) - want + 1))


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_hash_by_structure_stay_apart(make):
    # A string of two letters and its complement have one value in any polynomial modulo 2^64.
    same = [f"w{i}" for i in range(49)]
    docs = [(1, " ".join([*same, thue_morse(2048, "ab")])), (2, " ".join([*same, thue_morse(2048, "ba")]))]
    for digest in (substring_fm.digest, substring_bwt.digest):
        want = brute_words(docs) if digest is substring_fm.digest else brute_bytes(docs)
        assert sorted(map(tuple, digest(make(docs)).collect()), key=repr) == want
    texts = [t for _, t in docs]
    assert [r.text for r in substring_bwt.cut_later(make(docs)).orderBy("doc_id").collect()] == texts
    h = Batch([thue_morse(n, letters) for n in (512, 1024, 2048, 4096) for letters in ("ab", "ba")]).hashes()
    assert len(set(h.tolist())) == 8


@pytest.mark.parametrize("hot", [2048, 2])
def test_later_runs_are_cut_and_the_first_kept(make, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus()
    got = substring_bwt.cut_later(make(docs)).select("doc_id", "text", "n_chars").collect()
    rows = sorted(((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in got), key=repr)
    assert rows == sorted(((d, n - gone) for d, n, gone, _ in brute_words(docs)), key=repr)
    kept = sorted(((r.doc_id, hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).encode()).hexdigest()) for r in got), key=repr)
    assert kept == sorted(((d, x) for d, _, _, x in brute_words(docs)), key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    untouched = {d: t for d, t in docs if d in (0, 1, 40, 41, 42)}
    assert {r.doc_id: r.text for r in got if r.doc_id in untouched} == untouched


def test_cut_later_keeps_the_white_space_of_what_stays(make):
    run = " ".join(f"r{i}" for i in range(60))
    rows = substring_bwt.cut_later(make([(1, run), (2, f"a\n\n  {run}\tb  c"), (3, f"{run}\n"), (4, None), (5, "")])).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [run, "a\n\n  b  c", "\n", None, ""]
    assert [r.n_chars for r in rows] == [len(run), 9, 1, None, 0]
    assert substring_bwt.cut_later(make([])).collect() == []


def test_fragments_do_not_depend_on_the_chunk(monkeypatch):
    texts = [t for _, t in corpus()]
    for kind in (substring_bwt.BYTES, substring_fm.WORD_RUNS):
        whole = repeats.fragments(*kind.units(texts), kind.size, kind.k, kind.ahead)
        windows = lambda f: {(int(d), int(s) + i) for d, s, n, *_ in zip(*f, strict=True) for i in range(int(n))}
        key_of = lambda f: {(int(d), int(s) + i): int(k) for d, s, n, _, k, _ in zip(*f, strict=True) for i in range(int(n))}
        monkeypatch.setattr(repeats, "CHUNK", 777)
        cut = repeats.fragments(*kind.units(texts), kind.size, kind.k, kind.ahead)
        monkeypatch.setattr(repeats, "CHUNK", 1 << 18)
        assert sum(cut[2]) == len(windows(cut)) == len(windows(whole)) == sum(whole[2])
        assert key_of(cut) == key_of(whole)


def test_results_across_chunks(make, monkeypatch):
    # Workers import the module anew, so the small chunk is set where they run: through the units themselves.
    docs = [(1, PROSE(9000, 1)), (2, PROSE(200, 2) + " " + PROSE(9000, 1)), (3, PROSE(3000, 3) * 2)]
    assert sum(len(t) for _, t in docs) > 2 * repeats.CHUNK // 3
    assert sorted(map(tuple, substring_bwt.digest(make(docs)).collect()), key=repr) == brute_bytes(docs)
