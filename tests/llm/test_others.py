"""Sharding, packing, toxicity, decontamination, licences, fingerprints, URLs and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quietlog.llm import decontamination, license_scan, packing, queries, sharding, spotsigs, toxicity, url_filter

SF = "/root/testdata/sf0.001"
EDGES = [(1, "the cat sat on the mat"), (2, None), (3, ""), (3, ""), (None, "a b"), (4, "é" * 5000), (5, "word " * 20000)]


def test_shards_are_a_permutation(make):
    docs = [(i, f"text {i}") for i in range(1000)] + EDGES
    rows = sharding.shard(make(docs), 8).collect()
    assert len(rows) == len(docs)
    counts = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    want = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    again = {r.row_number: (r.shard, r.slot) for r in sharding.shard(make(docs).repartition(7), 8).collect()}
    assert again == {r.row_number: (r.shard, r.slot) for r in rows}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17])
def test_small_permutations(spark, n):
    df = sharding.permuted(spark.range(n).withColumnRenamed("id", "number").selectExpr("number", f"cast({n} as bigint) as total"), "number", "total", 3, "place")
    assert sorted(r.place for r in df.collect()) == list(range(n))


def test_encoder_is_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    e = packing.Encoder(path)
    texts = ["Éa 's don't  <|endoftext|>x\x1cy\x85z ΑΣ ΑΣ　Σ a  b\tc\nd 12345 日本語 \x00", "", " ", "<|STARTOFTEXT|>", "İstanbul!?"]
    for text, ids in zip(texts, e.ids(texts), strict=True):
        assert ids == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("chunks", [packing.CHUNKS_KEPT, 40, 0])
def test_encoder_with_generations_of_any_size(chunks):
    rng = random.Random(chunks)
    letters = ["a", "b", "é", "ß", "'s", "'", "!", "??", "1", "9", "Ǆ", "日", "-", "x\u0301"]
    texts = ["".join(rng.choice([*letters, " ", " ", "\n"]) for _ in range(rng.randrange(400))) for _ in range(300)]
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), chunks)
    for at in range(0, len(texts), 20):
        for text, ids in zip(texts[at : at + 20], e.ids(texts[at : at + 20]), strict=True):
            assert ids == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_packing_is_whole_and_tight(make):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["cat", "dog", "zebra"]) for _ in range(rng.choice([3, 50, 700, 900, 1300, 5000])))) for i in range(300)] + EDGES
    rows = packing.pack(make(docs), public_tokenizers.path("word_bpe_49k.json")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 2048) * 1.05 + 2
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in docs:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want += [(repr(d), k, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])) for k, at in enumerate(range(0, len(ids), 8192))]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packing.pack(make([]), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_plans_fill_the_counts():
    rng = random.Random(1)
    for _ in range(20):
        counts = {rng.randrange(1, 2049): rng.randrange(1, 400) for _ in range(rng.randrange(1, 200))}
        rows, total = packing.plan(counts)
        fill: dict = {}
        seen: dict = {}
        for length, first, n, sequence, offset in sorted(rows, key=lambda r: r[4]):
            seen.setdefault(length, []).append((first, n))
            for i in range(n):
                assert fill.get(sequence + i, 0) == offset
                fill[sequence + i] = offset + length
        assert max(fill.values()) <= 2048 and len(fill) == total
        for length, n in counts.items():
            at = 0
            for first, some in sorted(seen[length]):
                assert first == at
                at += some
            assert at == n


def test_toxicity_held_out(spark, make):
    rng = random.Random(3)
    mild, foul = ["sun", "tree", "river", "stone", "bird", "cloud"], ["vileish", "vileness", "scumbag", "scummy"]
    docs, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        words = [rng.choice(mild) + rng.choice(["", "s"]) for _ in range(40)]
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(foul)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    table = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(make(docs + EDGES), table).collect()
    assert len(rows) == len(docs) + len(EDGES)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    kept = toxicity.kept(make(docs + EDGES), table)
    assert kept.columns == make([]).columns and kept.count() == sum(r.predicted == 0 for r in rows)
    none = toxicity.toxicity(make(EDGES), table.where("false")).collect()
    assert {r.predicted for r in none} == {0}


def test_leaks_as_brute_force(spark, make):
    rng = random.Random(6)
    word = lambda: rng.choice("ab cd ef gh the of and to".split()) + rng.choice(["", str(rng.randrange(90))])
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, " ".join(sentence(rng.randrange(4, 20)) for _ in range(rng.randrange(1, 4)))) for i in range(40)] + [(50, None), (51, ""), (52, "zq1 zq2"), (53, "zq1 zq2")]
    docs = [(i, " ".join(sentence(12) for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    for i in range(40):
        text = items[i % 40][1]
        words = text.split()
        if i % 3 == 1:
            words[rng.randrange(len(words))] = "changed"
        if i % 3 == 2:
            words = words[: int(len(words) * 0.7)]
        docs.append((100 + i, docs[i][1] + " " + " ".join(words).upper() + " " + docs[i + 1][1]))
    docs += [(200, "so zq1, zq2!"), *EDGES]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.matched(make(docs), table).collect()
    split = re.compile(r"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    want = set()
    for d, t in docs:
        w = split.findall((t or "").lower())
        for i, x in items:
            own = split.findall((x or "").lower())
            if not own or len(w) < len(own) * 0.7:
                continue
            k = min(5, len(own))
            have = set(grams(w, k))
            hit = [g in have for g in grams(own, k)]
            a = len(split.findall(x[: decontamination.answer_start(x)].lower()))
            parts = [hit[:a], hit[max(0, a - 4) :]] if a and len(hit) > 1 else [hit]
            if sum(hit) >= 0.8 * len(hit) - 1e-9 and all(sum(p) >= 0.5 * len(p) for p in parts):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert len(want) > 15
    clean = decontamination.clean(make(docs), table)
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(d or -1 for d, _ in docs if d not in {x for x, _ in want})
    assert decontamination.matched(make([]), table).collect() == [] and decontamination.matched(make(docs), table.where("false")).collect() == []
    assert decontamination.clean(make(docs), table.where("false")).count() == len(docs)


def test_scores_do_not_depend_on_the_indexes(spark, make, monkeypatch):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice(["red", "blue", "green", "of", "the"]) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 40)))) for i in range(150)] + [(0, "same id"), (3, None), (4, "")]
    docs = [(i, " ".join(["some words before", *(t or "" for _, t in rng.sample(items, 2)), "and after"])) for i in range(60)]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for most, made in ((48 << 20, 1), (100_000, 2)):
        monkeypatch.setattr(decontamination, "INDEX_BYTES", most)
        assert len(decontamination.indexes(spark, table)) >= made
        found.append(sorted(map(tuple, decontamination.matched(make(docs), table).collect())))
    assert found[0] == found[1] and len(found[0]) >= 100
    # Scores by the book, over all items; the best passage of so short a document is the document.
    words = {k: re.findall(r"[a-z0-9']+", (t or "").lower()) for k, (_, t) in enumerate(items)}
    words = {k: w for k, w in words.items() if w}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    for d, i, score, overlap, *_ in found[0]:
        text = set(re.findall(r"[a-z0-9']+", docs[d][1].lower()))
        scores = []
        for k, w in words.items():
            if items[k][0] == i:
                total = 0.0
                for t in set(w) & text:
                    df = sum(t in x for x in words.values())
                    tf = w.count(t)
                    total += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                scores.append(total)
        assert any(abs(score - s) < 1e-3 for s in scores) and overlap >= 0.8


@pytest.mark.parametrize("inserted", [0, 20, 30, 60, 118])
def test_leaks_with_words_between_their_parts(inserted):
    words = [f"w{i}" for i in range(59)]
    item = " ".join(words[:40]) + ". " + " ".join(words[40:])
    put = " ".join([*words[:30], *(f"in{i}" for i in range(inserted)), *words[30:]])
    texts = [" ".join([*(f"x{i}" for i in range(before)), put, *(f"y{i}" for i in range(200))]) for before in range(2 * 59)]
    found = decontamination.leaks(texts, [decontamination.Index.of([(1, item), (2, "other short item")])])
    assert {d for d, _, i in found} == set(range(len(texts)))


def test_licences_as_brute_force(make):
    t = license_scan.TEMPLATES
    docs = [(1, "foo\nReleased under the MIT License.\nbar"), (2, t["MIT"][2].upper().replace(",", " ,")), (3, "released under license"), (4, "x\n" + t["GPL-3.0"][1][:-40] + "\ny"), (5, "nothing here"), *[(i, x) for i, x in EDGES if i != 1]]
    got = {(r.doc_id, r.licence): r.dice for r in license_scan.scanned(make(docs)).collect()}
    split = re.compile(r"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def pairs(text):
        w = split.findall(text.lower())
        return {(w[0],)} if len(w) == 1 else {(a, b) for a, b in zip(w, w[1:], strict=False)}

    want = {}
    for d, text in docs:
        for s in license_scan.stretches_of(text or ""):
            for name, own in t.items():
                for x in own:
                    a, b = pairs(s), pairs(x)
                    v = 2 * len(a & b) / (len(a) + len(b)) if a or b else 0
                    if v >= 0.8 - 1e-9:
                        want[d, name] = max(want.get((d, name), 0), round(v, 6))
    assert got == want and len(want) >= 3
    assert license_scan.scanned(make([])).collect() == []


def test_licences_inside_texts(make):
    page = "some prose of the page goes on here and on. {} More prose of the page\nfollows and ends. " + "Nothing more is said of it. " * 40
    full = {name: own[0] for name, own in license_scan.TEXTS.items()}
    docs = [(k, page.format(text)) for k, text in enumerate(full.values())] + [(100, page.format("Released under the MIT License.")), (101, full["BSD-3-Clause"]), (102, "Copyright 2020 A\n" + full["MIT"].replace("\n\n", "\n")), (103, page.format("Released under a license.")), (104, page.format(" ".join(f"word{i}" for i in range(200)) + " " + license_scan.TEMPLATES["GPL-3.0"][1]))]
    got = {(r.doc_id, r.licence): (r.dice, r.stretches) for r in license_scan.scanned(make(docs)).collect()}
    assert all((k, name) in got for k, name in enumerate(full))
    assert got[100, "MIT"] == (1.0, 1) and got[101, "BSD-3-Clause"][0] == 1.0 and (102, "MIT") in got and got[104, "GPL-3.0"] == (1.0, 1) and not any(d == 103 for d, _ in got)
    bsd2 = list(full).index("BSD-2-Clause")
    assert (bsd2, "BSD-3-Clause") not in got or got[bsd2, "BSD-3-Clause"][0] < 1


def test_runs_as_brute_force():
    rng = random.Random(7)
    own = {n: (" ".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 12))),) for n in "PQRS"}
    known = license_scan.Templates(own, 0.8)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(40))) for _ in range(800)] + [None, "", "a"]
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    want = {}
    for d, text in enumerate(texts):
        w = (text or "").split()
        for name, (x,) in own.items():
            b = pairs(x.split())
            for i in range(len(w)):
                for j in range(i + 2, min(len(w), i + 1 + int((len(x.split()) - 1) * 1.5 + 1e-9)) + 1):
                    v = 2 * len(b & pairs(w[i:j])) / (len(b) + len(pairs(w[i:j])))
                    if v >= 0.8 - 1e-9:
                        want[d, name] = max(want.get((d, name), 0), v)
    got = {(d, name): v for d, name, v in known.runs(texts, set())}
    assert got.keys() == want.keys() and len(want) > 20 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def spots(text):
    common, words = set(spotsigs.COMMON.split()), re.findall(r"[^\W_]+", text.lower())
    out = set()
    for i, w in enumerate(words):
        if w not in common:
            continue
        chain = []
        for y in words[i + 1 :]:
            if y not in common:
                chain.append(y)
                if len(chain) == 2:
                    out.add((w, *chain))
                    break
    return out or set(words)


def test_order_of_keys_with_outliers_and_ties(spark):
    ids = [1, *range(10**15, 10**15 + 3000), 2**62, 2**62, 5, 5, spotsigs.NEVER]
    keys = spark.createDataFrame([(i, k, 7) for k, i in enumerate(ids)], "did long, th long, n_chars long")
    rows = spotsigs.following(keys).collect()
    order = sorted(((r.did, r.th) for r in rows), reverse=True)
    assert len(order) == len(ids)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    assert all((r.next_did, r.next_th) == after[r.did, r.th] and r.n_chars == 7 for r in rows)
    assert spotsigs.following(keys.where("false")).collect() == []


def test_fingerprints_as_brute_force(make):
    rng = random.Random(8)
    words = "the of and a la der und katze hund cat dog house tree sky été".split()
    docs = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(1, None), (2, ""), (4, "de " * 3000 + "hund katze"), (5, "the " * 50)]
    rows = {r.doc_id: r for r in spotsigs.fingerprints(make(docs)).collect()}
    order = sorted(docs, reverse=True)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert abs(r.near_edited - like(spots(t), spots(e))) < 1e-9 and abs(r.near_next - like(spots(t), spots(n))) < 1e-9
        assert len(r.fingerprint) == 8 * len(spots(t))


def all_spots(text):
    common, words = set(spotsigs.COMMON.split()), re.findall(r"[^\W_]+", text.lower())
    chains = [(w, [y for y in words[i + 1 :] if y not in common][:2]) for i, w in enumerate(words) if w in common]
    return {(w, *c) for w, c in chains if len(c) == 2} or set(words)


def test_spots_after_any_run_of_common_words(make):
    rng, run = random.Random(8), "of the and a la der und in to on with for".split()
    texts = [" ".join([*run, "cat", *run, "dog", "tree"]), "the " * 2000 + "cat " + "of " * 2000 + "dog", " ".join([*run, "cat"]), *(" ".join(rng.choice([*run, "katze", "hund", "été"]) for _ in range(rng.randrange(99))) for _ in range(200))]
    rows = {r.doc_id: r for r in spotsigs.fingerprints(make(list(enumerate(texts)))).collect()}
    assert [len(all_spots(t)) for t in texts[:3]] == [2 * len(run), 1, len(run) + 1]
    for i, t in enumerate(texts):
        a, b = all_spots(t), all_spots(texts[i - 1])
        assert len(rows[i].fingerprint) == 8 * len(a)
        assert abs(rows[i].near_next - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9


def test_fingerprints_of_repeated_rows(make):
    rows = spotsigs.fingerprints(make(EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert spotsigs.fingerprints(make([])).collect() == []
    one = spotsigs.fingerprints(make([(1, "the cat sat on a mat")])).collect()[0]
    assert one.near_next == 1.0


def test_similar_pairs_as_brute_force(spark):
    rng = random.Random(9)
    sets = [sorted(rng.sample(range(200), rng.randrange(1, 40))) for _ in range(60)]
    for s in list(sets[:20]):
        sets.append(sorted(set(s[1:]) | {rng.randrange(200)}))
    rows = spark.createDataFrame([(str(i), s) for i, s in enumerate(sets)], "fp string, spots array<int>")
    got = {frozenset((int(r.a), int(r.b))) for r in spotsigs.similar_pairs(rows, 0.7).collect()}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.7 * len(set(sets[i]) | set(sets[j])) - 1e-9}
    assert got == want and want


def test_url_parts_and_rules(spark):
    urls = ["http://Sub.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://a.example.com/fr/1", "http://x.com/de/", "ftp://notexample.org", "nourl", None, "://", "http://h?q=/es/", "http://EXAMPLE.org#f/es/", "a://b://c/d", "http://org/x", "https://ÄB.net/p", ""]
    rows = spark.createDataFrame([(i, u, 1, 2.5, "s", None) for i, u in enumerate(urls)], "page_id long, url string, host int, depth double, suffix string, label string")
    got = {r.page_id: r for r in url_filter.judge(rows).collect()}
    assert all((r.depth, r.suffix, r.label) == (2.5, "s", None) for r in got.values())
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("sub.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("a.example.com", "/fr/1", "com/fr/"), ("x.com", "/de/", "com/de/"), ("notexample.org", "", None), ("", "", None), ("", "", None),
        ("", "", None), ("h", "", None), ("example.org", "", None), ("b:", "//c/d", None), ("org", "/x", "org/"), ("Äb.net", "/p", None), ("", "", None),
    ]
    assert all(got[i].verdict == ("allow" if got[i].rule in ("org/", "com/fr/") else "block") for i in got if got[i].rule)
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(rows.where("false")).collect() == []
    assert len(url_filter.judge(rows.select("url")).collect()) == len(urls)


def test_url_odd_rows(spark):
    long = "http://x.example.com/fr/" + "a1/" * 60_000
    urls = [(None, "http://x.com/de/1"), (1, "http://x.com/de/1"), (1, "http://x.com/de/1"), (2, long), (3, long + "?q=%F0"), (None, None), (None, None), (4, "http://no.rule/é日本")]
    rows = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()
    assert sorted((repr(r.page_id), r.quietlog_url or "") for r in rows) == sorted((repr(i), u or "") for i, u in urls)
    by = {}
    for r in rows:
        by.setdefault(r.quietlog_url, set()).add((r.verdict, r.score, r.rule))
    assert all(len(v) == 1 for v in by.values()) and len(by[long]) == 1 and next(iter(by[long]))[2] == "com/fr/"


def test_url_trees_judge_unseen_hosts(spark):
    """Rules label half of the hosts; the trees must tell the other half apart by how their URLs are made."""
    rng = random.Random(9)
    good = lambda h: f"https://{h}.example/{'/'.join(rng.choice(['news', 'about', 'team', 'garden']) for _ in range(rng.randrange(1, 4)))}"
    bad = lambda h: f"http://{h}.example/{rng.randrange(10**9)}/{rng.randrange(10**9)}?" + "&".join(f"p{i}={rng.randrange(10**6)}" for i in range(rng.randrange(3, 7)))
    urls, truth = [], {}
    for k in range(60):
        for _ in range(12):
            u = (bad if k % 2 else good)(f"h{k}")
            urls.append((len(urls), u))
            truth[len(urls) - 1] = "block" if k % 2 else "allow"
    rules = [(f"h{k}.example/", "block" if k % 2 else "allow") for k in range(30)]
    rows = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules).where("rule is null").collect()
    assert len(rows) == 360 and np.mean([r.verdict == truth[r.page_id] for r in rows]) > 0.95


def test_url_trees_learn_from_labelled_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    rows = url_filter.judge(pages).where("rule is not null").collect()
    assert np.mean([(r.score >= 0.5) == (r.verdict == "block") for r in rows]) > 0.8


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        done = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert done.columns == docs.columns
            sizes.append(done.count())
            docs = done
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in done.select("doc_id").collect()} == ids
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(x in r.text for r in docs.collect() for x in items)


def test_pipeline_on_odd_rows(make, tmp_path):
    clean = " ".join(f"stone{i} river{i}" for i in range(80))
    other = " ".join(f"bird{i} cloud{i}" for i in range(80))
    seven = " ".join(f"tree{i}" for i in range(120)) + " " + other
    rows = [(1, None), (2, ""), (2, ""), (3, " \n"), (None, None), (5, clean), (5, clean), (6, clean.upper()), (7, seven), (8, other + " and out " + "z" * 3000), (None, "a few words only")]
    docs = make(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(docs.sparkSession, docs, SF).write.parquet(f"{tmp_path}/{name}")
        assert docs.sparkSession.read.parquet(f"{tmp_path}/{name}").columns == docs.columns
        docs = docs.sparkSession.read.parquet(f"{tmp_path}/{name}")
    left = {(r.doc_id, r.text): r for r in docs.collect()}
    # One of the texts without words, one of the copies, 7 whole, 8 without what it shares with 7.
    assert set(left) == {(1, None), (5, clean), (7, seven), (8, "and out " + "z" * 3000), (None, "a few words only")}
    assert all(r.n_chars == (None if t is None else len(t)) and (r.did, r.th, r.spans) == (7, 8, "x") for (_, t), r in left.items())
    assert sorted(repr(r.doc_id) for r in corpus_pipeline.packed(docs.sparkSession, docs, SF).collect() if r.piece == 0) == sorted(repr(d) for d, _ in left)
    empty = make([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(empty.sparkSession, empty, SF).collect() == []


def test_empty_documents(spark, make):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert sharding.shard(make([]), 8).collect() == [] and toxicity.toxicity(make([]), labels).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_as_sql(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(rel.select(*cols).fetchall())
