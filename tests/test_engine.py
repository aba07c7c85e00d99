"""Operators on the cluster: queries against DuckDB, Drain against a sequential run, a sample from end to end, streams against batch."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quietlog import queries
from quietlog.functions import predicate as P
from quietlog.functions.text import line, mask
from quietlog.model import Effective, Source
from quietlog.operators import drain, redact, reduce, templates
from quietlog.operators.alerts import alerts, trailing_count
from quietlog.plans import plan, recipes
from quietlog.rules import sigma
from quietlog.sources import events as io
from quietlog.sources import synth
from quietlog.streaming.pipeline import start

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((norm(r) for r in df.select(*[F.col(f"`{c}`") for c in cols]).collect()), key=repr)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert got == sorted((norm(r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_trailing_count_at_equal_times(spark):
    rows = spark.createDataFrame([(0, 0), (1, 10), (2, 10), (3, 10), (4, 71)], "event_id long, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("k", F.lit(1))
    assert [r.in_span for r in trailing_count(rows, ["k"], 60).orderBy("event_id").collect()] == [1, 2, 3, 4, 1]


def by_the_book(lines, children=100):
    """Drain one line after the other, in plain Python: {event: (leaf, cluster)}, and the final patterns."""
    branches, leaves, where = {}, {}, {}
    for event, text in lines:
        tokens = [mask(x) for x in line(text)[0]]
        own = branches.setdefault(len(tokens), set())
        key = None
        if tokens:
            key = tokens[0]
            if key not in own:
                key = "<*>" if any(c.isdigit() for c in key) or len(own) + 1 >= children else key
            own.add(key)
        clusters = leaves.setdefault((len(tokens), key), [])
        best, rank = None, None
        for i, c in enumerate(clusters):
            same = sum(a == b and a != "<*>" for a, b in zip(c, tokens, strict=True)) / len(c) if c else 1.0
            r = (same, c.count("<*>"))
            if same >= 0.4 and (rank is None or r > rank):
                best, rank = i, r
        if best is None:
            best = len(clusters)
            clusters.append(tokens)
        else:
            clusters[best] = [a if a == b else "<*>" for a, b in zip(clusters[best], tokens, strict=True)]
        where[event] = (len(tokens), key, best)
    return where, leaves


def test_drain_as_one_run_after_the_other(spark):
    rng = random.Random(5)
    shapes = ["user {} logged in from {}", "disk {} full at {} percent", "{} failed", "session {} closed by {} after {} tries", "7up {} x", "<13>Jan  2 03:04:05 host sshd[9]: closed {} {}", "%SYS-5-UP: {} and {}"]
    value = lambda: rng.choice(["anna", "ben", "c" + str(rng.randrange(99)), str(rng.randrange(9)), "ax", "<*>"])
    lines = [(i, rng.choice(shapes).format(value(), value(), value())) for i in range(500)]
    lines += [(600 + i, t) for i, t in enumerate(["a b c d e", "a b x y z", "a q c d e", "a b c d e", "a b c d e", "a q c d e"] * 3)]
    lines += [(700 + i, " ".join(rng.choice("abc") for _ in range(4))) for i in range(400)]
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(130)]
    lines += [(2000 + i, f"{rng.choice(words)} {rng.choice('xy')} tail") for i in range(500)] + [(3000, ""), (3001, "   ")]
    where, leaves = by_the_book(lines)
    df = spark.createDataFrame([("s", i, t) for i, t in lines], "source string, event_id long, text string").repartition(5)
    rows = drain.clusters(df).collect()
    assert len(rows) == len(lines)
    groups: dict = {}
    for r in rows:
        n, key, k = where[r.event_id]
        assert r.pattern == leaves[n, key][k], r
        groups.setdefault((n, key, k), set()).add(r.cluster_id)
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)
    assert sum(k == "<*>" for _, k in leaves) >= 2
    tree = drain.Drain()
    assert [tree.add(x.split()) for x in ("a b c d e", "a b x y z", "a q c d e", "a b c d e")] == [0, 0, 1, 1]
    assert tree.clusters == [["a", "b", "<*>", "<*>", "<*>"], ["a", "<*>", "c", "d", "e"]]


RULES = r"""
id: failed
name: failed
logsource: {product: windows, service: security}
detection: {sel: {EventID: 4625}, machine: {TargetUserName|endswith: '$'}, condition: sel and not machine}
---
id: burst
correlation: {type: event_count, rules: [failed], group-by: [TargetUserName], timespan: 60s, condition: {gte: 10}}
---
id: lsass
logsource: {product: windows, service: sysmon}
detection: {sel: {TargetImage|endswith: '\lsass.exe', GrantedAccess: ['0x1010', '0x1410']}, condition: sel}
---
id: ssh
logsource: {product: linux}
detection: {words: ['Failed password for'], condition: words}
---
id: domain
logsource: {category: dns}
detection: {sel: {query.name|endswith: bad-domain.example}, condition: sel}
"""
BOOK = "id: conn\nlogsource: {product: windows, service: security}\nmatch: {fields: {EventID: '5156'}}\nforward_matching: {keys: [Application, DestPort]}\n---\nid: fw\nlogsource: {product: opnsense}\nmatch: {fields: {action: pass}}\nsummarize: {keys: [dst_ip, dst_port]}\n---\nid: w\nlogsource: {product: windows}\ndrop_fields: [agent]\n"


def test_sample_from_end_to_end(spark):
    loaded = sigma.load([RULES])
    sample = synth.generate(spark, scale=3).drop("line").persist()
    engine = lambda e: alerts(e, loaded.rules, loaded.correlations, synth.SOURCES)
    a = plan.analyze(sample, synth.SOURCES, recipes.book([BOOK]), loaded.requirements, engine)
    assert a.proof.holds and not a.conflicts
    total = next(v for v in a.volumes if v["template_id"] is None)
    parts = [v for v in a.volumes if v["template_id"] is not None]
    for c in ("events", "forwarded", "summarized", "summaries", "bytes_in", "bytes_out"):
        assert total[c] == sum(v[c] for v in parts)
    assert total["events"] == total["forwarded"] + total["summarized"] and total["bytes_out"] < 0.7 * total["bytes_in"]
    prepared = templates.prepared(sample, {s.id: s.event_type_fields() for s in synth.SOURCES})
    assert {r.rule: r["count"] for r in engine(prepared).groupBy("rule").count().collect()} == {"burst": 3, "lsass": 1, "ssh": 30, "domain": 1}
    assert any(t.is_text for t in a.templates) and {t.header for t in a.templates if t.source == "linux-auth"} == {"syslog"}
    known = templates.discovered(prepared, synth.SOURCES).select("event_id", F.col("template_id").alias("was"))
    again = templates.classified(prepared, a.templates, synth.SOURCES).select("event_id", "template_id").join(known, "event_id")
    assert again.where("template_id is null or template_id <> was").count() == 0
    text = plan.plan_json(a)
    assert plan.read_plan(text)[0] == a.proof.plans
    assert "% saved" in plan.report(a)
    with pytest.raises(ValueError):
        plan.read_plan(json.dumps({"format": "other/1"}))
    verdict, changes = plan.verified(text, sample, synth.SOURCES, loaded.requirements[1:], engine)
    assert verdict == "out_of_date" and changes["removed"] and not changes["missing"] and not changes["drifted"] and not changes["absent"] and set(changes["unknown"].values()) == {0.0}
    # The same plan, as if it had saved 30 points more on one template, on events that lack another and bring a new one.
    doc = json.loads(text)
    largest = next(t for t in doc["templates"] if t["bytes_out"] and t["bytes_out"] > 0.4 * t["bytes"])
    largest["bytes_out"] = int(largest["bytes_out"] - 0.3 * largest["bytes"])
    lost = next(t["id"] for t in doc["templates"] if not t["pattern"] and t["id"] != largest["id"])
    now = sample.join(known.where(F.col("was") == lost).select("event_id"), "event_id", "left_anti")
    new = sample.where("source = 'firewall'").limit(500).withColumn("body", F.parse_json(F.lit('{"a":{"b":1},"never":"seen"}')))
    verdict, changes = plan.verified(json.dumps(doc), now.unionByName(new), synth.SOURCES, loaded.requirements, engine)
    assert verdict == "out_of_date" and [d["template"] for d in changes["drifted"]] == [largest["id"]] and changes["drifted"][0]["lost"] >= 10
    assert lost in changes["absent"] and [s for s, x in changes["unknown"].items() if x > 0] == ["firewall"] and not changes["removed"]
    assert synth.generate(spark, scale=3).drop("line").selectExpr("event_id", "to_json(body) as b").exceptAll(sample.selectExpr("event_id", "to_json(body) as b")).count() == 0
    sample.unpersist()


def test_removals_and_rebuild(spark):
    rows = [{"k": "a", "o": {"x": "1", "y": ""}, "e": {}, "v": 7}, {"k": "b", "o": {"x": "2"}, "v": 7}, {"k": "a", "v": 8}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "event_id long, text string").select("event_id", F.lit("s").alias("source"), F.timestamp_seconds("event_id").alias("ts"), F.parse_json("text").alias("body"))
    df = templates.prepared(df, ("k",)).withColumn("template_id", F.lit("t"))
    from quietlog.model import Implied

    p = Effective("t", frozenset({"o.x"}), frozenset({"k"}), (Implied("v", "7", ("k", '"a"')),), P.Test("k", "equals", ("b",)))
    out = {r.event_id: r for r in reduce.with_bodies(reduce.reduced(df, [p])).collect()}
    assert (out[0].out_body, out[1].out_body, out[2].out_body) == ('{"k":"a"}', '{"k":"b","o":{"x":"2"},"v":7}', '{"k":"a","v":8}')
    assert {(r.path, r.bytes) for r in out[0].removed} == {("o.x", 8), ("o.y", 7), ("v", 6)} and out[0].shells == ["o"]
    back = reduce.rebuild(reduce.reduced(df, [Effective("t", implied=p.implied)]), [Effective("t", implied=p.implied)])
    assert [r.n for r in back.where("array_sort(map_entries(restored)) = array_sort(map_entries(leaves))").agg(F.count(F.lit(1)).alias("n")).collect()] == [3]


def test_summary_keys_fall_back(spark):
    rows = [{"user": 1}, {"EventData": {"user": "x"}}, {"EventData": '<Data Name="user">eve</Data>'}, {}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "text string").select(F.parse_json("text").alias("body"))
    from quietlog.functions.leaves import with_leaves

    got = [r.v for r in with_leaves(df).select(F.expr(reduce.summary_value("user")).alias("v")).collect()]
    assert got == ["1", '"x"', '"eve"', "null"]


def test_reading_and_writing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text('﻿{"@timestamp":"2026-01-01T00:00:02.9Z","x":1}\n\n{"x":2}\n')
    (tmp_path / "in" / "b.ndjson").write_text('{"@timestamp":"2026-01-01T00:00:02Z","y":1}\nnot json\n')
    declared = io.sources("sources:\n- {id: a, logsource: {product: p}, format: {kind: json}}\n- {id: b, format: {kind: text, field: y}}\n")
    got = [(r.event_id, r.source, r.t) for r in io.events(spark, str(tmp_path / "in"), declared, strict=False).select("event_id", "source", F.unix_timestamp("ts").alias("t")).orderBy("event_id").collect()]
    assert got == [(0, "a", 0), (1, "b", 0), (2, "a", 1767225602), (3, "b", 1767225602)]
    with pytest.raises(Exception, match="no JSON object"):
        io.events(spark, str(tmp_path / "in"), declared).select("body").collect()
    assert io.sources(io.sources_yaml(declared)) == declared
    for bad in ("sources: []", "sources: [{id: a, extra: 1}]", "sources: [{id: a, format: {kind: text}}]"):
        with pytest.raises(ValueError):
            io.sources(bad)
    (tmp_path / "m.json").write_text('{"files": ["in/a.ndjson"], "complete": true}')
    assert io.manifest(str(tmp_path / "m.json"))[1]
    (tmp_path / "m.json").write_text('{"files": ["../x"]}')
    with pytest.raises(ValueError):
        io.manifest(str(tmp_path / "m.json"))
    assert len(io.files(str(tmp_path), ["NDJSON"])) == 2


def test_redaction_is_consistent(spark):
    df = spark.createDataFrame([('{"user":"anna","m":"from 10.0.0.1 by a@b.org","l":["10.0.0.1"],"n":1}',)], "t string").select(redact.redact(F.parse_json("t"), "s").alias("r"))
    got = json.loads(df.collect()[0].r)
    assert "anna" not in str(got) and "10.0.0.1" not in str(got) and got["n"] == 1 and got["l"][0] in got["m"]


def test_stream_as_batch(spark, tmp_path):
    df = queries.event_rows(spark, SF).select("event_id", "ts", "source", F.to_json("body").alias("text"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("event_id", "ts", "source", F.parse_json("text").alias("body"))
    classify = lambda batch: reduce.reduced(queries.with_template(templates.prepared(batch, ("event_type",))), queries.PLANS)
    start(stream, classify, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    forwarded = spark.read.json(str(tmp_path / "out/forwarded"))
    assert forwarded.count() == queries.reduce_forward_bodies(spark, SF).count()
    assert spark.read.json(str(tmp_path / "out/archive")).count() == df.count()
    assert spark.read.json(str(tmp_path / "out/summaries")).agg(F.sum("events")).first()[0] == df.count() - forwarded.count()


def test_sources_scope_rules():
    assert Source("x").event_type_fields()[0] == "EventID"


def test_leaves_at_any_depth(spark):
    deep = {"leaf": 1}
    for i in range(20):
        deep = {"k": deep, f"n{i}": [{"x": {}}]}
    docs = [deep, {}, [1, 2], "text", {"a": {}, "b": {"c": {}}}, {"a.b": 1, "a": {"b": 2}}, {"s": "{{{ not an object", "n": None, "f": 3.5, "i": 3, "t": True, "l": [], "é": "ü"}, {"many": [{"o": {"p": i}} for i in range(50)]}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, "no json")], "i int, t string").select("i", F.try_parse_json("t").alias("body"))
    from quietlog.functions.leaves import with_leaves

    got = {r.i: {k: (v.json, v.kind) for k, v in r.leaves.items()} for r in with_leaves(df).collect()}
    assert got[0][".".join(["k"] * 20) + ".leaf"] == ("1", "int") and len(got[0]) == 21 and all(v[1] in ("int", "array") for v in got[0].values())
    assert got[1] == got[2] == got[3] == got[4] == got[99] == {}
    assert got[5] == {"a.b": ("2", "int")} or got[5] == {"a.b": ("1", "int")}
    assert got[6] == {"s": ('"{{{ not an object"', "string"), "n": ("null", "null"), "f": ("3.5", "float"), "i": ("3", "int"), "t": ("true", "bool"), "l": ("[]", "array"), "é": ('"ü"', "string")}
    assert got[7]["many"][1] == "array" and len(got[7]) == 1
