"""Leaves, text kernels and predicates against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from quietlog.functions import leaves, text
from quietlog.functions import predicate as P
from quietlog.model import LogSource, covers, is_rare, may_denote

BODY = {"a": {"b": 1, "c": None, "d": [{"x": 1}, 2], "e": {}}, "k.with.dot": "v", "f": 3.0, "g": 4624.5, "t": True, "s": "4624", "big": 2**63, "z": {"y": {"w": ""}}}


def frame(spark, *bodies):
    df = spark.createDataFrame([(i, json.dumps(b) if not isinstance(b, str) else b) for i, b in enumerate(bodies)], "event_id long, text string")
    return leaves.with_leaves(df.withColumn("body", leaves.body(F.col("text"))))


def test_leaves(spark):
    got = frame(spark, BODY, "no json", "[1]", {}).orderBy("event_id").collect()
    assert {k: (v.json, v.kind) for k, v in got[0].leaves.items()} == {
        "a.b": ("1", "int"), "a.c": ("null", "null"), "a.d": ('[{"x":1},2]', "array"), "k.with.dot": ('"v"', "string"), "f": ("3", "float"), "g": ("4624.5", "float"), "t": ("true", "bool"), "s": ('"4624"', "string"),
        "big": ("9223372036854775808", "float"), "z.y.w": ('""', "string"),
    }
    assert [r.leaves for r in got[1:]] == [{}, {}, {}]


def test_clashing_paths_keep_the_later(spark):
    row = frame(spark, '{"a":{"b":1},"a.b":2}').collect()[0]
    assert set(row.leaves) == {"a.b"}


def test_rendered_discriminators(spark):
    values = [4624, "4624", 4624.0, 4624.5, True, None, [1], ""]
    df = frame(spark, *({"v": v} for v in values)).withColumn("r", F.expr(leaves.rendered("leaves['v']")))
    assert [r.r for r in df.orderBy("event_id").collect()] == ["4624", "4624", "4624", "4624.5", "true", "", "", ""]


def test_member_sizes_add_up(spark):
    for b in (BODY, {"x": 'q"\\\n', "é": "ü"}):
        b = {k: v for k, v in b.items() if not isinstance(v, dict)}
        df = frame(spark, b).withColumn("n", F.expr(f"aggregate(transform(map_entries(leaves), e -> {leaves.member_size('e.key', 'e.value.json')}), 0L, (a, x) -> a + x)"))
        r = df.filter("true").withColumn("size", leaves.encoded_size(F.to_json("body"))).collect()[0]
        dotted = sum(len(k.encode()) - len(k.rsplit(".", 1)[-1].encode()) for k in b)
        assert r.n + 1 + dotted == r["size"]


def test_masks():
    cases = {"sshd[7107]:": "sshd[<NUM>]:", "10.0.0.1": "<NUM>.<NUM>.<NUM>.<NUM>", "abcdef1": "abcdef<NUM>", "abcdef12": "<HEX>", "(abcdef12)": "(<HEX>)", "deadbeef": "deadbeef", "0xF": "<HEX>", "%ASA-6-302013:": "%ASA-6-302013:", "%123-6-X:": "%<NUM>-<NUM>-X:", "٣": "٣", "": ""}
    for token, want in cases.items():
        assert text.mask(token) == want


def test_masks_in_sql_as_in_python(spark):
    tokens = ["sshd[7107]:", "abcdef12", "((0x1F))", "%ASA-6-302013:", "%1-2-3:", "plain", "'it's'", "1234abcd-5678", "é12é", "-", "12345678"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.expr(text.mask_sql("t")).alias("m"))
    assert {r.t: r.m for r in df.collect()} == {t: text.mask(t) for t in tokens}


def test_headers():
    assert text.line("Oct 10 08:00:01 bastion sshd[42]: Accepted key") == (["sshd", "Accepted", "key"], True)
    assert text.line("2026-10-10T08:00:01Z host cron: run it") == (["cron", "run", "it"], True)
    assert text.line("no header at all") == (["no", "header", "at", "all"], False)
    assert text.line("") == ([], False)


def test_patterns_match_their_lines(spark):
    pattern = text.pattern_regex(["sshd", "Accepted", "<*>", "port", "<NUM>"], "syslog")
    rows = spark.createDataFrame([("Oct 10 08:00:01 bastion sshd[42]: Accepted anna port 22",), ("sshd Accepted anna port 22",)], "t string")
    assert [r.m for r in rows.select(F.col("t").rlike(pattern).alias("m")).collect()] == [True, False]
    assert text.pattern_regex(["a"], "mixed") is None


EVENTS = [{"a": "Foo bar", "n": 4624}, {"a": "x", "n": 46.0, "m": ["foo", 1]}, {"a": None, "o": {"p": "yes"}}, {"n": "4624", "a": ""}, {"m": [{"q": 1}]}]


@pytest.mark.parametrize(
    ("p", "exact", "wide"),
    [
        (P.Test("a", "equals", ("foo BAR",)), [1, 0, 0, 0, 0], [1, 0, 0, 0, 0]),
        (P.Test("a", "equals", ("foo BAR",), True), [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]),
        (P.Test("n", "equals", ("4624",)), [1, 0, 0, 1, 0], [1, 1, 0, 1, 0]),
        (P.Test("n", "equals", ("x",)), [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]),
        (P.Test("m", "startswith", ("fo",)), [0, 1, 0, 0, 0], [0, 1, 0, 0, 1]),
        (P.present("a"), [1, 1, 0, 1, 0], [1, 1, 0, 1, 0]),
        (P.present("o"), [0, 0, 1, 0, 0], [0, 0, 1, 0, 0]),
        (P.Test("a", "contains", tuple("qwert") + (" b",)), [1, 0, 0, 0, 0], [1, 0, 0, 0, 0]),
        (P.Test("a", "regex", ("^fo+",)), [1, 0, 0, 0, 0], [1, 0, 0, 0, 0]),
        (P.Words(("462",)), [1, 0, 0, 1, 0], [1, 1, 0, 1, 0]),
        (P.Words(("YES",)), [0, 0, 1, 0, 0], [0, 0, 1, 0, 0]),
        (P.Not(P.Test("a", "endswith", ("r",))), [0, 1, 1, 1, 1], [0, 1, 1, 1, 1]),
        (P.ALWAYS, [1] * 5, [1] * 5),
        (P.NEVER, [0] * 5, [0] * 5),
    ],
)
def test_compiled(spark, p, exact, wide):
    df = frame(spark, *EVENTS).orderBy("event_id")
    for want, how in ((exact, False), (wide, True)):
        assert [int(r.m) for r in df.select("event_id", P.compiled(p, wide=how).alias("m")).orderBy("event_id").collect()] == want


def test_thousands_of_alternatives(spark):
    p = P.Any(tuple(P.Test(f"f{i}", "equals", (str(i),)) for i in range(300)))
    assert [r.m for r in frame(spark, {"f299": "299"}, {"f1": "2"}).select("event_id", P.compiled(p).alias("m")).orderBy("event_id").collect()] == [True, False]


def test_normal_forms():
    a, b = P.Test("a", "equals", ("1",)), P.Test("a", "equals", ("2",))
    assert P.any_of([b, a]) == P.Test("a", "equals", ("1", "2")) == P.any_of([a, b, a])
    assert P.any_of([a, P.ALWAYS]) == P.ALWAYS and P.all_of([a, P.NEVER]) == P.NEVER and P.any_of([]) == P.NEVER and P.all_of([]) == P.ALWAYS
    assert P.widened(P.all_of([a, P.Not(b)])) == a


def test_static_answers():
    p = P.all_of([P.Test("EventID", "equals", ("4624",)), P.present("User")])
    assert P.may_match(p, {"EventID": "4624"}, frozenset({"EventID", "User"}))
    assert not P.may_match(p, {"EventID": "1"}, frozenset({"EventID", "User"}))
    assert not P.may_match(p, {"EventID": "4624"}, frozenset({"EventID"}))
    assert P.may_match(P.Test("a", "equals", ("K",)), {"a": "K"}, None)  # the Kelvin sign is never told from k
    assert P.holds_for_all(P.Test("EventID", "startswith", ("46",)), {"EventID": "4624"}) and not P.holds_for_all(p, {"EventID": "4624"})


def test_model():
    assert LogSource("Windows").may_apply_to(LogSource("windows", "x")) and not LogSource("linux").may_apply_to(LogSource("windows"))
    assert LogSource(service="x").may_apply_to(LogSource("windows")) and not LogSource(service="x").may_apply_to(LogSource("windows", complete=True))
    assert covers("a", "a.b") and not covers("a", "ab") and may_denote("b", "x.b") and not may_denote("b", "xb")
    assert [is_rare(99, 99), is_rare(100, 100_000), is_rare(100, 100_001)] == [True, False, True]
