"""What must not grow with the events: what passes through the driver, and how often events are read and flattened."""

import json

import pytest
from pyspark.sql import functions as F

from quietlog import queries, store
from quietlog.functions import predicate as P
from quietlog.functions.leaves import string_of, with_leaves
from quietlog.operators import drain

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_do_not_pass_through_the_driver(spark, monkeypatch):
    lines = spark.range(3000).select(F.lit("s").alias("source"), F.col("id").alias("event_id"), F.concat(F.lit("order "), "id", F.lit(" is "), F.when(F.col("id") % 2 == 0, "open").otherwise("shut")).alias("text"))

    def found():
        df = drain.text_templates(lines)
        return planned(df), sorted((" ".join(p), n) for p, n in df.groupBy("pattern").count().collect())

    plan, rows = found()
    assert rows == [("order <NUM> is open", 1500), ("order <NUM> is shut", 1500)]
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    monkeypatch.setattr(store, "SENT", 0)  # as with too many patterns to send
    plan, again = found()
    assert again == rows and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["proof_rollback", "guarded_forward_bodies", "assigned_events", "discovered_forward_bodies", "proof_missing_extra", "saved_by_mode", "bytes_by_template", "tier_costs", "rollup_volumes"])
def test_events_are_read_once(spark, monkeypatch, name):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(source):
        seen.add(1)
        return source

    rows = queries.event_rows
    monkeypatch.setattr(queries, "event_rows", lambda *a: rows(*a).withColumn("source", counted("source")))
    queries.QUERIES[name](spark, SF).collect()
    assert seen.value == queries.table(spark, SF, "events").count()


def test_texts_with_and_without_escapes(spark):
    texts = ["", "plain", 'a "quoted" word', "back\\slash", "two\nlines\t", "[x", "{y", "é ü 日本 😀", "/slash/", "\x01", '"', "\\"]
    df = spark.createDataFrame([(i, json.dumps({"s": t, "o": {"t": t, "n": 1, "e": {}}})) for i, t in enumerate(texts)], "i int, j string").select("i", F.try_parse_json("j").alias("body"))
    df = with_leaves(df).select("i", F.expr(string_of("leaves['s']")).alias("s"), F.expr(string_of("leaves['o.t']")).alias("t"), P.compiled(P.Words(("slash", "\n"))).alias("words"), *(P.compiled(P.Test("s", "equals", (t,), cased=True)).alias(f"is_{i}") for i, t in enumerate(texts)))
    for r in df.collect():
        assert (r.s, r.t, r.words) == (texts[r.i], texts[r.i], "slash" in texts[r.i] or "\n" in texts[r.i])
        assert [r[f"is_{i}"] for i in range(len(texts))] == [i == r.i for i in range(len(texts))]
