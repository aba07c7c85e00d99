"""Implied values: what the kind of an event, or another field of it, already says. Approximate functional dependencies, mined exactly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_SUPPORT, MAX_IMPLYING, MAX_VALUES = 20, 32, 64
IDENTIFIER = "(Id|ID|Guid|GUID|_id|_guid)$"
PORT = "(?i)(^|[._])(src|dst|source|dest|destination|remote|local|ip)?_?port(name)?$"
IPV4 = r'^"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"$'
IPV6 = r'^"(?=[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:)[0-9A-Fa-f:]+(?:\.[0-9.]+)?"$'


def long_form(assigned_events: DataFrame) -> DataFrame:
    """One row per leaf: template_id, event_id, field, value (JSON text), kind."""
    return assigned_events.where("template_id is not null").select("template_id", "event_id", F.explode("leaves").alias("field", "leaf")).select("template_id", "event_id", "field", F.col("leaf.json").alias("value"), F.col("leaf.kind").alias("kind"))


def columns(leaves: DataFrame, totals: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Candidate columns: fields that every event of the template (totals: template_id, n) holds as a bool, integer or string, and that are no network fields."""
    found = leaves.where(~F.col("field").isin(list(skip)) if skip else F.lit(True)).groupBy("template_id", "field").agg(
        F.count(F.lit(1)).alias("held"), F.bool_and(F.col("kind").isin("bool", "int", "string")).alias("literal"), F.bool_and(F.col("value").rlike(IPV4) | F.col("value").rlike(IPV6)).alias("addresses")
    )
    return found.join(totals, "template_id").where("held = n and literal").where(~F.col("addresses") & ~F.col("field").rlike(PORT)).select("template_id", "field", "n")


def value_size(field: str = "field", value: str = "value") -> str:
    """Bytes that leaving a value out saves: name, quotes, colon, comma, value."""
    return f"cast(octet_length(element_at(split({field}, '[.]'), -1)) + 4 + octet_length({value}) as bigint)"


def dominant(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent value per keys of counts (keys, value, n), the least of equals: value, held, total."""
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("best"), F.sum("n").alias("total")).select(*keys, F.col("best.value").alias("value"), (-F.col("best.less")).alias("held"), "total")


def constants(leaves: DataFrame, candidates: DataFrame) -> DataFrame:
    """template_id, field, value, held, total, saved: one value on nine tenths of a template's events or more."""
    counts = leaves.join(candidates, ["template_id", "field"]).groupBy("template_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    return dominant(counts, ["template_id", "field"]).where("held * 10 >= total * 9").withColumn("saved", F.expr(f"held * {value_size()}"))


def categories(leaves: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fields fit to imply others: 2 to 32 values, no identifiers, and closed: every value of the later half of the events occurs in the earlier half."""
    rows = leaves.join(candidates.where(~F.col("field").rlike(IDENTIFIER)), ["template_id", "field"])
    values = rows.groupBy("template_id", "field", "value").agg(F.min("event_id").alias("first_seen"))
    few = values.groupBy("template_id", "field").agg(F.count(F.lit(1)).alias("values"), F.max("first_seen").alias("last_new")).where(f"values between 2 and {MAX_IMPLYING}")
    return few


def closed_categories(leaves: DataFrame, candidates: DataFrame, halves: DataFrame) -> DataFrame:
    """template_id, field, values of categories(), where the last new value came in the earlier half (halves: template_id, middle = first event_id of the later half)."""
    return categories(leaves, candidates).join(halves, "template_id").where("last_new < middle").select("template_id", "field", "values")


def middles(assigned_events: DataFrame) -> DataFrame:
    """template_id, n, middle: the event_id at which the later half begins. Exact, by ranks within hash-free buckets of event_id."""
    ranked = assigned_events.where("template_id is not null").select("template_id", "event_id")
    n = ranked.groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("template_id").orderBy("event_id")) - 1
    return ranked.withColumn("place", place).join(n, "template_id").where("place = n div 2").select("template_id", "n", F.col("event_id").alias("middle"))


def implied_by_field(leaves: DataFrame, candidates: DataFrame, closed: DataFrame) -> DataFrame:
    """template_id, field, when_field, when_value, value, held, total, saved: per value of a closed category with 20 events or more, one value on nine tenths of them.

    Only closed categories are joined to the other columns, so an event's row meets few others; counts are made before anything else moves."""
    given = leaves.join(closed.select("template_id", "field"), ["template_id", "field"]).select("template_id", "event_id", F.col("field").alias("when_field"), F.col("value").alias("when_value"))
    other = leaves.join(candidates.where(~F.col("field").rlike(IDENTIFIER)), ["template_id", "field"]).select("template_id", "event_id", "field", "value")
    counts = given.join(other, ["template_id", "event_id"]).where("field <> when_field").groupBy("template_id", "field", "when_field", "when_value", "value").agg(F.count(F.lit(1)).alias("n"))
    best = dominant(counts, ["template_id", "field", "when_field", "when_value"])
    return best.where(f"total >= {MIN_SUPPORT} and held * 10 >= total * 9").withColumn("saved", F.expr(f"held * {value_size()}"))


def chosen(alone: DataFrame, by_field: DataFrame) -> DataFrame:
    """The values to leave out, per template: for each field the way that saves most (the kind alone first, then the least implying field), a value held by all
    events needs no other way; then the largest savings first, never removing a field that implies another, at most 64 values. Rows: template_id, field, value, when_field, when_value, saved."""
    one = alone.select("template_id", "field", F.lit(None).cast("string").alias("when_field"), F.lit(None).cast("string").alias("when_value"), "value", "saved", (F.col("held") == F.col("total")).alias("always"))
    two = by_field.select("template_id", "field", "when_field", "when_value", "value", "saved", F.lit(False).alias("always"))
    rows = one.unionByName(two)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        ways: dict[str, tuple] = {}
        for (field, when), part in pdf.groupby(["field", pdf.when_field.fillna("")]):
            total = int(part.saved.sum())
            rank = (not bool(part.always.any()), -total, when != "", when)
            if field not in ways or rank < ways[field][0]:
                ways[field] = (rank, total, when, part)
        implying: set[str] = set()
        gone: set[str] = set()
        out, count = [], 0
        for field, (_, total, when, part) in sorted(ways.items(), key=lambda x: (-x[1][1], x[0])):
            if field in implying or when in gone or count + len(part) > MAX_VALUES:
                continue
            gone.add(field)
            if when:
                implying.add(when)
            out.append(part)
            count += len(part)
        return pd.concat(out)[["template_id", "field", "when_field", "when_value", "value", "saved"]] if out else pdf.iloc[:0][["template_id", "field", "when_field", "when_value", "value", "saved"]]

    # A template's rows are its fields' few dominant values, however many events it has.
    return rows.groupBy("template_id").applyInPandas(pick, "template_id string, field string, when_field string, when_value string, value string, saved long")
