"""Exact rule evaluation: which rule fires on which event."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietlog.functions import predicate as P
from quietlog.functions.leaves import string_of
from quietlog.model import LogSource, Source
from quietlog.store import written


@dataclass(frozen=True)
class Rule:
    """A rule on single events."""

    id: str
    condition: P.Predicate
    logsource: LogSource = LogSource()
    silent: bool = False  # a base rule that only feeds correlations


@dataclass(frozen=True)
class Correlation:
    """Over the base rules' events, per group, in a trailing span that includes both ends. kind: event_count or value_count (compared with at_least by op), temporal (every base rule fired),
    temporal_ordered (they fired in the order named)."""

    id: str
    kind: str
    rules: tuple[str, ...]
    seconds: int
    at_least: int
    group_by: tuple[str, ...] = ()
    field: str | None = None
    op: str = "gte"


def scope(rule: Rule, sources: Sequence[Source]) -> Column:
    ok = [s.id for s in sources if rule.logsource.may_apply_to(s.logsource)]
    return F.col("source").isin(ok) if ok else F.lit(False)


def matches(events: DataFrame, rules: Iterable[Rule], sources: Sequence[Source], fields: Iterable[str] = ()) -> DataFrame:
    """(rule, event_id, ts, of) of every rule that holds: all conditions in one projection over one scan. of: the texts of the named fields, in their order; the leaves go no further."""
    fired = [F.when(scope(r, sources) & P.compiled(r.condition, wide=False), F.lit(r.id)) for r in rules]
    own = F.array(*(F.expr(string_of(leaf_of(name))) for name in fields)).cast("array<string>")
    if not fired:
        return events.select(F.lit("").alias("rule"), "event_id", "ts", own.alias("of")).where("false")
    hit = F.filter(F.array(*fired), lambda r: r.isNotNull())
    return events.select(F.explode(hit).alias("rule"), "event_id", "ts", own.alias("of"))


COMPARED = {"gte": lambda c, n: c >= n, "gt": lambda c, n: c > n, "lte": lambda c, n: c <= n, "lt": lambda c, n: c < n, "eq": lambda c, n: c == n}


def all_fired(hits: DataFrame, keys: list[str], rules: Sequence[str], seconds: int, ordered: bool) -> DataFrame:
    """Rows of hits (rule, event_id, ts, keys) at which every rule has fired within the span that ends with them; with ordered, one after the other as named, the last one here.

    One pass in the order of time with running maxima, however many events a span holds. Events of one second count in the order of their ids."""
    at = F.unix_timestamp("ts")
    # Of one event its rules count in the order they are named in.
    place = F.array_position(F.array(*map(F.lit, rules)), F.col("rule"))
    before = Window.partitionBy(*keys).orderBy(at, "event_id", place).rowsBetween(Window.unboundedPreceding, 0)
    if not ordered:
        for i, r in enumerate(rules):
            hits = hits.withColumn(f"last_{i}", F.max(F.when(F.col("rule") == r, at)).over(before))
        return hits.where(F.least(*(F.coalesce(f"last_{i}", F.lit(NEVER_FIRED)) for i in range(len(rules))), F.lit(2**62)) >= at - seconds)
    hits = hits.withColumn("began", F.when(F.col("rule") == rules[0], at))
    for r in rules[1:]:
        hits = hits.withColumn("until", F.max("began").over(before)).withColumn("began", F.when(F.col("rule") == r, F.col("until")))
    return hits.where((F.col("rule") == rules[-1]) & (F.col("began") >= at - seconds))


NEVER_FIRED = -(2**62)


def leaf_of(field: str) -> str:
    quoted = field.replace("\\", "\\\\").replace("'", "\\'")
    return f"leaves['{quoted}']"


def trailing_count(rows: DataFrame, keys: list[str], seconds: int, to: str = "in_span") -> DataFrame:
    """rows (event_id, ts, keys) with the number of rows of their group in the span that ends with them. Of rows at one second only those up to the event itself
    count: a range frame holds later ones of the same second too, so those are taken off."""
    own = Window.partitionBy(*keys)
    at = F.unix_timestamp("ts")
    span = own.orderBy(at).rangeBetween(-seconds, 0)
    later = own.partitionBy(*keys, at).orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(to, F.count(F.lit(1)).over(span) - F.count(F.lit(1)).over(later))


def trailing_distinct(rows: DataFrame, keys: list[str], value: str, seconds: int, to: str = "in_span") -> DataFrame:
    """The number of different values in the span that ends with the row: collects (value, second, event_id) and leaves out later events of its second."""
    at = F.unix_timestamp("ts")
    span = Window.partitionBy(*keys).orderBy(at).rangeBetween(-seconds, 0)
    seen = F.collect_list(F.struct(F.col(value).alias("v"), at.alias("s"), F.col("event_id").alias("e"))).over(span)
    return rows.withColumn("_seen", seen).withColumn(to, F.expr("size(array_distinct(transform(filter(_seen, x -> x.s < unix_timestamp(ts) or x.e <= event_id), x -> x.v)))")).drop("_seen")


def alerts(events: DataFrame, rules: Sequence[Rule], correlations: Sequence[Correlation], sources: Sequence[Source]) -> DataFrame:
    """(rule, event_id): for a correlation every event at which its count reaches the threshold. events: event_id, ts, source, leaves.

    With correlations, matches are written once (small rows: a rule, an event and the fields that correlations name), and rules without a part in the result are not evaluated."""
    used = {r for c in correlations for r in c.rules}
    rules = [r for r in rules if not r.silent or r.id in used]
    fields = sorted({f for c in correlations for f in (*c.group_by, *([c.field] if c.field else []))})
    hits = matches(events, rules, sources, fields)
    if correlations:
        hits = written(hits, "matches")
    loud = [r.id for r in rules if not r.silent]
    out = hits.where(F.col("rule").isin(loud) if loud else F.lit(False)).select("rule", "event_id").distinct()
    for c in correlations:
        rows = hits.where(F.col("rule").isin(list(c.rules)))
        if not c.kind.startswith("temporal"):
            rows = rows.dropDuplicates(["event_id"])
        keys = []
        for i, name in enumerate(c.group_by):
            rows = rows.withColumn(f"key_{i}", F.col("of")[fields.index(name)]).where(f"key_{i} is not null")
            keys.append(f"key_{i}")
        if not keys:
            rows, keys = rows.withColumn("key_all", F.lit(0)), ["key_all"]
        if c.kind == "event_count":
            rows = trailing_count(rows, keys, c.seconds)
        elif c.kind == "value_count":
            rows = rows.withColumn("counted", F.col("of")[fields.index(c.field)]).where("counted is not null")
            rows = trailing_distinct(rows, keys, "counted", c.seconds)
        elif c.kind in ("temporal", "temporal_ordered"):
            rows = all_fired(rows, keys, c.rules, c.seconds, c.kind == "temporal_ordered")
            out = out.unionByName(rows.select(F.lit(c.id).alias("rule"), "event_id").distinct())
            continue
        else:
            raise ValueError(f"{c.kind} correlations cannot be evaluated here")
        out = out.unionByName(rows.where(COMPARED[c.op](F.col("in_span"), c.at_least)).select(F.lit(c.id).alias("rule"), "event_id"))
    return out


def numbered_rows(rows: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """Alerts of an engine that returns rows: equal rows stay apart by their occurrence number."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(rule, *keys).orderBy(*keys)))
