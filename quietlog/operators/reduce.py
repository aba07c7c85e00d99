"""The data pass: classify each event, decide its route, reduce its body, sum up the rest per minute. One pass without a shuffle but for the summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.functions import predicate as P
from quietlog.functions.leaves import rebuilt, removed_members, shells
from quietlog.model import WINDOW_SECONDS, Effective, Implied, covers
from quietlog.store import written

EMPTY_MAP = "cast(map() as map<string, struct<json:string,kind:string>>)"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def implied_test(v: Implied, leaves: str) -> str:
    own = f"coalesce({leaves}[{_lit(v.field)}].json = {_lit(v.value)}, false)"
    return own + (f" and coalesce({leaves}[{_lit(v.when[0])}].json = {_lit(v.when[1])}, false)" if v.when else "")


def kept_leaves(plan: Effective, fields: frozenset[str] | None = None) -> list[str]:
    """SQL steps, each from a map of leaves to the next: named fields with all below them, empties, then implied values as long as they hold."""
    steps = []
    if plan.drop_fields:
        gone = " or ".join(f"k = {_lit(f)} or startswith(k, {_lit(f + '.')})" for f in sorted(plan.drop_fields))
        steps.append(f"map_filter({{m}}, (k, v) -> not ({gone}))")
    if plan.empty_except is not None:
        spared = " or ".join(f"k = {_lit(f)} or startswith(k, {_lit(f + '.')}) or startswith({_lit(f)}, concat(k, '.'))" for f in sorted(plan.empty_except)) or "false"
        own = f"k in ({', '.join(map(_lit, sorted(fields)))})" if fields else "true"
        steps.append(f"map_filter({{m}}, (k, v) -> not ({own}) or not (v.kind = 'null' or v.json = '\"\"') or {spared})")
    for v in plan.implied:
        steps.append(f"map_filter({{m}}, (k, v) -> k <> {_lit(v.field)} or not ({implied_test(v, '{m}')}))")
    return steps


def summary_value(key: str, leaves: str = "leaves") -> str:
    """SQL of a summary key's value as JSON text: the field, its copy under EventData, a <Data Name=...> element of EventData XML, null."""
    out = f"{leaves}[{_lit(key)}].json, {leaves}[{_lit('EventData.' + key)}].json"
    if key.replace("_", "a").isalnum():
        xml = f"regexp_extract({leaves}['EventData'].json, {_lit('<Data Name=' + chr(92) * 2 + chr(34) + key + chr(92) * 2 + chr(34) + '>([^<]*)</Data>')}, 1)"
        out += f", if({xml} <> '', concat('\"', {xml}, '\"'), null)"
    return f"coalesce({out}, 'null')"


def reduced(assigned_events: DataFrame, plans: Mapping[str, Effective] | Sequence[Effective], fields: Mapping[str, frozenset[str]] | None = None) -> DataFrame:
    """Events with route ('forward' or 'summarize'), kept (the leaves that go on), summary_keys (array of JSON texts) and whole.

    An event without a template, or whose template has no plan, is forwarded as it is; so is one whose plan cannot be evaluated (null). keep_whole_when is
    asked before anything is removed, implied values after the other removals. Summaries see the whole event."""
    plans = list(plans.values()) if isinstance(plans, Mapping) else list(plans)
    df = assigned_events.withColumns({"kept": F.col("leaves"), "route": F.lit("forward"), "summary_keys": F.lit(None).cast("array<string>"), "whole": F.lit(True)})
    route, whole, keys = F.lit("forward"), F.lit(True), F.lit(None).cast("array<string>")
    steps: dict[str, list[str]] = {}
    for plan in sorted((p for p in plans if p.reduces()), key=lambda p: p.template):
        of = F.col("template_id") == plan.template
        if plan.forward_when is not None:
            route = F.when(of & ~P.compiled(plan.forward_when), F.lit("summarize")).otherwise(route)
            keys = F.when(of, F.expr(f"array({', '.join(summary_value(k) for k in plan.summary_keys)})")).otherwise(keys)
        if plan.removes_fields():
            keep = P.compiled(plan.keep_whole_when) if plan.keep_whole_when is not None else F.lit(False)
            whole = F.when(of, keep).otherwise(whole)
            steps[plan.template] = kept_leaves(plan, (fields or {}).get(plan.template))
    df = df.withColumns({"route": F.coalesce(route, F.lit("forward")), "whole": F.coalesce(whole, F.lit(True)), "summary_keys": keys})
    for i in range(max(map(len, steps.values()), default=0)):
        arms = " ".join(f"when {_lit(t)} then {s[i].replace('{m}', 'kept')}" for t, s in sorted(steps.items()) if i < len(s))
        df = df.withColumn("kept", F.expr(f"if(whole, kept, case template_id {arms} else kept end)"))
    return df.withColumn("summary_keys", F.when(F.col("route") == "summarize", F.col("summary_keys")))


def with_bodies(reduced_events: DataFrame) -> DataFrame:
    """Adds out_body (JSON text of what goes on, paths dotted; the body as it came where nothing is removed) and removed (path, json, bytes)."""
    same = F.size("kept") == F.size("leaves")
    return reduced_events.withColumn("out_body", F.when(same, F.to_json("body")).otherwise(F.expr(rebuilt("kept")))).withColumn("removed", F.expr(removed_members())).withColumn("shells", F.expr(shells()))


def sized(bodies: DataFrame) -> DataFrame:
    """What accounting asks of with_bodies(), without the bodies, written once: summaries(), volumes(), removals() and saved_by_mode() on it do not reduce the events again."""
    out = F.when(F.col("route") == "forward", F.octet_length("out_body")).otherwise(0).cast("long")
    removed = F.when(F.col("route") == "forward", F.transform("removed", lambda r: F.struct(r["path"].alias("path"), r["bytes"].alias("bytes"))))
    return written(bodies.select("source", "template_id", "ts", "route", "summary_keys", F.octet_length(F.to_json("body")).cast("long").alias("bytes_in"), out.alias("bytes_out"), removed.alias("removed")), "sized")


def window_of(ts: str = "ts") -> Column:
    """The minute, as the floor of epoch seconds over 60, for times before 1970 too."""
    return F.floor(F.unix_timestamp(ts) / WINDOW_SECONDS).cast("long")


def summaries(reduced_events: DataFrame) -> DataFrame:
    """Per template, minute and keys: how many events were summed up."""
    rows = reduced_events.where("route = 'summarize'").withColumn("minute", window_of())
    return rows.groupBy("source", "template_id", "minute", "summary_keys").agg(F.count(F.lit(1)).alias("events"))


def summary_bytes(summed: DataFrame) -> DataFrame:
    record = "octet_length(to_json(struct(template_id, minute, summary_keys, events)))"
    return summed.withColumn("bytes", F.expr(f"cast({record} as bigint)"))


def volumes(bodies: DataFrame, summed: DataFrame) -> DataFrame:
    """Per template, and in total (template_id null): events, forwarded, summarized, summaries, bytes_in, bytes_out. bodies: with_bodies(), or sized() of it."""
    inside = F.coalesce("template_id", F.lit("unknown"))
    size = F.when(F.col("route") == "forward", F.octet_length("out_body")).otherwise(0).cast("long")
    sizes = ["bytes_in", "bytes_out"] if "bytes_in" in bodies.columns else [F.octet_length(F.to_json("body")).cast("long").alias("bytes_in"), size.alias("bytes_out")]
    one = bodies.select(inside.alias("template_id"), F.lit(1).alias("events"), (F.col("route") == "forward").cast("long").alias("forwarded"), *sizes, F.lit(0).cast("long").alias("summaries"))
    two = summary_bytes(summed).select("template_id", F.lit(0).alias("events"), F.lit(0).cast("long").alias("forwarded"), F.lit(0).cast("long").alias("bytes_in"), F.col("bytes").alias("bytes_out"), F.lit(1).cast("long").alias("summaries"))
    out = one.unionByName(two).rollup("template_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("events", "forwarded", "summaries", "bytes_in", "bytes_out")))
    return out.withColumn("summarized", F.col("events") - F.col("forwarded"))


def removals(bodies: DataFrame) -> DataFrame:
    """Per template and path: events and bytes removed from forwarded bodies."""
    rows = bodies.where("route = 'forward'").select("template_id", F.explode_outer("removed").alias("r")).where("r is not null")
    return rows.groupBy("template_id", F.col("r.path").alias("path")).agg(F.count(F.lit(1)).alias("events"), F.sum("r.bytes").alias("bytes"))


def rebuild(reduced_events: DataFrame, plans: Mapping[str, Effective] | Sequence[Effective], always: Mapping[str, frozenset[str]] | None = None) -> DataFrame:
    """Adds restored: kept with implied values put back where the field is absent (and when holds): the inverse of leaving them out.

    always: per template, fields that every one of its events carries; only those can be told from fields that were never there."""
    plans = list(plans.values()) if isinstance(plans, Mapping) else list(plans)
    df = reduced_events.withColumn("restored", F.col("kept"))
    for depth in range(max((len(p.implied) for p in plans), default=0)):
        arms = []
        for p in sorted(plans, key=lambda p: p.template):
            if depth >= len(p.implied):
                continue
            v = p.implied[-1 - depth]
            if always is not None and v.field not in always.get(p.template, frozenset()):
                continue
            when = f" and coalesce(restored[{_lit(v.when[0])}].json = {_lit(v.when[1])}, false)" if v.when else ""
            kind = "string" if v.value.startswith('"') else "bool" if v.value in ("true", "false") else "int"
            arms.append(f"when {_lit(p.template)} then if(not map_contains_key(restored, {_lit(v.field)}){when}, map_concat(restored, map({_lit(v.field)}, named_struct('json', {_lit(v.value)}, 'kind', '{kind}'))), restored)")
        if arms:
            df = df.withColumn("restored", F.expr(f"if(whole, restored, case template_id {' '.join(arms)} else restored end)"))
    return df


__all__ = ["covers", "kept_leaves", "rebuild", "reduced", "removals", "sized", "summaries", "summary_value", "volumes", "window_of", "with_bodies"]
