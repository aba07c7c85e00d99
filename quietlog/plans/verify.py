"""Fingerprints of rules, changes between rule sets, drift of templates, and the verdict on an older plan."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.operators.guard import Requirement

DRIFT_POINTS = 10.0


def reading(r: Requirement) -> str:
    """All that a requirement says, as one text."""
    parts = [r.rule, repr(r.logsource), r.field_names or "", "?" if r.fields is None else "\x01".join(sorted(r.fields)), str(r.raw_text), str(r.stateful), str(r.text_lines_only), repr(r.prefilter)]
    return "\x00".join(parts)


def fingerprints(rules: Iterable[Requirement]) -> dict[str, str]:
    """Per rule a hash of its readings, in whatever order they come."""
    by: dict[str, list[str]] = {}
    for r in rules:
        by.setdefault(r.rule, []).append(reading(r))
    return {rule: "sha256:" + hashlib.sha256("\x00\x00".join(sorted(texts)).encode()).hexdigest() for rule, texts in sorted(by.items())}


def rule_changes(then: DataFrame, now: DataFrame) -> DataFrame:
    """(rule, change) from two tables (rule, fingerprint): added, removed or changed."""
    both = then.select("rule", F.col("fingerprint").alias("was")).join(now.select("rule", F.col("fingerprint").alias("is")), "rule", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select("rule", change.alias("change")).where("change is not null")


def drift(recorded: DataFrame, current: DataFrame, points: float = DRIFT_POINTS) -> DataFrame:
    """Templates (template, saved_pct) whose saving fell by that many points or more: template, before, after, lost."""
    both = recorded.select("template", F.col("saved_pct").alias("before")).join(current.select("template", F.col("saved_pct").alias("after")), "template")
    return both.withColumn("lost", F.round(F.col("before") - F.col("after"), 1)).where(F.col("lost") >= points)


def saved_pct(volumes: DataFrame) -> DataFrame:
    """volumes (template, bytes_in, bytes_out) with the share saved, in percent, one decimal."""
    return volumes.withColumn("saved_pct", F.when(F.col("bytes_in") > 0, F.round(100.0 * (F.col("bytes_in") - F.col("bytes_out")) / F.col("bytes_in"), 1)).otherwise(0.0))


def absent(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Templates of a plan that a new sample no longer holds."""
    return recorded.select("template").join(current.select("template"), "template", "left_anti")


def unknown_share(assigned_events: DataFrame) -> DataFrame:
    """Events of no known template, per source: events, unknown, unknown_pct."""
    return assigned_events.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("template_id").isNull()).alias("unknown")).withColumn("unknown_pct", F.round(100.0 * F.col("unknown") / F.col("events"), 1))


def verdict(proof_holds: bool, changed_rules: int, complete: bool, drifted: int) -> str:
    """holds, out_of_date or does_not_hold."""
    if not proof_holds:
        return "does_not_hold"
    return "out_of_date" if changed_rules or not complete or drifted else "holds"


#: What is known about a set of rules: nothing, that someone said it is all, that it was fetched, that it needs no others.
BASES = ("not_known", "claimed", "fetched", "self_contained")


def weakest(bases: Iterable[str]) -> str:
    """The basis of several rule sets together: the weakest, the first of equally weak ones; fetched and self-contained weigh the same. Not known without any."""
    weight = {"not_known": 0, "claimed": 1, "fetched": 2, "self_contained": 2}
    return min(bases, key=weight.__getitem__, default="not_known")


def rules_per_set(requirements: DataFrame) -> DataFrame:
    """(set, rules) of requirements (set, rule): a rule read in several ways counts once."""
    return requirements.groupBy("set").agg(F.count_distinct("rule").alias("rules"))


EXIT_CODES = {"holds": 0, "does_not_hold": 1, "out_of_date": 3}
