"""Proof by evaluation: the alerts on all events and on what is forwarded must be the same set; what breaks that is rolled back."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.model import Effective
from quietlog.operators.reduce import reduced
from quietlog.store import written


def flattened_once(events: DataFrame) -> DataFrame:
    """events written without what is only made of their bodies: rules see leaves, and a proof asks them on all events, on what is forwarded, and again after each rollback."""
    return written(events.drop("body", "keyset", "discr", "bytes"), "events")


def compared(full: DataFrame, forwarded: DataFrame) -> DataFrame:
    """(rule, event_id, change): 'missing' from the forwarded alerts, or 'extra' in them. Each side is evaluated once; one shuffle brings them together."""
    on = ["rule", "event_id"]
    both = full.select(*on, F.lit(1).alias("was"), F.lit(0).alias("is")).unionByName(forwarded.select(*on, F.lit(0).alias("was"), F.lit(1).alias("is")))
    seen = both.groupBy(*on).agg(F.max("was").alias("was"), F.max("is").alias("is")).where("was <> is")
    return seen.select(*on, F.when(F.col("was") == 1, "missing").otherwise("extra").alias("change"))


def forwarded_events(reduced_events: DataFrame) -> DataFrame:
    """What arrives: forwarded events with the leaves that are left. All removals of all plans are one expression: it is kept from being copied into every rule."""
    return reduced_events.where("route = 'forward'").withColumn("leaves", F.when(F.spark_partition_id() >= 0, F.col("kept")))


@dataclass
class Proof:
    plans: dict[str, Effective]
    rounds: int
    missing: int
    extra: int
    rolled_back: list[str]

    @property
    def holds(self) -> bool:
        return not self.missing and not self.extra


def select_proven(events: DataFrame, plans: Mapping[str, Effective], engine: Callable[[DataFrame], DataFrame]) -> Proof:
    """The largest part of plans under which alerts are unchanged. events: assigned events. Each round evaluates the rules once on what would be forwarded; templates
    of changed events go back to passing through; then, if none of those reduces, all of their sources; then everything.
    The events are flattened once; engine sees their event_id, ts, source, template_id and leaves, not their bodies. Only names of templates and sources to roll back reach the driver."""
    events = flattened_once(events)
    left = dict(plans)
    full = engine(events).select("rule", "event_id").distinct().persist()
    gone: list[str] = []
    try:
        for rounds in range(1, len(plans) + 3):
            after = engine(forwarded_events(reduced(events, left))).select("rule", "event_id")
            changed = compared(full, after).persist()
            missing, extra = changed.agg(F.count_if(F.col("change") == "missing"), F.count_if(F.col("change") == "extra")).first()
            if not missing and not extra:
                return Proof(left, rounds, 0, 0, gone)
            at = changed.select("event_id").distinct().join(events.select("event_id", "template_id", "source"), "event_id")
            blamed = {r[0] for r in at.select("template_id").distinct().collect()} & {t for t, p in left.items() if p.reduces()}
            if not blamed:
                sources = {r[0] for r in at.select("source").distinct().collect()}
                blamed = {r[0] for r in events.where(F.col("source").isin(list(sources))).select("template_id").distinct().collect()} & {t for t, p in left.items() if p.reduces()}
            blamed = blamed or {t for t, p in left.items() if p.reduces()}
            changed.unpersist()
            if not blamed:
                return Proof(left, rounds, missing, extra, gone)
            gone += sorted(blamed)
            left = {t: Effective(t) if t in blamed else p for t, p in left.items()}
        raise RuntimeError("no fixpoint")
    finally:
        full.unpersist()


def spot_checks(reduced_events: DataFrame, k: int = 5) -> DataFrame:
    """The first k events per template and outcome, for a rule service that answers one event at a time."""
    from pyspark.sql import Window

    of = Window.partitionBy("template_id", "route").orderBy("event_id")
    return reduced_events.withColumn("place", F.row_number().over(of)).where(F.col("place") <= k)


def examples(reduced_events: DataFrame, n: int) -> DataFrame:
    """n events for a report: the first of every template and outcome, then the second of each, and so on."""
    from pyspark.sql import Window

    first = spot_checks(reduced_events, n)  # n a template and outcome at most, so the order over all is over few rows
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place", "template_id", "route"))
    return first.withColumn("turn", turn).where(F.col("turn") <= n)


def fixtures(reduced_events: DataFrame) -> DataFrame:
    """The first event of every source, template, outcome and whether it stays whole: one regression test each."""
    return reduced_events.groupBy("source", "template_id", "route", "whole").agg(F.min("event_id").alias("event_id"))
