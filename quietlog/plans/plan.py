"""From a sample to a proven plan: discover, propose, guard, prove; and the plan as a document that can be read back, verified and applied."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.functions import predicate as P
from quietlog.model import Effective, Implied, Recipe, Source, Template
from quietlog.operators import implied as mining
from quietlog.operators import templates as discovery
from quietlog.operators.guard import Requirement, guard
from quietlog.operators.proof import Proof, select_proven
from quietlog.operators.reduce import reduced, summaries, volumes, with_bodies
from quietlog.plans.recipes import Entry, only, resolve, with_implied
from quietlog.plans.verify import fingerprints

FORMAT = "quietlog.plan/1"


@dataclass
class Analysis:
    templates: list[Template]
    recipes: dict[str, Recipe]
    conflicts: list[str]
    proof: Proof
    volumes: list[dict]
    fingerprints: dict[str, str] = field(default_factory=dict)


def learned(assigned: DataFrame, templates: Sequence[Template]) -> dict[str, list[Implied]]:
    """Implied values of the templates that are not rare, discriminators left out."""
    from quietlog.model import is_rare

    names = [t.id for t in templates if not t.is_text and not is_rare(t.events, t.source_events)]
    skip = tuple(sorted({d for t in templates for d, _ in t.discriminators}))
    events = assigned.where(F.col("template_id").isin(names)) if names else assigned.where("false")
    leaves, mid = mining.long_form(events), mining.middles(events)
    candidates = mining.columns(leaves, mid.select("template_id", "n"), skip)
    closed = mining.closed_categories(leaves, candidates, mid.select("template_id", "middle"))
    rows = mining.chosen(mining.constants(leaves, candidates), mining.implied_by_field(leaves, candidates, closed)).orderBy("template_id", "field", "when_field", "when_value").collect()  # 64 a template at most
    out: dict[str, list[Implied]] = {}
    for r in rows:
        out.setdefault(r.template_id, []).append(Implied(r.field, r.value, (r.when_field, r.when_value) if r.when_field else None))
    return out


def analyze(events: DataFrame, sources: Sequence[Source], entries: Sequence[Entry], rules: Sequence[Requirement], engine: Callable[[DataFrame], DataFrame], modes: Sequence[str] = ("duplicates", "implied", "counts"), archive: bool = True, complete: bool = True) -> Analysis:
    """events: event_id, ts, source, body. engine: events with leaves -> (rule, event_id); deterministic, never partial."""
    prepared = discovery.prepared(events, {s.id: s.event_type_fields() for s in sources})
    # Read twice by mining and twice a round by the proof: discovered once.
    assigned = discovery.discovered(prepared, sources).persist()
    try:
        known = discovery.templates_of(assigned, sources)
        recipes, conflicts = resolve(entries, known)
        if "implied" in modes:
            recipes = with_implied(recipes, learned(assigned, known))
        recipes = {t: r for t, r in ((t, only(r, modes)) for t, r in recipes.items()) if r}
        plans = {t.id: guard(t, recipes.get(t.id), rules, archive, complete) for t in known}
        proof = select_proven(assigned, plans, engine)
        bodies = with_bodies(reduced(assigned, proof.plans, {t.id: t.fields for t in known}))
        found = [r.asDict() for r in volumes(bodies, summaries(bodies)).orderBy("template_id").collect()]  # one row a template
        return Analysis(known, recipes, conflicts, proof, found, fingerprints(rules))
    finally:
        assigned.unpersist()


def predicate_json(p: P.Predicate | None) -> object:
    if p is None:
        return None
    if isinstance(p, P.Test):
        return {"field": p.field, "op": p.op, "values": list(p.values), "cased": p.cased}
    if isinstance(p, P.Words):
        return {"words": list(p.values), "cased": p.cased}
    if isinstance(p, P.Not):
        return {"not": predicate_json(p.of)}
    return {"any" if isinstance(p, P.Any) else "all": [predicate_json(q) for q in p.of]}


def predicate_of(doc: object) -> P.Predicate | None:
    if doc is None:
        return None
    if "field" in doc:
        return P.Test(doc["field"], doc["op"], tuple(doc["values"]), doc["cased"])
    if "words" in doc:
        return P.Words(tuple(doc["words"]), doc["cased"])
    if "not" in doc:
        return P.Not(predicate_of(doc["not"]))
    return P.Any(tuple(map(predicate_of, doc["any"]))) if "any" in doc else P.All(tuple(map(predicate_of, doc["all"])))


def effective_json(p: Effective) -> dict:
    return {
        "template": p.template, "drop_fields": sorted(p.drop_fields), "empty_except": None if p.empty_except is None else sorted(p.empty_except),
        "implied": [{"field": v.field, "value": v.value, "when": list(v.when) if v.when else None} for v in p.implied],
        "keep_whole_when": predicate_json(p.keep_whole_when), "forward_when": predicate_json(p.forward_when), "summary_keys": list(p.summary_keys), "adjustments": [list(a) for a in p.adjustments],
    }


def effective_of(doc: dict) -> Effective:
    return Effective(doc["template"], frozenset(doc["drop_fields"]), None if doc["empty_except"] is None else frozenset(doc["empty_except"]), tuple(Implied(v["field"], v["value"], tuple(v["when"]) if v["when"] else None) for v in doc["implied"]), predicate_of(doc["keep_whole_when"]), predicate_of(doc["forward_when"]), tuple(doc["summary_keys"]), [tuple(a) for a in doc["adjustments"]])


def plan_json(a: Analysis) -> str:
    """The plan: templates by bytes, largest first, what is enforced, what it saves, and the rules it was proven against."""
    volume = {v["template_id"]: v for v in a.volumes}
    rows = []
    for t in sorted(a.templates, key=lambda t: (-t.bytes, t.id)):
        v = volume.get(t.id) or {}
        rows.append({"id": t.id, "source": t.source, "discriminators": [list(d) for d in t.discriminators], "keysets": [list(k) for k in t.variants], "pattern": list(t.pattern), "header": t.header, "events": t.events, "bytes": t.bytes, "bytes_out": v.get("bytes_out"), "enforced": effective_json(a.proof.plans[t.id])})
    total = volume.get(None) or {}
    doc = {"format": FORMAT, "proven": a.proof.holds, "rounds": a.proof.rounds, "rolled_back": a.proof.rolled_back, "conflicts": a.conflicts, "total": {k: v for k, v in total.items() if k != "template_id"}, "rules": a.fingerprints, "templates": rows}
    return json.dumps(doc, indent=1, sort_keys=True)


def read_plan(text: str) -> tuple[dict[str, Effective], dict]:
    """(what to enforce by template, the document). Any other format is refused, as are members that are not known."""
    doc = json.loads(text)
    if doc.get("format") != FORMAT:
        raise ValueError(f"not a plan of format {FORMAT}")
    known = {"format", "proven", "rounds", "rolled_back", "conflicts", "total", "rules", "templates"}
    if set(doc) - known:
        raise ValueError(f"unknown members {sorted(set(doc) - known)}")
    return {t["id"]: effective_of(t["enforced"]) for t in doc["templates"]}, doc


def schema() -> dict:
    """JSON Schema of the plan's top level."""
    return {
        "type": "object", "required": ["format", "proven", "templates", "rules"], "additionalProperties": False,
        "properties": {"format": {"const": FORMAT}, "proven": {"type": "boolean"}, "rounds": {"type": "integer"}, "rolled_back": {"type": "array"}, "conflicts": {"type": "array"}, "total": {"type": "object"}, "rules": {"type": "object"}, "templates": {"type": "array"}},
    }


def report(a: Analysis) -> str:
    """A page of text: totals, then templates by saving."""
    volume = {v["template_id"]: v for v in a.volumes}
    total = volume.get(None) or {"bytes_in": 0, "bytes_out": 0, "events": 0, "forwarded": 0, "summaries": 0}
    share = 100.0 * (total["bytes_in"] - total["bytes_out"]) / total["bytes_in"] if total["bytes_in"] else 0.0
    out = [f"{total['events']} events, {total['forwarded']} forwarded and {total['summaries']} summaries; {total['bytes_in']} bytes in, {total['bytes_out']} out: {share:.1f} % saved", f"alerts unchanged: {a.proof.holds}, in {a.proof.rounds} rounds; rolled back: {', '.join(a.proof.rolled_back) or 'none'}"]
    for t in sorted(a.templates, key=lambda t: (-((volume.get(t.id) or {}).get("bytes_in", 0) - (volume.get(t.id) or {}).get("bytes_out", 0)), t.id)):
        v = volume.get(t.id)
        if v:
            out.append(f"{t.id}: {v['bytes_in']} -> {v['bytes_out']}")
    return "\n".join(out) + "\n"


def verified(plan_text: str, events: DataFrame, sources: Sequence[Source], rules: Sequence[Requirement], engine: Callable[[DataFrame], DataFrame], complete: bool = True) -> tuple[str, dict]:
    """(verdict, changes) of an older plan on new events and the rules of today. changes: rules added, removed and changed; alerts missing and extra; templates whose saving fell by ten points or
    more (drifted: template, before, after, lost), those the events no longer hold (absent), and the share of events of no known template per source (unknown)."""
    from quietlog.operators.proof import compared, forwarded_events
    from quietlog.plans.verify import absent, drift, saved_pct, unknown_share, verdict

    plans, doc = read_plan(plan_text)
    spark = events.sparkSession
    known = [Template(t["id"], t["source"], discriminators=tuple(map(tuple, t["discriminators"])), variants=tuple(map(tuple, t["keysets"])), pattern=tuple(t["pattern"]), header=t["header"]) for t in doc["templates"]]
    prepared = discovery.prepared(events, {s.id: s.event_type_fields() for s in sources})
    assigned = discovery.classified(prepared, known, sources).persist()
    try:
        after = reduced(assigned, plans, {t.id: t.fields for t in known})
        missing, extra = compared(engine(assigned), engine(forwarded_events(after))).agg(F.count_if(F.col("change") == "missing"), F.count_if(F.col("change") == "extra")).first()
        bodies = with_bodies(after)
        # As many rows as there are templates and sources, not events.
        found = [(r.template_id, r.bytes_in, r.bytes_out) for r in volumes(bodies, summaries(bodies)).collect() if r.template_id not in (None, "unknown")]
        current = spark.createDataFrame(found, "template string, bytes_in long, bytes_out long")
        then = spark.createDataFrame([(t["id"], t["bytes"], t["bytes_out"]) for t in doc["templates"] if t["bytes_out"] is not None], "template string, bytes_in long, bytes_out long")
        drifted = [r.asDict() for r in drift(saved_pct(then).select("template", "saved_pct"), saved_pct(current).select("template", "saved_pct")).orderBy("template").collect()]
        gone = sorted(r.template for r in absent(then, current).collect())
        unknown = {r.source: r.unknown_pct for r in unknown_share(assigned).collect()}
    finally:
        assigned.unpersist()
    now, was = fingerprints(rules), doc["rules"]
    changed = {
        "added": sorted(set(now) - set(was)), "removed": sorted(set(was) - set(now)), "changed": sorted(r for r in set(now) & set(was) if now[r] != was[r]), "missing": missing, "extra": extra,
        "drifted": drifted, "absent": gone, "unknown": unknown,
    }
    return verdict(not missing and not extra, sum(len(changed[k]) for k in ("added", "removed", "changed")), complete, len(drifted)), changed


__all__ = ["Analysis", "Mapping", "analyze", "plan_json", "read_plan", "report", "schema", "verified"]
