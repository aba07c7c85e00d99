"""What a recipe may do to a template, given every rule that could read it. Everything unknown fails closed: the event is forwarded whole."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from quietlog.functions import predicate as P
from quietlog.model import Effective, Implied, LogSource, Recipe, Template, can_read, covers, is_rare, may_denote


@dataclass(frozen=True)
class Requirement:
    """What one rule reads. fields: None if unknown."""

    rule: str
    logsource: LogSource = LogSource()
    field_names: str | None = None  # the naming convention of its fields
    fields: frozenset[str] | None = frozenset()
    raw_text: bool = False
    stateful: bool = False
    text_lines_only: bool = False
    prefilter: P.Predicate = P.ALWAYS

    def widened(self) -> Requirement:
        """Any field of any event."""
        return replace(self, field_names=None, fields=None, raw_text=True, prefilter=P.ALWAYS)

    def on_text_line(self) -> Requirement:
        return replace(self, raw_text=True, prefilter=P.on_text_line(self.prefilter))


def opaque(rule: str, logsource: LogSource = LogSource()) -> Requirement:
    """A rule that could not be read: it may read anything."""
    return Requirement(rule, logsource, None, None, True, True, False, P.ALWAYS)


def renamed(rule: Requirement, template: Template) -> bool:
    if template.is_text:
        return rule.field_names is not None and P.names_fields(rule.prefilter)
    return rule.field_names is not None and not can_read(template.schema, rule.field_names)


def applies(rule: Requirement, template: Template) -> bool:
    if not template.is_text and rule.text_lines_only:
        return False
    if not rule.logsource.may_apply_to(template.logsource):
        return False
    if renamed(rule, template):
        return True
    return P.may_match(rule.prefilter, {} if template.is_text else dict(template.discriminators), None if template.is_text else template.fields)


@dataclass(frozen=True)
class Claim:
    field: str | None  # None: every field
    rule: Requirement
    everywhere: bool


def claims_of(template: Template, rules: Iterable[Requirement], conditional: bool) -> list[Claim]:
    fixed = {} if template.is_text else dict(template.discriminators)
    out = []
    for rule in rules:
        everywhere = not conditional or P.holds_for_all(rule.prefilter, fixed)
        if rule.fields is None:
            out.append(Claim(None, rule, everywhere))
        else:
            for name in sorted(rule.fields):
                paths = [name, *sorted(p for p in template.fields if p != name and may_denote(name, p))]
                out += [Claim(p, rule, everywhere) for p in paths]
        if rule.raw_text:
            out += [Claim(f, rule, everywhere) for f in template.text_fields] if template.is_text else [Claim(None, rule, everywhere)]
    return out


def guard(template: Template, recipe: Recipe | None, rules: Sequence[Requirement], archive: bool = True, complete: bool = True, max_tests: int = P.MAX_TESTS) -> Effective:
    """Six rules hold: archive first; rare templates are never cut; what a rule can match is forwarded with the fields it reads; unknown passes
    through; nothing is enforced unproven (see proof); implied values can be put back. Refusals are listed in adjustments."""
    out = Effective(template.id)
    if recipe is None:
        out.adjustments.append(("unknown passes through", "no recipe"))
        return out
    if not archive or is_rare(template.events, template.source_events):
        why = ("archive first", "no archive") if not archive else ("rare is never cut", f"{template.events} of {template.source_events} events")
        out.adjustments += [(why[0], f"{level}: {why[1]}") for level in recipe.levels()]
        return out
    mapped = {r.rule for r in rules if not template.is_text and r.field_names is not None and can_read(template.schema, r.field_names) and r.logsource.may_apply_to(template.logsource)}
    others = [r for r in rules if renamed(r, template) and r.rule not in mapped and applies(r, template)]
    parsed = [r for r in rules if template.is_text and not renamed(r, template) and P.names_fields(r.prefilter)]
    own = [r for r in rules if not renamed(r, template) and r not in parsed and applies(r, template)]
    own += [r for r in (x.on_text_line() for x in parsed) if applies(r, template)]
    own += [others[0].widened()] if others else []
    shaped, conditions = shape(template, recipe, own, True, complete, max_tests)
    keep = P.any_of(conditions)
    if P.tests(keep) > max_tests:
        shaped, _ = shape(template, recipe, own, False, complete, max_tests)
        shaped.adjustments.append(("rule matches are forwarded", f"protection too broad: {P.tests(keep)} tests"))
    elif shaped.removes_fields() and keep != P.NEVER:
        shaped.keep_whole_when = keep
    if others:
        shaped.adjustments.append(("rule matches are forwarded", f"{len({r.rule for r in others})} rules name fields otherwise, as {others[0].rule}"))
    shaped.adjustments = list(dict.fromkeys(shaped.adjustments))
    return shaped


def shape(template: Template, recipe: Recipe, rules: list[Requirement], conditional: bool, complete: bool, max_tests: int) -> tuple[Effective, list[P.Predicate]]:
    out, conditions = Effective(template.id), []
    claims = claims_of(template, rules, conditional)
    forwarded = "rule matches are forwarded"

    def allowed(fields: Iterable[str]) -> set[str]:
        ok = set()
        for field in sorted(fields):
            on = [c for c in claims if c.field is None or covers(field, c.field) or covers(c.field, field)]
            unbounded = next((c for c in on if c.everywhere), None)
            if unbounded:
                out.adjustments.append((forwarded, f"{field} is needed by {unbounded.rule.rule}"))
                continue
            for c in on:
                conditions.append(c.rule.prefilter)
                out.adjustments.append((forwarded, f"fields stay where {c.rule.rule} may match"))
            ok.add(field)
        return ok

    out.drop_fields = frozenset(allowed(recipe.drop_fields))
    if recipe.drop_empty:
        everything = next((c for c in claims if c.field is None and c.everywhere), None)
        if everything:
            out.adjustments.append((forwarded, f"all fields are needed by {everything.rule.rule}"))
        else:
            out.empty_except = frozenset(c.field for c in claims if c.field is not None)
            conditions += [c.rule.prefilter for c in claims if c.field is None]
    if recipe.implied:
        ok = allowed({v.field for v in recipe.implied})
        out.implied = tuple(v for v in recipe.implied if v.field in ok)
    if recipe.route and not complete:
        out.adjustments.append((forwarded, f"{recipe.route}: not all rules are known"))
    elif recipe.route:
        if recipe.route == "summarize" and rules:
            out.adjustments.append((forwarded, "summarize: rules cover this template"))
        unbounded = next((r for r in rules if r.prefilter == P.ALWAYS), None)
        union = P.any_of(r.prefilter for r in rules)
        if unbounded:
            out.adjustments.append((forwarded, f"{recipe.route}: {unbounded.rule} may match any event"))
        elif P.tests(union) > max_tests and union != P.NEVER:
            out.adjustments.append((forwarded, f"{recipe.route}: {P.tests(union)} tests are too many"))
        else:
            out.forward_when, out.summary_keys = union, recipe.summary_keys
    return out, conditions


def removable_fields(plans: Iterable[Effective]) -> set[str]:
    """Every field that some plan may remove by name."""
    return {f for p in plans for f in (*p.drop_fields, *(v.field for v in p.implied))}


def emptiable_objects(plans: Iterable[Effective]) -> set[str]:
    """Every object that may lose its last field."""
    return {f[:i] for f in removable_fields(plans) for i in range(len(f)) if f[i] == "."}


def coverage_gaps(rules: Sequence[Requirement], templates: Sequence[Template]) -> list[str]:
    """Rules that no template can feed."""
    return sorted({r.rule for r in rules} - {r.rule for r in rules if any(applies(r, t) for t in templates)})


__all__ = ["Claim", "Implied", "Requirement", "applies", "claims_of", "coverage_gaps", "emptiable_objects", "guard", "opaque", "removable_fields", "renamed"]
