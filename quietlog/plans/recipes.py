"""Recipes: which reductions are proposed for which templates, read from YAML, matched, merged, and limited to the modes asked for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from quietlog.model import Implied, LogSource, Recipe, Template


@dataclass(frozen=True)
class Entry:
    """A recipe with what it is for. Without an event type or pattern it is for the whole source, and may only be lossless."""

    id: str
    logsource: LogSource
    schema: str | None
    discriminators: tuple[tuple[str, str], ...]
    pattern: str | None
    recipe: Recipe

    @property
    def specific(self) -> bool:
        return bool(self.discriminators or self.pattern)

    def fits(self, t: Template) -> bool:
        if not self.logsource.same(t.logsource) or (self.schema and self.schema != t.schema):
            return False
        own = dict(t.discriminators)
        return all(own.get(k) == v for k, v in self.discriminators) and (not self.pattern or self.pattern in " ".join(t.pattern))


def entry(doc: dict) -> Entry:
    known = {"id", "logsource", "schema", "match", "drop_fields", "drop_empty_fields", "drop_implied", "forward_matching", "summarize", "description"}
    if set(doc) - known:
        raise ValueError(f"{doc.get('id')}: unknown members {sorted(set(doc) - known)}")
    if "forward_matching" in doc and "summarize" in doc:
        raise ValueError(f"{doc['id']}: one routing reduction at most")
    ls, match = doc.get("logsource") or {}, doc.get("match") or {}
    route = "forward_matching" if "forward_matching" in doc else "summarize" if "summarize" in doc else None
    implied = tuple(Implied(v["field"], v["value"], tuple(v["when"]) if v.get("when") else None) for v in doc.get("drop_implied") or [])
    recipe = Recipe(frozenset(doc.get("drop_fields") or ()), bool(doc.get("drop_empty_fields")), implied, route, tuple((doc.get(route) or {}).get("keys") or ()) if route else (), doc["id"])
    out = Entry(doc["id"], LogSource(ls.get("product"), ls.get("service"), ls.get("category")), doc.get("schema"), tuple(sorted((str(k), str(v)) for k, v in (match.get("fields") or {}).items())), match.get("pattern"), recipe)
    if not out.specific and route:
        raise ValueError(f"{out.id}: a source-wide recipe may not decide which events are forwarded")
    return out


def book(texts: Iterable[str]) -> list[Entry]:
    import yaml

    out = [entry(d) for text in texts for d in yaml.safe_load_all(text) if d]
    if len({e.id for e in out}) < len(out):
        raise ValueError("two recipes share an id")
    return out


def merged(a: Recipe, b: Recipe) -> Recipe:
    if a.route and b.route and a.route != b.route:
        raise ValueError("two routing reductions")
    lead = a if a.route else b
    return Recipe(a.drop_fields | b.drop_fields, a.drop_empty or b.drop_empty, a.implied + tuple(v for v in b.implied if v not in a.implied), lead.route, lead.summary_keys, f"{a.by}+{b.by}")


def resolve(entries: Sequence[Entry], templates: Iterable[Template]) -> tuple[dict[str, Recipe], list[str]]:
    """(template -> recipe, conflicts). One specific recipe at most fits a template; two are a conflict and neither is taken. Source-wide ones are added."""
    out, conflicts = {}, []
    for t in templates:
        own = [e for e in entries if e.fits(t)]
        specific = [e for e in own if e.specific]
        if len(specific) > 1:
            conflicts.append(f"{t.id}: {', '.join(e.id for e in specific)}")
            specific = []
        for e in [*specific, *(e for e in own if not e.specific)]:
            out[t.id] = merged(out[t.id], e.recipe) if t.id in out else e.recipe
    return out, conflicts


MODES = {"duplicates", "implied", "counts"}


def only(recipe: Recipe, modes: Iterable[str]) -> Recipe | None:
    """What is left of a recipe in these modes: duplicates (fields and empties), implied, counts (routing). 'rules' stands for duplicates and counts."""
    modes = set(modes)
    if "rules" in modes:
        modes = (modes - {"rules"}) | {"duplicates", "counts"}
    if modes - MODES:
        raise ValueError(f"unknown modes {sorted(modes - MODES)}")
    out = replace(recipe, drop_fields=recipe.drop_fields if "duplicates" in modes else frozenset(), drop_empty=recipe.drop_empty and "duplicates" in modes, implied=recipe.implied if "implied" in modes else (), route=recipe.route if "counts" in modes else None, summary_keys=recipe.summary_keys if "counts" in modes else ())
    return out if out.levels() else None


def with_implied(recipes: Mapping[str, Recipe], learned: Mapping[str, Sequence[Implied]]) -> dict[str, Recipe]:
    """Learned values join what is proposed; a field dropped anyway, or a discriminator that implies, is left alone."""
    out = dict(recipes)
    for t, values in learned.items():
        own = Recipe(implied=tuple(v for v in values if v.field not in (recipes[t].drop_fields if t in recipes else ())), by="learned")
        if own.implied:
            out[t] = merged(recipes[t], own) if t in recipes else own
    return out
