"""Sigma rules: requirements for the guard, exact conditions for evaluation, correlations."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from quietlog.functions import predicate as P
from quietlog.model import LogSource
from quietlog.operators.alerts import Correlation, Rule
from quietlog.operators.guard import Requirement, opaque
from quietlog.rules.lex import MIN_WORD, wildcard

EXACT = {"contains", "startswith", "endswith", "re", "exists", "all", "cased", "i"}


@dataclass
class Loaded:
    requirements: list[Requirement] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    correlations: list[Correlation] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)


def documents(texts: Iterable[str]) -> tuple[list[dict], list[str]]:
    import yaml

    docs, problems = [], []
    for text in texts:
        try:
            for d in yaml.safe_load_all(text):
                if isinstance(d, dict):
                    docs.append(d)
                elif d is not None:
                    problems.append("a document that is no mapping")
        except yaml.YAMLError as e:
            problems.append(f"unreadable: {str(e).splitlines()[0]}")
    return docs, problems


def logsource(doc: dict) -> LogSource:
    s = doc.get("logsource") or {}
    return LogSource(s.get("product"), s.get("service"), s.get("category"))


def text_of(value: object) -> str:
    return "true" if value is True else "false" if value is False else str(value)


def field_test(name: str, value: object, exact: bool) -> P.Predicate:
    """One 'field|modifiers: value(s)' entry."""
    fieldname, *mods = name.split("|")
    values = value if isinstance(value, list) else [value]
    unknown = [m for m in mods if m not in EXACT]
    if unknown:
        if exact:
            raise ValueError(f"modifier {unknown[0]} is not evaluated here")
        return P.ALWAYS if None in values else P.present(fieldname)
    cased = "cased" in mods

    def one(v: object) -> P.Predicate:
        if "exists" in mods:
            return P.present(fieldname) if v in (True, "true") else P.Not(P.present(fieldname))
        if v is None:
            return P.Not(P.present(fieldname))
        v = text_of(v)
        if v == "":
            return P.Any((P.Test(fieldname, "equals", ("",)), P.Not(P.present(fieldname)))) if exact else P.ALWAYS
        if "re" in mods:
            return P.Test(fieldname, "regex", (v if "i" not in mods else f"(?i){v}",), True)
        for m in ("contains", "startswith", "endswith"):
            if m in mods:
                if re.search(r"(?<!\\)[*?]", v):
                    v = {"contains": f"*{v}*", "startswith": f"{v}*", "endswith": f"*{v}"}[m]
                    return exact_wildcard(fieldname, v, cased) if exact else wildcard(fieldname, v, cased)
                return P.Test(fieldname, m, (re.sub(r"\\([*?])", r"\1", v),), cased)
        return exact_wildcard(fieldname, v, cased) if exact else wildcard(fieldname, v, cased)

    parts = [one(v) for v in values]
    out = P.all_of(parts) if "all" in mods else P.any_of(parts)
    return out if exact else P.widened(out)


def exact_wildcard(fieldname: str, value: str, cased: bool) -> P.Predicate:
    """Outer stars only stay an operator; any inner wildcard becomes a pattern."""
    p = wildcard(fieldname, value, cased)
    inner = re.search(r"(?<!\\)\?|(?<!\\)(?<!^)\*(?!$)", value)
    if not inner:
        return p
    body, i = "", 0
    while i < len(value):
        if value[i] == "\\" and i + 1 < len(value) and value[i + 1] in "*?\\":
            body += re.escape(value[i + 1])
            i += 2
            continue
        body += {"*": ".*", "?": "."}.get(value[i], re.escape(value[i]))
        i += 1
    return P.Test(fieldname, "regex", (f"(?s{'' if cased else 'i'})^{body}$",), True)


def keyword(value: object, exact: bool) -> P.Predicate:
    v = text_of(value)
    pieces = [p for p in re.split(r"(?<!\\)[*?]", v) if p]
    if exact:
        return P.all_of([P.Words((p,)) for p in pieces]) if pieces else P.ALWAYS
    pieces = [p for p in pieces if len(p) >= MIN_WORD]
    return P.Words((max(pieces, key=len),)) if pieces else P.ALWAYS


def detection(block: object, exact: bool) -> P.Predicate:
    if isinstance(block, dict):
        return P.all_of([keyword_list(v, exact) if k.startswith("|") else field_test(k, v, exact) for k, v in block.items()])
    if isinstance(block, list):
        return P.any_of([detection(b, exact) if isinstance(b, (dict, list)) else keyword(b, exact) for b in block])
    return keyword(block, exact)


def keyword_list(value: object, exact: bool) -> P.Predicate:
    """'|all': every keyword."""
    values = value if isinstance(value, list) else [value]
    return P.all_of([keyword(v, exact) for v in values])


def fields_of(block: object) -> tuple[set[str], bool]:
    """(fields, whether keywords are there)."""
    fields, free = set(), False
    if isinstance(block, dict):
        for k, v in block.items():
            name, *mods = k.split("|")
            if not name:
                free = True
                continue
            fields.add(name)
            if "fieldref" in mods:
                fields |= {text_of(x) for x in (v if isinstance(v, list) else [v])}
    elif isinstance(block, list):
        for b in block:
            f, k = fields_of(b) if isinstance(b, (dict, list)) else (set(), True)
            fields, free = fields | f, free or k
    else:
        free = True
    return fields, free


def condition(text: str, named: dict[str, P.Predicate], exact: bool) -> P.Predicate:
    """'a and not (1 of b*)' and the like; not binds first, and before or."""
    tokens = re.findall(r"\(|\)|[^\s()]+", text)
    at = 0

    def look() -> str:
        return tokens[at].lower() if at < len(tokens) else ""

    def either() -> P.Predicate:
        nonlocal at
        parts = [both()]
        while look() == "or":
            at += 1
            parts.append(both())
        return P.any_of(parts)

    def both() -> P.Predicate:
        nonlocal at
        parts = [single()]
        while look() == "and":
            at += 1
            parts.append(single())
        return P.all_of(parts)

    def single() -> P.Predicate:
        nonlocal at
        word = look()
        at += 1
        if word == "not":
            inner = single()
            return P.Not(inner) if exact else P.ALWAYS
        if word == "(":
            inner = either()
            if look() != ")":
                raise ValueError("')' expected")
            at += 1
            return inner
        if (word.isdigit() or word in ("all", "any")) and look() == "of":
            at += 1
            glob = tokens[at]
            at += 1
            some = [p for n, p in sorted(named.items()) if (glob.lower() == "them" and not n.startswith("_")) or fnmatch.fnmatchcase(n, glob)]
            if not some:
                raise ValueError(f"nothing is named {glob}")
            if word == "all":
                return P.all_of(some)
            need = 1 if word == "any" else int(word)
            if need <= 1:
                return P.any_of(some)
            if exact:
                from itertools import combinations

                return P.any_of([P.all_of(c) for c in combinations(some, need)])
            return P.any_of(some)
        if tokens[at - 1] not in named:
            raise ValueError(f"nothing is named {tokens[at - 1]}")
        return named[tokens[at - 1]]

    out = either()
    if at != len(tokens):
        raise ValueError(f"{tokens[at]} is too much")
    return out


def compiled(doc: dict, exact: bool) -> P.Predicate:
    blocks = doc["detection"]
    named = {k: detection(v, exact) for k, v in blocks.items() if k not in ("condition", "timeframe")}
    conditions = blocks["condition"] if isinstance(blocks["condition"], list) else [blocks["condition"]]
    return P.any_of([condition(c, named, exact) for c in conditions])


def seconds(text: object) -> int:
    m = re.fullmatch(r"(\d+)([smhdw])", str(text))
    if not m:
        raise ValueError(f"{text} is no time span")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[m[2]]


def mapped(p: P.Predicate, names: dict[str, list[str]]) -> P.Predicate:
    """A predicate in another naming convention."""
    if isinstance(p, P.Test):
        return P.any_of([replace(p, field=n) for n in names.get(p.field, [p.field])])
    if isinstance(p, P.Any):
        return P.any_of([mapped(q, names) for q in p.of])
    if isinstance(p, P.All):
        return P.all_of([mapped(q, names) for q in p.of])
    return P.Not(mapped(p.of, names)) if isinstance(p, P.Not) else p


def load(texts: Iterable[str], pipelines: dict[str, dict] | None = None) -> Loaded:
    """All rules, correlations and filters of some YAML texts. pipelines: per naming convention a processing pipeline (transformations of type field_name_mapping).

    A document that cannot be read is a rule that may read anything."""
    out = Loaded()
    docs, out.problems = documents(texts)
    if out.problems:
        out.requirements.append(opaque("unreadable"))
    by_name: dict[str, dict] = {}
    ids: dict[str, int] = {}
    for d in docs:
        for key in (d.get("name"), d.get("id")):
            if key:
                by_name[str(key)] = d
    filters = [d for d in docs if "filter" in d]
    named_by_correlation, generate = set(), set()
    for d in docs:
        if "correlation" in d:
            refs = d["correlation"].get("rules") or []
            refs = refs if isinstance(refs, list) else [refs]
            named_by_correlation |= {id(by_name[r]) for r in map(str, refs) if r in by_name}
            if d["correlation"].get("generate"):
                generate |= {id(by_name[r]) for r in map(str, refs) if r in by_name}
    for d in docs:
        rule = str(d.get("id") or d.get("name") or d.get("title"))
        ids[rule] = ids.get(rule, 0) + 1
        try:
            if "correlation" in d:
                correlation(d, rule, by_name, out)
            elif "detection" in d:
                fields, free = set(), False
                for k, v in d["detection"].items():
                    if k not in ("condition", "timeframe"):
                        f, w = fields_of(v)
                        fields, free = fields | f, free or w
                wide = P.widened(compiled(d, False))
                for f in filters:
                    extra, w = fields_of([v for k, v in f["filter"].items() if k not in ("condition", "rules")])
                    fields, free = fields | extra, free or w
                one = Requirement(rule, logsource(d), "sigma", None if free else frozenset(fields), free, id(d) in named_by_correlation, False, wide)
                out.requirements.append(one)
                for names, pipeline in (pipelines or {}).items():
                    table = mapping(pipeline)
                    out.requirements.append(replace(one, field_names=names, fields=None if free else frozenset(n for f in fields for n in table.get(f, [f])), prefilter=mapped(wide, table)))
                exact = compiled(d, True)
                for f in filters:
                    if rule in map(str, f["filter"].get("rules") or []) or d.get("name") in (f["filter"].get("rules") or []):
                        exact = P.all_of([exact, P.Not(compiled({"detection": {k: v for k, v in f["filter"].items() if k != "rules"}}, True))])
                out.rules.append(Rule(rule, exact, logsource(d), id(d) in named_by_correlation and id(d) not in generate))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            out.problems.append(f"{rule}: {e}")
            if not any(r.rule == rule for r in out.requirements):
                out.requirements.append(opaque(rule, logsource(d)))
    out.problems += [f"{n} rules share the id {r}" for r, n in ids.items() if n > 1]
    return out


def mapping(pipeline: dict) -> dict[str, list[str]]:
    table: dict[str, list[str]] = {}
    for t in pipeline.get("transformations") or []:
        if t.get("type") == "field_name_mapping":
            table |= {k: v if isinstance(v, list) else [v] for k, v in t["mapping"].items()}
        elif t.get("type") not in ("change_logsource", "add_condition", "rule_failure", "detection_item_failure"):
            raise ValueError(f"{t.get('type')} transformations are not read")
    return table


def correlation(d: dict, rule: str, by_name: dict[str, dict], out: Loaded) -> None:
    c = d["correlation"]
    refs = [str(r) for r in (c["rules"] if isinstance(c["rules"], list) else [c["rules"]])]
    base = [by_name[r] for r in refs if r in by_name]
    if len(base) < len(refs):
        raise ValueError("a base rule is missing")
    keys = c.get("group-by") or []
    keys = tuple(keys if isinstance(keys, list) else [keys])
    aliases = c.get("aliases") or {}
    reads = {n for k in keys for n in (aliases[k].values() if k in aliases else [k])}
    cond = c.get("condition") or {}
    if cond.get("field"):
        reads |= set(cond["field"]) if isinstance(cond["field"], list) else {cond["field"]}
    wide = P.any_of([P.widened(compiled(b, False)) for b in base if "detection" in b]) if all("detection" in b for b in base) else P.ALWAYS
    scopes = {logsource(b) for b in base}
    out.requirements.append(Requirement(rule, scopes.pop() if len(scopes) == 1 else LogSource(), "sigma", frozenset(reads), False, True, False, wide))
    ops = [k for k in ("gte", "gt", "lte", "lt", "eq") if k in cond]
    names = tuple(str(b.get("id") or b.get("name") or b.get("title")) for b in base)
    simple = not aliases and all("detection" in b for b in base) and not isinstance(cond.get("field"), list)
    if c["type"] in ("event_count", "value_count") and len(ops) == 1 and simple:
        out.correlations.append(Correlation(rule, c["type"], names, seconds(c["timespan"]), int(cond[ops[0]]), keys, cond.get("field"), ops[0]))
    elif c["type"] in ("temporal", "temporal_ordered") and not ops and simple:
        out.correlations.append(Correlation(rule, c["type"], names, seconds(c["timespan"]), len(names), keys))
    else:
        out.problems.append(f"{rule}: {c['type']} is kept for the guard, not evaluated")
