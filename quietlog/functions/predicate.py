"""Predicates on events: normalised trees, static answers about templates, and Spark columns.

Compiled as a pre-filter a predicate may only be too wide: what cannot be told counts as a match."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ALTERNATION_FROM = 5
MAX_TESTS = 256


@dataclass(frozen=True, order=True)
class Test:
    """A field's value against any of values. op: equals, contains, startswith, endswith, regex, exists."""

    field: str
    op: str
    values: tuple[str, ...] = ()
    cased: bool = False


@dataclass(frozen=True, order=True)
class Words:
    """Any of values inside any string or number of the event."""

    values: tuple[str, ...]
    cased: bool = False


@dataclass(frozen=True)
class Any:
    of: tuple = ()


@dataclass(frozen=True)
class All:
    of: tuple = ()


@dataclass(frozen=True)
class Not:
    """Only in exact rules; pre-filters widen it to Always."""

    of: object


ALWAYS, NEVER = All(), Any()
Predicate = Test | Words | Any | All | Not


def _flat(kind: type, parts) -> list:
    out = []
    for p in parts:
        out += list(p.of) if isinstance(p, kind) else [p]
    return sorted(set(out), key=repr)


def any_of(parts) -> Predicate:
    """Flattened, in order, each once, tests of one kind on one field merged; one that always holds makes all hold."""
    flat = _flat(Any, parts)
    if ALWAYS in flat:
        return ALWAYS
    flat = merged_alternatives(flat)
    return flat[0] if len(flat) == 1 else Any(tuple(flat))


def all_of(parts) -> Predicate:
    flat = [p for p in _flat(All, parts) if p != ALWAYS]
    if NEVER in flat:
        return NEVER
    return flat[0] if len(flat) == 1 else All(tuple(flat))


def merged_alternatives(parts: list) -> list:
    """Tests that differ only in their values become one."""
    groups: dict = {}
    rest = []
    for p in parts:
        if isinstance(p, Test) and p.op not in ("exists",):
            groups.setdefault((p.field, p.op, p.cased), set()).update(p.values)
        elif isinstance(p, Words):
            groups.setdefault((None, "words", p.cased), set()).update(p.values)
        else:
            rest.append(p)
    made = [Words(tuple(sorted(v)), c) if op == "words" else Test(f, op, tuple(sorted(v)), c) for (f, op, c), v in groups.items()]
    return sorted([*made, *rest], key=repr)


def present(field: str) -> Test:
    """Any value but null and an empty object."""
    return Test(field, "exists")


def tests(p: Predicate) -> int:
    """How many comparisons an event can cost."""
    if isinstance(p, (Test, Words)):
        return max(1, len(p.values))
    return sum(map(tests, p.of)) if isinstance(p, (Any, All)) else tests(p.of)


def names_fields(p: Predicate) -> bool:
    if isinstance(p, Test):
        return True
    return any(map(names_fields, p.of)) if isinstance(p, (Any, All)) else isinstance(p, Not) and names_fields(p.of)


def on_text_line(p: Predicate) -> Predicate:
    """What is left of a predicate where only the line is known: words stay, fields may hold anything."""
    if isinstance(p, Test):
        return ALWAYS
    if isinstance(p, Any):
        return any_of(map(on_text_line, p.of))
    if isinstance(p, All):
        return all_of(map(on_text_line, p.of))
    return p


def widened(p: Predicate) -> Predicate:
    """An exact rule's predicate as a pre-filter: negations always hold."""
    if isinstance(p, Not):
        return ALWAYS
    if isinstance(p, Any):
        return any_of(map(widened, p.of))
    return all_of(map(widened, p.of)) if isinstance(p, All) else p


def _told(test: Test, value: str) -> bool | None:
    """Whether a known text passes; None where case cannot be decided (beyond ASCII) or a pattern asks."""
    if test.op == "exists":
        return True
    if test.op == "regex":
        return None
    if not test.cased and not (value.isascii() and all(v.isascii() for v in test.values)):
        return None
    fold = (lambda s: s) if test.cased else str.lower
    ask: Callable[[str, str], bool] = {"equals": str.__eq__, "contains": lambda a, b: b in a, "startswith": str.startswith, "endswith": str.endswith}[test.op]
    return any(ask(fold(value), fold(v)) for v in test.values)


def may_match(p: Predicate, fixed: dict[str, str], paths: frozenset[str] | None) -> bool:
    """Could an event with these fixed values, and no fields beyond paths, match? Words and patterns never rule out."""
    if isinstance(p, Test):
        if p.field in fixed:
            return _told(p, fixed[p.field]) is not False
        return paths is None or any(q == p.field or q.startswith(p.field + ".") for q in paths)
    if isinstance(p, Any):
        return any(may_match(q, fixed, paths) for q in p.of)
    if isinstance(p, All):
        return all(may_match(q, fixed, paths) for q in p.of)
    return True


def holds_for_all(p: Predicate, fixed: dict[str, str]) -> bool:
    """Does every event with these fixed values match?"""
    if isinstance(p, Test):
        return p.field in fixed and _told(p, fixed[p.field]) is True
    if isinstance(p, Any):
        return any(holds_for_all(q, fixed) for q in p.of)
    return isinstance(p, All) and all(holds_for_all(q, fixed) for q in p.of)


def _balanced(parts: list[Column], join) -> Column:
    """A balanced tree: thousands of alternatives in a row would overflow the stack."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _quoted(value: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", value)


def text_test(column: Column, op: str, values: tuple[str, ...], cased: bool) -> Column:
    if op == "regex":
        return _balanced([column.rlike(v if cased else f"(?i){v}") for v in values], lambda a, b: a | b)
    own = column if cased else F.lower(column)
    values = tuple(dict.fromkeys(v if cased else v.lower() for v in values))
    if op == "equals":
        return own.isin(list(values)) if len(values) > 1 else own == values[0]
    if len(values) >= ALTERNATION_FROM:
        body = "(?:" + "|".join(map(_quoted, values)) + ")"
        return own.rlike({"contains": "(?s)" + body, "startswith": "(?s)^" + body, "endswith": "(?s)" + body + r"\z"}[op])
    ask = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[op]
    return _balanced([ask(own, F.lit(v)) for v in values], lambda a, b: a | b)


def _number_like(value: str) -> bool:
    return any(c.isdigit() for c in value) or value == ""


def _texts_pass(texts: Column, test) -> Column:
    return F.exists(texts, test)


def compiled(p: Predicate, leaves: str = "leaves", wide: bool = True) -> Column:
    """A boolean column, never null. With wide, as a pre-filter: floats a tested value might print as, and nested array members, count as matches."""
    if isinstance(p, Any):
        return _balanced([compiled(q, leaves, wide) for q in p.of], lambda a, b: a | b) if p.of else F.lit(False)
    if isinstance(p, All):
        return _balanced([compiled(q, leaves, wide) for q in p.of], lambda a, b: a & b) if p.of else F.lit(True)
    if isinstance(p, Not):
        return ~compiled(p.of, leaves, wide)

    def strings(j: Column) -> Column:
        """The text of a JSON string; only one with escapes needs a parser. Of an array its JSON text."""
        parsed = F.get_json_object(F.concat(F.lit("["), j, F.lit("]")), "$[0]")
        return F.when(F.startswith(j, F.lit('"')) & ~F.contains(j, F.lit("\\")), F.substring(j, F.lit(2), F.length(j) - 2)).otherwise(parsed)

    if isinstance(p, Words):
        eager = F.lit(wide and any(map(_number_like, p.values)))

        def word(e: Column) -> Column:
            kind, json = e["kind"], e["json"]
            text = F.when(kind.isin("string", "array"), strings(json)).otherwise(json)
            return (kind.isin("string", "int", "array") & text_test(text, "contains", p.values, p.cased)) | ((kind == "float") & eager)

        return F.coalesce(F.exists(F.map_values(F.col(leaves)), word), F.lit(False))
    leaf = F.col(leaves)[p.field]
    below = F.exists(F.map_keys(F.col(leaves)), lambda k: F.startswith(k, F.lit(p.field + ".")))
    if p.op == "exists":
        return F.coalesce((leaf["kind"] != "null") | below, below, F.lit(False))
    kind, json = leaf["kind"], leaf["json"]
    plain = text_test(F.when(kind == "string", strings(json)).otherwise(json), p.op, p.values, p.cased)
    members = F.from_json(json, "array<string>")
    hit = (
        F.when(leaf.isNull(), below if wide else F.lit(False))
        .when(kind == "null", False)
        .when(kind == "array", F.exists(members, lambda m: F.when(F.startswith(m, F.lit("{")) | F.startswith(m, F.lit("[")), F.lit(wide)).otherwise(text_test(m, p.op, p.values, p.cased))))
        .when(kind == "float", F.lit(True) if wide and (p.op == "regex" or any(map(_number_like, p.values))) else plain)
        .otherwise(plain)
    )
    return F.coalesce(hit, F.lit(False))
