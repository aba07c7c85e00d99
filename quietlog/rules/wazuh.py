"""Wazuh rules and decoders as requirements: own tests, and what parents (if_sid) already demand."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable

from quietlog.functions import predicate as P
from quietlog.model import LogSource
from quietlog.operators.guard import Requirement, opaque

STATIC = {"srcip", "dstip", "srcport", "dstport", "protocol", "action", "user", "id", "url", "data", "extra_data", "status", "system_name", "program_name", "hostname", "location", "srcuser", "dstuser"}
RAW = {"match", "regex"}
SAME = re.compile(r"(same|different|not_same)_(\w+)")
DECODER_DEPTH = 8


def lenient(text: str) -> list[ET.Element]:
    """Elements of a file with several roots, bare '&' and '<' in values."""
    text = re.sub(r"<\?xml[^>]*\?>|<!--.*?-->", "", text, flags=re.DOTALL)
    text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+);)", "&amp;", text)
    text = re.sub(r"<(?![/A-Za-z!])", "&lt;", text)
    return list(ET.fromstring(f"<all>{text}</all>"))


def literal(pattern: str) -> str | None:
    """The text that any match of an osregex or sregex pattern must hold: its longest plain run."""
    if "|" in pattern:
        return None
    runs = [r for r in re.split(r"\\.[+*]?|[\^$()+*?.\[\]{}]", pattern) if len(r) >= 3]
    return max(runs, key=len) if runs else None


def words(pattern: str) -> P.Predicate:
    parts = [literal(x) for x in pattern.split("|")]
    return P.ALWAYS if None in parts or not parts else P.Words(tuple(sorted(set(parts))))


def own(rule: ET.Element) -> tuple[set[str] | None, bool, bool, P.Predicate]:
    """(fields, reads the raw line, stateful, pre-filter) of a rule alone."""
    fields: set[str] | None = set()
    raw = stateful = False
    parts = []
    for e in rule:
        negated, text = e.get("negate") == "yes", (e.text or "").strip()
        if e.tag in RAW:
            raw = True
            parts.append(P.ALWAYS if negated else words(text))
        elif e.tag == "field":
            name = e.get("name", "")
            fields.add(name)
            parts.append(P.ALWAYS if negated else P.present(name))
        elif e.tag in STATIC:
            fields.add(e.tag)
            parts.append(P.ALWAYS)
        elif e.tag == "list":
            fields.add(e.get("field", ""))
            parts.append(P.ALWAYS)
        elif m := SAME.fullmatch(e.tag):
            stateful = True
            fields.add(text if m[2] == "field" else m[2])
        elif e.tag in ("if_fts", "if_matched_sid", "if_matched_group"):
            stateful = True
    if rule.get("frequency") or rule.get("timeframe") or rule.get("ignore"):
        stateful = True
    return fields, raw, stateful, P.all_of(parts)


def load(rule_files: Iterable[str], decoder_files: Iterable[str] = ()) -> tuple[list[Requirement], list[str]]:
    """Requirements of all rules. A rule holds only where its parents do, or any of them; a cycle or a missing parent bounds nothing. Rules that read JSON fields and the raw line may read any field."""
    rules: dict[str, ET.Element] = {}
    groups: dict[str, list[str]] = {}
    out, problems = [], []
    for text in rule_files:
        try:
            roots = lenient(text)
        except ET.ParseError as e:
            problems.append(f"unreadable: {e}")
            out.append(opaque("unreadable"))
            continue
        for group in roots:
            for r in group.iter("rule"):
                rules[r.get("id", "?")] = r
                for g in filter(None, ",".join([group.get("name", ""), *(x.text or "" for x in r.findall("group"))]).split(",")):
                    groups.setdefault(g.strip(), []).append(r.get("id", "?"))
    programs = decoders(decoder_files, problems)
    memo: dict[str, tuple[set[str] | None, bool, P.Predicate, bool]] = {}

    def resolved(rid: str, path: frozenset[str]) -> tuple[set[str] | None, bool, P.Predicate, bool]:
        if rid in memo:
            return memo[rid]
        if rid in path or rid not in rules:
            return None, True, P.ALWAYS, False
        r = rules[rid]
        fields, raw, stateful, p = own(r)
        parents = [x.strip() for tag in ("if_sid", "if_matched_sid") for e in r.findall(tag) for x in re.split(r"[,\s]+", e.text or "") if x.strip()]
        parents += [x for tag in ("if_group", "if_matched_group") for e in r.findall(tag) for x in groups.get((e.text or "").strip(), []) if x != rid]
        text_only = False
        decoded = (r.findtext("decoded_as") or "").strip()
        if decoded and decoded != "json":
            text_only = True
            if decoded in programs:
                p = P.all_of([p, programs[decoded]])
        if parents:
            found = [resolved(x, path | {rid}) for x in parents]
            p = P.all_of([p, P.any_of([f[2] for f in found])])
            fields = None if fields is None or any(f[0] is None for f in found) else fields.union(*(f[0] for f in found))
            raw |= any(f[1] for f in found)
            text_only |= all(f[3] for f in found)
        memo[rid] = (fields, raw, p, text_only)
        return memo[rid]

    for rid in rules:
        fields, raw, p, text_only = resolved(rid, frozenset())
        stateful = own(rules[rid])[2]
        known = None if fields is None or (raw and fields) else frozenset(fields)
        out.append(Requirement(rid, LogSource(), "wazuh", known, raw, stateful, text_only, p))
    return out, problems


def decoders(files: Iterable[str], problems: list[str]) -> dict[str, P.Predicate]:
    """Per decoder the words a line must hold: program name and prematch literals, through at most eight parents."""
    found: dict[str, ET.Element] = {}
    for text in files:
        try:
            for d in lenient(text):
                found.setdefault(d.get("name", "?"), d)
        except ET.ParseError as e:
            problems.append(f"unreadable decoders: {e}")

    def bound(name: str, depth: int) -> P.Predicate:
        d = found.get(name)
        if d is None or depth > DECODER_DEPTH:
            return P.ALWAYS
        parts = [words((d.findtext(tag) or "").strip()) for tag in ("program_name", "prematch") if d.findtext(tag)]
        parent = (d.findtext("parent") or "").strip()
        return P.all_of([*parts, bound(parent, depth + 1)] if parent else parts)

    return {name: bound(name, 0) for name in found}
