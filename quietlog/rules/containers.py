"""Exported rule sets of a workspace, in whatever language each rule is, as requirements."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from quietlog.functions import predicate as P
from quietlog.model import LogSource
from quietlog.operators.guard import Requirement, opaque
from quietlog.rules import kibana, kusto, spl
from quietlog.rules.lex import Reading, Unreadable

INDEX = ((r"winlogbeat|windows", LogSource("windows")), (r"auditbeat|linux", LogSource("linux")), (r"packetbeat|dns", LogSource(category="dns")), (r"aws", LogSource("aws")), (r"azure", LogSource("azure")), (r"okta", LogSource("okta")), (r"gcp", LogSource("gcp")))


def scope(patterns: list[str]) -> LogSource:
    """The log source that all index patterns agree on; nothing where they don't."""
    found = {next((s for rx, s in INDEX if re.search(rx, p)), LogSource()) for p in patterns}
    return found.pop() if len(found) == 1 else LogSource()


def elastic(lines: Iterable[str]) -> list[Requirement]:
    """An NDJSON export: of each rule its newest version; disabled and deprecated rules are left out; machine-learning rules may read anything."""
    newest: dict[str, dict] = {}
    for line in lines:
        if not line.strip():
            continue
        r = json.loads(line)
        if "rule_id" not in r and "id" not in r:
            continue
        key = str(r.get("rule_id") or r["id"])
        if key not in newest or r.get("version", 0) >= newest[key].get("version", 0):
            newest[key] = r
    out = []
    for rule, r in newest.items():
        if r.get("enabled") is False or "deprecated" in str(r.get("name", "")).lower():
            continue
        where = scope(r.get("index") or [])
        try:
            if r.get("type") == "machine_learning":
                raise Unreadable("machine learning")
            language = r.get("language", "kuery")
            query = r.get("query") or ""
            reading = {"kuery": kibana.kql, "eql": kibana.eql, "esql": kibana.esql}[language](query) if language != "lucene" else lucene()
            extra = set()
            if r.get("threshold"):
                f = r["threshold"].get("field") or []
                extra |= set(f if isinstance(f, list) else [f]) | {c["field"] for c in r["threshold"].get("cardinality") or []}
            extra |= set((r.get("new_terms_fields") or [])) | {e["field"] for t in r.get("threat_mapping") or [] for e in t.get("entries") or []}
            fields = None if reading.fields is None else frozenset(reading.fields | extra)
            prefilter = P.ALWAYS if any("alerts-security" in p or ".siem-signals" in p for p in r.get("index") or []) else reading.prefilter
            out.append(Requirement(rule, where, "ecs", fields, reading.raw_text, reading.stateful or r.get("type") in ("threshold", "new_terms", "threat_match"), False, prefilter))
        except (Unreadable, KeyError, TypeError):
            out.append(opaque(rule, where))
    return out


def lucene() -> Reading:
    out = Reading()
    out.any_field("Lucene is not read")
    return out


def sentinel(rules: Iterable[dict], functions: dict[str, str] | None = None) -> list[Requirement]:
    """Analytics rules (name, query): one requirement per table, or one for any data where no table is known."""
    out = []
    for r in rules:
        try:
            reading, tables = kusto.kusto(r["query"], functions)
            fields = None if reading.fields is None else frozenset(reading.fields)
            for scope_of in sorted({kusto.TABLES.get(t, LogSource()) for t in tables}, key=repr) or [LogSource()]:
                out.append(Requirement(r["name"], scope_of, "sentinel", fields, reading.raw_text, reading.stateful, False, reading.prefilter if len(tables) == 1 else P.ALWAYS))
        except (Unreadable, KeyError, TypeError):
            out.append(opaque(r.get("name", "?")))
    return out


def splunk(searches: dict[str, str], macros: dict[str, tuple[list[str], str]] | None = None, props: spl.Props | None = None) -> list[Requirement]:
    out = []
    for name, search in searches.items():
        try:
            reading = spl.spl(search, macros, props)
            out.append(Requirement(name, LogSource(), "splunk", None if reading.fields is None else frozenset(reading.fields), reading.raw_text, reading.stateful, False, reading.prefilter))
        except (Unreadable, ValueError):
            out.append(opaque(name))
    return out
