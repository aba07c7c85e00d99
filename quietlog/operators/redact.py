"""Pseudonyms for values that name people or machines, before an event is shown to anyone outside. The same value has the same pseudonym under one salt."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = re.compile(r"(user|account|host|computer|domain|mail|workstation|owner|subject|client)", re.I)
PATTERNS = (
    ("mail", re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")), ("mac", re.compile(r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b")), ("ip", re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b")),
    ("ip6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:)+(?::[0-9A-Fa-f]{1,4})+(?![\w:])")), ("token", re.compile(r"\b[A-Za-z0-9+/_-]{32,}={0,2}")),
)


def name(kind: str, value: str, salt: str) -> str:
    return f"<{kind}-{hashlib.sha256(f'{salt}\x00{kind}\x00{value}'.encode()).hexdigest()[:8]}>"


def redacted(value: object, salt: str, key: str = "") -> object:
    if isinstance(value, dict):
        return {k: redacted(v, salt, k) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, salt, key) for v in value]
    if isinstance(value, str) and value:
        if NAMED.search(key):
            return name("name", value, salt)
        for kind, rx in PATTERNS:
            value = rx.sub(lambda m, kind=kind: name(kind, m[0], salt), value)
    return value


def redact(body: Column, salt: str) -> Column:
    """JSON text of a body (VARIANT) with pseudonyms; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(redacted(json.loads(t), salt), separators=(",", ":"), sort_keys=True, ensure_ascii=False))

    return F.pandas_udf(run, "string")(F.to_json(body))
