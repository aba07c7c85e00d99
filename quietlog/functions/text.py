"""Text lines: headers, tokens, masks. Each function comes as Spark SQL (for tables) and as Python (for the driver and for Drain)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
BSD = re.compile(rf"^(?:<\d{{1,3}}>)?(?:{MONTHS})\s+\d{{1,2}}\s+\d\d:\d\d:\d\d\s+\S+\s+([^\s\[:]+)(?:\[[^\]\s]*\])?:(?:\s+|$)", re.ASCII)
ISO = re.compile(r"^(?:<\d{1,3}>)?\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?\s+\S+\s+([^\s\[:]+)(?:\[[^\]\s]*\])?:(?:\s+|$)", re.ASCII)
TAG = r"^%(?=[A-Za-z0-9_]*[A-Za-z])[A-Za-z0-9_]+-[0-9]-[A-Za-z0-9_]+:*$"
_TAG = re.compile(TAG)
_CORE = re.compile(r"^([^A-Za-z0-9]*)(.*?)([^A-Za-z0-9]*)$", re.DOTALL)


def line(text: str) -> tuple[list[str], bool]:
    """(tokens, whether a syslog header led): the header goes, its program's name becomes the first token."""
    for header in (BSD, ISO):
        if m := header.match(text):
            return [m[1], *text[m.end() :].split()], True
    return text.split(), False


def is_hex_identifier(core: str) -> bool:
    """0x and hex digits, or at least eight hex digits with a decimal one among them."""
    if re.fullmatch(r"0[xX][0-9A-Fa-f]+", core):
        return True
    return len(core) >= 8 and re.fullmatch(r"[0-9A-Fa-f]+", core) is not None and any(c in "0123456789" for c in core)


def mask(token: str) -> str:
    """A message tag stays; a hex identifier becomes <HEX>; each run of ASCII digits <NUM>."""
    if _TAG.match(token):
        return token
    lead, core, tail = _CORE.match(token).groups()
    if is_hex_identifier(core):
        return f"{lead}<HEX>{tail}"
    return re.sub(r"[0-9]+", "<NUM>", token)


def mask_sql(token: str) -> str:
    """The same in Spark SQL. Only tokens with a digit can change."""
    core = f"regexp_extract({token}, '(?s)^[^A-Za-z0-9]*(.*?)[^A-Za-z0-9]*$', 1)"
    hexed = f"({core} rlike '^0[xX][0-9A-Fa-f]+$' or ({core} rlike '^[0-9A-Fa-f]{{8,}}$' and {core} rlike '[0-9]'))"
    lead = f"regexp_extract({token}, '(?s)^([^A-Za-z0-9]*)', 1)"
    tail = f"regexp_extract({token}, '(?s)[A-Za-z0-9]([^A-Za-z0-9]*)$', 1)"
    return f"case when not {token} rlike '[0-9]' then {token} when {token} rlike '{TAG}' then {token} when {hexed} then concat({lead}, '<HEX>', {tail}) else regexp_replace({token}, '[0-9]+', '<NUM>') end"


def tokens(text: Column) -> Column:
    """Words of a text between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def masked_tokens(text: str) -> Column:
    """Masked words of a text column, its header kept in."""
    return F.expr(f"transform(filter(split({text}, r'(?U)\\s+'), w -> w <> ''), w -> {mask_sql('w')})")


def sanitize(text: Column) -> Column:
    """':' '/' and white space become '_'."""
    return F.regexp_replace(text, r"(?U)[:/\s]", "_")


def pattern_regex(pattern: list[str] | tuple[str, ...], header: str) -> str | None:
    """A Java regular expression for lines of a text template; none where some had a header and some not."""
    if header == "mixed":
        return None
    quote = lambda s: "".join("\\" + c if not c.isalnum() and c.isascii() and c not in "_ " else c for c in s)

    def token(t: str) -> str:
        out = ""
        for piece in re.split(r"(<\*>|<NUM>|<HEX>)", t):
            out += {"<*>": r"\S+", "<NUM>": r"[0-9]+", "<HEX>": r"(?:0[xX])?[0-9A-Fa-f]+"}.get(piece) or quote(piece)
        return out

    body = r"\s+".join(map(token, pattern[1:] if header == "syslog" else pattern))
    if header == "syslog":
        stamp = rf"(?:(?:{MONTHS})\s+\d{{1,2}}\s+\d\d:\d\d:\d\d|\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?)"
        return rf"(?U)^(?:<\d{{1,3}}>)?{stamp}\s+\S+\s+{token(pattern[0])}(?:\[[^\]\s]*\])?:\s*{body}\s*$"
    return rf"(?U)^\s*{body}\s*$"


#: Both headers in one, as Spark reads it; the program's name is group 1.
HEADER = ("^(?:" + BSD.pattern[1:].partition(r"\s+\S+\s+")[0] + "|" + ISO.pattern[1:].partition(r"\s+\S+\s+")[0] + r")\s+\S+\s+" + ISO.pattern.partition(r"\s+\S+\s+")[2]).replace("\\", "\\\\")


def with_line_tokens(df: DataFrame, text: str = "text", tokens: str = "tokens", syslog: str = "syslog") -> DataFrame:
    """df with line() of a text column: its masked tokens, header taken off, and whether there was one. Null has no tokens.

    The optimizer would copy the regular expressions into every use of their results; it moves nothing past what it cannot foresee."""
    df = df.withColumn(syslog, F.when(F.spark_partition_id() >= 0, F.regexp_extract(F.coalesce(text, F.lit("")), HEADER.replace("\\\\", "\\"), 1)))
    rest = f"if({syslog} = '', coalesce({text}, ''), regexp_replace({text}, '{HEADER}', ''))"
    words = f"concat(if({syslog} = '', cast(array() as array<string>), array({syslog})), filter(split({rest}, '(?U)\\\\s+'), w -> w <> ''))"
    return df.withColumn(tokens, F.expr(f"transform({words}, w -> {mask_sql('w')})")).withColumn(syslog, F.col(syslog) != "")
