"""The plain values that rules, recipes and plans are made of. They are rule-sized and live on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

WINDOW_SECONDS = 60
GLOBAL_EVENT_TYPES = ("EventID", "event.code", "event.action", "action")
PRODUCT_EVENT_TYPES = {
    "aws": ("eventName", "eventSource"), "okta": ("eventType",), "m365": ("Operation", "Workload"), "azure": ("operationName", "category"),
    "gcp": ("protoPayload.methodName",), "kubernetes": ("verb", "objectRef.resource"),
}
SCHEMAS = ("undeclared", "sigma", "ecs", "cim", "asim", "ocsf", "udm", "sentinel", "splunk")


@dataclass(frozen=True)
class LogSource:
    product: str | None = None
    service: str | None = None
    category: str | None = None
    complete: bool = False

    def may_apply_to(self, data: LogSource) -> bool:
        """Whether a rule with this scope may see that data: only a conflict rules it out, or an attribute the data is known not to have."""
        for own, other in ((self.product, data.product), (self.service, data.service), (self.category, data.category)):
            if own is None:
                continue
            if other is None:
                if data.complete:
                    return False
            elif own.isascii() and other.isascii() and own.lower() != other.lower():
                return False
        return True

    def same(self, data: LogSource) -> bool:
        """Strict, for recipes: every attribute named here is there and equal."""
        return all(a is None or a == b for a, b in ((self.product, data.product), (self.service, data.service), (self.category, data.category)))


@dataclass(frozen=True)
class Source:
    id: str
    logsource: LogSource = LogSource()
    text_field: str | None = None  # set for sources of text lines
    schema: str = "undeclared"
    event_type: tuple[str, ...] = ()

    def event_type_fields(self) -> tuple[str, ...]:
        """Discriminators to look for, in order, each once."""
        return tuple(dict.fromkeys((*GLOBAL_EVENT_TYPES, *PRODUCT_EVENT_TYPES.get(self.logsource.product or "", ()), *self.event_type)))


def covers(parent: str, child: str) -> bool:
    """parent is child or holds it."""
    return parent == child or child.startswith(parent + ".")


def may_denote(name: str, path: str) -> bool:
    """A bare name may be stored at path itself or below any leading object."""
    return path == name or path.endswith("." + name)


def can_read(data_schema: str, rule_names: str) -> bool:
    """Whether rules in one naming convention can be compared with data in another."""
    return data_schema == rule_names or data_schema == "undeclared"


@dataclass(frozen=True)
class Template:
    id: str
    source: str
    logsource: LogSource = LogSource()
    schema: str = "undeclared"
    discriminators: tuple[tuple[str, str], ...] = ()
    variants: tuple[tuple[str, ...], ...] = ()  # key sets; empty for text
    pattern: tuple[str, ...] = ()  # tokens of a text template
    header: str = "none"
    text_fields: tuple[str, ...] = ()
    events: int = 0
    bytes: int = 0
    source_events: int = 0

    @property
    def is_text(self) -> bool:
        return bool(self.pattern)

    @property
    def fields(self) -> frozenset[str]:
        return frozenset(p for v in self.variants for p in v)


@dataclass(frozen=True)
class Implied:
    """field holds value (JSON text) on these events, or only where when[0] holds when[1]."""

    field: str
    value: str
    when: tuple[str, str] | None = None


@dataclass(frozen=True)
class Recipe:
    drop_fields: frozenset[str] = frozenset()
    drop_empty: bool = False
    implied: tuple[Implied, ...] = ()
    route: str | None = None  # forward_matching or summarize
    summary_keys: tuple[str, ...] = ()
    by: str = "book"

    def __post_init__(self) -> None:
        if self.route not in (None, "forward_matching", "summarize"):
            raise ValueError(f"unknown routing {self.route!r}")
        if self.route and not self.summary_keys:
            raise ValueError("a routing reduction needs summary keys")

    def levels(self) -> list[str]:
        out = [name for name, on in (("drop_fields", self.drop_fields), ("drop_empty", self.drop_empty), ("implied", self.implied)) if on]
        return out + ([self.route] if self.route else [])


@dataclass
class Effective:
    """What may be enforced for a template."""

    template: str
    drop_fields: frozenset[str] = frozenset()
    empty_except: frozenset[str] | None = None  # None: empties stay
    implied: tuple[Implied, ...] = ()
    keep_whole_when: object | None = None  # a predicate
    forward_when: object | None = None  # a predicate: others are summarised; None: all are forwarded
    summary_keys: tuple[str, ...] = ()
    adjustments: list[tuple[str, str]] = field(default_factory=list)

    def removes_fields(self) -> bool:
        return bool(self.drop_fields or self.implied or self.empty_except is not None)

    def reduces(self) -> bool:
        return self.removes_fields() or self.forward_when is not None


RARE_EVENTS, RARE_PPM = 100, 1000


def is_rare(events: int, source_events: int) -> bool:
    """Under either floor; a template exactly at both is not rare."""
    return events < RARE_EVENTS or events * 1_000_000 < RARE_PPM * source_events
