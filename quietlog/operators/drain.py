"""Templates of text lines: Drain clusters, exact in event order, in parallel.

Clusters never cross (source, number of tokens, routed first token), so each such group is clustered on its own, line after line in the order of events. Groups stream through
their task sorted: it holds the clusters and remembered answers for different lines, not the events. A line's answer is remembered as long as no cluster of the group changes: then adding it
again would change nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietlog.functions.text import with_line_tokens
from quietlog.store import joined, written

WILD, SIMILAR, CHILDREN, MAX_CATEGORIES = "<*>", 0.4, 100, 6
#: Between the tokens of a line that travels as one string; no token holds it: it is white space to nobody, but masks leave it alone, so it is taken out first.
JOINT = "\x1f"
#: Different lines whose answers a group remembers at most; it forgets all when there are more.
REMEMBERED = 100_000


class Drain:
    """Clusters of one routed group."""

    def __init__(self, similar: float = SIMILAR):
        self.similar = similar
        self.code: dict[str, int] = {WILD: 0}
        self.names: list[str] = [WILD]
        self.rows = np.zeros((0, 0), np.int32)  # a row per cluster, the code of each token; 0 is the wildcard
        self.wild = np.zeros(0, np.int64)
        self.n = 0
        self.answers: dict[str, int] = {}

    @property
    def clusters(self) -> list[list[str]]:
        return [[self.names[c] for c in self.rows[i]] for i in range(self.n)]

    def add_line(self, line: str) -> int:
        """add() of a joined line."""
        found = self.answers.get(line)
        return self.add(line.split(JOINT) if line else [], line) if found is None else found

    def add(self, tokens: list[str], line: str | None = None) -> int:
        """The cluster's number; of equally similar ones that with more wildcards, then the older."""
        line = JOINT.join(tokens) if line is None else line
        codes = []
        for t in tokens:
            c = self.code.get(t)
            if c is None:
                c = self.code[t] = len(self.names)
                self.names.append(t)
            codes.append(c)
        own = np.array(codes, np.int32)
        if self.n:
            rows = self.rows[: self.n]
            equal = ((rows == own) & (rows != 0)).sum(axis=1) if len(own) else np.zeros(self.n, np.int64)
            # Shares of one length compare as counts do; of equal ones the most wildcards, then the first.
            best = int(np.argmax(equal * (len(own) + 1) + self.wild[: self.n]))
            if not len(own) or equal[best] / len(own) >= self.similar:
                changed = (self.rows[best] != own) & (self.rows[best] != 0)
                if changed.any():
                    self.rows[best, changed] = 0
                    self.wild[best] += changed.sum()
                    self.answers.clear()
                else:
                    if len(self.answers) >= REMEMBERED:
                        self.answers.clear()
                    self.answers[line] = best
                return best
        if self.n == len(self.rows):
            grown = np.zeros((max(16, 2 * self.n), len(own)), np.int32)
            if self.n:
                grown[: self.n] = self.rows[: self.n]
            self.rows, self.wild = grown, np.append(self.wild, np.zeros(len(grown) - len(self.wild), np.int64))
        self.rows[self.n] = own
        self.wild[self.n] = (own == 0).sum()
        self.n += 1
        self.answers.clear()
        return self.n - 1


def routed(lines: DataFrame, children: int = CHILDREN) -> DataFrame:
    """lines (source, event_id, text) with line (the masked tokens, joined), syslog, length and route.

    Of each length, first tokens without a digit get a branch each in the order they first come, as long as there are fewer than children - 1 branches; the wildcard's, which tokens with digits and
    those beyond take, counts as one from its first line on."""
    df = with_line_tokens(lines.select("source", "event_id", "text"))
    df = df.select("source", "event_id", "syslog", F.array_join(F.transform("tokens", lambda t: F.translate(t, JOINT, "")), JOINT).alias("line"), F.size("tokens").alias("length"))
    df = written(df, "lines").withColumn("first", F.substring_index("line", JOINT, 1))
    seen = df.groupBy("source", "length", "first").agg(F.min("event_id").alias("since"))
    wild = F.col("first").rlike("[0-9]") | (F.col("first") == WILD)
    seen = seen.withColumn("wild", wild).withColumn("wild_since", F.min(F.when(wild, F.col("since"))).over(Window.partitionBy("source", "length")))
    place = F.row_number().over(Window.partitionBy("source", "length", "wild").orderBy("since", "first"))
    taken = place - 1 + F.when(F.col("wild_since") < F.col("since"), 1).otherwise(0)
    early = seen.withColumn("taken", taken).where(~F.col("wild") & (F.col("taken") + 1 < children)).select("source", "length", "first", F.col("first").alias("route"))
    return joined(df, written(early, "routes"), ["source", "length", "first"], "left").withColumn("route", F.coalesce("route", F.lit(WILD))).drop("first")


GROUP = ["source", "length", "route"]


def clustered_groups(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per line with its cluster's number; after the last line of a group a row per cluster with its pattern."""
    now, drain = None, Drain()
    done: list[tuple] = []

    def finish() -> None:
        done.extend((*now, i, pattern) for i, pattern in enumerate(drain.clusters))

    def patterns() -> pd.DataFrame:
        out = pd.DataFrame(done, columns=["source", "length", "route", "cluster", "pattern"])
        done.clear()
        n = len(out)
        return out.assign(event_id=pd.array([None] * n, dtype="Int64"), syslog=pd.array([None] * n, dtype="boolean"), line=None)[["source", "length", "route", "event_id", "syslog", "line", "cluster", "pattern"]]

    for pdf in it:
        group = list(zip(pdf.source, pdf.length, pdf.route, strict=True))
        edges = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
        cluster = np.empty(len(pdf), np.int64)
        lines = pdf.line.tolist()
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if group[lo] != now:
                if now is not None:
                    finish()
                now, drain = group[lo], Drain()
            add = drain.add_line
            cluster[lo:hi] = [add(x) for x in lines[lo:hi]]
        yield pdf.assign(cluster=cluster, pattern=None)
        if done:
            yield patterns()
    if now is not None:
        finish()
        yield patterns()


def clusters(lines: DataFrame) -> DataFrame:
    """(source, event_id, syslog, tokens, cluster_id, pattern): every line's cluster, with the cluster's final pattern, as one run over the lines of each source by event_id (ties by the line) gives them.

    A null text is a line without tokens. event_id must not be null."""
    df = routed(lines).select(*GROUP, "event_id", "syslog", "line")
    df = df.repartition(*GROUP).sortWithinPartitions(*GROUP, "event_id", "line")
    found = df.mapInPandas(clustered_groups, "source string, length int, route string, event_id long, syslog boolean, line string, cluster int, pattern array<string>")
    found = written(found, "drain")
    name = F.concat_ws(":", "source", F.substring(F.sha2(F.concat_ws("\x1f", "source", "length", "route", F.array_join("pattern", " ")), 256), 1, 12))
    # Two clusters of a group may end with one pattern; they are told apart by their number in the group.
    named = found.where("event_id is null").select(*GROUP, "cluster", "pattern", F.concat(name, F.lit("."), F.col("cluster").cast("string")).alias("cluster_id"))
    rows = joined(found.where("event_id is not null").drop("pattern"), written(named, "patterns"), [*GROUP, "cluster"])
    tokens = F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", JOINT))
    return rows.select("source", "event_id", "syslog", tokens.alias("tokens"), "cluster_id", "pattern")


def categorical(clustered: DataFrame, most: int = MAX_CATEGORIES) -> DataFrame:
    """(cluster_id, position): wildcards that hold six different tokens at most, or message tags only."""
    tag = r"^%(?=[A-Za-z0-9_]*[A-Za-z])[A-Za-z0-9_]+-[0-9]-[A-Za-z0-9_]+:*$"
    rows = clustered.select("cluster_id", "pattern", F.posexplode("tokens").alias("position", "token")).where("pattern[position] = '<*>'")
    values = rows.groupBy("cluster_id", "position", "token").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("cluster_id", "position").agg(F.count(F.lit(1)).alias("values"), F.bool_and(F.col("token").rlike(tag)).alias("tags")).where((F.col("values") <= most) | F.col("tags")).select("cluster_id", "position")


def text_templates(lines: DataFrame) -> DataFrame:
    """(source, event_id, template_id, pattern, header): clusters with categorical wildcards filled in; header is syslog, none or mixed."""
    found = clusters(lines)
    at = categorical(found).groupBy("cluster_id").agg(F.collect_set("position").alias("positions"))
    df = joined(found, written(at, "categories"), ["cluster_id"], "left").withColumn("pattern", F.expr("transform(pattern, (t, i) -> if(array_contains(coalesce(positions, array()), i), tokens[i], t))"))
    df = df.withColumn("template_id", F.concat_ws(":", "source", F.substring(F.sha2(F.concat_ws("\x1f", "source", F.array_join("pattern", " ")), 256), 1, 12)))
    header = df.groupBy("template_id").agg(F.min("syslog").alias("lo"), F.max("syslog").alias("hi")).select("template_id", F.when(F.col("lo") != F.col("hi"), "mixed").when(F.col("hi"), "syslog").otherwise("none").alias("header"))
    return joined(df, written(header, "headers"), ["template_id"]).select("source", "event_id", "template_id", "pattern", "header")
