"""Templates of JSON events: which shapes there are, how many, how large, and which event has which."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietlog.functions.leaves import encoded_size, keyset, rendered, string_of, with_leaves
from quietlog.functions.text import pattern_regex
from quietlog.model import RARE_EVENTS, RARE_PPM, Source, Template
from quietlog.operators.drain import text_templates
from quietlog.store import joined, written

FREE_TEXT_BYTES = 40


def prepared(events: DataFrame, discriminators: dict[str, tuple[str, ...]] | tuple[str, ...]) -> DataFrame:
    """events (event_id, ts, source, body VARIANT) with leaves, keyset, discr (the discriminators there, as 'field=value' lines) and bytes.

    discriminators: fields to look for, in order, for all sources or by source. An event whose body is null (bad JSON) has no leaves."""
    df = with_leaves(events) if "leaves" not in events.columns else events
    by = discriminators if isinstance(discriminators, dict) else {None: discriminators}

    def named(fields: tuple[str, ...]):
        parts = ", ".join(f"if(map_contains_key(leaves, '{f}'), concat('{f}=', {rendered(f'leaves[{chr(39)}{f}{chr(39)}]')}), null)" for f in fields)
        return F.expr(f"concat_ws('\\n', {parts})") if parts else F.lit("")

    discr = named(by[None]) if None in by else F.lit("")
    for source, fields in by.items():
        if source is not None:
            discr = F.when(F.col("source") == source, named(fields)).otherwise(discr)
    return df.withColumn("discr", discr).withColumn("keyset", keyset()).withColumn("bytes", encoded_size(F.coalesce(F.to_json("body"), F.lit(""))))


def shapes(prepared_events: DataFrame) -> DataFrame:
    """(source, discr, keyset): events, bytes. One shuffle, partial sums first."""
    return prepared_events.groupBy("source", "discr", "keyset").agg(F.count(F.lit(1)).alias("events"), F.sum("bytes").alias("bytes"))


def kinds(shapes_found: DataFrame) -> DataFrame:
    """Every shape with the template it belongs to: source, discr, keyset, template_id, and the template's events, bytes, source_events, is_rare.

    Frequent variants with the same discriminators are one template; a rare variant, or one without discriminators, is its own."""
    per_source = shapes_found.groupBy("source").agg(F.sum("events").alias("source_events"))  # one row a source
    df = shapes_found.join(F.broadcast(per_source), "source")
    rare = f"events < {RARE_EVENTS} or cast(events as decimal(38,0)) * 1000000 < cast(source_events as decimal(38,0)) * {RARE_PPM}"
    alone = F.expr(f"({rare}) or discr = ''")
    df = df.withColumn("kind", F.when(alone, F.col("keyset")).otherwise("")).withColumn("merged", ~alone)
    label = F.expr("array_join(transform(filter(split(discr, '\\n'), d -> d <> ''), d -> regexp_replace(substring_index(d, '=', -1), '(?U)[:/\\\\s]', '_')), ':')")
    name = F.concat_ws(":", F.col("source"), F.when(label != "", label), F.substring(F.sha2(F.concat_ws("\x1f", "source", "discr", "kind", F.col("merged").cast("string")), 256), 1, 12))
    of = Window.partitionBy("source", "discr", "kind", "merged")
    df = df.withColumn("template_id", name).withColumn("template_events", F.sum("events").over(of)).withColumn("template_bytes", F.sum("bytes").over(of))
    return df.select(
        "source", "discr", "keyset", "template_id", F.col("template_events").alias("events"), F.col("template_bytes").alias("bytes"), "source_events",
        F.expr(rare.replace("events", "template_events", 1).replace("cast(events", "cast(template_events")).alias("is_rare"),
    )


def kinds_of(prepared_events: DataFrame) -> DataFrame:
    """kinds() of the events, written once: what asks for them again does not read the events again."""
    return written(kinds(shapes(prepared_events)), "kinds")


def template_volumes(kinds_found: DataFrame) -> DataFrame:
    """One row per template, its share of its source in parts per million rounded down."""
    one = kinds_found.groupBy("template_id", "source", "discr").agg(*(F.first(c).alias(c) for c in ("events", "bytes", "source_events", "is_rare")), F.count(F.lit(1)).alias("variants"))
    return one.withColumn("share_ppm", F.expr("cast(events * 1000000 div source_events as bigint)"))


def assigned(prepared_events: DataFrame, kinds_found: DataFrame) -> DataFrame:
    """Events with template_id, by a hash join on the shape; an unknown shape has null and is passed through. kinds_found: a written table.

    Shapes are few and events many: sorted by shape, all events would meet in a handful of tasks."""
    return joined(prepared_events, kinds_found.select("source", "discr", "keyset", "template_id"), ["source", "discr", "keyset"], "left")


def free_text_fields(prepared_events: DataFrame, group: tuple[str, ...] = ("source",)) -> DataFrame:
    """String fields per group: values, mean bytes (whole), share with white space in percent (rounded down), and whether that is free text:
    40 bytes or more on average, white space in half of the values or more."""
    long = prepared_events.select(*group, F.explode("leaves").alias("path", "leaf")).where("leaf.kind = 'string'").withColumn("text", F.expr("get_json_object(concat('[', leaf.json, ']'), '$[0]')"))
    found = long.groupBy(*group, "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("total"), F.sum(F.col("text").rlike(r"(?U)\s").cast("long")).alias("spaced"))
    return found.select(*group, "path", "n", F.expr("total div n").alias("avg_bytes"), F.expr("spaced * 100 div n").alias("spaced_pct"), F.expr(f"total div n >= {FREE_TEXT_BYTES} and spaced * 2 >= n").alias("is_free_text"))


def leaf_paths(prepared_events: DataFrame) -> DataFrame:
    """(path, kind): how many leaves."""
    return prepared_events.select(F.explode("leaves").alias("path", "leaf")).groupBy("path", F.col("leaf.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def line_of(sources: Sequence[Source]) -> Column:
    """The text line of events of text sources that hold one; null for all others."""
    out = F.lit(None).cast("string")
    for s in sources:
        if s.text_field:
            leaf = f"leaves['{s.text_field}']"
            out = F.when((F.col("source") == s.id) & F.expr(f"{leaf}.kind = 'string'"), F.expr(string_of(leaf))).otherwise(out)
    return out


def discovered(prepared_events: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """Events with template_id, pattern and header (null for JSON): text lines by Drain, everything else, and text events without their line, by shape."""
    text = [s for s in sources if s.text_field]
    df = prepared_events.withColumn("line", line_of(sources))
    shaped = df.where("line is null") if text else df
    out = assigned(shaped, kinds_of(shaped)).withColumns({"pattern": F.lit(None).cast("array<string>"), "header": F.lit(None).cast("string")})
    if text:
        lines = df.where("line is not null")
        found = text_templates(lines.select("source", "event_id", F.col("line").alias("text")))
        out = out.unionByName(lines.join(found, ["source", "event_id"]))
    return out.drop("line")


def templates_of(found: DataFrame, sources: Sequence[Source]) -> list[Template]:
    """Templates of discovered events as driver values: as many as there are shapes, not events."""
    by = {s.id: s for s in sources}
    totals = {r.source: r.n for r in found.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = found.groupBy("template_id", "source", F.when(F.col("pattern").isNull(), F.col("discr")).alias("discr"), "pattern", "header").agg(F.collect_set("keyset").alias("keysets"), F.count(F.lit(1)).alias("events"), F.sum("bytes").alias("bytes"))
    out = []
    for r in rows.orderBy("template_id").collect():
        s = by[r.source]
        pairs = tuple(tuple(d.split("=", 1)) for d in (r.discr or "").split("\n") if d)
        out.append(Template(r.template_id, r.source, s.logsource, s.schema, pairs, tuple(sorted(tuple(k.split("\n")) for k in r.keysets)), tuple(r.pattern or ()), r.header or "none", (s.text_field,) if s.text_field else (), r.events, r.bytes, totals[r.source]))
    return out


def classified(prepared_events: DataFrame, known: Iterable[Template], sources: Sequence[Source]) -> DataFrame:
    """Events with template_id by known templates: key sets first, by a join; then text patterns, fewest wildcards first. What fits none has null, and is forwarded.

    A text template whose lines had headers only in part cannot tell its lines, so they are forwarded too."""
    known = list(known)
    rows = [(t.source, "\n".join("=".join(d) for d in t.discriminators), "\n".join(k), t.id) for t in known if not t.is_text for k in t.variants]
    shape = prepared_events.sparkSession.createDataFrame(rows, "source string, discr string, keyset string, template_id string")
    df = prepared_events.withColumn("line", line_of(sources))
    by_line = F.lit(None).cast("string")
    wild = lambda t: sum(x.count("<") for x in t.pattern)
    for t in sorted((t for t in known if t.is_text), key=lambda t: (wild(t), t.id), reverse=True):
        rx = pattern_regex(t.pattern, t.header)
        if rx:
            by_line = F.when((F.col("source") == t.source) & F.col("line").rlike(rx), F.lit(t.id)).otherwise(by_line)
    shaped = df.join(shape.withColumnRenamed("template_id", "by_shape"), ["source", "discr", "keyset"], "left")
    return shaped.withColumn("template_id", F.when(F.col("line").isNull(), F.col("by_shape")).otherwise(by_line)).drop("by_shape", "line")
