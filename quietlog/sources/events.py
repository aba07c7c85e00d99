"""Reading events, source declarations, rule files and manifests; writing archives, forwarded events, summaries and samples."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.functions.leaves import body
from quietlog.model import SCHEMAS, LogSource, Source


def sources(text: str) -> list[Source]:
    """Source declarations in YAML: at least one; unknown members are refused."""
    import yaml

    doc = yaml.safe_load(text)
    only(doc, {"sources"}, "the file")
    out = []
    for s in doc.get("sources") or []:
        only(s, {"id", "logsource", "format", "schema", "event_type"}, s.get("id", "a source"))
        ls, fmt = s.get("logsource") or {}, s.get("format") or {"kind": "json"}
        only(ls, {"product", "service", "category", "complete"}, "logsource")
        only(fmt, {"kind", "field"}, "format")
        if fmt["kind"] not in ("json", "text") or s.get("schema", "undeclared") not in SCHEMAS:
            raise ValueError(f"{s['id']}: unknown format or schema")
        if fmt["kind"] == "text" and not fmt.get("field"):
            raise ValueError(f"{s['id']}: a text source names the field of its line")
        out.append(Source(s["id"], LogSource(ls.get("product"), ls.get("service"), ls.get("category"), bool(ls.get("complete"))), fmt.get("field"), s.get("schema", "undeclared"), tuple(s.get("event_type") or ())))
    if not out:
        raise ValueError("no source is declared")
    return out


def only(doc: object, known: set[str], what: str) -> None:
    if not isinstance(doc, dict) or set(doc) - known:
        raise ValueError(f"{what}: unknown members {sorted(set(doc) - known) if isinstance(doc, dict) else ''}")


def sources_yaml(found: Iterable[Source]) -> str:
    import yaml

    rows = []
    for s in found:
        ls = {k: v for k, v in (("product", s.logsource.product), ("service", s.logsource.service), ("category", s.logsource.category)) if v} | ({"complete": True} if s.logsource.complete else {})
        rows.append({"id": s.id, "logsource": ls, "format": {"kind": "text", "field": s.text_field} if s.text_field else {"kind": "json"}, "schema": s.schema, "event_type": list(s.event_type)})
    return yaml.safe_dump({"sources": rows}, sort_keys=False)


def lines(spark: SparkSession, path: str, source: str, order: int = 0, strict: bool = True) -> DataFrame:
    """One source's NDJSON: source, source_order, line_key, ts, body. A byte-order mark and blank lines are skipped; a line that is no object is an error, or, without strict, a null body that is forwarded.

    line_key orders lines as they stand: file, then offset of the line's partition and place in it."""
    raw = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("line_key", F.monotonically_increasing_id())
    text = F.regexp_replace("value", "^\ufeff", "")
    df = raw.withColumn("text", text).where(F.trim("text") != "")
    df = df.withColumn("body", body(F.col("text")))
    good = F.coalesce(F.startswith(F.expr("schema_of_variant(body)"), F.lit("OBJECT")), F.lit(False))
    df = df.withColumn("body", F.when(good, F.col("body")).otherwise(F.raise_error(F.concat(F.lit(f"{source}: no JSON object: "), F.substring("text", 1, 80))).cast("variant") if strict else F.lit(None).cast("variant")))
    stamp = F.expr("try_to_timestamp(try_variant_get(body, '$[\"@timestamp\"]', 'string'))")
    ts = F.timestamp_seconds(F.floor(F.unix_micros(F.coalesce(stamp, F.timestamp_seconds(F.lit(0)))) / 1_000_000))
    return df.select(F.lit(source).alias("source"), F.lit(order).alias("source_order"), "line_key", ts.alias("ts"), "body", "text")


def events(spark: SparkSession, folder: str, declared: list[Source], strict: bool = True) -> DataFrame:
    """All declared sources' '<id>.ndjson' as events, numbered from 0 in order of time, source and line.

    Numbers are gapless ranks found per hour of the clock: no task sees the whole order, and only one row an hour is looked at across hours."""
    from pyspark.sql import Window

    out = None
    for i, s in enumerate(declared):
        one = lines(spark, f"{folder}/{s.id}.ndjson", s.id, i, strict)
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600))
    counts = out.groupBy("hour").agg(F.count(F.lit(1)).alias("rows_in"))
    before = counts.select("hour", (F.sum("rows_in").over(Window.partitionBy(F.lit(0)).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows_in")).alias("before"))
    place = F.row_number().over(Window.partitionBy("hour").orderBy("ts", "source_order", "line_key")) - 1
    return out.withColumn("place", place).join(F.broadcast(before), "hour").select((F.col("before") + F.col("place")).alias("event_id"), "ts", "source", "body", "text")


def files(folder: str, extensions: Iterable[str]) -> list[str]:
    """Files below a folder by extension, in any case, in order; a loop of links is walked once."""
    ends, seen, out = tuple("." + e.lower().lstrip(".") for e in extensions), set(), []
    for at, folders, names in os.walk(folder, followlinks=True):
        real = os.path.realpath(at)
        if real in seen:
            folders[:] = []
            continue
        seen.add(real)
        out += [os.path.join(at, n) for n in names if n.lower().endswith(ends)]
    return sorted(out)


def manifest(path: str) -> tuple[list[str], bool]:
    """(rule files of a fetched inventory, whether it is complete). A file outside the folder is refused."""
    base = Path(path).resolve().parent
    doc = json.loads(Path(path).read_text())
    out = []
    for name in doc["files"]:
        full = (base / name).resolve()
        if not full.is_relative_to(base):
            raise ValueError(f"{name} lies outside the inventory")
        out.append(str(full))
    return out, bool(doc.get("complete", False))


def file_name(text: str) -> str:
    """A name fit for a file."""
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in text).strip(".") or "_"


def write_outputs(bodies: DataFrame, summed: DataFrame, out: str) -> None:
    """Archive first and whole, by source, date and hour; then what is forwarded; then the summaries."""
    whole = bodies.select("source", "event_id", "ts", F.to_json("body").alias("body"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.hour("ts").alias("hour"))
    whole.write.mode("overwrite").partitionBy("source", "date", "hour").parquet(f"{out}/archive")
    bodies.where("route = 'forward'").select("source", "event_id", "ts", "template_id", "out_body").write.mode("overwrite").partitionBy("source").parquet(f"{out}/forwarded")
    summed.write.mode("overwrite").partitionBy("source").parquet(f"{out}/summaries")


def write_sample(found: DataFrame, out: str) -> None:
    """NDJSON per source."""
    found.select("source", F.to_json("body").alias("value")).write.mode("overwrite").partitionBy("source").text(out)
