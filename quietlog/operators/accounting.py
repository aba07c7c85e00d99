"""Where the bytes go: savings by mode, tables inferred from records, and what tiers cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("duplicates", "implied", "counts")


def saved_by_mode(bodies: DataFrame, volumes: DataFrame, implied_paths: dict[str, list[str]], counts: bool = True) -> DataFrame:
    """Bytes saved per template and mode: implied values removed, capped by what was saved at all; other removals, capped by the rest (all of it without counts); the remainder is counts'."""
    rows = bodies.where("route = 'forward'").select("template_id", F.explode_outer("removed").alias("r")).where("r is not null")
    listed = F.lit(False)
    for template, paths in implied_paths.items():
        listed = listed | ((F.col("template_id") == template) & F.col("r.path").isin(paths))
    cut = rows.groupBy("template_id").agg(F.sum(F.when(listed, F.col("r.bytes")).otherwise(0)).alias("by_implied"), F.sum(F.when(listed, 0).otherwise(F.col("r.bytes"))).alias("by_fields"))
    df = volumes.where("template_id is not null").join(cut, "template_id", "left").fillna(0, ["by_implied", "by_fields"])
    total = F.greatest(F.lit(0), F.col("bytes_in") - F.col("bytes_out"))
    df = df.withColumn("total", total).withColumn("implied", F.least("by_implied", "total"))
    df = df.withColumn("duplicates", F.least("by_fields", F.col("total") - F.col("implied")) if counts else F.col("total") - F.col("implied"))
    return df.select("template_id", "total", "duplicates", "implied", (F.col("total") - F.col("implied") - F.col("duplicates")).alias("counts"))


def inferred_columns(prepared_events: DataFrame) -> DataFrame:
    """A table for records: name, type, fields. Types join upwards: boolean, long, real, string; arrays and mixes of text and arrays are dynamic. Nulls say nothing.
    Names keep letters, digits and '_', begin with a letter, and are numbered where they fall together (fields: how many)."""
    rank = F.expr("case leaf.kind when 'bool' then 1 when 'int' then 2 when 'float' then 3 when 'string' then 4 when 'null' then 0 else 5 end")
    long = prepared_events.select(F.explode("leaves").alias("path", "leaf")).select("path", rank.alias("rank"))
    seen = long.groupBy("path").agg(F.max("rank").alias("top"), F.max(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("has_bool"), F.max(F.when(F.col("rank").isin(2, 3), 1).otherwise(0)).alias("has_number"))
    kind = F.when(F.col("top") == 5, "dynamic").when((F.col("has_bool") == 1) & (F.col("has_number") == 1), "string").when(F.col("top") == 1, "boolean").when(F.col("top") == 2, "long").when(F.col("top") == 3, "real").otherwise("string")
    bare = F.regexp_replace("path", "[^A-Za-z0-9_]", "_")
    named = seen.select("path", F.when(bare.rlike("^[A-Za-z]"), bare).otherwise(F.concat(F.lit("F"), bare)).alias("base"), kind.alias("type"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("base").orderBy("path"))
    return named.withColumn("place", place).select("path", F.when(F.col("place") == 1, F.col("base")).otherwise(F.concat("base", F.col("place").cast("string"))).alias("name"), "type")


def tier_costs(volumes: DataFrame, analytics: float = 4.3, lake: float = 0.15, days: float = 30.0) -> DataFrame:
    """Monthly cost of four arrangements from bytes per day: all in analytics; reduced in analytics; the same with the whole in a lake; only what rules read in analytics, the rest in the lake."""
    gb = lambda c: F.sum(c) / 1e9 * days
    one = volumes.where("template_id is not null").agg(gb("bytes_in").alias("all_gb"), gb("bytes_out").alias("reduced_gb"))
    costs = {"everything": F.col("all_gb") * analytics, "reduced": F.col("reduced_gb") * analytics, "reduced_and_lake": F.col("reduced_gb") * analytics + F.col("all_gb") * lake, "routed_and_lake": F.col("reduced_gb") * analytics + (F.col("all_gb") - F.col("reduced_gb")) * lake}
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("arrangement"), F.round(v, 6).alias("cost")) for k, v in costs.items()))).alias("x")).select("x.*")


def determinism(leaves_counts: DataFrame) -> DataFrame:
    """How much of a template's bytes is said by its kind: per threshold of the dominant value's share (100, 99, 95, 90, 50 percent), bytes of such fields.
    leaves_counts: template_id, field, value, n."""
    from quietlog.operators.implied import dominant, value_size

    best = dominant(leaves_counts, ["template_id", "field"]).withColumn("saved", F.expr(f"held * {value_size()}"))
    levels = F.explode(F.array(*(F.lit(x) for x in (100, 99, 95, 90, 50)))).alias("percent")
    return best.select("*", levels).where("held * 100 >= total * percent").groupBy("percent").agg(F.sum("saved").alias("bytes"), F.count(F.lit(1)).alias("fields"))
