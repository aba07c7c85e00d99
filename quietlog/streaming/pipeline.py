"""The data pass on streams: archive first and whole, then forward or count per minute. What cannot be classified is forwarded as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quietlog.model import WINDOW_SECONDS
from quietlog.store import new_path


def work_dir(spark: SparkSession, tag: str) -> str:
    """A folder for checkpoints and output in the shared folder."""
    return new_path(spark, tag)


def windowed(reduced_stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts per template, minute of event time and keys. Each minute is given out when the watermark has passed it."""
    rows = reduced_stream.where("route = 'summarize'").withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", f"{WINDOW_SECONDS} seconds"), "source", "template_id", "summary_keys").agg(F.count(F.lit(1)).alias("events"))
    return out.select("source", "template_id", F.floor(F.unix_timestamp("window.start") / WINDOW_SECONDS).cast("long").alias("minute"), "summary_keys", "events")


def is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def summaries_of_stream(spark: SparkSession, path: str, schema: StructType, shaped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over the files at path to its end and returns its summaries. Complete mode: the last state is the result, and late events are counted."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    # One file is read by its name in its folder; a folder as a whole.
    stream = reader.option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder) if is_file(spark, path) else reader.parquet(path)
    out = work_dir(spark, "summaries")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    rows = shaped(stream).where("route = 'summarize'")
    counted = rows.groupBy(F.window("ts", f"{WINDOW_SECONDS} seconds"), "source", "template_id", "summary_keys").agg(F.count(F.lit(1)).alias("events"))
    counted = counted.select("source", "template_id", F.floor(F.unix_timestamp("window.start") / WINDOW_SECONDS).cast("long").alias("minute"), "summary_keys", "events")
    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table")


def start(stream: DataFrame, classify: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger):
    """Starts the topology on a stream of events (event_id, ts, source, body): archive, forwarded, and per-batch counts that add up.

    Each batch is archived before anything else is written. A batch's number is part of every path, so a batch that runs again after a failure overwrites its own output: each event arrives once.
    Late events need no watermark here: they are counted in their minute, in the batch they come with. If classifying fails as a whole, the batch is forwarded as it came."""
    from quietlog.operators.reduce import summaries, with_bodies

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            plain = batch.withColumn("text", F.to_json("body")).drop("body")
            day = F.date_format("ts", "yyyy-MM-dd")
            plain.withColumn("date", day).withColumn("hour", F.hour("ts")).write.mode("overwrite").partitionBy("source", "date", "hour").json(f"{out}/archive/batch={number}")
            try:
                done = with_bodies(classify(batch)).persist()
                done.count()
            except Exception:  # noqa: BLE001 - fail open: what cannot be reduced goes on whole
                plain.select("source", "event_id", "ts", F.col("text").alias("out_body")).write.mode("overwrite").partitionBy("source").json(f"{out}/forwarded/batch={number}")
                return
            done.where("route = 'forward'").select("source", "event_id", "ts", "template_id", F.coalesce("out_body", F.to_json("body")).alias("out_body")).write.mode("overwrite").partitionBy("source").json(f"{out}/forwarded/batch={number}")
            summaries(done).write.mode("overwrite").json(f"{out}/summaries/batch={number}")
            done.unpersist()
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
