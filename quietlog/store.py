"""Tables written to the shared folder, to cut lineage so that a lost executor costs a task, not a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table's rows, as counted, up to which it is sent to every task.
SENT = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one on a local master; on a cluster, whose executors share no local disk, an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quietlog-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/quietlog-{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(df: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of few, a written table of mostly few rows.

    The planner goes by the size of files, and lines that repeat make files a hundred times smaller than their rows: it would send df through the driver. So the rows of few are
    measured (counts only reach the driver): a small table goes to every task, with a larger one both sides are sorted, and nothing passes through the driver."""
    rows, size = few.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return df.join(few.hint("broadcast" if 64 * rows + (size or 0) <= SENT else "merge"), on, how)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
