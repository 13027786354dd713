"""What the training-data operators share: table access, lineage cuts, small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that one Arrow batch may hold; long texts would otherwise fill a Python worker.
BATCH_ROWS = 512

#: Sorts after every real id. A missing id counts as one document, the last one.
LAST_ID = 2**63 - 1

SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once while it reads whole texts. One value for all operators, as it counts when a plan runs, not when it is made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named and all runs on this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        named = tempfile.mkdtemp(prefix="votelake-")
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write narrow rows to the shared folder and go on from there; Spark removes them when unused."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_wide(df: DataFrame) -> DataFrame:
    """Like cut, as a compressed Parquet table, for rows that carry texts or arrays. It is removed when the driver's JVM ends."""
    at = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is removed when the driver's JVM ends."""
    at = f"{shared_dir(spark).rstrip('/')}/votelake-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use yet, in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def id_or_last(c: Column) -> Column:
    return F.coalesce(c, F.lit(LAST_ID))


def utf8(text: str | None) -> bytes:
    return text.encode() if text else b""
