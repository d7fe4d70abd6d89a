"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "ridgeline.scratch"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where it is unset (one machine, as in tests) a temporary folder is made
    and recorded, so that all later calls in the session agree on it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_OWN, folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of this session's own, on whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut there.
    Its folder is in ``stored_at``."""
    path = new_path(df.sparkSession, "stored")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out
