"""Vendor files as they land, taken into the raw layer by Structured Streaming.

The batch job reads a whole landing folder again; this does the same step for
new files only. Spark's checkpoint remembers which files are done, and a
micro-batch that is run again overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import lake
from ..sources.vendor import normalized


def landing_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).csv(path)


def ingest_stream(spark: SparkSession, landing: str, schema: T.StructType, source: str, out: str, checkpoint: str, interval: str = "1d") -> StreamingQuery:
    """Append all files that have landed to ``out`` and stop; start again for later ones."""

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = lake.with_interval(interval)(normalized(batch, source)).dropna(subset=lake.RAW_PARTITIONS)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*lake.RAW_PARTITIONS).parquet(f"{out}/batch={batch_id}")

    return landing_stream(spark, landing, schema).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
