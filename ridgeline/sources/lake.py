"""Layers of the lake: partitioned Parquet that can be rewritten safely."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CLEAN_STORED, FEATURES_STORED, RAW_STORED, require

log = logging.getLogger(__name__)
RAW_PARTITIONS = ["source", "interval", "symbol", "year"]
VIEWS = {"raw_daily_prices": RAW_STORED, "clean_daily_prices": CLEAN_STORED, "asset_daily_features": FEATURES_STORED}


def clean_path(base: str) -> str:
    return f"{base}/daily_prices"


def features_path(base: str) -> str:
    return f"{base}/features"


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("date"))


def with_interval(interval: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: with_year(df).withColumn("interval", F.lit(interval))


def write_partitioned(df: DataFrame, path: str, partitions: list[str], extra: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Replace the partitions that ``df`` has rows for, and no others.

    Rows without a partition value are not stored; an empty frame changes
    nothing. Dealing by the partition columns gives each folder few files;
    AQE splits a partition that is too large for one task.
    """
    df = df.transform(extra) if extra else df
    require(df.columns, partitions, "write_partitioned")
    kept = df.dropna(subset=partitions)
    kept.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_single(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").parquet(path)


def read_dataset(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All files below ``path`` with their path columns; columns that a file
    lacks are null. A missing or empty folder gives an empty frame."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def write_raw(df: DataFrame, path: str, interval: str = "1d") -> None:
    write_partitioned(df, path, RAW_PARTITIONS, with_interval(interval))


def write_by_year(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ["year"], with_year)


def write_by_symbol(df: DataFrame, path: str, name: str, buckets: int = 64) -> None:
    """A copy of a layer as the table ``name`` over ``path``, bucketed by symbol and sorted by symbol and
    date in each bucket: windows over a symbol's dates then need no exchange. Rows are dealt by symbol
    first, so that a bucket is one file."""
    dealt = df.repartition(buckets, "symbol")
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, "symbol").sortBy("symbol", "date").saveAsTable(name)


def read_by_symbol(spark: SparkSession, path: str, name: str, schema: T.StructType, buckets: int = 64) -> DataFrame:
    """The table that ``write_by_symbol`` made; a session that doesn't know it yet takes it from ``path``."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, date) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def create_views(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Temporary views over the layers in ``paths``, by name; a layer that isn't there is skipped."""
    made = []
    for name, path in paths.items():
        try:
            if spark.read.parquet(path).isEmpty():
                raise FileNotFoundError(path)
            spark.read.schema(VIEWS[name]).parquet(path).createOrReplaceTempView(name)
            made.append(name)
        except (AnalysisException, FileNotFoundError) as e:
            if isinstance(e, AnalysisException) and e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            log.warning("no view %s: nothing at %s", name, path)
    return made
