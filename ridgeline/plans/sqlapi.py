"""SQL over the layers' views."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def _over(spark: SparkSession, view: str, schema: str, make) -> DataFrame:
    """``make`` of the view, or an empty frame and a warning where there is none."""
    try:
        return make(spark.table(view))
    except AnalysisException as e:
        if e.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            raise
        log.warning("no view %s", view)
        return spark.createDataFrame([], schema)


def summarized(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("row_count"), F.min("date").alias("start_date"), F.max("date").alias("end_date")).orderBy("symbol")


def averaged(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.avg("return_1d").alias("avg_return"), F.stddev_samp("return_1d").alias("volatility"), F.count(F.lit(1)).alias("observations")).orderBy("symbol")


def summary_stats(spark: SparkSession, view: str = "clean_daily_prices") -> DataFrame:
    return _over(spark, view, "symbol string, row_count long, start_date date, end_date date", summarized)


def avg_returns(spark: SparkSession, view: str = "asset_daily_features") -> DataFrame:
    return _over(spark, view, "symbol string, avg_return double, volatility double, observations long", averaged)
