"""Price panels derived from order lines, as input of the registered queries.

A symbol is a part's brand and a tick an order line; bars gather a day's
ticks. ``dirty`` breaks the contracts on certain days of the month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What orders a symbol's ticks within a day.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
SOURCE = "orders"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_discount").alias("disc"), F.col("l_quantity").alias("qty"), *ORDER)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct(*ORDER)
    out = ticks(spark, sf_dir).groupBy("symbol", "date").agg(
        F.min_by("px", order).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", order).alias("close"),
        F.max_by(F.col("px") * (1 - F.col("disc")), order).alias("adj_close"),
        F.sum("qty").alias("volume"),
    )
    return out.select("date", "symbol", "open", "high", "low", "close", "adj_close", "volume", F.lit(0.0).alias("dividends"), F.lit(0.0).alias("stock_splits"), F.lit(SOURCE).alias("source"), F.timestamp_seconds(F.lit(0)).alias("ingested_at"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with null and negative values, crossed prices, repeated rows and volumes as text."""
    day = F.dayofmonth("date")
    out = bars(spark, sf_dir).withColumns(
        {
            "volume_text": F.when(day == 23, "n/a").otherwise(F.col("volume").cast("long").cast("string")),
            "adj_close": F.when(day == 7, F.lit(None)).when(day == 11, -F.col("adj_close")).otherwise(F.col("adj_close")),
            "volume": F.when(day == 13, -F.col("volume")).otherwise(F.col("volume")),
            "high": F.when(day == 17, F.col("low") - 1).otherwise(F.col("high")),
        }
    )
    return out.withColumn("_copy", F.explode(F.when(day == 19, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_copy")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dirty`` as it may land: prices as text, some of which are no numbers, and NaN."""
    day = F.dayofmonth("date")
    text = lambda c: F.col(c).cast("string")
    return dirty(spark, sf_dir).withColumns(
        {
            "open": F.when(day == 3, "n/a").when(day == 4, "NaN").otherwise(text("open")),
            "adj_close": F.when(day == 5, " nan ").when(day == 6, "12,5").otherwise(text("adj_close")),
            "close": F.when(day == 8, F.lit(float("nan"))).otherwise(F.col("close")),
            "volume": F.when(day == 9, "many").otherwise(text("volume")),
            "dividends": F.when(day == 10, "-").otherwise(text("dividends")),
        }
    )


_TICKS = """ticks AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l_discount AS disc,
         l_quantity AS qty, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_ORDER = ", ".join(ORDER)
_BARS = f"""bars AS (
  SELECT date, symbol, first(px ORDER BY {_ORDER}) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY {_ORDER}) AS close,
         last(px * (1 - disc) ORDER BY {_ORDER}) AS adj_close, sum(qty) AS volume, 0.0::DOUBLE AS dividends,
         0.0::DOUBLE AS stock_splits, '{SOURCE}' AS source
  FROM ticks GROUP BY date, symbol)"""
_DIRTY = """dirty AS (
  SELECT date, symbol, open, CASE WHEN day(date) = 17 THEN low - 1 ELSE high END AS high, low, close,
         CASE day(date) WHEN 7 THEN NULL WHEN 11 THEN -adj_close ELSE adj_close END AS adj_close,
         CASE WHEN day(date) = 13 THEN -volume ELSE volume END AS volume, dividends, stock_splits, source,
         CASE WHEN day(date) = 23 THEN 'n/a' ELSE CAST(CAST(volume AS BIGINT) AS VARCHAR) END AS volume_text
  FROM bars CROSS JOIN range(1, 3) AS copies(k) WHERE k = 1 OR day(date) = 19)"""
_TEXTS = """texts AS (
  SELECT * REPLACE (CASE day(date) WHEN 3 THEN 'n/a' WHEN 4 THEN 'NaN' ELSE CAST(open AS VARCHAR) END AS open,
         CASE day(date) WHEN 5 THEN ' nan ' WHEN 6 THEN '12,5' ELSE CAST(adj_close AS VARCHAR) END AS adj_close,
         CASE WHEN day(date) = 8 THEN 'NaN'::DOUBLE ELSE close END AS close,
         CASE WHEN day(date) = 9 THEN 'many' ELSE CAST(volume AS VARCHAR) END AS volume, CASE WHEN day(date) = 10 THEN '-' ELSE CAST(dividends AS VARCHAR) END AS dividends)
  FROM dirty)"""
_CLEAN = """clean AS (
  SELECT date, symbol, open, high, low, close, adj_close, volume,
         adj_close / nullif(lag(adj_close) OVER s, 0) - 1 AS return_1d,
         ln(adj_close / nullif(lag(adj_close) OVER s, 0)) AS log_return_1d
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date))"""
_FEATURES = """features AS (
  SELECT date, symbol, return_1d, log_return_1d,
         adj_close / lag(adj_close, 5) OVER s - 1 AS return_5d, adj_close / lag(adj_close, 21) OVER s - 1 AS return_21d,
         adj_close / lag(adj_close, 63) OVER s - 1 AS return_63d,
         CASE WHEN count(return_1d) OVER w21 >= 5 THEN stddev_samp(return_1d) OVER w21 END AS volatility_21d,
         CASE WHEN count(return_1d) OVER w63 >= 10 THEN stddev_samp(return_1d) OVER w63 END AS volatility_63d,
         adj_close / lag(adj_close, 21) OVER s - 1 AS momentum_21d, adj_close / lag(adj_close, 63) OVER s - 1 AS momentum_63d,
         adj_close / max(adj_close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
         avg(volume) OVER w21 AS rolling_volume_21d, adj_close / avg(adj_close) OVER w21 - 1 AS price_to_ma_21,
         adj_close / avg(adj_close) OVER w63 - 1 AS price_to_ma_63,
         lead(adj_close, 1) OVER s / adj_close - 1 AS target_return_1d, lead(adj_close, 5) OVER s / adj_close - 1 AS target_return_5d
  FROM clean
  WINDOW s AS (PARTITION BY symbol ORDER BY date), w21 AS (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING),
         w63 AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING))"""
_CTES = {"ticks": _TICKS, "bars": _BARS, "dirty": _DIRTY, "texts": _TEXTS, "clean": _CLEAN, "features": _FEATURES}
_NEEDS = {"ticks": ["ticks"], "bars": ["ticks", "bars"], "dirty": ["ticks", "bars", "dirty"], "texts": ["ticks", "bars", "dirty", "texts"], "clean": ["ticks", "bars", "clean"], "features": ["ticks", "bars", "clean", "features"]}


def sql(panel: str, select: str) -> str:
    """``select`` over one of the panels, as DuckDB SQL over the given tables; one that starts with a comma adds further tables."""
    return "WITH " + ",\n".join(_CTES[n] for n in _NEEDS[panel]) + "\n" + select
