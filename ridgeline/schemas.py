"""Declared layouts of the price layers."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_D = T.DoubleType()
PRICES = {"open": _D, "high": _D, "low": _D, "close": _D, "adj_close": _D, "volume": _D}

RAW = _struct(date=T.DateType(), symbol=T.StringType(), **PRICES, dividends=_D, stock_splits=_D, source=T.StringType(), ingested_at=T.TimestampType())
CLEAN = _struct(date=T.DateType(), symbol=T.StringType(), **PRICES, return_1d=_D, log_return_1d=_D, is_trading_day=T.BooleanType(), data_quality_flag=T.StringType(), created_at=T.TimestampType())
FEATURE_NAMES = ["return_1d", "log_return_1d", "return_5d", "return_21d", "return_63d", "volatility_21d", "volatility_63d", "momentum_21d", "momentum_63d", "drawdown", "rolling_volume_21d", "price_to_ma_21", "price_to_ma_63", "target_return_1d", "target_return_5d"]
FEATURES = _struct(date=T.DateType(), symbol=T.StringType(), **{n: _D for n in FEATURE_NAMES}, created_at=T.TimestampType())
ASSETS = _struct(symbol=T.StringType(), name=T.StringType(), asset_class=T.StringType(), currency=T.StringType(), source=T.StringType())

RAW_KEY = ["symbol", "date", "source"]
KEY = ["symbol", "date"]


def with_partitions(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """A layer's schema with its path columns; given on reading, as inferred symbols may turn into numbers."""
    return T.StructType([f for f in schema.fields if f.name not in fields] + [T.StructField(k, v) for k, v in fields.items()])


RAW_STORED = with_partitions(RAW, source=T.StringType(), interval=T.StringType(), symbol=T.StringType(), year=T.IntegerType())
CLEAN_STORED = with_partitions(CLEAN, year=T.IntegerType())
FEATURES_STORED = with_partitions(FEATURES, year=T.IntegerType())


def require(columns: list[str], needed: list[str], who: str) -> None:
    """Exact names are needed: Spark itself would also take another case."""
    missing = [c for c in needed if c not in columns]
    if missing:
        raise ValueError(f"{who}: missing required input columns: {missing}")
