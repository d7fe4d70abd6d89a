"""The daily job from source to views."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import CleaningCounters, clean_prices, run_time
from ..operators.contracts import CLEAN_CONTRACT, FEATURE_CONTRACT, RAW_CONTRACT, Watch, validate
from ..operators.features import BLOCK_ROWS, asset_features
from .. import workspace
from ..schemas import CLEAN_STORED, FEATURES_STORED, RAW_STORED
from ..sources import config, lake
from ..sources.vendor import restricted


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Lake:
    """Folders of the layers and of the validation reports."""

    raw: str
    clean: str
    features: str
    reports: str | None = None

    @classmethod
    def of(cls, settings: config.Settings) -> Lake:
        return cls(settings.raw_data_dir, lake.clean_path(settings.processed_data_dir), lake.features_path(settings.marts_data_dir), settings.validation_reports_dir)


def ingest(spark: SparkSession, fetch: Callable, symbols: list[str], start, end, path: str, interval: str = "1d") -> None:
    lake.write_raw(fetch(spark, symbols, start, end), path, interval)


def daily_job(spark: SparkSession, fetch: Callable, symbols: list[str], start, end, at: Lake, interval: str = "1d") -> DataFrame:
    """Fetch, store, check, clean, check, store, compute features, check, store; returns the feature layer.

    The raw layer is checked from what is stored. The clean and feature layers are
    checked while they are written to a staging folder, without a scan for it, and
    reach their own only when they keep their contracts.
    """
    now = run_time()
    ingest(spark, fetch, symbols, start, end, at.raw, interval)
    stored = restricted(lake.read_dataset(spark, at.raw, RAW_STORED), symbols, start, end)
    raw = validate(stored.where(F.col("year").between(F.year(F.lit(start).cast("date")), F.year(F.lit(end).cast("date")))), RAW_CONTRACT, at.reports, now)
    counters = CleaningCounters()
    clean = _gated(spark, clean_prices(raw, now, counters), at.clean, CLEAN_STORED, CLEAN_CONTRACT, at.reports, now)
    log.info("clean_prices: %s", counters.get())
    features = _gated(spark, asset_features(clean, now, BLOCK_ROWS), at.features, FEATURES_STORED, FEATURE_CONTRACT, at.reports, now)
    lake.create_views(spark, {"raw_daily_prices": at.raw, "clean_daily_prices": at.clean, "asset_daily_features": at.features})
    return features


def run_from_settings(spark: SparkSession, fetch: Callable, settings_path: str, assets_path: str) -> DataFrame:
    """The daily job for the assets and the dates, folders and interval of two YAML files."""
    settings = config.load_settings(settings_path)
    wanted = config.symbols(config.load_assets(assets_path))
    return daily_job(spark, fetch, wanted, config.parse_date(settings.start_date), config.resolve_end_date(settings.end_date), Lake.of(settings), settings.interval)


def _gated(spark, df: DataFrame, path: str, schema, contract, reports, now) -> DataFrame:
    staging = f"{path}_staging_{uuid.uuid4().hex}"
    watch = Watch(df, contract)
    watch.frame.write.parquet(staging)
    written = spark.read.schema(df.schema).parquet(staging)
    try:
        watch.settle(written, reports, now)
        lake.write_by_year(written, path)
    finally:
        workspace.drop(spark, staging)
    return lake.read_dataset(spark, path, schema)
