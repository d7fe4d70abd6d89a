"""Settings of the daily job, read on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schemas import ASSETS


@dataclass(frozen=True)
class Settings:
    start_date: str
    interval: str
    raw_data_dir: str
    processed_data_dir: str
    marts_data_dir: str
    validation_reports_dir: str
    duckdb_path: str = ""
    end_date: str | None = None


def _yaml(path: str) -> dict:
    if not Path(path).exists():
        raise FileNotFoundError(path)
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def load_assets(path: str) -> list[dict[str, str]]:
    """The asset records in the file's order; a missing file, list or field raises."""
    return [{f: str(row[f]) for f in ASSETS.names} for row in _yaml(path)["assets"]]


def symbols(assets: list[dict[str, str]]) -> list[str]:
    return [a["symbol"] for a in assets]


def asset_table(spark: SparkSession, assets: list[dict[str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(a[f] for f in ASSETS.names) for a in assets], ASSETS)


def load_settings(path: str) -> Settings:
    found = _yaml(path)["pipeline"]
    needed = [f for f in Settings.__dataclass_fields__ if f != "end_date"]
    missing = [f for f in needed if f not in found]
    if missing:
        raise KeyError(f"{path}: missing {missing}")
    return Settings(**{f: str(found[f]) for f in needed}, end_date=found.get("end_date"))


def parse_date(text: str | date) -> date:
    return text if isinstance(text, date) else date.fromisoformat(text)


def resolve_end_date(text: str | date | None) -> date:
    """The date, or today in UTC for null, "null", "none" or an empty text."""
    if text is None or str(text).strip().lower() in ("", "null", "none"):
        return datetime.now(timezone.utc).date()
    return parse_date(text)
