"""From raw to clean prices."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.numbers import number, ratio_less_one
from ..schemas import CLEAN, KEY, PRICES, require

INPUT = ["date", "symbol", *PRICES]


def run_time() -> datetime:
    return datetime.now(timezone.utc)


def normalized_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def coerced(df: DataFrame) -> DataFrame:
    """Prices as doubles, date as a date; text that is no number is null, and no volume is 0."""
    cast = {c: number(F.col(c)) for c in PRICES if c != "volume"}
    return df.withColumns(cast | {"volume": F.coalesce(number(F.col("volume")), F.lit(0.0)), "date": F.to_date("date")})


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def keep_last(df: DataFrame, key: list[str] = KEY, order: list[Column] | None = None) -> DataFrame:
    """One row for each key: the last by ``order``. The default order takes
    ingested_at (where there is one), then all other columns, so that the
    result follows from the data."""
    if order is None:
        rest = [c for c in df.columns if c not in key and c != "ingested_at"]
        order = [F.col(c) for c in (["ingested_at"] if "ingested_at" in df.columns else []) + rest]
    w = Window.partitionBy(*key).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def with_returns(df: DataFrame, price: str = "adj_close", by: str = "symbol", order: str = "date") -> DataFrame:
    """return_1d and log_return_1d from the row before; null where it or a positive ratio is missing."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.lag(price).over(w)
    return df.withColumns({"return_1d": ratio_less_one(F.col(price), before), "log_return_1d": F.ln(F.try_divide(F.col(price), before))})


def quality_flag(price: str = "adj_close") -> Column:
    return F.when(F.col(price).isNull(), "missing_adj_close").otherwise("ok")


class CleaningCounters:
    """What a run of ``clean_prices`` drops, observed on the way; ``get`` waits for its action."""

    def __init__(self):
        self.all, self.distinct, self.kept = Observation(), Observation(), Observation()

    def get(self) -> dict[str, int]:
        n, distinct, kept = self.all.get["n"], self.distinct.get, self.kept.get["n"]
        return {"n_rows": n, "exact_duplicates": n - distinct["n"], "key_conflicts": distinct["n"] - kept, "null_adj_close": distinct["nulls"]}


def clean_prices(raw: DataFrame, created_at: datetime | None = None, counters: CleaningCounters | None = None) -> DataFrame:
    """The clean table. Dealing by symbol first lets both duplicate steps and
    the windows that follow share one exchange. ``counters`` are taken after it,
    where a task that is run again isn't counted twice."""
    require(raw.columns, INPUT, "clean_prices")
    n = F.count(F.lit(1)).alias("n")
    seen = lambda df, where, *more: df.observe(where, n, *more) if counters else df
    df = seen(coerced(normalized_names(raw)).repartition("symbol"), counters and counters.all)
    df = seen(drop_exact_duplicates(df), counters and counters.distinct, F.count_if(F.col("adj_close").isNull()).alias("nulls"))
    df = with_returns(seen(keep_last(df), counters and counters.kept))
    df = df.withColumns({"data_quality_flag": quality_flag(), "is_trading_day": F.lit(True), "created_at": F.lit(created_at or run_time())})
    return df.select(*CLEAN.names)


def cleaning_counters(df: DataFrame, key: list[str] = KEY, price: str = "adj_close") -> DataFrame:
    """rows, exact_duplicates, key_conflicts and null_adj_close, in one row.

    Copies are counted where equal rows meet, so nothing but counts travels on.
    """
    each = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    keys = each.groupBy(*key).agg(F.count(F.lit(1)).alias("_kinds"), F.sum("_copies").alias("_copies"), F.count_if(F.col(price).isNull()).alias("_nulls"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return keys.agg(total("_copies").alias("n_rows"), total(F.col("_copies") - F.col("_kinds")).alias("exact_duplicates"), total(F.col("_kinds") - 1).alias("key_conflicts"), total("_nulls").alias("null_adj_close"))
