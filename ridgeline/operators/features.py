"""Window features of each symbol's series, all over one partitioning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import workspace
from ..functions.numbers import at_least, ratio_less_one
from ..schemas import FEATURE_NAMES, FEATURES, require
from .clean import run_time

INPUT = ["date", "symbol", "adj_close", "volume", "return_1d", "log_return_1d"]


#: Rows before and after a row that its features look at; drawdown looks at all before.
BEFORE, AFTER = 63, 5
#: Rows of a long symbol's block, and rows of such symbols' years that may be broadcast.
BLOCK_ROWS, BROADCAST_ROWS = 100_000, 500_000
SERIES = ("symbol",)


def series(by=SERIES):
    return Window.partitionBy(*by).orderBy("date")


def last_rows(n: int, by=SERIES):
    return series(by).rowsBetween(1 - n, 0)


def period_return(n: int, price: str = "adj_close", by=SERIES) -> Column:
    return ratio_less_one(F.col(price), F.lag(price, n).over(series(by)))


def volatility(n: int, least: int, of: str = "return_1d", by=SERIES) -> Column:
    return at_least(least, F.col(of), F.stddev_samp(of), last_rows(n, by))


def rolling_mean(n: int, of: str, by=SERIES) -> Column:
    return F.avg(of).over(last_rows(n, by))


def price_to_average(n: int, price: str = "adj_close", by=SERIES) -> Column:
    return ratio_less_one(F.col(price), rolling_mean(n, price, by))


def drawdown(price: str = "adj_close", by=SERIES, earlier: Column | None = None) -> Column:
    """``earlier``: the peak of what lies ahead of the frame."""
    peak = F.max(price).over(series(by).rowsBetween(Window.unboundedPreceding, 0))
    return ratio_less_one(F.col(price), peak if earlier is None else F.greatest(peak, earlier))


def target_return(n: int, price: str = "adj_close", by=SERIES) -> Column:
    """A label: it looks ahead on purpose."""
    return ratio_less_one(F.lead(price, n).over(series(by)), F.col(price))


#: Expressions over a table with INPUT and the columns of ``by``, by feature.
EXPRESSIONS = {
    "return_5d": lambda by: period_return(5, by=by),
    "return_21d": lambda by: period_return(21, by=by),
    "return_63d": lambda by: period_return(63, by=by),
    "volatility_21d": lambda by: volatility(21, 5, by=by),
    "volatility_63d": lambda by: volatility(63, 10, by=by),
    "momentum_21d": lambda by: period_return(21, by=by),
    "momentum_63d": lambda by: period_return(63, by=by),
    "drawdown": lambda by: drawdown(by=by, earlier=F.col("_earlier") if "_block" in by else None),
    "rolling_volume_21d": lambda by: rolling_mean(21, "volume", by),
    "price_to_ma_21": lambda by: price_to_average(21, by=by),
    "price_to_ma_63": lambda by: price_to_average(63, by=by),
    "target_return_1d": lambda by: target_return(1, by=by),
    "target_return_5d": lambda by: target_return(5, by=by),
}


def features(clean: DataFrame, names: list[str]) -> DataFrame:
    """date, symbol and the named features."""
    return clean.select("date", "symbol", *[EXPRESSIONS[n](SERIES).alias(n) if n in EXPRESSIONS else F.col(n) for n in names])


def long_years(clean: DataFrame, block_rows: int) -> DataFrame:
    """(symbol, _year, _blocks, _at, _earlier) for the years of symbols with more than ``block_rows`` rows.

    Whole years make blocks of about ``block_rows`` rows, or of two of the largest years if that is more.
    ``_at`` is a year's block and ``_earlier`` the peak before that block: a running
    maximum over blocks. ``_blocks`` also has the next block, if that looks back at the
    year, and the one before, if that looks ahead at it."""
    years = clean.groupBy("symbol", F.coalesce(F.year("date"), F.lit(0)).alias("_year")).agg(F.count(F.lit(1)).alias("n"), F.max("adj_close").alias("peak"))
    own, past = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("_year")  # a row for a year
    block = Window.partitionBy("symbol", "_at")
    years = years.select("*", F.sum("n").over(past).alias("upto"), F.sum("n").over(own).alias("total"), F.greatest(F.lit(max(block_rows, 512)), 2 * F.max("n").over(own)).alias("size")).where("total > size")
    years = years.withColumn("_at", F.floor((F.col("upto") - F.col("n")) / F.col("size")).cast("int"))
    years = years.select("*", F.max("upto").over(block).alias("end"), F.min(F.col("upto") - F.col("n")).over(block).alias("start"), F.max("peak").over(Window.partitionBy("symbol").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    ahead = F.when((F.col("end") - F.col("upto") < BEFORE) & (F.col("end") < F.col("total")), F.col("_at") + 1)
    behind = F.when((F.col("upto") - F.col("n") - F.col("start") < AFTER) & (F.col("_at") > 0), F.col("_at") - 1)
    return years.select("symbol", "_year", F.filter(F.array("_at", ahead, behind), lambda b: b.isNotNull()).alias("_blocks"), "_at", "_earlier")


def blocked_features(clean: DataFrame, names: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``features`` for symbols of any length: a symbol of more than ``block_rows`` rows is
    dealt as blocks of its years, each with the rows around it that its windows
    reach into, so no task holds the symbol. ``clean`` is read twice: give a stored table."""
    years = workspace.stored(long_years(clean, block_rows))
    if years.isEmpty():
        return features(clean, names)
    few = years.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = clean.withColumn("_year", F.coalesce(F.year("date"), F.lit(0))).join(F.broadcast(years) if few else years, ["symbol", "_year"], "left")
    dealt = rows.withColumn("_block", F.explode(F.coalesce("_blocks", F.array(F.lit(0))))).withColumn("_own", F.col("_block") == F.coalesce("_at", F.lit(0)))
    by = ("symbol", "_block")
    out = dealt.select("*", *[EXPRESSIONS[n](by).alias(f"_{n}") for n in names if n in EXPRESSIONS])
    return out.where("_own").select("date", "symbol", *[F.col(f"_{n}" if n in EXPRESSIONS else n).alias(n) for n in names])


def asset_features(clean: DataFrame, created_at: datetime | None = None, block_rows: int | None = None) -> DataFrame:
    """The feature table. With ``block_rows``, symbols of more rows are dealt in blocks."""
    require(clean.columns, INPUT, "asset_features")
    out = blocked_features(clean, FEATURE_NAMES, block_rows) if block_rows else features(clean, FEATURE_NAMES)
    return out.withColumn("created_at", F.lit(created_at or run_time())).select(*FEATURES.names)
