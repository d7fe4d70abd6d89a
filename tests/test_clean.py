"""Cleaning: returns, duplicates, coercion, flags."""

import math
from datetime import date

import pytest

from ridgeline.operators import clean

COLUMNS = "date string, symbol string, open string, high double, low double, close double, adj_close double, volume string"


def raw(spark, rows):
    """Rows (symbol, day, adj_close) with the other columns filled in."""
    return spark.createDataFrame([(f"2024-01-{d:02d}", s, "1", 1.0, 1.0, 1.0, p, "10") for s, d, p in rows], COLUMNS)


def by_key(df):
    return {(r.symbol, r.date.day): r for r in df.collect()}


def test_columns_and_returns(spark):
    out = clean.clean_prices(raw(spark, [("SPY", 2, 100.0), ("SPY", 3, 101.0), ("SPY", 4, 102.0)]))
    assert out.columns == ["date", "symbol", "open", "high", "low", "close", "adj_close", "volume", "return_1d", "log_return_1d", "is_trading_day", "data_quality_flag", "created_at"]
    rows = by_key(out)
    assert rows["SPY", 2].return_1d is None and rows["SPY", 2].log_return_1d is None
    assert rows["SPY", 3].return_1d == pytest.approx(0.01) and rows["SPY", 4].return_1d == pytest.approx(102 / 101 - 1)
    assert rows["SPY", 3].log_return_1d == pytest.approx(math.log(101 / 100))
    assert rows["SPY", 2].date == date(2024, 1, 2) and rows["SPY", 2].is_trading_day and rows["SPY", 2].open == 1.0


def test_symbols_are_independent_and_order_does_not_matter(spark):
    rows = [("QQQ", 3, 202.0), ("SPY", 3, 101.0), ("QQQ", 2, 200.0), ("SPY", 2, 100.0)]
    out = by_key(clean.clean_prices(raw(spark, rows)))
    assert [k for k in sorted(out)] == [("QQQ", 2), ("QQQ", 3), ("SPY", 2), ("SPY", 3)]
    assert out["QQQ", 2].return_1d is None and out["SPY", 2].return_1d is None
    assert out["QQQ", 3].return_1d == pytest.approx(0.01) and out["SPY", 3].return_1d == pytest.approx(0.01)


def test_exact_duplicates_and_conflicts(spark):
    df = raw(spark, [("SPY", 2, 100.0), ("SPY", 2, 100.0), ("SPY", 3, 101.0), ("SPY", 3, 103.0)])
    assert clean.drop_exact_duplicates(df).count() == 3
    assert by_key(clean.clean_prices(df))["SPY", 3].adj_close == 103.0
    c = clean.cleaning_counters(df).first()
    assert (c.n_rows, c.exact_duplicates, c.key_conflicts, c.null_adj_close) == (4, 1, 1, 0)


def test_keep_last_prefers_the_later_ingestion(spark):
    df = spark.createDataFrame([("A", 1, 9.0, 5), ("A", 1, 2.0, 7), ("B", 1, 1.0, None)], "symbol string, date int, adj_close double, ingested_at int")
    assert sorted((r.symbol, r.adj_close) for r in clean.keep_last(df).collect()) == [("A", 2.0), ("B", 1.0)]


def test_null_and_zero_prices(spark):
    out = by_key(clean.clean_prices(raw(spark, [("S", 2, 100.0), ("S", 3, None), ("S", 4, 0.0), ("S", 5, 5.0), ("S", 6, -5.0), ("S", 7, 5.0)])))
    assert [out["S", d].return_1d for d in (2, 3, 4, 5)] == [None] * 4 and out["S", 6].return_1d == -2.0
    assert out["S", 6].log_return_1d is None and out["S", 7].log_return_1d is None
    assert out["S", 3].data_quality_flag == "missing_adj_close" and out["S", 4].data_quality_flag == "ok"


def test_text_numbers(spark):
    df = raw(spark, [("S", 2, float("nan"))]).selectExpr("date", "symbol", "'x' AS open", "high", "low", "close", "adj_close", "'n/a' AS volume")
    r = clean.clean_prices(df).first()
    assert r.open is None and r.volume == 0.0 and r.adj_close is None
    texts = spark.createDataFrame([(" 1e3 ",), ("inf",), ("",), (None,), ("nan",)], "t string")
    assert [x.n for x in texts.select(clean.number(texts.t).alias("n")).collect()] == [1000.0, math.inf, None, None, None]


def test_missing_columns(spark):
    df = spark.createDataFrame([("2024-01-01", "SPY")], "date string, symbol string")
    with pytest.raises(ValueError, match="missing required input columns"):
        clean.clean_prices(df)
    with pytest.raises(ValueError, match="adj_close"):
        clean.clean_prices(raw(spark, []).withColumnRenamed("adj_close", "Adj_Close"))


def test_empty_input(spark):
    assert clean.clean_prices(raw(spark, [])).count() == 0


def test_one_exchange_for_the_chain(spark, capsys):
    clean.clean_prices(raw(spark, [("S", 2, 1.0)])).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
