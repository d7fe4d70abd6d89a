"""Window features."""

import random
import statistics
from datetime import date, timedelta

import pytest

from ridgeline import workspace
from ridgeline.operators import features
from ridgeline.schemas import FEATURES

INPUT = "date date, symbol string, adj_close double, volume double, return_1d double, log_return_1d double"
DAY = date(2024, 1, 1)


def panel(spark, prices, symbol="SPY", returns=None):
    returns = returns or [None] + [b / a - 1 if a and b else None for a, b in zip(prices, prices[1:])]
    return spark.createDataFrame([(DAY + timedelta(k), symbol, p, 10.0 + k, r, r) for k, (p, r) in enumerate(zip(prices, returns))], INPUT)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").collect()]


def test_columns_and_missing_input(spark):
    assert features.asset_features(panel(spark, [1.0, 2.0])).columns == FEATURES.names and len(FEATURES.names) == 18
    with pytest.raises(ValueError, match="missing required input columns"):
        features.asset_features(panel(spark, [1.0]).select("date", "symbol"))
    empty = features.asset_features(panel(spark, [1.0]).limit(0))
    assert empty.count() == 0 and empty.columns == FEATURES.names


def test_period_returns_and_labels(spark):
    out = features.asset_features(panel(spark, [100.0 + k for k in range(10)]))
    five = column(out, "return_5d")
    assert five[:5] == [None] * 5 and five[5] == pytest.approx(0.05)
    target = column(out, "target_return_1d")
    assert target[0] == pytest.approx(0.01) and target[-1] is None
    assert column(out, "target_return_5d")[5:] == [None] * 5
    assert column(out, "return_63d") == [None] * 10 == column(out, "momentum_21d")


def test_constant_returns_have_no_volatility(spark):
    out = features.asset_features(panel(spark, [100.0] * 25, returns=[None] + [0.005] * 24))
    short, long = column(out, "volatility_21d"), column(out, "volatility_63d")
    assert short[:5] == [None] * 5 and short[5] == 0.0 == short[-1]
    assert long[:10] == [None] * 10 and long[10] == 0.0


def test_volatility_counts_values_not_rows(spark):
    returns = [None, 0.1, None, 0.2, 0.3, None, 0.1, 0.4]
    out = column(features.asset_features(panel(spark, [1.0] * 8, returns=returns)), "volatility_21d")
    assert out[:7] == [None] * 7 and out[7] == pytest.approx(statistics.stdev([0.1, 0.2, 0.3, 0.1, 0.4]))


def test_drawdown(spark):
    out = column(features.asset_features(panel(spark, [100.0, 110.0, 105.0, None, 108.0, 95.0])), "drawdown")
    assert out[:2] == [0.0, 0.0] and out[2] == pytest.approx(105 / 110 - 1) and out[3] is None and out[5] == pytest.approx(95 / 110 - 1)


def test_two_symbols(spark):
    out = features.asset_features(panel(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).union(panel(spark, [9.0, 8.0, 7.0, 6.0, 5.0], "QQQ")))
    assert out.count() == 10 and column(out, "drawdown")[:5] == pytest.approx([0, 8 / 9 - 1, 7 / 9 - 1, 6 / 9 - 1, 5 / 9 - 1])


def test_windows_against_plain_python(spark):
    r = random.Random(1)
    prices = [r.uniform(50, 150) for _ in range(90)]
    rows = features.asset_features(panel(spark, prices)).orderBy("date").collect()
    for k in (0, 3, 20, 21, 63, 89):
        last = lambda n: prices[max(0, k - n + 1) : k + 1]
        assert rows[k].price_to_ma_21 == pytest.approx(prices[k] / statistics.mean(last(21)) - 1)
        assert rows[k].price_to_ma_63 == pytest.approx(prices[k] / statistics.mean(last(63)) - 1)
        assert rows[k].rolling_volume_21d == pytest.approx(statistics.mean(10.0 + j for j in range(max(0, k - 20), k + 1)))
        assert rows[k].return_21d == (pytest.approx(prices[k] / prices[k - 21] - 1) if k >= 21 else None)


def test_no_lookahead(spark):
    """A shorter history gives the same features, labels apart."""
    r = random.Random(2)
    prices = [r.uniform(50, 150) for _ in range(80)]
    names = [n for n in FEATURES.names if not n.startswith("target") and n != "created_at"]
    whole = features.asset_features(panel(spark, prices)).select(*names).orderBy("date").collect()
    short = features.asset_features(panel(spark, prices[:70])).select(*names).orderBy("date").collect()
    assert [tuple(x) for x in whole[:70]] == [tuple(x) for x in short]


def test_one_exchange(spark, capsys):
    features.asset_features(panel(spark, [1.0, 2.0])).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def long_symbol(spark, rows, symbol="LONG", parts=8):
    """A price a day from year 1 on; some are null."""
    from pyspark.sql import functions as F

    day = spark.range(0, rows, 1, parts)
    price = F.when(day["id"] % 997 == 5, None).otherwise(100 + F.pmod(F.xxhash64(F.lit(symbol), "id"), F.lit(1000)) / 100 + F.col("id") % 91)
    out = day.select(F.date_add(F.lit("0001-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(symbol).alias("symbol"), price.alias("adj_close"), (F.col("id") % 1013).cast("double").alias("volume"))
    return out.withColumn("return_1d", F.col("adj_close") / 1000).withColumn("log_return_1d", F.col("return_1d") / 2)


def differences(a, b):
    """Rows of either table that the other lacks, to eight digits."""
    from ridgeline.operators.explore import rounded

    x, y = (rounded(d.drop("created_at")) for d in (a, b))
    return x.exceptAll(y).count() + y.exceptAll(x).count()


def test_blocks_equal_whole_series(spark):
    short = [long_symbol(spark, n, f"S{n}", 2) for n in (1, 4, 70, 700, 1500, 4000)]
    rows = short[0]
    for s in short[1:]:
        rows = rows.union(s)
    sparse = long_symbol(spark, 900_000, "SPARSE", 2).where("date_format(date, 'MMdd') in ('0101', '0301') or symbol is null")  # two rows a year
    rows = rows.union(sparse).union(spark.createDataFrame([(None, "S4000", 5.0, 1.0, 0.1, 0.1), (None, None, 5.0, 1.0, 0.1, 0.1), (DAY, None, 6.0, 1.0, 0.1, 0.1)], INPUT))
    assert differences(features.asset_features(rows), features.asset_features(rows, block_rows=512)) == 0


def test_a_symbol_of_two_million_rows(spark):
    rows = workspace.stored(long_symbol(spark, 2_000_000))
    out = features.asset_features(rows, block_rows=100_000)
    dealt = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in dealt and all("_block" in x.split(")")[0] for x in dealt.split("hashpartitioning(symbol")[1:])  # no exchange gathers a symbol
    blocks = features.long_years(rows, 100_000)
    sizes = [r["count"] for r in rows.withColumn("_year", features.F.year("date")).join(blocks, ["symbol", "_year"]).select(features.F.explode("_blocks").alias("b")).groupBy("b").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 102_000
    assert differences(features.asset_features(rows), out) == 0
