"""Exploratory analytics against small hand-made tables."""

import math
import random
import statistics
from datetime import date, timedelta

import pytest

from pyspark.sql import functions as F

from ridgeline import workspace
from ridgeline.operators import explore

DAY = date(2024, 1, 1)


def table(spark, series):
    """symbol -> returns, one a day."""
    rows = [(s, DAY + timedelta(k), r) for s, v in series.items() for k, r in enumerate(v)]
    return spark.createDataFrame(rows, "symbol string, date date, return_1d double")


def test_correlation_of_a_constant_series_is_null(spark):
    df = table(spark, {"A": [0.1, 0.2, 0.4], "B": [0.2, 0.4, 0.8], "C": [0.1, 0.1, 0.1], "D": [None, 0.5, 0.1]})
    m = {(r.symbol_a, r.symbol_b): r["corr"] for r in explore.correlation_matrix(df).collect()}
    assert len(m) == 16 and m["A", "B"] == pytest.approx(1) == m["B", "A"] and m["A", "C"] is None and m["A", "D"] == pytest.approx(-1)


def test_histogram(spark):
    df = table(spark, {"A": [0.0, 1.0, 2.0, 10.0, None]})
    assert [(r.bin, r.n) for r in explore.histogram(df, "return_1d", 5).orderBy("bin").collect()] == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 1)]
    same = table(spark, {"A": [3.0, 3.0]})
    assert explore.histogram(same, "return_1d", 4).where("n > 0").first().n == 2


def test_quantile_means(spark):
    df = spark.createDataFrame([(float(k), float(k % 2)) for k in range(101)], "m double, t double")
    out = {r.part: r for r in explore.quantile_means(df, "m", "t").collect()}
    assert len(out) == 10 and out[0].n == 11 and out[1].n == 10 and out[9].high == 100.0
    with pytest.raises(Exception, match="unique"):
        explore.quantile_means(df.selectExpr("1.0D AS m", "t"), "m", "t").collect()


def test_profiles(spark):
    df = table(spark, {"A": [None, 0.5, -0.2], "B": [None, 0.05]})
    assert {r.column_name: r.nulls for r in explore.null_profile(df).collect()} == {"symbol": 0, "date": 0, "return_1d": 2}
    assert explore.shape(df).count() == 3 and explore.shape(df).first().n_rows == 5
    assert not explore.balanced(df).first().balanced and explore.duplicate_count(df.union(df), ["symbol", "date"]).first().duplicates == 5
    assert sorted(r.return_1d for r in explore.extreme_moves(df).collect()) == [-0.2, 0.5]
    assert [r.move for r in explore.top_moves(df, 2).collect()] == [0.5, 0.2]
    d = explore.describe(df, "return_1d").first()
    assert d["count"] == 3 and d.p50 == 0.05 and d.p25 == pytest.approx(-0.075)


def test_date_gaps(spark):
    days = [DAY, DAY + timedelta(1), DAY + timedelta(4), DAY + timedelta(5)]
    df = spark.createDataFrame([("A", d) for d in days] + [("B", DAY)], "symbol string, date date")
    assert {r.gap_days: r.n for r in explore.date_gaps(df).collect()} == {1: 2, 3: 1}


def test_pivot(spark):
    df = table(spark, {"A": [0.1, 0.2], "B": [0.3]})
    out = {r.date.day: (r.A, r.B) for r in explore.pivoted(df, ["A", "B"]).collect()}
    assert out == {1: (0.1, 0.3), 2: (0.2, None)}
    with pytest.raises(Exception, match="duplicate entries"):
        explore.pivoted(df.union(df), ["A", "B"]).collect()


def test_density_is_about_one(spark):
    df = table(spark, {"A": [k / 10 for k in range(-20, 21)]})
    rows = explore.density(df).orderBy("x").collect()
    assert len(rows) == 200 and sum(r.density for r in rows) * (rows[1].x - rows[0].x) == pytest.approx(1, abs=0.01)


def test_percentiles_of_ties_and_of_one_value(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 1, 2, 9, 9, 3]], "v double")
    q = explore.percentiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], read_out=1).first().q
    assert q == pytest.approx([1.0, 1.0, 2.5, 9.0, 9.0])
    assert explore.percentiles(df.limit(1), "v", [0.5]).first().q[0] in (5.0, 1.0, 2.0, 9.0, 3.0)
    assert explore.percentiles(df.limit(0), "v", [0.5]).first().q == [None]


@pytest.mark.parametrize("read_out", [0, 300, 65_536])
def test_percentiles_of_any_doubles(spark, read_out):
    """Selection over one to four rounds gives what sorting gives, for values of all sizes and signs."""
    r = random.Random(read_out)
    own = [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(300)] + [1 + r.randrange(9) * 2**-52 for _ in range(400)] + [0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf")] + [r.gauss(0, 1) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in own] + [(None,)] * 5, "v double").repartition(5)
    shares = [0.0, 0.001, 0.1, 0.25, 0.333, 0.5, 0.501, 0.9, 0.999, 1.0]
    ordered = sorted(own)
    for share, got in zip(shares, explore.percentiles(df, "v", shares, read_out=read_out).first().q):
        p = share * (len(own) - 1)
        lo, hi = ordered[math.floor(p)], ordered[math.ceil(p)]
        want = lo + (hi - lo) * (p - math.floor(p))
        assert got == want or math.isnan(got) and math.isnan(want)


def test_percentile_rounds_are_small(spark, monkeypatch):
    """A round's counts are of what lies in the wanted buckets only."""
    seen, counts = [], explore._digit_counts
    monkeypatch.setattr(explore, "_digit_counts", lambda *a: seen.append(counts(*a)) or seen[-1])
    df = spark.range(200_000).select((F.rand(3) + 1).alias("v"))
    explore.percentiles(df, "v", [0.5], read_out=100)
    assert len(seen) == 3 and len(seen[0]) == 16 and sum(seen[1].values()) < 2 * 200_000 / 16 * 1.1 and len(seen[1]) <= 65_536 and sum(seen[2].values()) < 100


def test_density_equals_the_sum_of_kernels(spark):
    r = random.Random(1)
    series = {"A": [r.gauss(0, 0.02) for _ in range(900)] + [3.0, -2.0], "B": [5.0, 5.0, 6.0], "C": [1.0] * 4, "D": [2.0], "E": [r.choice([0.0, 1e6]) for _ in range(50)]}
    out = explore.density(table(spark, series)).collect()
    assert {x.symbol for x in out} == {"A", "B", "E"} and len(out) == 600
    facts = {s: statistics.stdev(v) * len(v) ** -0.2 for s, v in series.items() if len(v) > 1}
    for x in out:
        own, bw = series[x.symbol], facts[x.symbol]
        want = sum(math.exp(-(((x.x - v) / bw) ** 2) / 2) for v in own) / len(own)
        assert x.density * bw * math.sqrt(2 * math.pi) == pytest.approx(want, abs=1e-12)


def test_a_second_value_of_a_day_raises(spark):
    df = table(spark, {"A": [0.1, 0.2], "B": [0.3, 0.1]})
    with pytest.raises(Exception, match="duplicate entries"):
        explore.correlation_matrix(df.union(df.limit(1))).collect()


def test_correlation_in_several_blocks(spark):
    """Blocks of symbols and dates of several years give what one block does."""
    rows = [(f"S{s}", DAY + timedelta(40 * k), ((s * 7 + k * k) % 11) / 10) for s in range(9) for k in range(30) if (s + k) % 6]
    df = spark.createDataFrame(rows, "symbol string, date date, return_1d double")
    one, many = ({(r.symbol_a, r.symbol_b): r["corr"] for r in explore.correlation_matrix(df, block=b).collect()} for b in (512, 2))
    assert set(one) == set(many) and len(one) == 81 and all(many[k] == pytest.approx(one[k]) for k in one)
    a, b = (spark.createDataFrame(rows, df.schema).where(F.col("symbol") == s).select("date", F.col("return_1d").alias(s)) for s in ("S1", "S4"))
    assert one["S1", "S4"] == pytest.approx(a.join(b, "date").stat.corr("S1", "S4"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_at_scale(spark, monkeypatch):
    """No percentile buffer in one task, a broadcast grid only while it is small, and the input's own work done once."""
    df = table(spark, {"A": [k / 10 for k in range(40)], "B": [k / 7 for k in range(40)]}).withColumn("t", F.col("return_1d") * 2)
    for out in (explore.describe(df, "return_1d"), explore.quantile_means(df, "return_1d", "t", 4)):
        assert "percentile(" not in plan(out).replace("percentile_approx(", "")
    assert "BroadcastHashJoin" in plan(explore.density(df))
    with monkeypatch.context() as m:
        m.setattr(explore, "BROADCAST_ROWS", 100)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "BroadcastHashJoin" not in plan(explore.density(df))
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored, seen = workspace.stored, []
    monkeypatch.setattr(workspace, "stored", lambda x: seen.append(plan(x)) or stored(x))
    windowed = df.withColumn("return_1d", F.col("return_1d") - F.lag("return_1d", 1, 0.0).over(explore.Window.partitionBy("symbol").orderBy("date")))
    for make in (explore.correlation_matrix, explore.density, lambda x: explore.describe(x, "return_1d")):
        seen.clear()
        assert "lag(" not in plan(make(windowed)) and sum("lag(" in p for p in seen) == 1
