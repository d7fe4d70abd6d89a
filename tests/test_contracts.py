"""Data contracts and their gate."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import contracts
from ridgeline.operators.clean import clean_prices
from ridgeline.operators.features import asset_features
from ridgeline.schemas import RAW


def raw(spark, **changes):
    base = {"date": date(2024, 1, 2), "symbol": "SPY", "open": 449.0, "high": 452.0, "low": 448.0, "close": 450.0, "adj_close": 450.0, "volume": 1e6, "dividends": 0.0, "stock_splits": 0.0, "source": "v", "ingested_at": datetime(2024, 1, 3)}
    return spark.createDataFrame([tuple(base.values()), tuple((base | {"date": date(2024, 1, 3)} | changes).values())], RAW)


def failures(df, contract=contracts.RAW_CONTRACT):
    return {(r.column_name, r.rule): r.failures for r in contracts.violations(df, contract).collect() if r.failures}


def test_valid_layers(spark):
    df = raw(spark)
    assert contracts.validate(df, contracts.RAW_CONTRACT).count() == 2
    clean = clean_prices(df)
    assert contracts.validate(clean, contracts.CLEAN_CONTRACT).count() == 2
    assert contracts.validate(asset_features(clean), contracts.FEATURE_CONTRACT).count() == 2


@pytest.mark.parametrize(
    "change,found",
    [
        ({"adj_close": -1.0}, {("adj_close", "positive"): 1}),
        ({"adj_close": None}, {("adj_close", "not_null"): 1}),
        ({"volume": -1000.0}, {("volume", "not_negative"): 1}),
        ({"high": 448.0, "low": 449.0, "open": 448.5, "close": 448.5}, {("high", ">= low"): 1, ("high", ">= open"): 1, ("high", ">= close"): 1, ("low", "<= open"): 1, ("low", "<= close"): 1}),
        ({"high": None, "low": None}, {}),
        ({"symbol": None}, {("symbol", "not_null"): 1}),
    ],
)
def test_rules(spark, change, found):
    df = raw(spark, **change)
    assert failures(df) == found
    if found:
        with pytest.raises(contracts.ContractError):
            contracts.validate(df, contracts.RAW_CONTRACT)


def test_every_rule_is_reported(spark):
    found = contracts.violations(raw(spark), contracts.RAW_CONTRACT)
    assert found.count() == 12 + 6 + 5 + 1 + 5  # a type for each declared column, and the rules


def test_duplicates_come_first(spark):
    df = raw(spark, date=date(2024, 1, 2), adj_close=-1.0)
    with pytest.raises(ValueError, match="2 duplicate rows by"):
        contracts.validate(df, contracts.RAW_CONTRACT)
    nulls = raw(spark).withColumn("date", F.lit(None).cast("date"))
    assert contracts.duplicate_keys(nulls, ["symbol", "date"]).first().copies == 2


def test_missing_columns_are_reported(spark, tmp_path):
    df = raw(spark).drop("symbol", "low")
    assert failures(df) == {("symbol", "missing"): 1, ("low", "missing"): 1}
    with pytest.raises(contracts.ContractError, match="symbol missing"):
        contracts.validate(df, contracts.RAW_CONTRACT, str(tmp_path / "r"))


def test_text_is_coerced(spark):
    df = raw(spark).withColumn("adj_close", F.col("adj_close").cast("string"))
    assert dict(contracts.validate(df, contracts.RAW_CONTRACT).dtypes)["adj_close"] == "double"


def test_reports(spark, tmp_path):
    path = str(tmp_path / "reports")
    contracts.validate(raw(spark), contracts.RAW_CONTRACT, path)
    with pytest.raises(contracts.ContractError):
        contracts.validate(raw(spark, volume=-1.0), contracts.RAW_CONTRACT, path)
    rows = sorted(spark.read.json(path).collect(), key=lambda r: r.status)
    assert [r.status for r in rows] == ["failed", "passed"] and rows[0].row_count == 2 and "volume" in rows[0].error


def texts(spark, **second):
    """Two raw rows of strings."""
    first = {"date": "2024-01-02", "symbol": "SPY", "open": "449", "high": "452", "low": "448", "close": "450.5", "adj_close": " 450 ", "volume": "1e6", "dividends": "0", "stock_splits": "0", "source": "v", "ingested_at": "2024-01-03 00:00:00"}
    rows = [first, first | {"date": "2024-01-03"} | second]
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(first))


def test_what_is_no_number_breaks_its_type(spark):
    assert failures(texts(spark)) == {}
    assert failures(texts(spark, open="n/a", volume="")) == {("open", "type"): 1, ("volume", "type"): 1}
    assert failures(texts(spark, open="n/a", adj_close="NaN")) == {("open", "type"): 1, ("adj_close", "not_null"): 1}
    assert failures(texts(spark, dividends="1,5", date="soon", ingested_at="x")) == {("dividends", "type"): 1, ("date", "type"): 1, ("ingested_at", "type"): 1}
    clean = clean_prices(raw(spark)).withColumn("return_1d", F.lit("up"))
    assert failures(clean, contracts.CLEAN_CONTRACT) == {("return_1d", "type"): 2}
    with pytest.raises(contracts.ContractError, match="open type: 1"):
        contracts.validate(texts(spark, open="n/a"), contracts.RAW_CONTRACT)


def test_nan_is_null(spark):
    nan = float("nan")
    assert failures(raw(spark, adj_close=nan, open=nan, high=nan, volume=nan)) == {("adj_close", "not_null"): 1, ("volume", "not_null"): 1}
    row = contracts.validate(raw(spark, open=nan, close=nan), contracts.RAW_CONTRACT).orderBy("date").collect()[1]
    assert row.open is None and row.close is None
    assert failures(texts(spark, open=" nan ", high="-NaN")) == {}


def test_cases_are_the_first_keys(spark):
    rows = raw(spark).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(99)))).select("*").withColumn("symbol", F.format_string("S%02d", "k")).drop("k")
    bad = rows.withColumn("volume", F.when(F.substring("symbol", 3, 1) == "7", -1.0).otherwise(F.col("volume"))).union(rows.where("symbol = 'S07'").withColumn("volume", F.lit(-2.0))).repartition(7)
    found = {(r.column_name, r.rule): r for r in contracts.cases(bad, contracts.RAW_CONTRACT, 3).collect()}
    assert len(found) == 29 and {k for k, r in found.items() if r.failures} == {("volume", "not_negative")}
    r = found["volume", "not_negative"]
    assert r.failures == 22 and r.cases == ["S07/2024-01-02/v", "S07/2024-01-03/v", "S17/2024-01-02/v"]
    none = bad.where("false")
    assert all(r.failures == 0 and r.cases == [] for r in contracts.cases(none, contracts.RAW_CONTRACT).collect())


def test_report_has_the_cases(spark, tmp_path):
    path = str(tmp_path / "reports")
    with pytest.raises(contracts.ContractError, match="SPY/2024-01-03/v"):
        contracts.validate(raw(spark, volume=-1.0, symbol="SPY"), contracts.RAW_CONTRACT, path)
    r = spark.read.json(path).first()
    assert [(c["column_name"], c["rule"], c["failures"], c["keys"]) for c in r.cases] == [("volume", "not_negative", 1, ["SPY/2024-01-03/v"])]


@pytest.mark.parametrize("change", [{}, {"volume": -1.0}, {"date": date(2024, 1, 2)}, {"adj_close": None, "open": float("nan")}])
def test_watch_tells_what_validate_tells(spark, tmp_path, change):
    df = raw(spark, **change)

    def told(run):
        try:
            run()
        except contracts.ContractError as e:
            return str(e)

    watch = contracts.Watch(df, contracts.RAW_CONTRACT)
    path = str(tmp_path / "written")
    watch.frame.write.parquet(path)
    written = spark.read.parquet(path)
    assert written.columns == df.columns and written.count() == 2
    want = told(lambda: contracts.validate(df, contracts.RAW_CONTRACT))
    assert told(lambda: watch.settle(written)) == want and (want is None) == (not change)


def test_watch_of_a_dealt_frame_adds_no_exchange(spark):
    clean = clean_prices(raw(spark))
    plan = contracts.Watch(clean, contracts.CLEAN_CONTRACT).frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == clean._jdf.queryExecution().executedPlan().toString().count("Exchange") and plan.count("Sort ") == clean._jdf.queryExecution().executedPlan().toString().count("Sort ")
