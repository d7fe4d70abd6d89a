"""Vendor files, settings, lake, views, the daily job and the stream."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ridgeline.plans import job, sqlapi
from ridgeline.schemas import CLEAN_STORED, FEATURES_STORED, RAW, RAW_STORED
from ridgeline.sources import config, lake, vendor
from ridgeline.streaming import landing

HEADER = "Date,Open,High,Low,Close,Adj Close,Volume,Capital Gains,symbol\n"


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "landing"
    path.mkdir()
    for s, base in (("SPY", 100), ("QQQ", 200)):
        rows = [f"2023-12-{d:02d} 00:00:00,{base},{base + 2},{base - 1},{base + 1},{base + d},{'x' if d == 30 else 1000},0.5,{s}" for d in range(20, 32)]
        (path / f"{s}.csv").write_text(HEADER + "\n".join(rows) + "\n")
    return str(path)


def test_landed_files(spark, folder):
    fetch = vendor.landed(folder, "vendor")
    both = fetch(spark, ["SPY", "QQQ"], "2023-12-21", "2023-12-30")
    assert both.columns == RAW.names and both.count() == 20 and dict(both.dtypes)["date"] == "date"
    assert {r.symbol for r in both.collect()} == {"SPY", "QQQ"}
    assert {r.volume for r in both.where("date = '2023-12-30'").collect()} == {0.0} and both.first().dividends == 0.0
    some = fetch(spark, ["SPY", "NONE"], "2023-12-21", "2023-12-30")
    assert {r.symbol for r in some.collect()} == {"SPY"}
    wanted = spark.createDataFrame([("SPY",), ("NONE",)], "symbol string")
    assert [r.symbol for r in vendor.missing_symbols(wanted, some).collect()] == ["NONE"]
    with pytest.raises(RuntimeError):
        fetch(spark, ["NONE"], "2023-12-21", "2023-12-30")
    with pytest.raises(RuntimeError):
        vendor.landed(folder + "/absent", "vendor")(spark, ["SPY"], "2023-12-21", "2023-12-30")


def test_normalized_frames(spark):
    nested = spark.createDataFrame([(datetime(2024, 1, 2, 23), (1.0, 2.0), 5.0)], "Datetime timestamp_ntz, Price struct<Low: double, High: double>, volume double")
    assert vendor.flattened(nested).columns == ["Datetime", "price_low", "price_high", "volume"]
    with pytest.raises(ValueError, match="no date column"):
        vendor.normalized(nested.drop("Datetime"), "v")
    with pytest.raises(ValueError, match="miss"):
        vendor.normalized(nested, "v", symbol="S")
    instant = spark.sql("SELECT timestamp'2024-01-02 02:00:00+00:00' AS timestamp, 1.0 AS open, 1.0 AS high, 1.0 AS low, 1.0 AS close")
    r = vendor.normalized(instant, "v", symbol="S", zone="America/New_York").first()
    assert r.date == date(2024, 1, 1) and r.adj_close == 0.0 and r.volume == 0.0
    assert vendor.normalized(instant, "v", symbol="S").first().date == date(2024, 1, 2)


def test_union_of_different_frames(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y",)], "b string")
    assert [tuple(r) for r in vendor.union([a, b]).collect()] == [(1, "x"), (None, "y")]


def test_settings(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "assets.yaml").write_text("assets:\n" + "".join(f"- {{symbol: {s}, name: n, asset_class: c, currency: USD, source: v}}\n" for s in ("B", "A")))
    assets = config.load_assets(str(tmp_path / "assets.yaml"))
    assert config.symbols(assets) == ["B", "A"] and config.asset_table(spark, assets).count() == 2
    keys = ["interval", "raw_data_dir", "processed_data_dir", "marts_data_dir", "validation_reports_dir", "duckdb_path"]
    (tmp_path / "p.yaml").write_text('pipeline:\n  start_date: "2018-01-01"\n  end_date: null\n' + "".join(f"  {k}: x\n" for k in keys))
    s = config.load_settings(str(tmp_path / "p.yaml"))
    assert s.start_date == "2018-01-01" and s.end_date is None and s.interval == "x"
    (tmp_path / "q.yaml").write_text("pipeline: {interval: 1d}\n")
    with pytest.raises(KeyError):
        config.load_settings(str(tmp_path / "q.yaml"))
    with pytest.raises(FileNotFoundError):
        config.load_assets(str(tmp_path / "none.yaml"))
    assert config.parse_date("2024-02-03") == date(2024, 2, 3) == config.resolve_end_date("2024-02-03")
    assert config.resolve_end_date("none") == config.resolve_end_date(None) == config.resolve_end_date("") >= date(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, symbol string, adj_close double")


def test_partitioned_write(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = frame(spark, []).schema.add("year", "integer")
    lake.write_by_year(frame(spark, [(date(2023, 5, 1), "A", 1.0), (date(2024, 5, 1), "A", 2.0), (None, "A", 3.0)]), path)
    lake.write_by_year(frame(spark, [(date(2024, 6, 1), "A", 9.0)]), path)
    lake.write_by_year(frame(spark, []), path)
    assert sorted((r.year, r.adj_close) for r in lake.read_dataset(spark, path, schema).collect()) == [(2023, 1.0), (2024, 9.0)]
    with pytest.raises(ValueError, match="missing required"):
        lake.write_partitioned(frame(spark, []), path, ["nope"])
    assert lake.read_dataset(spark, str(tmp_path / "none"), schema).count() == 0
    lake.write_single(frame(spark, [(None, "A", 3.0)] * 3), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1


def test_numeric_symbols_stay_text(spark, tmp_path):
    df = vendor.normalized(spark.createDataFrame([("2024-01-02", "1", 1.0, 1.0, 1.0, 1.0, 1.0)], "date string, symbol string, open double, high double, low double, close double, adj_close double"), "v")
    lake.write_raw(df, str(tmp_path / "raw"))
    r = lake.read_dataset(spark, str(tmp_path / "raw"), RAW_STORED).first()
    assert (r.symbol, r.interval, r.year, r.source) == ("1", "1d", 2024, "v")


def test_views_are_skipped_where_nothing_is(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert lake.create_views(spark, {"raw_daily_prices": str(tmp_path / "none"), "clean_daily_prices": str(tmp_path / "empty")}) == []
    assert sqlapi.summary_stats(spark, "no_such_view").count() == 0 and sqlapi.avg_returns(spark, "no_such_view").columns == ["symbol", "avg_return", "volatility", "observations"]


def test_daily_job_twice(spark, folder, tmp_path):
    layers = job.Lake(*[str(tmp_path / x) for x in ("raw", "clean", "features", "reports")])
    args = (spark, vendor.landed(folder, "vendor"), ["SPY", "QQQ"], "2023-12-20", "2023-12-31", layers, "1d")
    first = sorted(map(tuple, job.daily_job(*args).drop("created_at").collect()))
    again = sorted(map(tuple, job.daily_job(*args).drop("created_at").collect()))
    assert len(first) == 24 and first == again
    assert lake.read_dataset(spark, layers.clean, CLEAN_STORED).count() == 24 and lake.read_dataset(spark, layers.features, FEATURES_STORED).columns[-1] == "year"
    assert [r.row_count for r in sqlapi.summary_stats(spark).collect()] == [12, 12]
    assert sqlapi.query(spark, "SELECT count(*) AS n FROM asset_daily_features").first().n == 24
    assert spark.read.json(layers.reports).where("status = 'passed'").count() == 6


def test_stream_takes_new_files_only(spark, folder, tmp_path):
    schema = "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume string, `Capital Gains` double, symbol string"
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    landing.ingest_stream(spark, folder, kind, "vendor", out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 24
    (tmp_path / "landing" / "DIA.csv").write_text(HEADER + "2024-01-02,1,1,1,1,1,5,0,DIA\n")
    landing.ingest_stream(spark, folder, kind, "vendor", out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 25


def test_job_from_settings(spark, tmp_path):
    """Two YAML files decide symbols, dates and folders."""
    lines = [(f"2024-01-{d:02}", s, 10.0 + d, 11.0 + d, 9.0 + d, 10.5 + d, 10.5 + d, 100.0) for d in range(1, 12) for s in ("A", "B", "C")]
    landing = spark.createDataFrame(lines, "Date string, Symbol string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double")
    landing.write.option("header", True).csv(str(tmp_path / "landing"))
    (tmp_path / "assets.yaml").write_text("assets:\n" + "".join(f"  - {{symbol: {s}, name: n, asset_class: equity, currency: USD, source: files}}\n" for s in "AB"))
    folders = {k: str(tmp_path / k) for k in ("raw_data_dir", "processed_data_dir", "marts_data_dir", "validation_reports_dir", "duckdb_path")}
    (tmp_path / "pipeline.yaml").write_text("pipeline:\n  start_date: 2024-01-02\n  end_date: 2024-01-10\n  interval: 1d\n" + "".join(f"  {k}: {v}\n" for k, v in folders.items()))
    out = job.run_from_settings(spark, vendor.landed(str(tmp_path / "landing"), "files"), str(tmp_path / "pipeline.yaml"), str(tmp_path / "assets.yaml"))
    assert {(r.symbol, r.n) for r in out.groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {("A", 9), ("B", 9)}
    found = sorted(p.name for p in tmp_path.iterdir())
    assert {"raw_data_dir", "processed_data_dir", "marts_data_dir"} <= set(found)
    assert not list(tmp_path.rglob("*_staging*")) and (tmp_path / "processed_data_dir" / "daily_prices").is_dir() and (tmp_path / "marts_data_dir" / "features").is_dir()
    assert spark.read.json(folders["validation_reports_dir"]).where("status = 'passed'").count() == 3


def test_two_header_levels(spark, tmp_path):
    """A download of several symbols in one file, fields over symbols; files with other columns, and empty cells."""
    wide = tmp_path / "wide"
    wide.mkdir()
    (wide / "a.csv").write_text(
        "Price,Adj Close,Adj Close,Adj Close,Close,Close,Close,High,High,High,Low,Low,Low,Open,Open,Open,Volume,Volume,Volume\n"
        "Ticker,SPY,QQQ,BRK-B,SPY,QQQ,BRK-B,SPY,QQQ,BRK-B,SPY,QQQ,BRK-B,SPY,QQQ,BRK-B,SPY,QQQ,BRK-B\n"
        "Date,,,,,,,,,,,,,,,,,,\n"
        "2024-01-02,1.5,2.5,,1,2,,3,4,,0.5,0.25,,1,2,,100,x,\n"
        "2024-01-03 00:00:00,1.25,,3.5,1,,3,3,,4,0.5,,2,1,,3,100,,7\n"
    )
    (wide / "b.csv").write_text("Price,Volume,Close,Open,High,Low\nTicker,DIA,DIA,DIA,DIA,DIA\n2024-01-02,5,1,2,3,4\n")
    raw = vendor.read_landing(spark, str(wide), "wide")
    assert set(raw.columns) == {"Date", "Symbol", "Adj Close", "Close", "High", "Low", "Open", "Volume"}
    out = {(r.symbol, r.date.day): r for r in vendor.normalized(raw, "v").collect()}
    assert set(out) == {("SPY", 2), ("QQQ", 2), ("SPY", 3), ("BRK-B", 3), ("DIA", 2)}
    assert out["SPY", 2].adj_close == 1.5 and out["QQQ", 2].volume == 0.0 and out["BRK-B", 3].low == 2.0 and out["BRK-B", 3].volume == 7.0 and out["DIA", 2].adj_close is None and out["DIA", 2].open == 2.0
    fetch = vendor.landed(str(wide), "v", "wide")
    assert fetch(spark, ["BRK-B"], "2024-01-01", "2024-01-31").count() == 1


def test_a_layer_stored_by_symbol_needs_no_exchange(spark, tmp_path):
    from ridgeline.operators.clean import clean_prices
    from ridgeline.operators.features import asset_features
    from ridgeline.schemas import CLEAN

    rows = [(date(2024, 1, 1 + d), s, 1.0 + d, 3.0 + d, 0.5, 2.0 + d, 2.0 + d, 10.0) for d in range(28) for s in ("A", "B", "C", "D")]
    clean = clean_prices(spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, adj_close double, volume double"))
    path = str(tmp_path / "by_symbol")
    lake.write_by_symbol(clean, path, "clean_by_symbol_test", 4)
    try:
        out = asset_features(lake.read_by_symbol(spark, path, "clean_by_symbol_test", CLEAN, 4)).drop("created_at")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" in plan
        want = sorted(map(tuple, asset_features(clean).drop("created_at").collect()))
        assert sorted(map(tuple, out.collect())) == want
        spark.sql("DROP TABLE clean_by_symbol_test")  # another session: the files are still there
        again = asset_features(lake.read_by_symbol(spark, path, "clean_by_symbol_test", CLEAN, 4)).drop("created_at")
        assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, again.collect())) == want
    finally:
        spark.sql("DROP TABLE IF EXISTS clean_by_symbol_test")
