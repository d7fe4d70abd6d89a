"""The registered queries over derived price panels, and their SQL, by name."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import panel, workspace
from .operators import clean, contracts, explore
from .operators import features as feats
from .plans import job, sqlapi
from .schemas import CLEAN, CLEAN_STORED, FEATURE_NAMES, FEATURES, FEATURES_STORED, KEY, RAW_KEY, RAW_STORED, with_partitions
from .sources import config, lake, vendor

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SYMBOLS = [f"Brand#{i}" for i in range(1, 26)]
START, END = "1996-01-01", "2000-12-31"
PRICE_COLUMNS = ["date", "symbol", "open", "high", "low", "close", "adj_close", "volume"]
_in = ", ".join(f"'{s}'" for s in SYMBOLS[:12])


def query(over: str | None = None, sql: str | None = None):
    """Register a query; ``sql`` selects from the panel ``over``, or stands alone without one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = panel.sql(over, sql) if over else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(names: list[str], digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_prices(panel.bars(spark, sf))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return feats.asset_features(_clean(spark, sf))


def _key_and(spark, sf, names: list[str], digits: int = 8) -> DataFrame:
    return explore.rounded(feats.features(_clean(spark, sf), names), digits)


# ---- window features


@query("clean", f"SELECT symbol, date, {_r(['return_1d', 'log_return_1d'])} FROM clean")
def returns(spark, sf):
    return explore.rounded(clean.with_returns(panel.bars(spark, sf)).select("symbol", "date", "return_1d", "log_return_1d"))


@query("features", f"SELECT symbol, date, {_r(['return_5d', 'return_21d', 'return_63d'])} FROM features")
def multi_returns(spark, sf):
    return _key_and(spark, sf, ["return_5d", "return_21d", "return_63d"])


@query("features", f"SELECT symbol, date, {_r(['volatility_21d', 'volatility_63d'])} FROM features")
def volatility(spark, sf):
    return _key_and(spark, sf, ["volatility_21d", "volatility_63d"])


@query("features", f"SELECT symbol, date, {_r(['momentum_21d', 'momentum_63d'])} FROM features")
def momentum(spark, sf):
    return _key_and(spark, sf, ["momentum_21d", "momentum_63d"])


@query("features", f"SELECT symbol, date, {_r(['rolling_volume_21d'])} FROM features")
def rolling_volume(spark, sf):
    return _key_and(spark, sf, ["rolling_volume_21d"])


@query("features", f"SELECT symbol, date, {_r(['price_to_ma_21', 'price_to_ma_63'])} FROM features")
def price_to_ma(spark, sf):
    return _key_and(spark, sf, ["price_to_ma_21", "price_to_ma_63"])


@query("features", f"SELECT symbol, date, {_r(['drawdown'])} FROM features")
def drawdown(spark, sf):
    return _key_and(spark, sf, ["drawdown"])


@query("features", f"SELECT symbol, date, {_r(['target_return_1d', 'target_return_5d'])} FROM features")
def targets(spark, sf):
    return _key_and(spark, sf, ["target_return_1d", "target_return_5d"])


@query("features", f"SELECT symbol, date, {_r(FEATURE_NAMES)} FROM features")
def asset_features(spark, sf):
    return explore.rounded(_features(spark, sf).drop("created_at"))


@query("features", f"SELECT symbol, date, {_r(FEATURE_NAMES)} FROM features")
def blocked_features(spark, sf):
    """The feature table with every symbol dealt in blocks of some two years."""
    return explore.rounded(feats.asset_features(workspace.stored(_clean(spark, sf)), block_rows=512).drop("created_at"))


# ---- cleaning


@query(
    "dirty",
    """SELECT symbol, date, open, volume_text, TRY_CAST(volume_text AS DOUBLE) AS number,
       coalesce(TRY_CAST(volume_text AS DOUBLE), 0.0) AS volume FROM dirty""",
)
def coerce_numeric(spark, sf):
    dirty = panel.dirty(spark, sf)
    cast = clean.coerced(dirty.withColumn("volume", F.col("volume_text")))
    return cast.select("symbol", "date", "open", "volume_text", clean.number(F.col("volume_text")).alias("number"), "volume")


@query("dirty", "SELECT symbol, date, CASE WHEN adj_close IS NULL THEN 'missing_adj_close' ELSE 'ok' END AS data_quality_flag FROM dirty")
def quality_flag(spark, sf):
    return panel.dirty(spark, sf).select("symbol", "date", clean.quality_flag().alias("data_quality_flag"))


@query(
    "ticks",
    "SELECT DISTINCT symbol, date, px, disc, qty FROM ticks",
)
def dedupe_exact(spark, sf):
    return clean.drop_exact_duplicates(panel.ticks(spark, sf).select("symbol", "date", "px", "disc", "qty"))


@query(
    "ticks",
    f"SELECT symbol, date, px, disc, qty FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY {', '.join(c + ' DESC' for c in panel.ORDER)}) = 1",
)
def dedupe_keep_last(spark, sf):
    kept = clean.keep_last(panel.ticks(spark, sf), order=[F.col(c) for c in panel.ORDER])
    return kept.select("symbol", "date", "px", "disc", "qty")


_COUNTERS = """SELECT (SELECT count(*) FROM dirty) AS n_rows, (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS exact_duplicates,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) - (SELECT count(*) FROM (SELECT DISTINCT symbol, date FROM dirty)) AS key_conflicts,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty) WHERE adj_close IS NULL) AS null_adj_close"""


@query("dirty", _COUNTERS)
def clean_counters(spark, sf):
    return clean.cleaning_counters(panel.dirty(spark, sf))


@query("dirty", _COUNTERS)
def observed_counters(spark, sf):
    """The counters of a cleaning run, observed while its rows are stored."""
    counters = clean.CleaningCounters()
    workspace.stored(clean.clean_prices(panel.dirty(spark, sf).withColumn("volume", F.col("volume_text")).drop("volume_text"), counters=counters))
    found = counters.get()
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} long" for c in found))


@query(
    "dirty",
    """, once AS (SELECT DISTINCT * FROM dirty)
SELECT date, symbol, open, high, low, close, adj_close, coalesce(TRY_CAST(volume_text AS DOUBLE), 0.0) AS volume,
       round(adj_close / nullif(lag(adj_close) OVER s, 0) - 1, 8) AS return_1d,
       round(CASE WHEN adj_close / nullif(lag(adj_close) OVER s, 0) > 0 THEN ln(adj_close / nullif(lag(adj_close) OVER s, 0)) END, 8) AS log_return_1d,
       true AS is_trading_day, CASE WHEN adj_close IS NULL THEN 'missing_adj_close' ELSE 'ok' END AS data_quality_flag
FROM once WINDOW s AS (PARTITION BY symbol ORDER BY date)""",
)
def clean_prices(spark, sf):
    raw = panel.dirty(spark, sf).withColumn("volume", F.col("volume_text")).drop("volume_text")
    out = clean.clean_prices(raw).drop("created_at")
    return out.withColumns({c: F.round(c, 8) for c in ("return_1d", "log_return_1d")})


# ---- contracts


_RULES = {
    contracts.RAW_CONTRACT: (["date", "symbol", "adj_close", "volume", "source", "ingested_at"], ["open", "high", "low", "close", "adj_close"], ["volume"], contracts.OHLC),
    contracts.CLEAN_CONTRACT: (["date", "symbol", "adj_close", "volume", "is_trading_day", "data_quality_flag", "created_at"], ["adj_close"], ["volume"], ()),
    contracts.FEATURE_CONTRACT: (["date", "symbol", "created_at"], [], [], ()),
}


def _checked_sql(contract: contracts.Contract, rows: str) -> str:
    """``given``: whether a value is there; ``checked``: values as numbers, NaN as null."""
    doubles = [f.name for f in contract.schema.fields if f.dataType.typeName() == "double"]
    number = [f"CASE WHEN NOT isnan(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END AS {c}" for c in doubles]
    given = [f"{c} IS NOT NULL AND lower(trim(CAST({c} AS VARCHAR))) <> 'nan' AS {c}_given" for c in doubles]
    return f", came AS ({rows}), checked AS (SELECT * REPLACE ({', '.join(number)}), {', '.join(given)} FROM came) "


def _broken(contract: contracts.Contract) -> list[tuple[str, str, str]]:
    """(column, rule, SQL of what breaks it)."""
    present, positive, not_negative, ordered = _RULES[contract]
    kinds = [(f.name, "type", f"{f.name}_given AND {f.name} IS NULL" if f.dataType.typeName() == "double" else "false") for f in contract.schema.fields]
    doubles = {f.name for f in contract.schema.fields if f.dataType.typeName() == "double"}
    nulls = [(c, "not_null", f"{c} IS NULL" + f" AND NOT {c}_given" * (c in doubles)) for c in present]
    return kinds + nulls + [(c, "positive", f"{c} <= 0") for c in positive] + [(c, "not_negative", f"{c} < 0") for c in not_negative] + [(a, f"{s} {b}", f"NOT ({a} {s} {b})") for a, s, b in ordered]


def _rule_sql(contract: contracts.Contract, rows: str, where=lambda rule: True) -> str:
    parts = [f"SELECT '{contract.table}' AS table_name, '{c}' AS column_name, '{r}' AS rule, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS failures FROM checked" for c, r, bad in _broken(contract) if where(r)]
    return _checked_sql(contract, rows) + " UNION ALL ".join(parts)


@query("texts", _rule_sql(contracts.RAW_CONTRACT, "SELECT *, DATE '1970-01-01' AS ingested_at FROM texts"))
def validate_raw(spark, sf):
    return contracts.violations(panel.texts(spark, sf), contracts.RAW_CONTRACT)


@query(
    "texts",
    _checked_sql(contracts.RAW_CONTRACT, "SELECT *, DATE '1970-01-01' AS ingested_at, symbol || '/' || strftime(date, '%Y-%m-%d') || '/' || source AS key FROM texts")
    + " UNION ALL ".join(
        f"SELECT '{contracts.RAW_CONTRACT.table}' AS table_name, '{c}' AS column_name, '{r}' AS rule, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS failures, coalesce(array_to_string(list_sort(list_distinct(list(key) FILTER (WHERE {bad})))[:5], '; '), '') AS cases FROM checked"
        for c, r, bad in _broken(contracts.RAW_CONTRACT)
    ),
)
def contract_cases(spark, sf):
    """Each rule of the raw contract with its failures and the first keys that break it."""
    return contracts.cases(panel.texts(spark, sf), contracts.RAW_CONTRACT).withColumn("cases", F.array_join("cases", "; "))


@query("dirty", _rule_sql(contracts.RAW_CONTRACT, "SELECT *, DATE '1970-01-01' AS ingested_at FROM dirty", lambda rule: rule[1] == "="))
def ohlc_violations(spark, sf):
    found = contracts.violations(panel.dirty(spark, sf), contracts.RAW_CONTRACT)
    return found.where(F.col("rule").rlike("^[<>]="))


@query("dirty", "SELECT symbol, date, source, count(*) AS copies FROM dirty GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return contracts.duplicate_keys(panel.dirty(spark, sf), RAW_KEY)


@query("dirty", _rule_sql(contracts.CLEAN_CONTRACT, "SELECT DISTINCT *, NULL::DOUBLE AS return_1d, NULL::DOUBLE AS log_return_1d, true AS is_trading_day, 'ok' AS data_quality_flag, DATE '1970-01-01' AS created_at FROM dirty"))
def validate_clean(spark, sf):
    return contracts.violations(clean.clean_prices(panel.dirty(spark, sf)), contracts.CLEAN_CONTRACT)


@query("features", _rule_sql(contracts.FEATURE_CONTRACT, "SELECT *, 1 AS created_at FROM features"))
def validate_features(spark, sf):
    return contracts.violations(_features(spark, sf), contracts.FEATURE_CONTRACT)


@query(
    "dirty",
    """SELECT 'raw_daily_prices' AS table_name, 'failed' AS status, count(*) AS row_count,
       'raw_daily_prices: ' || (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM dirty GROUP BY symbol, date, source HAVING count(*) > 1)) || ' duplicate rows by symbol, date, source' AS error
       FROM dirty UNION ALL SELECT 'raw_daily_prices', 'passed', count(*), NULL FROM bars""",
)
def validation_report(spark, sf):
    """Reports of a table that breaks its contract and of one that keeps it, less run time and examples."""
    dirty = workspace.stored(panel.dirty(spark, sf))
    path = workspace.new_path(spark, "reports")
    for rows in (dirty, workspace.stored(panel.bars(spark, sf))):
        try:
            contracts.validate(rows, contracts.RAW_CONTRACT, path)
        except contracts.ContractError:
            pass
    reports = spark.read.schema("table_name string, status string, row_count long, error string").json(path)
    return reports.withColumn("error", F.regexp_replace("error", r" \(such as.*", ""))


# ---- sources and sinks

_VENDOR = {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume", "Capital Gains": None, "Symbol": "symbol"}


def _landing(spark, rows: DataFrame, kind: str = "csv") -> str:
    """Vendor files with ``rows``, a folder for each symbol."""
    path = workspace.new_path(spark, "landing")
    named = rows.select(*[(F.col(c) if c else F.lit(0.5)).alias(v) for v, c in _VENDOR.items()], F.col("symbol").alias("folder"))
    named.repartition("folder").write.partitionBy("folder").option("header", True).format(kind).save(path)
    return path


_RAW_SQL = "date, symbol, open, high, low, close, adj_close, volume, dividends, stock_splits, source"


@query("bars", f"SELECT {_RAW_SQL} FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}' AND symbol IN ({_in})")
def vendor_scan(spark, sf):
    fetch = vendor.landed(_landing(spark, panel.bars(spark, sf)), panel.SOURCE)
    return fetch(spark, SYMBOLS[:12], START, END).drop("ingested_at")


@query("dirty", "SELECT date, symbol, open, high, low, close, adj_close, coalesce(TRY_CAST(volume_text AS DOUBLE), 0.0) AS volume, dividends, stock_splits, source FROM dirty")
def normalize_vendor(spark, sf):
    rows = panel.dirty(spark, sf).withColumn("volume", F.col("volume_text"))
    return vendor.normalized(vendor.read_landing(spark, _landing(spark, rows)), panel.SOURCE).drop("ingested_at")


def _wide_landing(spark, rows: DataFrame) -> str:
    """Vendor files with a header of fields over one of symbols, a file for each year."""
    path = workspace.new_path(spark, "wide")
    cells = [(v, s) for v, c in _VENDOR.items() for s in SYMBOLS if c not in (None, "date", "symbol")]
    wide = rows.groupBy("date").pivot("symbol", SYMBOLS).agg(F.first(F.struct(*[c for c in _VENDOR.values() if c not in (None, "date", "symbol")])).alias("x"))
    text = F.concat_ws(",", F.col("date").cast("string"), *[F.coalesce(F.col(f"`{s}`.{_VENDOR[v]}").cast("string"), F.lit("")) for v, s in cells])
    lines = wide.select(F.year("date").alias("year"), F.lit(3).alias("k"), F.col("date").alias("at"), text.alias("line"))
    heads = [",".join(["Price", *[v for v, _ in cells]]), ",".join(["Ticker", *[s for _, s in cells]]), "Date" + "," * len(cells)]
    first = lines.select("year").distinct().select("year", F.posexplode(F.array(*map(F.lit, heads))).alias("k", "line"))
    both = lines.unionByName(first.select("year", "k", F.lit(None).cast("date").alias("at"), "line"))
    both.repartition("year").sortWithinPartitions("year", "k", "at").select("year", "line").write.partitionBy("year").text(path)
    return path


@query("bars", f"SELECT {_RAW_SQL} FROM bars")
def wide_vendor(spark, sf):
    """Bars from files with two header levels, as a download of several symbols gives them."""
    return vendor.normalized(vendor.read_landing(spark, _wide_landing(spark, panel.bars(spark, sf)), "wide"), panel.SOURCE).drop("ingested_at")


@query("bars", f"SELECT DISTINCT p_type AS symbol FROM part UNION SELECT p_brand FROM part WHERE p_brand NOT IN (SELECT symbol FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}')")
def missing_symbols(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    wanted = part.select(F.col("p_brand").alias("symbol")).union(part.select("p_type"))
    return vendor.missing_symbols(wanted, vendor.restricted(panel.bars(spark, sf), None, START, END))


@query("bars", f"SELECT date, symbol, close, NULL::DOUBLE AS volume FROM bars WHERE symbol IN ({_in}) UNION ALL SELECT date, symbol, close, volume FROM bars WHERE symbol NOT IN ({_in})")
def union_vendor(spark, sf):
    rows = panel.bars(spark, sf)
    first = F.col("symbol").isin(SYMBOLS[:12])
    return vendor.union([rows.where(first).select("date", "symbol", "close"), rows.where(~first).select("symbol", "date", "close", "volume")]).select("date", "symbol", "close", "volume")


@query(
    "bars",
    "SELECT p_brand AS symbol, max(p_type) AS name, min(p_type) AS asset_class, 'USD' AS currency, 'orders' AS source, (SELECT count(*) FROM bars WHERE bars.symbol = p_brand) AS n_bars FROM part GROUP BY p_brand",
)
def asset_universe(spark, sf):
    """The assets of a settings file, which is written from the parts' brands, with their bars."""
    brands = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_brand").alias("symbol")).agg(F.max("p_type").alias("name"), F.min("p_type").alias("asset_class"), F.lit("USD").alias("currency"), F.lit(panel.SOURCE).alias("source"))
    with tempfile.NamedTemporaryFile("w", prefix="spark-", suffix=".yaml") as f:  # settings are the driver's
        json.dump({"assets": [r.asDict() for r in brands.orderBy("symbol").collect()]}, f)
        f.flush()
        assets = config.asset_table(spark, config.load_assets(f.name))
    return assets.join(explore.rows_per(panel.bars(spark, sf)).withColumnRenamed("n_rows", "n_bars"), "symbol", "left").fillna(0, ["n_bars"])


def _raw_lake(spark, sf) -> str:
    path = workspace.new_path(spark, "raw")
    lake.write_raw(panel.bars(spark, sf), path)
    return path


_STORED_RAW = f"SELECT {_RAW_SQL}, '1d' AS interval, CAST(year(date) AS INTEGER) AS year FROM bars"


@query("bars", _STORED_RAW)
def ingest_raw(spark, sf):
    path = workspace.new_path(spark, "raw")
    job.ingest(spark, lambda s, symbols, a, z: vendor.restricted(panel.bars(s, sf), symbols, a, z), SYMBOLS, "1990-01-01", "2010-12-31", path)
    return lake.read_dataset(spark, path, RAW_STORED).drop("ingested_at")


@query("bars", _STORED_RAW)
def view_raw(spark, sf):
    lake.create_views(spark, {"raw_daily_prices": _raw_lake(spark, sf)})
    return sqlapi.query(spark, "SELECT * FROM raw_daily_prices").drop("ingested_at")


def _clean_lake(spark, sf) -> str:
    path = workspace.new_path(spark, "clean")
    lake.write_by_year(_clean(spark, sf), path)
    return path


@query("clean", f"SELECT date, symbol, open, high, low, close, adj_close, volume, {_r(['return_1d', 'log_return_1d'])}, true AS is_trading_day, 'ok' AS data_quality_flag, CAST(year(date) AS INTEGER) AS year FROM clean")
def view_clean(spark, sf):
    lake.create_views(spark, {"clean_daily_prices": _clean_lake(spark, sf)})
    out = sqlapi.query(spark, "SELECT * FROM clean_daily_prices").drop("created_at")
    return out.withColumns({c: F.round(c, 8) for c in ("return_1d", "log_return_1d")})


@query("features", f"SELECT symbol, date, {_r(FEATURE_NAMES)} FROM features")
def features_by_symbol(spark, sf):
    """The feature table from clean prices that are stored by symbol, without an exchange."""
    path = workspace.new_path(spark, "by-symbol")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    lake.write_by_symbol(_clean(spark, sf), path, name, 16)
    return explore.rounded(feats.asset_features(lake.read_by_symbol(spark, path, name, CLEAN, 16)).drop("created_at"))


def _mart(spark, sf) -> str:
    path = workspace.new_path(spark, "features")
    lake.write_by_year(_features(spark, sf), path)
    return path


_MART = f"SELECT date, symbol, {_r(FEATURE_NAMES)}, CAST(year(date) AS INTEGER) AS year FROM features"


@query("features", _MART)
def view_features(spark, sf):
    lake.create_views(spark, {"asset_daily_features": _mart(spark, sf)})
    return explore.rounded(sqlapi.query(spark, "SELECT * FROM asset_daily_features").drop("created_at"))


@query("features", _MART + " ORDER BY date, symbol")
def eda_scan(spark, sf):
    out = lake.read_dataset(spark, _mart(spark, sf), FEATURES_STORED).orderBy("date", "symbol")
    return explore.rounded(out.drop("created_at"))


@query("bars", "SELECT date, symbol, adj_close * CASE WHEN year(date) = 1997 THEN 2 ELSE 1 END AS adj_close, volume, CAST(year(date) AS INTEGER) AS year FROM bars")
def write_roundtrip(spark, sf):
    """All years are stored; then one year is replaced, and rows without a date are added, which aren't stored."""
    path = workspace.new_path(spark, "roundtrip")
    rows = panel.bars(spark, sf).select("date", "symbol", "adj_close", "volume")
    lake.write_by_year(rows, path)
    again = rows.where("year(date) = 1997").withColumn("adj_close", F.col("adj_close") * 2)
    undated = again.withColumn("date", F.lit(None).cast("date"))
    lake.write_by_year(again.union(undated), path)
    return lake.read_dataset(spark, path, with_partitions(rows.schema, year=RAW_STORED["year"].dataType))


@query("bars", f"SELECT date, symbol, close, NULL::DOUBLE AS volume, CAST(year(date) AS INTEGER) AS year FROM bars WHERE symbol IN ({_in}) UNION ALL SELECT date, symbol, close, volume, CAST(year(date) AS INTEGER) FROM bars WHERE symbol NOT IN ({_in})")
def read_dataset(spark, sf):
    path = workspace.new_path(spark, "mixed")
    rows = lake.with_year(panel.bars(spark, sf).select("date", "symbol", "close", "volume"))
    first = F.col("symbol").isin(SYMBOLS[:12])
    rows.where(first).drop("volume").write.partitionBy("year").parquet(path)
    rows.where(~first).write.mode("append").partitionBy("year").parquet(path)
    return lake.read_dataset(spark, path, with_partitions(rows.schema, year=rows.schema["year"].dataType))


# ---- SQL surface


@query("clean", "SELECT symbol, count(*) AS row_count, min(date) AS start_date, max(date) AS end_date FROM clean GROUP BY symbol")
def summary_stats(spark, sf):
    _clean(spark, sf).createOrReplaceTempView("clean_daily_prices")
    return sqlapi.summary_stats(spark)


@query("features", "SELECT symbol, round(avg(return_1d), 8) AS avg_return, round(stddev_samp(return_1d), 8) AS volatility, count(*) AS observations FROM features GROUP BY symbol")
def avg_returns(spark, sf):
    _features(spark, sf).createOrReplaceTempView("asset_daily_features")
    return explore.rounded(sqlapi.avg_returns(spark))


@query("features", "SELECT symbol, round(avg(return_1d) * 252, 6) AS annual_return, round(stddev_samp(return_1d) * sqrt(252), 6) AS annual_volatility FROM features GROUP BY symbol")
def sql_annualized(spark, sf):
    _features(spark, sf).createOrReplaceTempView("asset_daily_features")
    text = "SELECT symbol, AVG(return_1d) * 252 AS annual_return, STDDEV(return_1d) * SQRT(252) AS annual_volatility FROM asset_daily_features GROUP BY symbol ORDER BY annual_return DESC"
    return explore.rounded(sqlapi.query(spark, text), 6)


@query("features", "SELECT symbol, date, round(return_1d, 8) AS return_1d, round(volatility_21d, 8) AS volatility_21d FROM features WHERE date >= '2001-01-01' ORDER BY date DESC, symbol LIMIT 20")
def sql_recent_features(spark, sf):
    _features(spark, sf).createOrReplaceTempView("asset_daily_features")
    text = "SELECT symbol, date, return_1d, volatility_21d FROM asset_daily_features WHERE date >= '2001-01-01' ORDER BY date DESC, symbol LIMIT 20"
    return explore.rounded(sqlapi.query(spark, text))


@query("features", "SELECT date, round(return_1d, 8) AS return_1d FROM features WHERE symbol = 'Brand#1'")
def symbol_slice(spark, sf):
    return explore.rounded(_features(spark, sf).where("symbol = 'Brand#1'").select("date", "return_1d"))


@query("features", "SELECT symbol, date, round(drawdown, 8) AS drawdown FROM features ORDER BY date, symbol LIMIT 5")
def head_rows(spark, sf):
    return explore.rounded(_features(spark, sf).select("symbol", "date", "drawdown").orderBy("date", "symbol").limit(5))


# ---- exploration


@query("features", "SELECT symbol, count(*) AS n_rows FROM features GROUP BY symbol")
def rows_per_symbol(spark, sf):
    return explore.rows_per(_features(spark, sf))


@query("features", "SELECT min(date) AS first_date, max(date) AS last_date FROM features")
def date_range(spark, sf):
    return explore.date_range(_features(spark, sf))


@query("features", "SELECT DISTINCT symbol FROM features")
def distinct_symbols(spark, sf):
    return explore.distinct_values(_features(spark, sf))


_KINDS = [(f.name, f.dataType.simpleString()) for f in FEATURES.fields]


@query("features", " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS position, '{n}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, CAST({len(_KINDS)} AS INTEGER) AS n_columns FROM features" for i, (n, t) in enumerate(_KINDS)))
def profile_shape(spark, sf):
    return explore.shape(_features(spark, sf))


@query("dirty", "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, date FROM dirty)) AS BIGINT) AS duplicates FROM dirty")
def duplicate_count(spark, sf):
    return explore.duplicate_count(panel.dirty(spark, sf), KEY)


@query("features", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM features" for c in ["date", "symbol", *FEATURE_NAMES]))
def null_profile(spark, sf):
    return explore.null_profile(_features(spark, sf).drop("created_at"))


@query(
    "features",
    """SELECT count(return_1d) AS count, round(avg(return_1d), 8) AS mean, round(stddev_samp(return_1d), 8) AS std, round(min(return_1d), 8) AS min,
       round(quantile_cont(return_1d, 0.25), 8) AS p25, round(quantile_cont(return_1d, 0.5), 8) AS p50, round(quantile_cont(return_1d, 0.75), 8) AS p75,
       round(max(return_1d), 8) AS max FROM features""",
)
def describe_returns(spark, sf):
    return explore.rounded(explore.describe(_features(spark, sf), "return_1d"))


@query("features", "SELECT symbol, round(avg(volatility_21d), 8) AS mean_volatility_21d FROM features GROUP BY symbol")
def mean_volatility(spark, sf):
    return explore.rounded(explore.mean_by(_features(spark, sf), "volatility_21d"))


def _histogram_sql(c: str) -> str:
    return f"""SELECT bin, coalesce(n, 0) AS n FROM range(100) AS r(bin) LEFT JOIN (
      SELECT CAST(least(floor(({c} - lo) / ((hi - lo) / 100)), 99) AS BIGINT) AS b, count(*) AS n
      FROM features, (SELECT min({c}) AS lo, max({c}) AS hi FROM features) WHERE {c} IS NOT NULL GROUP BY b) ON b = bin"""


@query("features", _histogram_sql("return_1d"))
def return_histogram(spark, sf):
    return explore.histogram(_features(spark, sf), "return_1d")


@query("features", _histogram_sql("volatility_21d"))
def volatility_histogram(spark, sf):
    return explore.histogram(_features(spark, sf), "volatility_21d")


@query("features", "SELECT gap_days, count(*) AS n FROM (SELECT CAST(date - lag(date) OVER (ORDER BY date) AS INTEGER) AS gap_days FROM (SELECT DISTINCT date FROM features)) WHERE gap_days IS NOT NULL GROUP BY gap_days")
def date_gaps(spark, sf):
    return explore.date_gaps(_features(spark, sf))


@query(
    "features",
    """SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, round(covar_samp(a.return_1d, b.return_1d) / nullif(stddev_samp(a.return_1d) * stddev_samp(b.return_1d), 0), 8) AS corr
       FROM features a JOIN features b ON a.date = b.date AND a.return_1d IS NOT NULL AND b.return_1d IS NOT NULL GROUP BY ALL""",
)
def return_correlation(spark, sf):
    return explore.rounded(explore.correlation_matrix(_features(spark, sf)))


@query(
    "features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(covar_samp({c}, target_return_1d) / nullif(stddev_samp(CASE WHEN target_return_1d IS NOT NULL THEN {c} END) * stddev_samp(CASE WHEN {c} IS NOT NULL THEN target_return_1d END), 0), 8) AS corr FROM features"
        for c in FEATURE_NAMES
    ),
)
def target_correlation(spark, sf):
    return explore.rounded(explore.target_correlation(_features(spark, sf)))


@query(
    "features",
    """, x AS (SELECT round(momentum_21d, 10) AS x, target_return_1d AS y FROM features WHERE momentum_21d IS NOT NULL),
e AS (SELECT [round(q, 10) FOR q IN quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])] AS e FROM x)
SELECT part, round(e[part + 1], 8) AS low, round(e[part + 2], 8) AS high, count(*) AS n, round(avg(y), 8) AS mean_value
FROM (SELECT e, y, len(list_filter(e[2:10], lambda v: x > v))::INTEGER AS part FROM x, e) GROUP BY part, e""",
)
def momentum_deciles(spark, sf):
    return explore.rounded(explore.quantile_means(_features(spark, sf), "momentum_21d", "target_return_1d"))


@query(
    "features",
    """, f AS (SELECT symbol, count(log_return_1d) AS n, stddev_samp(log_return_1d) * pow(count(log_return_1d), -0.2) AS bw, min(log_return_1d) AS lo, max(log_return_1d) AS hi FROM features GROUP BY symbol),
g AS (SELECT symbol, bw, point, (lo - 3 * bw) + point * ((hi + 3 * bw) - (lo - 3 * bw)) / 199 AS x FROM f, range(200) AS r(point))
SELECT g.symbol, CAST(point AS INTEGER) AS point, round(x, 6) AS x, round(avg(exp(-((x - log_return_1d) / bw) * ((x - log_return_1d) / bw) / 2)) / (bw * sqrt(2 * pi())), 6) AS density
FROM g JOIN features ON g.symbol = features.symbol AND log_return_1d IS NOT NULL GROUP BY g.symbol, point, x, bw""",
)
def return_density(spark, sf):
    return explore.rounded(explore.density(_features(spark, sf), "log_return_1d"), 6)


@query("features", "SELECT count(*) AS n_symbols, min(n) AS min_rows, max(n) AS max_rows, min(n) = max(n) AS balanced FROM (SELECT count(*) AS n FROM features GROUP BY symbol)")
def balanced_panel(spark, sf):
    return explore.balanced(_features(spark, sf))


@query(
    "features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(sum(nulls) AS BIGINT) AS nulls, CAST(sum(least(n, {k})) AS BIGINT) AS expected, sum(nulls) = sum(least(n, {k})) AS matches FROM (SELECT count(*) AS n, count(*) - count({c}) AS nulls FROM features GROUP BY symbol)"
        for c, k in explore.BLANK_ROWS.items()
    ),
)
def null_reconciliation(spark, sf):
    return explore.null_reconciliation(_features(spark, sf))


@query("features", "SELECT symbol, date, round(return_1d, 8) AS return_1d FROM features WHERE abs(return_1d) > 0.1")
def extreme_moves(spark, sf):
    return explore.rounded(explore.extreme_moves(_features(spark, sf)))


@query("features", "SELECT symbol, date, round(abs(return_1d), 8) AS move FROM features WHERE return_1d IS NOT NULL ORDER BY abs(return_1d) DESC, symbol, date LIMIT 20")
def top_abs_moves(spark, sf):
    return explore.rounded(explore.top_moves(_features(spark, sf)))


@query("features", "SELECT date, " + ", ".join(f"round(max(CASE WHEN symbol = '{s}' THEN return_1d END), 8) AS \"{s}\"" for s in SYMBOLS) + " FROM features GROUP BY date")
def pivot_returns(spark, sf):
    wide = explore.pivoted(_features(spark, sf), SYMBOLS)
    return wide.select("date", *[F.round(F.col(f"`{s}`"), 8).alias(s) for s in SYMBOLS])


# ---- the whole job


@query("features", _MART)
def pipeline_features(spark, sf):
    base = workspace.new_path(spark, "lake")
    fetch = lambda s, symbols, a, z: vendor.restricted(panel.bars(s, sf), symbols, a, z)
    layers = job.Lake(f"{base}/raw", f"{base}/processed", f"{base}/marts", f"{base}/reports")
    return explore.rounded(job.daily_job(spark, fetch, SYMBOLS, "1990-01-01", "2010-12-31", layers).drop("created_at"))
