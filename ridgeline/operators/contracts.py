"""Data contracts as rules over columns, counted in one pass."""

from __future__ import annotations

import heapq
import operator
from collections import Counter
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import number
from ..schemas import CLEAN, FEATURES, KEY, RAW, RAW_KEY
from .clean import run_time


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class Contract:
    table: str
    schema: T.StructType
    key: tuple[str, ...]
    present: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    not_negative: tuple[str, ...] = ()
    #: (column, comparison, column), skipped where either is null
    ordered: tuple[tuple[str, str, str], ...] = ()

    def coerced(self, df: DataFrame) -> DataFrame:
        """Declared columns in their declared types, NaN as null; further ones stay."""
        return df.withColumns({f.name: _cast(f) for f in self.schema.fields if f.name in df.columns})

    def rules(self, columns: list[str]) -> dict[tuple[str, str], Column]:
        """(column, rule) -> whether a row, as it comes, breaks it, for a frame with ``columns``.

        A value that is there but can't be cast breaks ``type`` and no other rule. NaN is null."""
        have = [c for c in self.schema.names if c in columns]
        after = {c: _cast(self.schema[c]) for c in have}
        lost = {c: _given(F.col(c)) & after[c].isNull() for c in have}
        compare = {">=": operator.ge, "<=": operator.le}
        broken = lambda ok: ~F.coalesce(ok, F.lit(True))
        out = {(c, "type"): lost[c] for c in have}
        out |= {(c, "not_null"): after[c].isNull() & ~lost[c] for c in self.present if c in have}
        out |= {(c, "positive"): broken(after[c] > 0) for c in self.positive if c in have}
        out |= {(c, "not_negative"): broken(after[c] >= 0) for c in self.not_negative if c in have}
        return out | {(a, f"{sign} {b}"): broken(compare[sign](after[a], after[b])) for a, sign, b in self.ordered if a in have and b in have}

    def absent(self, columns: list[str]) -> list[str]:
        return [c for c in self.schema.names if c not in columns]

    def key_text(self) -> Column:
        return F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in self.key])


def _cast(field: T.StructField) -> Column:
    return number(F.col(field.name)) if isinstance(field.dataType, T.DoubleType) else F.col(field.name).try_cast(field.dataType)


def _given(c: Column) -> Column:
    """Whether a value of any type is neither null nor NaN; a text that says NaN is NaN."""
    return c.isNotNull() & ~F.lower(F.trim(c.cast("string"))).isin("nan", "+nan", "-nan")


OHLC = tuple(("high", ">=", c) for c in ("low", "open", "close")) + tuple(("low", "<=", c) for c in ("open", "close"))
RAW_CONTRACT = Contract("raw_daily_prices", RAW, tuple(RAW_KEY), ("date", "symbol", "adj_close", "volume", "source", "ingested_at"), ("open", "high", "low", "close", "adj_close"), ("volume",), OHLC)
CLEAN_CONTRACT = Contract("clean_daily_prices", CLEAN, tuple(KEY), ("date", "symbol", "adj_close", "volume", "is_trading_day", "data_quality_flag", "created_at"), ("adj_close",), ("volume",))
FEATURE_CONTRACT = Contract("asset_daily_features", FEATURES, tuple(KEY), ("date", "symbol", "created_at"))


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(table_name, column_name, rule, failures) for every rule, none left out; a
    missing column counts once under "missing"."""
    rules = contract.rules(df.columns)
    entry = lambda c, r, n: F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"), n.cast("long").alias("failures"))
    entries = [entry(c, r, F.col(f"r{i}")) for i, (c, r) in enumerate(rules)] + [entry(c, "missing", F.lit(1)) for c in contract.absent(df.columns)]
    return df.agg(*_counts(rules)).select(F.explode(F.array(*entries)).alias("x")).select(F.lit(contract.table).alias("table_name"), "x.*")


def _counts(rules: dict[tuple[str, str], Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("row_count"), *[F.count_if(broken).alias(f"r{i}") for i, broken in enumerate(rules.values())]]


def cases(df: DataFrame, contract: Contract, k: int = 5) -> DataFrame:
    """(table_name, column_name, rule, failures, cases) for every rule that ``df`` has
    the columns for: cases are the first ``k`` different keys, in text order, of rows that break it.

    One pass: only rows that break a rule reach Python, as a key and a rule's number.
    There a task keeps a count and a buffer of ``k`` keys for each rule, and the
    buffers are merged in two levels, so that no task gets one from each other task."""
    rules = contract.rules(df.columns)
    broken = F.filter(F.array(*[F.when(b, F.lit(i)) for i, b in enumerate(rules.values())]), lambda x: x.isNotNull())
    found = df.select(contract.key_text().alias("key"), F.explode(broken).alias("rule"))

    def first_keys(batches):
        n: Counter = Counter()
        least: dict[int, list[str]] = {}
        for b in batches:
            own: dict[int, set[str]] = {}
            for key, rule in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[rule] += 1
                own.setdefault(rule, set()).add(key)
            for rule, keys in own.items():
                least[rule] = heapq.nsmallest(k, keys.union(least.get(rule, ())))
        lot = [TaskContext.get().partitionId() % 64] * len(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(lot, pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([least[r] for r in n], pa.list_(pa.string()))], ["at", "lot", "n", "keys"])

    merged = [F.sum("n").alias("n"), F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))), 1, k).alias("keys")]
    total = found.mapInArrow(first_keys, "at int, lot int, n long, keys array<string>").groupBy("at", "lot").agg(*merged).groupBy("at").agg(*merged)
    named = df.sparkSession.createDataFrame([(i, contract.table, c, r) for i, (c, r) in enumerate(rules)], "at int, table_name string, column_name string, rule string")
    out = named.join(F.broadcast(total), "at", "left")  # a row for each rule
    return out.select("table_name", "column_name", "rule", F.coalesce("n", F.lit(0)).alias("failures"), F.coalesce("keys", F.array().cast("array<string>")).alias("cases"))


def duplicate_keys(df: DataFrame, key: list[str] | tuple[str, ...]) -> DataFrame:
    """The keys with more than one row, and ``copies``, how many; null keys compare equal."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def validate(df: DataFrame, contract: Contract, reports: str | None = None, at: datetime | None = None) -> DataFrame:
    """``df`` with declared types, if it keeps its contract; else ContractError.

    Broken keys are told first, then all rules. ``df`` is read twice here, for
    its keys and for its rules, so give a stored table, or use ``Watch`` where it is
    written. With ``reports`` one JSON row is added there either way.
    """
    counts = df.agg(*_counts(contract.rules(df.columns))).first().asDict()
    if set(contract.key) <= set(df.columns):
        counts["twice"] = duplicate_keys(df, contract.key).agg(F.sum("copies")).first()[0]
    _settle(df, contract, counts, reports, at)
    return contract.coerced(df)


class Watch:
    """A contract's counts, taken while a frame is written: write ``frame``, then ``settle``.

    Rows that share a key are neighbours in a window over the key, which a frame that is
    dealt and sorted by it gets without an exchange."""

    def __init__(self, df: DataFrame, contract: Contract):
        self.contract, self.seen, first, rest = contract, Observation(), contract.key[0], F.struct(*contract.key[1:])
        series = Window.partitionBy(first).orderBy(*contract.key[1:])
        twice = F.lag(rest).over(series).eqNullSafe(rest) | F.lead(rest).over(series).eqNullSafe(rest)
        marked = df.withColumn("_twice", twice).observe(self.seen, *_counts(contract.rules(df.columns)), F.count_if("_twice").alias("twice"))
        self.frame = contract.coerced(marked.drop("_twice"))

    def settle(self, written: DataFrame, reports: str | None = None, at: datetime | None = None) -> None:
        """ContractError if what was written breaks the contract; only then ``written`` is read, for examples."""
        _settle(written, self.contract, self.seen.get, reports, at)


def _settle(df: DataFrame, contract: Contract, counts: dict, reports: str | None, at: datetime | None) -> None:
    error, found = "", []
    names = [(c, r, counts[f"r{i}"]) for i, (c, r) in enumerate(contract.rules(df.columns))] + [(c, "missing", 1) for c in contract.absent(df.columns)]
    if counts.get("twice"):
        some = ["/".join(map(str, r)) for r in duplicate_keys(df, contract.key).select(*contract.key).orderBy(*contract.key).limit(5).collect()]
        error = f"{contract.table}: {counts['twice']} duplicate rows by {', '.join(contract.key)} (such as {'; '.join(some)})"
    elif broken := [f"{c} {r}: {n}" for c, r, n in names if n]:
        error = f"{contract.table}: " + "; ".join(broken)
        if set(contract.key) <= set(df.columns):
            found = [(r.column_name, r.rule, r.failures, r.cases) for r in cases(df, contract).where("failures > 0").orderBy("column_name", "rule").collect()]  # five keys for each rule
    if reports:
        report(df.sparkSession, contract, counts["row_count"], error, at, found).write.mode("append").json(reports)
    if error:
        raise ContractError(error + "".join(f"\n{c} {r}, such as {'; '.join(keys)}" for c, r, _, keys in found))


def report(spark: SparkSession, contract: Contract, row_count: int, error: str, at: datetime | None = None, found: list[tuple] = ()) -> DataFrame:
    """One row: table_name, status, timestamp, row_count, error (null if it passed) and the first keys of broken rules."""
    row = (contract.table, "failed" if error else "passed", at or run_time(), row_count, error or None, list(found))
    return spark.createDataFrame([row], "table_name string, status string, timestamp timestamp, row_count long, error string, cases array<struct<column_name:string,rule:string,failures:long,keys:array<string>>>")
