"""Exploratory analytics of a feature table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import workspace
from ..functions.numbers import correlation

#: Rows of at most three numbers and a key that may be broadcast.
BROADCAST_ROWS = 1_000_000


def rows_per(df: DataFrame, by: str = "symbol") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def distinct_values(df: DataFrame, column: str = "symbol") -> DataFrame:
    return df.select(column).distinct()


def shape(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, n_rows, n_columns), a row for each column."""
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column_name"), F.lit(t).alias("data_type")) for i, (n, t) in enumerate(df.dtypes)])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(entries).alias("x"), "n_rows").select("x.*", "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def duplicate_count(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    each = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, nulls), most first; one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls").orderBy(F.desc("nulls"), "column_name")


#: Bits of a double by which a round of the selection tells values apart, and values that are read out at once.
_DIGIT, READ_OUT = 16, 65_536


def _places(x: np.ndarray) -> np.ndarray:
    """Numbers that ascend as the doubles do; both zeros are one."""
    u = (x + 0.0).view(np.uint64)
    return u ^ np.where(u >> np.uint64(63) == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1 << 63))


def _double(place: int) -> float:
    return float(np.array([place ^ (1 << 63) if place >> 63 else place ^ 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.float64)[0])


def _digit_counts(values: DataFrame, column: str, within: list[int] | None, bits: int, seen: int) -> dict[int, int]:
    """How many values there are for each ``bits`` leading bits, of those whose ``seen`` leading
    bits are among ``within``. Tasks add up what they have first, so a task sends at most 2^16 rows for each of ``within``."""
    wanted = None if within is None else np.array(within, np.uint64)

    def count(batches):
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            k = _places(b.column(0).to_numpy(zero_copy_only=False))
            if wanted is not None:
                k = k[np.isin(k >> np.uint64(64 - seen), wanted)]
            own, counts = np.unique(k >> np.uint64(64 - bits), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, counts]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    x = values.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    found = x.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys = found.column(0).to_numpy().view(np.uint64)
    return dict(sorted(zip(keys.tolist(), found.column(1).to_numpy().tolist())))


def percentiles(values: DataFrame, column: str, shares: list[float], read_out: int = READ_OUT) -> DataFrame:
    """One row with an array ``q``: the exact, interpolated percentiles of ``column``.

    Radix selection: values are counted by the leading 16 bits of an order-preserving
    code; buckets that hold a wanted rank are counted by their next 16 bits, or, once they
    hold at most ``read_out`` values together, by all that are left. So at most four
    rounds read ``values`` (give a stored table), nothing is sorted, and counts alone are
    shuffled and come to the driver: 2^16 for each wanted rank and round at most.
    """
    counts, bits = _digit_counts(values, column, None, _DIGIT, 0), _DIGIT
    total = sum(counts.values())
    places = [s * (total - 1) for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))}) if total else []
    ahead, found = dict.fromkeys(ranks, 0), {}  # values before the bucket that a rank is in
    while ranks:
        ends, inside = 0, {}
        for key, n in counts.items():
            inside[key] = (ends, ends := ends + n)
        for r in ranks:  # counts are those of the rank's last bucket and of others; the first bits tell them apart
            own = [(k, span) for k, span in inside.items() if bits == _DIGIT or k >> (bits - seen) == found[r]]
            first = own[0][1][0]
            key, span = next((k, span) for k, span in own if ahead[r] + span[1] - first > r)
            ahead[r], found[r] = ahead[r] + span[0] - first, key
        if bits == 64:
            break
        seen = bits
        within = sorted(set(found.values()))
        bits = 64 if sum(counts[k] for k in within) <= read_out else bits + _DIGIT
        counts = _digit_counts(values, column, within, bits, seen)
    at = {r: _double(found[r]) for r in ranks}
    q = [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) if total else None for p in places]
    return values.sparkSession.createDataFrame([(q,)], "q array<double>")


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, exact quartiles (interpolated) and max."""
    own = workspace.stored(df.select(column))
    out = own.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    both = out.crossJoin(F.broadcast(percentiles(own, column, [0.25, 0.5, 0.75])))  # a row each
    return both.select("count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def mean_by(df: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias(f"mean_{value}"))


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """(bin, n) of equal widths between the least and the largest value; the
    last bin is closed, and empty bins count 0. Equal values all fall in bin 0."""
    values = df.select(F.col(column).alias("x")).where("x IS NOT NULL")
    ends = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    at = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), (F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    counts = values.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))  # at most ``bins`` rows


def date_gaps(df: DataFrame) -> DataFrame:
    """(gap_days, n) between neighbouring trading dates. The window sees the
    distinct dates only, so one task is enough for it."""
    gap = F.date_diff("date", F.lag("date").over(Window.orderBy("date")))
    return df.select("date").distinct().select(gap.alias("gap_days")).where("gap_days IS NOT NULL").groupBy("gap_days").agg(F.count(F.lit(1)).alias("n"))


_SUMS = ["sa", "sb", "saa", "sbb", "sab"]


def _gram(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of products of two blocks of symbols over one period's dates that both symbols have."""

    def table(part):
        wide = part.pivot(index="date", columns="symbol", values="v").reindex(dates)  # refuses a second row of a symbol and date
        have = wide.notna().to_numpy(float)
        return wide.columns.to_numpy(), have, wide.fillna(0.0).to_numpy(float)

    dates = np.sort(rows["date"].unique())
    (a, have_a, x), (b, have_b, y) = table(rows[rows["left"]]), table(rows[rows["right"]])
    sums = {"n": have_a.T @ have_b, "sa": x.T @ have_b, "sb": have_a.T @ y, "saa": (x * x).T @ have_b, "sbb": have_a.T @ (y * y), "sab": x.T @ y}
    keep = (sums["n"] > 0) & (a[:, None] <= b[None, :]) if rows["a"].iloc[0] == rows["b"].iloc[0] else sums["n"] > 0
    i, j = np.nonzero(keep)
    low, high = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
    turned = a[i] > b[j]  # the lesser symbol comes first
    pair = lambda p, q: (np.where(turned, sums[q][i, j], sums[p][i, j]), np.where(turned, sums[p][i, j], sums[q][i, j]))
    (sa, sb), (saa, sbb) = pair("sa", "sb"), pair("saa", "sbb")
    return pd.DataFrame({"symbol_a": low, "symbol_b": high, "n": sums["n"][i, j].astype(int), "sa": sa, "sb": sb, "saa": saa, "sbb": sbb, "sab": sums["sab"][i, j]})


def correlation_matrix(df: DataFrame, value: str = "return_1d", block: int = 512) -> DataFrame:
    """(symbol_a, symbol_b, corr) over dates that both have; half of the pairs are computed and mirrored.

    Symbols are put in blocks of about ``block``. Each pair of blocks and each
    year is a matrix product, and the products' sums are added up, so a task
    holds a year of two blocks and rows don't grow with the number of dates. Two
    values of a symbol for a date raise.
    """
    own = workspace.stored(df.select("date", "symbol", F.col(value).alias("v")).where("v IS NOT NULL"))
    least = own.groupBy("symbol").agg(F.min("v").alias("least"))
    n_blocks = -(-max(1, least.count()) // block)
    # the least value is taken off, which changes no correlation and keeps the sums of squares exact for constants
    rows = own.join(least, "symbol").select("symbol", "date", (F.col("v") - F.col("least")).alias("v"), F.pmod(F.xxhash64("symbol"), F.lit(n_blocks)).cast("int").alias("own"))
    others = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    dealt = rows.select("*", others.alias("other")).select("symbol", "date", "v", (F.col("own") == F.least("own", "other")).alias("left"), (F.col("own") == F.greatest("own", "other")).alias("right"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.trunc("date", "year").alias("period"))
    sums = dealt.groupBy("a", "b", "period").applyInPandas(_gram, ", ".join(["symbol_a string", "symbol_b string", "n long", *[f"{c} double" for c in _SUMS]]))
    total = sums.groupBy("symbol_a", "symbol_b").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _SUMS])
    spread = lambda s, ss: F.col("n") * F.col(ss) - F.col(s) * F.col(s)
    varies = (spread("sa", "saa") > 1e-13 * F.col("n") * F.col("saa")) & (spread("sb", "sbb") > 1e-13 * F.col("n") * F.col("sbb"))
    corr = (F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(spread("sa", "saa") * spread("sb", "sbb"))
    half = total.select("symbol_a", "symbol_b", F.when(varies, corr).alias("corr"))
    both = F.array(F.struct("symbol_a", "symbol_b"), F.struct(F.col("symbol_b").alias("symbol_a"), F.col("symbol_a").alias("symbol_b")))
    return half.select(F.explode(F.array_distinct(both)).alias("x"), "corr").select("x.*", "corr")


def target_correlation(df: DataFrame, target: str = "target_return_1d") -> DataFrame:
    """(feature, corr) of each numeric column with the target, highest first; one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    sums = df.agg(*[correlation(F.col(c), F.col(target)).alias(c) for c in names])
    return sums.unpivot([], names, "feature", "corr").orderBy(F.desc_nulls_last("corr"), "feature")


def quantile_means(df: DataFrame, by: str, value: str, parts: int = 10, digits: int = 10) -> DataFrame:
    """(part, low, high, n, mean_value): ``by`` cut at exact quantiles, right-closed,
    the first part closed on both sides. Equal edges raise. Values and edges are
    rounded alike, so that the last bit of an edge decides nothing."""
    x = workspace.stored(df.select(F.round(by, digits).alias("x"), F.col(value).alias("y")).where("x IS NOT NULL"))
    cuts = percentiles(x, "x", [k / parts for k in range(parts + 1)])
    edges = cuts.select(F.transform("q", lambda e: F.round(e, digits)).alias("edges"))
    edges = edges.select(F.when(F.size(F.array_distinct("edges")) == parts + 1, F.col("edges")).otherwise(F.raise_error(F.lit("bin edges must be unique"))).alias("edges"))
    at = F.size(F.filter(F.slice("edges", 2, parts - 1), lambda e: F.col("x") > e))
    cut = x.crossJoin(F.broadcast(edges)).withColumn("part", at)  # one row of edges
    return cut.groupBy("part").agg(F.first(F.get("edges", F.col("part"))).alias("low"), F.first(F.get("edges", F.col("part") + 1)).alias("high"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_value"))


#: Width of a cell in bandwidths, moments kept of it, and bandwidths beyond which a kernel is 0.
CELL, MOMENTS, REACH = 0.5, 16, 8.5


def density(df: DataFrame, value: str = "return_1d", points: int = 200, beyond: float = 3.0) -> DataFrame:
    """(symbol, point, x, density): Gaussian kernel density on an even grid that
    reaches ``beyond`` bandwidths past the values; bandwidth = sd * n^(-1/5).

    A fast Gauss sum: values of a cell of half a bandwidth are summed as 16 moments
    about its middle, and the grid points within 8.5 bandwidths add up the cells'
    expansions. For an offset s from the middle and a distance t to it, both in
    sqrt(2) bandwidths, exp(-(t - s)^2) is exp(-t^2) times the sum over k of (2t)^k / k! times
    s^k exp(-s^2). With s at most 0.18 the rest after 16 terms is below 1e-15, and a kernel
    left out below 3e-16. Rows after the first sums are cells, whose number grows with n^(1/5)."""
    values = workspace.stored(df.select("symbol", F.col(value).alias("v")).where("v IS NOT NULL"))
    facts = values.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("sd > 0")
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    facts = facts.withColumn("bw", bw).withColumns({"from": F.col("lo") - beyond * F.col("bw"), "to": F.col("hi") + beyond * F.col("bw")})
    few = points * facts.limit(BROADCAST_ROWS // points + 1).count() <= BROADCAST_ROWS
    own = F.broadcast if few else lambda x: x
    width, step = CELL * F.col("bw"), (F.col("to") - F.col("from")) / (points - 1)
    celled = values.join(own(facts), "symbol").withColumn("cell", F.floor((F.col("v") - F.col("lo")) / width))
    celled = celled.withColumn("middle", F.col("lo") + (F.col("cell") + 0.5) * width).withColumn("s", (F.col("v") - F.col("middle")) / (F.col("bw") * math.sqrt(2)))
    power, sums = F.exp(-F.col("s") * F.col("s")), []
    for k in range(MOMENTS):
        sums.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("s")
    cells = celled.groupBy("symbol", "middle", "bw", "from", "to").agg(*sums)
    first = F.greatest(F.lit(0), F.ceil((F.col("middle") - REACH * F.col("bw") - F.col("from")) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("middle") + REACH * F.col("bw") - F.col("from")) / step)).cast("int")
    near = cells.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    t = (F.col("from") + F.col("point") * step - F.col("middle")) / (F.col("bw") * math.sqrt(2))
    series = F.col(f"m{MOMENTS - 1}")
    for k in range(MOMENTS - 1, 0, -1):
        series = F.col(f"m{k - 1}") + 2 * F.col("t") / k * series
    kernels = near.withColumn("t", t).groupBy("symbol", "point").agg(F.sum(F.exp(-F.col("t") * F.col("t")) * series).alias("k"))
    grid = facts.select("symbol", "n", "bw", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), (F.col("from") + F.col("point") * step).alias("x"))
    both = grid.join(own(kernels), ["symbol", "point"], "left")
    return both.select("symbol", "point", "x", (F.coalesce("k", F.lit(0.0)) / F.col("n") / (F.col("bw") * F.sqrt(2 * F.pi()))).alias("density"))


def balanced(df: DataFrame, by: str = "symbol") -> DataFrame:
    out = rows_per(df, by).agg(F.count(F.lit(1)).alias("n_symbols"), F.min("n_rows").alias("min_rows"), F.max("n_rows").alias("max_rows"))
    return out.withColumn("balanced", F.col("min_rows") == F.col("max_rows"))


#: Rows at the start or end of a series that have no value.
BLANK_ROWS = {"return_1d": 1, "log_return_1d": 1, "return_5d": 5, "return_21d": 21, "return_63d": 63, "momentum_21d": 21, "momentum_63d": 63, "volatility_21d": 5, "volatility_63d": 10, "target_return_1d": 1, "target_return_5d": 5}


def null_reconciliation(df: DataFrame) -> DataFrame:
    """(feature, nulls, expected, matches): expected are each symbol's blank rows, or all its rows if it has fewer."""
    own = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in BLANK_ROWS])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("nulls"), F.least(F.col("_rows"), F.lit(k)).alias("expected")) for c, k in BLANK_ROWS.items()])
    each = own.select(F.explode(entries).alias("x")).select("x.*")
    return each.groupBy("feature").agg(F.sum("nulls").alias("nulls"), F.sum("expected").alias("expected")).withColumn("matches", F.col("nulls") == F.col("expected"))


def extreme_moves(df: DataFrame, limit: float = 0.1, value: str = "return_1d") -> DataFrame:
    return df.where(F.abs(value) > limit).select("symbol", "date", value)


def top_moves(df: DataFrame, n: int = 20, value: str = "return_1d") -> DataFrame:
    size = F.abs(value).alias("move")
    return df.where(F.col(value).isNotNull()).select("symbol", "date", size).orderBy(F.desc("move"), "symbol", "date").limit(n)


def pivoted(df: DataFrame, symbols: list[str], value: str = "return_1d") -> DataFrame:
    """One row for a date, one column for each of ``symbols``; a cell with two values raises."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("index contains duplicate entries"))).otherwise(F.first(value))
    return df.groupBy("date").pivot("symbol", symbols).agg(one)


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """``df`` with its doubles rounded, for comparison."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])

