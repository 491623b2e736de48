"""Panel operators over ordered rows: returns, rolling statistics, ranks, labels and forward looks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions.expr import flow_direction, flow_significance, rolling
from probspark.operators.ranks import rank_percentiles


def by(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def pct_changes(df: DataFrame, key: list[str], order: str, value: str, steps: list[int]) -> DataFrame:
    """``ret_k``: change over the last k rows; null before there are k rows or where the earlier value is 0."""
    w = by(key, [order])
    return df.withColumns({f"ret_{k}": F.try_divide(F.col(value), F.lag(value, k).over(w)) - 1 for k in steps})


def rolling_stats(df: DataFrame, key: list[str], order: str, value: str, width: int) -> DataFrame:
    """Mean, sample deviation, largest, smallest and sum of the last ``width`` rows; null until there are as many."""
    w, x = by(key, [order]).rowsBetween(1 - width, 0), F.col(value)
    names = {"mean": F.avg(x), "std": F.stddev_samp(x), "max": F.max(x), "min": F.min(x), "sum": F.sum(x)}
    return df.withColumns({f"{value}_{n}_{width}": rolling(f, x, w, width) for n, f in names.items()})


def previous_extremes(df: DataFrame, key: list[str], order: str, width: int, least: int) -> DataFrame:
    """Highest high and lowest low of the ``width`` rows before this one, where ``least`` of them are there."""
    w = by(key, [order]).rowsBetween(-width, -1)
    return df.withColumns({f"recent_high_{width}": rolling(F.max("high"), F.col("high"), w, least), f"recent_low_{width}": rolling(F.min("low"), F.col("low"), w, least)})


def low_buy_features(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Moving averages, gaps to them, run-up over the seven rows before the last, and the bar's amplitude."""
    w = by(key, [order])
    close = F.col("close")
    means = {f"ma{n}": rolling(F.avg("close"), close, w.rowsBetween(1 - n, 0), n) for n in (5, 10, 20)}
    df = df.withColumns(means).withColumns({
        "prev_close": F.lag("close").over(w),
        "runup_8": F.lag("close", 1).over(w) / F.lag("close", 8).over(w) - 1,
        "amplitude": F.try_divide(F.col("high"), F.col("low")) - 1,
        "close_vs_open": F.try_divide(close, F.col("open")) - 1,
    })
    return df.withColumns({"close_to_ma10": close / F.col("ma10") - 1, "distance_to_ma5": close / F.col("ma5") - 1})


def forward_returns(df: DataFrame, key: list[str], order: str, value: str, steps: list[int]) -> DataFrame:
    w = by(key, [order])
    return df.withColumns({f"fwd_{h}": F.lead(value, h).over(w) / F.col(value) - 1 for h in steps})


def future_maximum(df: DataFrame, key: list[str], order: str, value: str, width: int) -> DataFrame:
    """Largest of the next ``width`` values; null on the last row."""
    return df.withColumn(f"future_max_{width}", F.max(value).over(by(key, [order]).rowsBetween(1, width)))


def cross_section_ranks(df: DataFrame, partition: list[str], columns: list[str]) -> DataFrame:
    """Average-rank percentiles in groups of any size: ranges of values are ranked, not whole groups."""
    return rank_percentiles(df, partition, {f"{c}_rank_pct": c for c in columns})


def first_rank(df: DataFrame, partition: list[str], value: str, tie: list[str], name: str = "rank") -> DataFrame:
    """1, 2, ... from the largest value down; ties by ``tie``; nulls come last."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(F.col(value).desc_nulls_last(), *tie)))


def difference(df: DataFrame, key: list[str], order: str, value: str, step: int) -> DataFrame:
    return df.withColumn(f"{value}_diff_{step}", F.col(value) - F.lag(value, step).over(by(key, [order])))


def probability_flow(df: DataFrame, key: list[str], order: str, value: str, low: float = 2.0, high: float = 5.0) -> DataFrame:
    """Change of a probability in percentage points, its means over 3 and 5 rows, direction and significance."""
    w = by(key, [order])
    df = df.withColumn("flow_pp", (F.col(value) - F.lag(value).over(w)) * 100)
    flow = F.col("flow_pp")
    return df.withColumns({
        "momentum_3": rolling(F.avg("flow_pp"), flow, w.rowsBetween(-2, 0), 3),
        "momentum_5": rolling(F.avg("flow_pp"), flow, w.rowsBetween(-4, 0), 5),
        "direction": flow_direction(flow, low),
        "significance": flow_significance(flow, low, high),
    })


def max_drawdown(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Per key the deepest fall of the compounded value from its running peak; null returns count as 0."""
    w = by(key, [order]).rowsBetween(Window.unboundedPreceding, 0)
    equity = df.withColumn("equity", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w))
    return equity.withColumn("peak", F.max("equity").over(w)).groupBy(*key).agg(F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"))


def price_grid(df: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    """Every date for every entity, with the last value known by then."""
    # both sides are distinct keys: one row per cell of the grid is the result itself
    grid = df.select(date).distinct().join(df.select(entity).distinct(), F.lit(True), "inner")
    filled = F.last(value, ignorenulls=True).over(by([entity], [date]).rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(df.select(entity, date, value), [entity, date], "left").select(entity, date, filled.alias(value))


def keep_last(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    latest = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", latest).filter("__n = 1").drop("__n")


def top_per(df: DataFrame, partition: list[str], value: str, tie: list[str], n: int) -> DataFrame:
    return first_rank(df, partition, value, tie).filter(F.col("rank") <= n)


def group_size(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumn("group_rows", F.count(F.lit(1)).over(Window.partitionBy(*key)))
