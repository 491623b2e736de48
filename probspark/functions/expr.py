"""Scalar column functions: probabilities, clipped scores and threshold ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPSILON = 1e-6


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many digits, halves up: the same two operations in every engine."""
    return F.floor(x * 10.0**digits + 0.5) / F.lit(10.0**digits)


def logit(p: Column) -> Column:
    q = clip(p, EPSILON, 1 - EPSILON)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step with ``x`` below its bound."""
    out = F.when(x < steps[0][0], steps[0][1])
    for bound, name in steps[1:]:
        out = out.when(x < bound, name)
    return out.otherwise(otherwise)


def quote_probability(value: Column, signal_type: Column) -> Column:
    """Decimal odds by 1/v (0 unless v > 1), percentages by v/100, other types as they are; all within 0 and 1."""
    odds = F.when(value > 1, 1 / value).otherwise(0.0)
    return F.when(signal_type == "decimal_odds", odds).when(signal_type == "percentage", clip(value / 100, 0.0, 1.0)).otherwise(clip(value, 0.0, 1.0))


def evidence_probability(probability: Column, value: Column, direction: Column) -> Column:
    """The probability, else the value, else what the direction's word stands for, else one half."""
    word = F.lower(direction)
    named = F.when(word.isin("upward", "up", "positive"), 0.65).when(word.isin("downward", "down", "negative"), 0.35)
    return F.coalesce(clip(probability, 0.0, 1.0), clip(value, 0.0, 1.0), named, F.lit(0.5))


def flow_direction(flow: Column, low: float) -> Column:
    """stable below ``low`` (and for null), else upward or downward."""
    return F.when(F.coalesce(F.abs(flow) < low, F.lit(True)), "stable").when(flow > 0, "upward").otherwise("downward")


def flow_significance(flow: Column, low: float, high: float) -> Column:
    size = F.abs(flow)
    return F.when(F.coalesce(size < low, F.lit(True)), "low").when(size < high, "medium").otherwise("high")


def kelly(p: Column, multiplier: Column) -> tuple[Column, Column]:
    """(expected value, optimal fraction); no gain to win gives 0."""
    gain = multiplier - 1
    value = F.when(gain > 0, p * gain - (1 - p)).otherwise(0.0)
    return value, F.when(gain > 0, F.greatest(F.lit(0.0), (p * gain - (1 - p)) / gain)).otherwise(0.0)


def rank_pct(x: Column, partition: list[str]) -> Column:
    """Average rank of ties over the number of non-null values; null stays null.

    The first rank of the ties and the count up to their last one share a sort, and their mean is the average rank.
    """
    whole = Window.partitionBy(*partition)
    order = whole.orderBy(x.asc_nulls_first())
    present = F.count(x).over(whole)
    nulls = F.count(F.lit(1)).over(whole) - present
    return F.when(x.isNotNull(), (F.rank().over(order) - nulls + F.count(x).over(order)) / 2 / present)


def rolling(aggregate: Column, counted: Column, window: WindowSpec, least: int) -> Column:
    """The aggregate where the window has at least ``least`` non-null values."""
    return F.when(F.count(counted).over(window) >= least, aggregate.over(window))


def market_regime(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 0.62, "risk_on").when(score >= 0.45, "mixed").otherwise("risk_off")
