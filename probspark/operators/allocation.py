"""Shares of a budget for the outcomes of a subject, by the fraction that the expected gain allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions.expr import kelly

#: Part of the optimal fraction that each risk tier uses; fixed values.
TIERS = {"conservative": 0.10, "balanced": 0.25, "aggressive": 0.50, "extreme": 1.00}


def allocate(legs: DataFrame, key: list[str], budget: float, most: int = 10, tier: str = "balanced", cap: float = 0.2) -> DataFrame:
    """The ``most`` legs of each subject with the largest expected value (``outcome, p, multiplier, confidence``).

    Legs with a ``direction`` of downward are left out.

    Fractions above 1 in sum are scaled to 1, each is held to ``cap``, and if they are still above 1 they are scaled again.
    """
    value, optimal = kelly(F.col("p"), F.col("multiplier"))
    df = legs.withColumns({"value": value, "optimal": optimal}).filter((F.col("value") > 0) & (F.col("p") >= 0.05) & (F.col("multiplier") >= 1.1))
    if "direction" in legs.columns:
        df = df.filter(F.coalesce(F.col("direction") != "downward", F.lit(True)))
    w = Window.partitionBy(*key)
    df = df.withColumn("place", F.row_number().over(w.orderBy(F.desc("value"), "outcome"))).filter(F.col("place") <= most)
    df = df.withColumn("raw", F.col("optimal") * TIERS[tier] * F.col("confidence"))
    df = df.withColumn("held", F.least(F.col("raw") / F.greatest(F.sum("raw").over(w), F.lit(1.0)), F.lit(cap)))
    df = df.withColumn("fraction", F.col("held") / F.greatest(F.sum("held").over(w), F.lit(1.0)))
    risk = F.least(F.col("optimal") * (1 - F.col("p")) + (1 - F.col("confidence")) * 0.5, F.lit(1.0))
    return df.withColumns({"amount": F.col("fraction") * budget, "expected": F.col("value") * F.col("fraction") * budget, "risk": risk})


def rebalance(df: DataFrame, key: list[str], target: float) -> DataFrame:
    """Where a subject is less diverse than ``target``, half of what is above an equal share goes to those below it."""
    w = Window.partitionBy(*key)
    n, diversity = F.count(F.lit(1)).over(w), 1 - F.sum(F.col("fraction") ** 2).over(w)
    df = df.withColumns({"n": n, "diversity": diversity, "equal": 1 / n})
    over, under = F.greatest(F.col("fraction") - F.col("equal"), F.lit(0.0)), F.greatest(F.col("equal") - F.col("fraction"), F.lit(0.0))
    df = df.withColumns({"over": over, "under": under})
    moved, room = F.sum("over").over(w) / 2, F.sum("under").over(w)
    df = df.withColumn("shifted", F.col("fraction") - F.col("over") / 2 + F.coalesce(F.try_divide(moved * F.col("under"), room), F.lit(0.0)))
    skip = (F.col("diversity") >= target) | (F.col("n") <= 1)
    return df.withColumn("rebalanced", F.when(skip, F.col("fraction")).otherwise(F.col("shifted") / F.sum("shifted").over(w)))


def eligibility(p: Column, multiplier: Column, direction: Column) -> Column:
    """Why a leg is left out, or eligible."""
    return (
        F.when(direction == "downward", "falling").when(kelly(p, multiplier)[0] <= 0, "no expected gain")
        .when(p < 0.05, "improbable").when(multiplier < 1.1, "low multiplier").otherwise("eligible")
    )


def concentration(allocated: DataFrame, key: list[str], budget: float, cap: float = 0.2) -> DataFrame:
    """Per subject its diversification, largest share, allocated and free amount, expected total and whether all keep the cap."""
    return allocated.groupBy(*key).agg(
        (1 - F.sum(F.col("fraction") ** 2)).alias("diversification"), F.max("fraction").alias("largest"), F.sum("amount").alias("allocated"),
        (budget - F.sum("amount")).alias("free"), F.sum("expected").alias("expected_total"), F.bool_and(F.col("fraction") <= cap).alias("within_limit"),
    )
