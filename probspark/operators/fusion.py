"""Probabilities from quotes, evidence and several sources: one row per subject, outcome or source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions.expr import clip, ladder, logit, sigmoid

#: Weights of source grades; fixed values.
GRADE_WEIGHTS = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.4, "E": 0.2, "F": 0.5}


def true_probabilities(quotes: DataFrame, key: list[str]) -> DataFrame:
    """Decimal odds (above 1) without the margin: implied share of each outcome, the margin and its share."""
    w = Window.partitionBy(*key)
    df = quotes.filter("value > 1").withColumn("implied", 1 / F.col("value")).withColumn("total", F.sum("implied").over(w))
    return df.withColumns({"margin": F.col("total") - 1, "margin_share": (F.col("total") - 1) / F.col("total"), "probability": F.col("implied") / F.col("total")})


def wilson_interval(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds with ``n`` trials; callers that have outcomes only pass their number."""
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def conditional_probabilities(df: DataFrame, key: list[str], condition: Column) -> DataFrame:
    """Share of each outcome that meets the condition among those that do; 0 where they have no probability."""
    df = df.filter(condition).withColumn("total", F.sum("p").over(Window.partitionBy(*key)))
    return df.withColumn("conditional", F.when(F.col("total") == 0, 0.0).otherwise(F.col("p") / F.col("total")))


def beta_update(alpha: Column, beta: Column, successes: Column, trials: Column) -> dict[str, Column]:
    """Posterior parameters and moments; bounds at 1.96 deviations, within 0 and 1."""
    a, b = alpha + successes, beta + trials - successes
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return {"alpha": a, "beta": b, "mean": mean, "sd": sd, "low": clip(mean - 1.96 * sd, 0.0, 1.0), "high": clip(mean + 1.96 * sd, 0.0, 1.0)}


def source_weights(evidence: DataFrame, as_of: str | Column, half_life_hours: float = 24.0) -> DataFrame:
    """Reliability times confidence, halved with every half-life of age; shares of their subject's sum (equal where it is 0)."""
    grade = F.coalesce(*(F.when(F.col("grade") == g, w) for g, w in GRADE_WEIGHTS.items()))
    age = F.greatest(F.datediff(F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of, F.col("ts")) * 24.0, F.lit(0.0))
    w = Window.partitionBy("subject")  # one row per source
    df = evidence.withColumn("raw", grade * F.col("confidence") * F.pow(F.lit(2.0), -age / half_life_hours))
    total = F.sum("raw").over(w)
    return df.withColumn("weight", F.when(total <= 0, 1.0 / F.count(F.lit(1)).over(w)).otherwise(F.col("raw") / total))


def pools(weighted: DataFrame, prior: float = 0.5) -> DataFrame:
    """Linear, log-odds, Bayesian and hybrid pools of each subject's sources, and how much they agree."""
    start = logit(F.lit(prior))
    spread = weighted.withColumn("mean", F.sum(F.col("weight") * F.col("p")).over(Window.partitionBy("subject")))
    df = spread.groupBy("subject").agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum(F.col("weight") * F.col("p")).alias("linear"),
        sigmoid(F.sum(F.col("weight") * logit(F.col("p")))).alias("log_odds"),
        sigmoid(start + F.sum(F.col("weight") * (logit(F.col("p")) - start))).alias("bayesian"),
        F.sqrt(F.sum(F.col("weight") * (F.col("p") - F.col("mean")) ** 2)).alias("deviation"),
    )
    consensus = 1 - F.least(F.col("deviation") / 0.5, F.lit(1.0))
    return df.withColumn("hybrid", (F.col("linear") + F.col("log_odds") + F.col("bayesian")) / 3).withColumn("consensus", consensus)


def anomalies(weighted: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Sources further than ``threshold`` weighted deviations from their subject's mean, where it has three or more."""
    w = Window.partitionBy("subject")
    df = weighted.withColumn("mean", F.sum(F.col("weight") * F.col("p")).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    df = df.withColumn("deviation", F.sqrt(F.sum(F.col("weight") * (F.col("p") - F.col("mean")) ** 2).over(w)))
    return df.withColumn("distance", F.abs(F.col("p") - F.col("mean")) / F.col("deviation")).filter((F.col("n") >= 3) & (F.col("deviation") >= 1e-6) & (F.col("distance") > threshold))


def stability(consensus: Column, anomalies_: Column, momentum: Column, low: float = 0.3, high: float = 0.7) -> Column:
    return (
        F.when(anomalies_ > 0, "anomalous").when(consensus >= high, "stable").when(consensus <= low, "unstable")
        .when(F.abs(momentum) > 2, "emerging").otherwise("ambiguous")
    )


def amplification_level(score: Column) -> Column:
    return ladder(F.abs(score), [(1, "none"), (3, "low"), (6, "medium"), (10, "high"), (15, "very_high")], "exceptional")


def source_diversity(evidence: DataFrame) -> DataFrame:
    """Mean absolute difference over the pairs of a subject's sources, without making pairs.

    In order of value the i-th of n values is subtracted n-i times and added i-1 times.
    """
    w = Window.partitionBy("subject")
    i, n = F.row_number().over(w.orderBy("p", "source")), F.count(F.lit(1)).over(w)
    df = evidence.withColumn("n", n).withColumn("part", F.col("p") * (2 * i - n - 1))
    df = df.groupBy("subject").agg(F.first("n").alias("n"), F.sum("part").alias("total")).filter("n > 1")
    df = df.withColumn("mean_difference", F.col("total") / (F.col("n") * (F.col("n") - 1) / 2))
    df = df.withColumn("diversity", F.least(F.col("mean_difference") / 0.5, F.lit(1.0)))
    return df.withColumn("effective", 1 + (F.col("n") - 1) * F.col("diversity"))


#: Lower bounds of the grades of a numeric reliability, and reliabilities of source types; fixed values.
GRADE_BOUNDS = [(0.9, "A"), (0.7, "B"), (0.5, "C"), (0.3, "D")]
RELIABILITY = {"market": 0.95, "model": 0.70, "expert": 0.60, "nlp": 0.50, "sensor": 0.80, "llm": 0.55, "api": 0.75}


def reliability_grade(weight: Column) -> Column:
    out = F.when(weight >= GRADE_BOUNDS[0][0], GRADE_BOUNDS[0][1])
    for bound, grade in GRADE_BOUNDS[1:]:
        out = out.when(weight >= bound, grade)
    return out.otherwise("E")
