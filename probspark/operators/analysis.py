"""Evidence updates, situation reports, momentum of snapshots, bundle rules and rebalanced strategies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions.expr import clip, logit
from probspark.operators.fusion import GRADE_WEIGHTS, anomalies, pools, source_weights, stability
from probspark.operators.windows import first_rank


def snapshot_momentum(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """Hourly changes of ``p`` in percentage points, weighted 1, 1/2, 1/3, ... from the oldest; the last one and its change.

    Two changes are needed at least.
    """
    w = Window.partitionBy(*key).orderBy(ts)
    hours = F.datediff(F.col(ts), F.lag(ts).over(w)) * 24.0
    df = df.withColumn("flow", (F.col("p") - F.lag("p").over(w)) * 100 / hours).filter("flow is not null")
    df = df.withColumns({"i": F.row_number().over(w), "before": F.lag("flow").over(w)})
    out = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("flows"),
        (F.sum(F.col("flow") / F.col("i")) / F.sum(1 / F.col("i"))).alias("momentum"),
        F.max_by("flow", ts).alias("last_flow"),
        F.max_by(F.col("flow") - F.col("before"), F.col(ts)).alias("acceleration"),
    )
    return out.filter("flows >= 2")


def evidence_update(prior: DataFrame, evidence: DataFrame) -> DataFrame:
    """``subject, outcome, posterior``: prior log-odds shifted by each piece of evidence, then a softmax.

    Evidence for an outcome shifts that one by its weight; other evidence shifts all, each by its share of the prior.
    All shifts start from the prior, so they are one sum.
    """
    total = F.sum("p").over(Window.partitionBy("subject"))
    prior = prior.select("subject", "outcome", F.col("p").alias("p0"), (F.col("p") / total).alias("share"))
    said = evidence.select("subject", F.col("outcome").alias("target"), "weight", "p")
    part = F.when(F.col("target").isNull(), F.col("share")).when(F.col("target") == F.col("outcome"), 1.0).otherwise(0.0)
    shift = F.sum(part * F.col("weight") * (logit(F.col("p")) - logit(F.col("p0"))))
    moved = prior.join(said, "subject", "left").groupBy("subject", "outcome", "p0").agg(F.coalesce(shift, F.lit(0.0)).alias("shift"))
    moved = moved.withColumn("odds", F.exp(logit(F.col("p0")) + F.col("shift")))
    return moved.select("subject", "outcome", (F.col("odds") / F.sum("odds").over(Window.partitionBy("subject"))).alias("posterior"))


def ingest_signals(df: DataFrame, key: list[str]) -> DataFrame:
    """``posterior`` of every outcome: ``prior`` overlaid with market odds, then with direct values, and normalised.

    Outcomes that only have a direct value complete a subject's ``odds`` by 1 / max(direct, 0.01), and two or more are
    normalised together; where such a completion is no odds (a direct value of 1), all odds count as direct values.
    ``direct`` values above 1.05 in sum are rescaled; they win over odds.
    """
    w = Window.partitionBy(*key)
    odds, direct = F.when(F.col("odds") > 1, F.col("odds")), F.col("direct")
    has = F.count(odds).over(w) > 0
    filled = F.when(has & odds.isNull() & direct.isNotNull() & F.col("prior").isNotNull(), 1 / F.greatest(direct, F.lit(0.01)))
    df = df.withColumn("__odds", F.coalesce(odds, filled))
    market = F.count("__odds").over(w) >= 2
    broken = market & (F.min("__odds").over(w) <= 1)
    implied = 1 / F.col("__odds")
    from_odds = F.when(market & ~broken, implied / F.sum(implied).over(w))
    fallback = F.when(F.col("__odds") > 1, implied).when(F.col("__odds").isNotNull(), 0.5)
    df = df.withColumn("__direct", F.when(broken, F.coalesce(fallback, direct)).otherwise(direct)).withColumn("__from", from_odds)
    total = F.sum("__direct").over(w)
    merged = F.coalesce(F.col("__direct") / F.when(total > 1.05, total).otherwise(1.0), F.col("__from"), F.col("prior"))
    df = df.withColumn("merged", merged).drop("__odds", "__direct", "__from")
    return df.withColumn("posterior", F.try_divide(F.col("merged"), F.sum("merged").over(w)))


def assess(evidence: DataFrame, as_of, subjects: DataFrame | None = None, prior: float = 0.5, method: str = "hybrid", half_life_hours: float = 24.0) -> DataFrame:
    """Per subject the pooled probability, agreement, odd sources, momentum against the prior, stability and confidence.

    ``method`` is linear, log_odds, bayesian or hybrid.  A subject of ``subjects`` without sources has the prior, no
    consensus and no confidence.
    """
    weighted = source_weights(evidence, as_of, half_life_hours)
    grade = F.coalesce(*(F.when(F.col("grade") == g, w) for g, w in GRADE_WEIGHTS.items()))
    facts = weighted.groupBy("subject").agg(F.avg("raw").alias("effective"), F.avg(grade).alias("reliability"))
    odd = anomalies(weighted).groupBy("subject").agg(F.count(F.lit(1)).alias("odd"))
    df = pools(weighted, prior).join(facts, "subject").join(odd, "subject", "left").withColumn("anomalous", F.coalesce("odd", F.lit(0)))
    one = F.lit(1.0)
    confidence = 0.35 * F.col("consensus") + 0.25 * F.least(F.col("sources") / 5, one) + 0.2 * F.least("effective", one) + 0.2 * F.col("reliability") - 0.05 * F.col("anomalous")
    df = df.withColumns({"aggregate": clip(F.col(method), 0.0, 1.0), "confidence": clip(confidence, 0.0, 1.0)})
    if subjects is not None:
        df = subjects.select("subject").distinct().join(df, "subject", "left")
        empty = {"aggregate": prior, "consensus": 0.0, "confidence": 0.0, "sources": 0, "anomalous": 0}
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in empty.items()})
    momentum = (F.col("aggregate") - prior) * 100
    state = F.when(F.col("sources") == 0, "ambiguous").otherwise(stability(F.col("consensus"), F.col("anomalous"), momentum))
    return df.withColumns({"momentum": momentum, "stability": state, "agreed": F.col("consensus") > 0.7})


def cross_validate(evidence: DataFrame, group: Column, as_of, prior: float = 0.5, half_life_hours: float = 24.0) -> DataFrame:
    """Per subject how two groups of its sources (``group`` true and false) agree, and a confidence from agreement, consensus and number.

    One assessment serves both groups and all sources together; a subject that lacks a group agrees not at all.
    """
    side = F.explode(F.array(F.lit("all"), F.when(group, "a").otherwise("b")))
    rows = evidence.withColumn("__side", side).withColumn("subject", F.struct("subject", F.col("__side").alias("side")))
    out = assess(rows, as_of, None, prior, "hybrid", half_life_hours).select("subject.subject", "subject.side", "aggregate", "consensus", "sources")
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    df = out.groupBy("subject").agg(of("a", "aggregate").alias("p_a"), of("b", "aggregate").alias("p_b"), of("all", "aggregate").alias("combined"), of("all", "consensus").alias("consensus"), of("all", "sources").alias("sources"))
    both = F.col("p_a").isNotNull() & F.col("p_b").isNotNull()
    df = df.withColumn("delta", F.when(both, F.abs(F.col("p_a") - F.col("p_b"))).otherwise(0.0))
    df = df.withColumn("agreement", F.when(both, F.greatest(F.lit(0.0), 1 - 2 * F.col("delta"))).otherwise(0.0))
    meta = F.col("agreement") * 0.5 + F.col("consensus") * 0.3 + F.least(F.col("sources") / 8, F.lit(1.0)) * 0.2
    return df.withColumn("meta_confidence", F.when(both, meta).otherwise(0.0))


def check_bundles(legs: DataFrame, key: str, deep_markets: list[str], least_odds: float = 3.0, most_legs: int = 8, most_deep: int = 4, most_multiplier: int = 99, least_stake: float = 2.0) -> DataFrame:
    """Per bundle its legs (``odds, match, market, flow``), combined odds, risk tier and the rules that it breaks.

    ``multiplier`` and ``stake`` are the bundle's.  A bundle with a leg of ``deep_markets`` may have fewer legs.
    """
    df = legs.groupBy(key).agg(
        F.count(F.lit(1)).alias("legs"), F.product("odds").alias("odds"), F.count_distinct("match", "market").alias("places"), F.min("flow").alias("weakest"),
        F.bool_or(F.col("market").isin(deep_markets)).alias("deep"), F.max("multiplier").alias("multiplier"), F.max("stake").alias("stake"),
    )
    broken = {
        "flow": F.col("weakest") <= 0, "odds": F.col("odds") < least_odds, "same_match": F.col("places") < F.col("legs"),
        "depth": F.col("legs") > F.when(F.col("deep"), most_deep).otherwise(most_legs), "multiplier": F.col("multiplier") > most_multiplier, "stake": F.col("stake") < least_stake,
    }
    return df.withColumns({"risk": risk_level(F.col("odds")), "errors": F.concat_ws(",", *(F.when(c, n) for n, c in broken.items()))})


def risk_level(odds: Column) -> Column:
    return F.when(odds < 5, "conservative").when(odds < 20, "balanced").when(odds < 100, "aggressive").otherwise("extreme")


def generate_bundles(amplified: DataFrame, key: list[str], budget: float, most: int = 10, odds: float = 3.0, stake: float = 10.0) -> DataFrame:
    """One single-leg bundle for each of the ``most`` best scores of a subject that have a level and enough confidence.

    Valid bundles only; ``allocated`` and ``free`` are the subject's stakes and what is left of the budget.
    """
    chosen = first_rank(amplified.filter((F.col("level") != "none") & (F.col("confidence") >= 0.5)), key, "score", ["outcome"], "place").filter(F.col("place") <= most)
    valid = chosen.withColumns({"odds": F.lit(odds), "stake": F.lit(stake), "risk": risk_level(F.lit(odds))}).filter((F.col("odds") >= 3) & (F.col("stake") >= 2))
    total = F.sum("stake").over(Window.partitionBy(*key))
    return valid.withColumn("allocated", total).withColumn("free", budget - F.col("allocated"))


def match_forecast(df: DataFrame, advantage: float = 100.0) -> DataFrame:
    """Shares of home win, draw and away win from ``rating``, ``away_rating`` and ``away_rd``."""
    scale = 173.7178  # of ratings to the logistic scale; a fixed value
    g = 1 / F.sqrt(1 + 3 * F.pow(F.col("away_rd") / scale, F.lit(2.0)) / math.pi**2)
    expected = 1 / (1 + F.exp(-g * (F.col("rating") - F.col("away_rating")) / scale))
    draw = F.greatest(F.lit(0.15), 0.30 * F.exp(-F.abs(F.col("rating") + advantage - F.col("away_rating")) / 500))
    return df.withColumns({"draw": draw, "home_win": expected * (1 - draw), "away_win": (1 - expected) * (1 - draw)})
