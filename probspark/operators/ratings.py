"""Ratings of teams by periods: every period is one join with the opponents' ratings before it and one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probspark.sources.stored import fresh_path, stored

#: Scale of the ratings, first rating, deviation and volatility, and the largest change before volatility jumps; fixed values.
SCALE, RATING, DEVIATION, VOLATILITY, TAU = 173.7178, 1500.0, 350.0, 0.06, 1.0


def new_ratings(teams: DataFrame) -> DataFrame:
    """``team, rating, rd, volatility, games`` of teams that haven't played."""
    return teams.select("team").distinct().select("team", F.lit(RATING).alias("rating"), F.lit(DEVIATION).alias("rd"), F.lit(VOLATILITY).alias("volatility"), F.lit(0).cast("long").alias("games"))


def rate_period(ratings: DataFrame, results: DataFrame) -> DataFrame:
    """Ratings after one period's results (``team, opponent, score`` with 1, 0.5 or 0; both sides have a row); others stay."""
    opponents = ratings.select(F.col("team").alias("opponent"), ((F.col("rating") - RATING) / SCALE).alias("mu_o"), (F.col("rd") / SCALE).alias("phi_o"))
    own = ratings.select("team", ((F.col("rating") - RATING) / SCALE).alias("mu"))
    g = 1 / F.sqrt(1 + 3 * F.col("phi_o") * F.col("phi_o") / math.pi**2)
    met = results.select("team", "opponent", "score").join(opponents, "opponent").join(own, "team").withColumn("g", g)
    met = met.withColumn("e", 1 / (1 + F.exp(-F.col("g") * (F.col("mu") - F.col("mu_o")))))
    sums = met.groupBy("team").agg(F.sum(F.col("g") * F.col("g") * F.col("e") * (1 - F.col("e"))).alias("v_sum"), F.sum(F.col("g") * (F.col("score") - F.col("e"))).alias("d_sum"), F.count(F.lit(1)).alias("n"))
    df = ratings.join(sums, "team", "left")
    v = F.when(F.col("v_sum") > 0, 1 / F.col("v_sum")).otherwise(1.0)
    df = df.withColumns({"v": v, "mu": (F.col("rating") - RATING) / SCALE, "phi": F.col("rd") / SCALE})
    df = df.withColumn("sigma", F.when(F.abs(F.col("v") * F.col("d_sum")) > TAU, TAU).otherwise(F.col("volatility")))
    df = df.withColumn("phi_n", 1 / F.sqrt(1 / (F.col("phi") * F.col("phi") + F.col("sigma") * F.col("sigma")) + 1 / F.col("v")))
    played = F.col("n").isNotNull()
    return df.select(
        "team",
        F.when(played, RATING + SCALE * (F.col("mu") + F.col("phi_n") * F.col("phi_n") * F.col("d_sum"))).otherwise(F.col("rating")).alias("rating"),
        F.when(played, SCALE * F.col("phi_n")).otherwise(F.col("rd")).alias("rd"),
        F.when(played, F.col("sigma")).otherwise(F.col("volatility")).alias("volatility"),
        (F.col("games") + F.coalesce("n", F.lit(0))).alias("games"),
    )


def by_period(results: DataFrame) -> DataFrame:
    """``results`` stored with a folder for each period."""
    path = fresh_path(results.sparkSession, "results")
    results.write.partitionBy("period").parquet(path)
    return results.sparkSession.read.schema(results.schema).parquet(path)


def period_ratings(results: DataFrame, teams: DataFrame) -> DataFrame:
    """``period, team, rating, rd, volatility, games`` after each period of ``results`` (``period`` and the columns of one period).

    Periods follow each other; teams are rated side by side.  Each period's table is stored, so a lost executor repeats one.
    The results are stored by period, so that a period reads its own and doesn't work all of them out again.
    """
    results = by_period(results.select("period", "team", "opponent", "score"))
    periods = [r[0] for r in results.select("period").distinct().orderBy("period").collect()]  # a calendar
    now, out = new_ratings(teams), None
    for p in periods:
        now = stored(rate_period(now, results.filter(F.col("period") == p)), "ratings")
        rows = now.select(F.lit(p).alias("period"), *now.columns)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else now.select(F.lit(None).alias("period"), *now.columns).limit(0)
