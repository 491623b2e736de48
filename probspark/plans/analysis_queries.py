"""Queries of evidence updates, situation reports, momentum, signals and strategy summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions import expr as X
from probspark.operators import analysis as N
from probspark.operators import windows as W
from probspark.plans.fusion_queries import _ANOMALIES, _LOGIT, _WEIGHTED, AS_OF
from probspark.plans.registry import query


@query("w16_snapshot_momentum", "shares", keep="subject outcome flows", doubles="momentum last_flow acceleration", sql="""
    SELECT subject, outcome, count(*) AS flows, sum(flow / i) / sum(1.0e0 / i) AS momentum, max(CASE WHEN back = 1 THEN flow END) AS last_flow,
        max(CASE WHEN back = 1 THEN flow END) - max(CASE WHEN back = 2 THEN flow END) AS acceleration FROM (
        SELECT *, row_number() OVER (PARTITION BY subject, outcome ORDER BY ts) AS i, row_number() OVER (PARTITION BY subject, outcome ORDER BY ts DESC) AS back FROM (
            SELECT *, (p - lag(p) OVER (PARTITION BY subject, outcome ORDER BY ts)) * 100 / (date_diff('day', lag(ts) OVER (PARTITION BY subject, outcome ORDER BY ts), ts) * 24.0e0) AS flow FROM shares) f
        WHERE flow IS NOT NULL) q GROUP BY subject, outcome HAVING count(*) >= 2""", digits=9)
def w16(shares):
    return N.snapshot_momentum(shares, ["subject", "outcome"], "ts")


@query("a21_long_term_performance", "shares", keep="subject forecasts", doubles="accuracy mean_brier mean_log mean_p", sql="""
    SELECT subject, count(*) AS forecasts, avg(CAST(top = actual AS INT)) AS accuracy, avg(brier) AS mean_brier, avg(-ln(p_actual)) AS mean_log, avg(p_actual) AS mean_p FROM (
        SELECT subject, ts, first(outcome ORDER BY p DESC, outcome) AS top, max(CASE WHEN hit THEN outcome END) AS actual, avg((p - CAST(hit AS INT)) * (p - CAST(hit AS INT))) AS brier, max(CASE WHEN hit THEN p END) AS p_actual FROM (
            SELECT *, row_number() OVER (PARTITION BY subject, ts ORDER BY p DESC, outcome) = 2 AS hit FROM shares) h GROUP BY subject, ts) q GROUP BY subject""")
def a21(shares):
    from probspark.operators.scoring import outcome_scores

    hit = F.row_number().over(Window.partitionBy("subject", "ts").orderBy(F.desc("p"), "outcome")) == 2
    df = shares.withColumn("hit", hit)
    actual = df.filter("hit").select("subject", "ts", F.col("outcome").alias("actual"))
    scores = outcome_scores(df, ["subject", "ts"]).join(actual, ["subject", "ts"])
    right = (F.col("top") == F.col("actual")).cast("int")
    return scores.groupBy("subject").agg(F.count(F.lit(1)).alias("forecasts"), F.avg(right).alias("accuracy"), F.avg("brier").alias("mean_brier"), F.avg("log_score").alias("mean_log"), F.avg("p_actual").alias("mean_p"))


@query("f12_expected_scores", "supplier", keep="home away", doubles="home_win draw away_win", sql="""
    SELECT home, away, e * (1 - d) AS home_win, d AS draw, (1 - e) * (1 - d) AS away_win FROM (
        SELECT a.s_suppkey AS home, b.s_suppkey AS away, greatest(0.15e0, 0.3e0 * exp(-abs(a.r + 100 - b.r) / 500)) AS d,
            1 / (1 + exp(-(1 / sqrt(1 + 3 * pow(b.rd / 173.7178e0, 2) / (pi() * pi()))) * ((a.r - b.r) / 173.7178e0))) AS e
        FROM (SELECT s_suppkey, 1500 + s_acctbal / 20 AS r, 50 + s_suppkey % 100 AS rd FROM supplier) a JOIN (SELECT s_suppkey, 1500 + s_acctbal / 20 AS r, 50 + s_suppkey % 100 AS rd FROM supplier) b ON b.s_suppkey = a.s_suppkey + 1) q""")
def f12(supplier):
    rated = supplier.select("s_suppkey", (1500 + F.col("s_acctbal") / 20).alias("rating"), (50 + F.col("s_suppkey") % 100).alias("rd"))
    away = rated.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("away"), F.col("rating").alias("away_rating"), F.col("rd").alias("away_rd"))
    return N.match_forecast(rated.join(away, "s_suppkey").withColumnRenamed("s_suppkey", "home"))
