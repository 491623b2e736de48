"""Queries of the panel operators over monthly bars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions import expr as X
from probspark.operators import windows as W
from probspark.operators.ranks import first_ranks
from probspark.plans.registry import query
from probspark.sources.stored import stored

KEY = ["entity"]
_W = "(PARTITION BY entity ORDER BY dt)"


def _rank(column: str, by: str = "dt") -> str:
    """Average-rank percentile in SQL."""
    return f"""CASE WHEN {column} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {column} NULLS FIRST)
        - (count(*) OVER (PARTITION BY {by}) - count({column}) OVER (PARTITION BY {by}))
        + (count({column}) OVER (PARTITION BY {by}, {column}) - 1) / 2.0e0) / count({column}) OVER (PARTITION BY {by}) END"""


@query("w1_pct_change", "panel", keep="entity dt", doubles="ret_1 ret_3 ret_5 ret_10 ret_20", sql=f"""
    SELECT entity, dt, {', '.join(f'close / nullif(lag(close, {k}) OVER {_W}, 0) - 1 AS ret_{k}' for k in (1, 3, 5, 10, 20))} FROM panel""")
def w1(panel):
    return W.pct_changes(panel, KEY, "dt", "close", [1, 3, 5, 10, 20])


@query("w2_rolling", "panel", keep="entity dt", doubles="close_mean_5 close_std_5 close_max_5 close_min_5 close_sum_5", sql="""
    SELECT entity, dt, CASE WHEN n = 5 THEN a END AS close_mean_5, CASE WHEN n = 5 THEN s END AS close_std_5, CASE WHEN n = 5 THEN h END AS close_max_5,
        CASE WHEN n = 5 THEN l END AS close_min_5, CASE WHEN n = 5 THEN t END AS close_sum_5 FROM (
        SELECT entity, dt, count(close) OVER w AS n, avg(close) OVER w AS a, stddev_samp(close) OVER w AS s, max(close) OVER w AS h,
            min(close) OVER w AS l, sum(close) OVER w AS t FROM panel
        WINDOW w AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) q""", digits=4)
def w2(panel):
    return W.rolling_stats(panel, KEY, "dt", "close", 5)


@query("w3_shifted_rolling", "panel", keep="entity dt", doubles="recent_high_10 recent_low_10", sql="""
    SELECT entity, dt, CASE WHEN count(high) OVER w >= 5 THEN max(high) OVER w END AS recent_high_10,
        CASE WHEN count(low) OVER w >= 5 THEN min(low) OVER w END AS recent_low_10 FROM panel
    WINDOW w AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def w3(panel):
    return W.previous_extremes(panel, KEY, "dt", 10, 5)


@query("w4_moving_averages", "panel", keep="entity dt", doubles="ma5 ma10 ma20 prev_close runup_8 amplitude close_vs_open close_to_ma10 distance_to_ma5", digits=4, sql="""
    SELECT *, close / ma10 - 1 AS close_to_ma10, close / ma5 - 1 AS distance_to_ma5 FROM (
        SELECT entity, dt, close, CASE WHEN count(*) OVER a = 5 THEN avg(close) OVER a END AS ma5, CASE WHEN count(*) OVER b = 10 THEN avg(close) OVER b END AS ma10,
            CASE WHEN count(*) OVER c = 20 THEN avg(close) OVER c END AS ma20, lag(close) OVER w AS prev_close,
            lag(close, 1) OVER w / lag(close, 8) OVER w - 1 AS runup_8, high / low - 1 AS amplitude, close / open - 1 AS close_vs_open FROM panel
        WINDOW w AS (PARTITION BY entity ORDER BY dt), a AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
            b AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
            c AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) q""")
def w4(panel):
    return W.low_buy_features(panel, KEY, "dt")


@query("w5_forward_return", "panel", keep="entity dt", doubles="fwd_1 fwd_3 fwd_5", sql=f"""
    SELECT entity, dt, {', '.join(f'lead(close, {h}) OVER {_W} / close - 1 AS fwd_{h}' for h in (1, 3, 5))} FROM panel""")
def w5(panel):
    return W.forward_returns(panel, KEY, "dt", "close", [1, 3, 5])


@query("w6_future_maximum", "panel", keep="entity dt", doubles="future_max_3", sql="""
    SELECT entity, dt, max(close) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS future_max_3 FROM panel""")
def w6(panel):
    return W.future_maximum(panel, KEY, "dt", "close", 3)


@query("w7_rank_percentile", "features", keep="entity dt", doubles="ret_5_rank_pct amount_ratio_rank_pct", sql=f"""
    SELECT entity, dt, {_rank('ret_5')} AS ret_5_rank_pct, {_rank('amount_ratio')} AS amount_ratio_rank_pct FROM features""")
def w7(features):
    return W.cross_section_ranks(stored(features, "features"), ["dt"], ["ret_5", "amount_ratio"])


@query("w8_first_rank", "features", keep="entity dt rank", doubles="ret_3", sql="""
    SELECT entity, dt, ret_3, row_number() OVER (PARTITION BY dt ORDER BY ret_3 DESC NULLS LAST, entity) AS rank FROM features""")
def w8(features):
    return first_ranks(features, ["dt"], "ret_3", ["entity"])


@query("w9_difference", "features", keep="entity dt", doubles="ret_5_diff_3", sql=f"""
    SELECT entity, dt, ret_5 - lag(ret_5, 3) OVER {_W} AS ret_5_diff_3 FROM features""")
def w9(features):
    return W.difference(features, KEY, "dt", "ret_5", 3)


_FLOW_STATE = """CASE WHEN abs(flow_pp) < 2 OR flow_pp IS NULL THEN 'stable' WHEN flow_pp > 0 THEN 'upward' ELSE 'downward' END AS direction,
    CASE WHEN abs(flow_pp) < 2 OR flow_pp IS NULL THEN 'low' WHEN abs(flow_pp) < 5 THEN 'medium' ELSE 'high' END AS significance"""


@query("w10_probability_flow", "shares", keep="subject ts outcome direction significance", doubles="flow_pp momentum_3 momentum_5", sql=f"""
    SELECT subject, ts, outcome, flow_pp, {_FLOW_STATE}, CASE WHEN count(flow_pp) OVER a = 3 THEN avg(flow_pp) OVER a END AS momentum_3,
        CASE WHEN count(flow_pp) OVER b = 5 THEN avg(flow_pp) OVER b END AS momentum_5 FROM (
        SELECT *, (p - lag(p) OVER (PARTITION BY subject, outcome ORDER BY ts)) * 100 AS flow_pp FROM shares) q
    WINDOW a AS (PARTITION BY subject, outcome ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY subject, outcome ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def w10(shares):
    return W.probability_flow(shares, ["subject", "outcome"], "ts", "p")


@query("w12_max_drawdown", "features", keep="entity", doubles="max_drawdown", sql="""
    SELECT entity, min(equity / peak - 1) AS max_drawdown FROM (
        SELECT entity, equity, max(equity) OVER (PARTITION BY entity ORDER BY dt) AS peak FROM (
            SELECT entity, dt, product(1 + coalesce(ret_1, 0)) OVER (PARTITION BY entity ORDER BY dt) AS equity FROM features) a) b GROUP BY entity""")
def w12(features):
    return W.max_drawdown(features, KEY, "dt", "ret_1")


@query("w13_price_grid", "panel", keep="entity dt", doubles="close", sql="""
    SELECT e.entity, d.dt, last_value(p.close IGNORE NULLS) OVER (PARTITION BY e.entity ORDER BY d.dt) AS close
    FROM (SELECT DISTINCT dt FROM panel) d CROSS JOIN (SELECT DISTINCT entity FROM panel) e LEFT JOIN panel p ON p.dt = d.dt AND p.entity = e.entity""")
def w13(panel):
    return W.price_grid(panel, "entity", "dt", "close")


@query("w14_group_size", "members", keep="grp member dt group_rows", sql="""
    SELECT grp, member, dt, count(*) OVER (PARTITION BY grp, dt) AS group_rows FROM members""")
def w14(members):
    return W.group_size(members, ["grp", "dt"])


@query("w15_latest_per_key", "panel", keep="entity dt", doubles="close", sql="""
    SELECT entity, dt, close FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY dt DESC) AS n FROM panel) q WHERE n = 1""")
def w15(panel):
    return W.keep_last(panel, KEY, [F.desc("dt")])


@query("k1_top_per_date", "features", keep="entity dt rank", doubles="ret_5 fwd_3", sql="""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY ret_5 DESC NULLS LAST, entity) AS rank FROM features) q WHERE rank <= 5""")
def k1(features):
    return W.top_per(features, ["dt"], "ret_5", ["entity"], 5)


@query("k2_first_per_group", "members", keep="grp member dt", doubles="amount", sql="""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, dt ORDER BY amount DESC, member) AS n FROM members) q WHERE n <= 3""")
def k2(members):
    return W.top_per(members, ["grp", "dt"], "amount", ["member"], 3)


@query("k3_global_top", "panel", keep="entity dt", doubles="amount", sql="SELECT entity, dt, amount FROM panel ORDER BY amount DESC, entity, dt LIMIT 20")
def k3(panel):
    return panel.orderBy(F.desc("amount"), "entity", "dt").limit(20)


@query("k4_latest_candidates", "features", keep="entity dt", doubles="ret_5", sql="""
    SELECT entity, dt, ret_5 FROM features WHERE dt = (SELECT max(dt) FROM features) ORDER BY ret_5 DESC NULLS LAST, entity LIMIT 10""")
def k4(features):
    latest = features.agg(F.max("dt").alias("dt"))
    return features.join(F.broadcast(latest), "dt").orderBy(F.col("ret_5").desc_nulls_last(), "entity").limit(10)  # one row


@query("k5_outcome_ranking", "shares", keep="subject ts outcome place best", doubles="p", sql="""
    SELECT subject, ts, outcome, p, row_number() OVER w AS place, first_value(outcome) OVER w AS best FROM shares
    WINDOW w AS (PARTITION BY subject, ts ORDER BY p DESC, outcome)""")
def k5(shares):
    w = Window.partitionBy("subject", "ts").orderBy(F.desc("p"), "outcome")
    return shares.withColumn("place", F.row_number().over(w)).withColumn("best", F.first("outcome").over(w))


@query("j2_group_join", "members groups", keep="grp member dt rows_of_pair", doubles="close group_close", sql="""
    SELECT * FROM (SELECT m.grp, m.member, m.dt, m.close, g.close AS group_close, count(*) OVER (PARTITION BY m.grp, m.member) AS rows_of_pair
        FROM members m JOIN groups g ON m.grp = g.grp AND m.dt = g.dt) q WHERE rows_of_pair >= 20""")
def j2(members, groups):
    joined = members.join(groups.select("grp", "dt", F.col("close").alias("group_close")), ["grp", "dt"])
    return joined.withColumn("rows_of_pair", F.count(F.lit(1)).over(Window.partitionBy("grp", "member"))).filter("rows_of_pair >= 20")


@query("j10_calendar_returns", "panel", keep="start_date end_date names", doubles="mean_return", sql="""
    WITH cal AS (SELECT dt, dense_rank() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM panel) d)
SELECT a.dt AS start_date, b.dt AS end_date, count(*) AS names, avg(q.close / p.close - 1) AS mean_return FROM cal a JOIN cal b ON b.i = a.i + 5
    JOIN panel p ON p.dt = a.dt JOIN panel q ON q.dt = b.dt AND q.entity = p.entity GROUP BY a.dt, b.dt""")
def j10(panel):
    """Equal-weight return from each date to the one five steps later in the calendar of all dates."""
    dates = panel.select("dt").distinct().withColumn("i", F.row_number().over(Window.orderBy("dt")))  # a table of dates
    ends = dates.select(F.col("dt").alias("end_date"), (F.col("i") - 5).alias("i"))
    pairs = dates.withColumnRenamed("dt", "start_date").join(ends, "i").drop("i")
    starts = panel.select(F.col("dt").alias("start_date"), "entity", F.col("close").alias("first_close")).join(pairs, "start_date")
    ended = starts.join(panel.select(F.col("dt").alias("end_date"), "entity", "close"), ["end_date", "entity"])
    return ended.groupBy("start_date", "end_date").agg(F.count(F.lit(1)).alias("names"), F.avg(F.col("close") / F.col("first_close") - 1).alias("mean_return"))

