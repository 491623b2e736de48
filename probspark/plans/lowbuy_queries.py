"""Queries of signals, plans, rebound filter, events and their outcomes over monthly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from probspark.operators import lowbuy as L
from probspark.operators.windows import first_rank
from probspark.operators.ranks import joined, quantiles
from probspark.plans.registry import query
from probspark.sources.stored import stored

KEY = ["entity"]
RULES = L.RULES | {"amount": 1000.0, "ma10_break": 0.6}  # months of invented prices move more than days
REBOUND = L.REBOUND | {"amount": 20000.0, "strong_amount": 40000.0, "amplitude": 0.8, "extreme": 2.0, "low": -0.8, "high": 0.5}
SPLIT = ("1998-06-01", "1998-07-01")
_W = "PARTITION BY entity ORDER BY dt"
_R = "floor(({}) * 1e4 + 0.5e0) / 1e4"


def _before(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _mean(n: int) -> str:
    over = f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) OVER {over} = {n} THEN avg(close) OVER {over} END AS ma{n}"


_SIGNALS = f"""f0 AS (SELECT *, volume / 10 AS turnover, {_mean(5)}, {_mean(10)}, lag(close) OVER w AS prev_close, close / nullif(lag(close) OVER w, 0) - 1 AS ret_1,
    lag(close, 1) OVER w / lag(close, 8) OVER w - 1 AS runup_8, high / nullif(low, 0) - 1 AS amplitude,
    {', '.join(f'lead({c}, {k}) OVER w AS t{k}_{n}' for k in (1, 2, 3) for n, c in (('date', 'dt'), ('open', 'open'), ('high', 'high'), ('low', 'low'), ('close', 'close')))}
    FROM panel WINDOW w AS ({_W})),
f1 AS (SELECT *, close / ma10 - 1 AS close_to_ma10, CASE WHEN count(ret_1) OVER {_before(8)} >= 3 THEN max(ret_1) OVER {_before(8)} END AS max_gain_8,
    CASE WHEN count(high) OVER {_before(10)} >= 5 THEN max(high) OVER {_before(10)} END AS recent_high_10, CASE WHEN count(low) OVER {_before(10)} >= 5 THEN min(low) OVER {_before(10)} END AS recent_low_10,
    CASE WHEN count(low) OVER {_before(8)} >= 5 THEN min(low) OVER {_before(8)} END AS recent_low_8 FROM f0)"""
_PLAN = f"""p0 AS (SELECT *, coalesce(recent_low_8, low) AS sl, greatest(recent_high_10, high) AS sh FROM {{source}}),
p1 AS (SELECT *, CASE WHEN sh <= sl THEN low ELSE sh - (sh - sl) * 0.382e0 END AS f38, CASE WHEN sh <= sl THEN low * 0.97e0 ELSE sh - (sh - sl) * 0.5e0 END AS f5,
    CASE WHEN sh <= sl THEN low * 0.94e0 ELSE sh - (sh - sl) * 0.618e0 END AS f61 FROM p0),
p2 AS (SELECT *, least(low, f38) AS anchor, greatest(f5, coalesce(ma10, close), low * 0.97e0) AS deep FROM p1),
plans AS (SELECT *, {_R.format('sl')} AS swing_low, {_R.format('sh')} AS swing_high, {_R.format('f38')} AS fib382, {_R.format('f5')} AS fib50, {_R.format('f61')} AS fib618,
    {_R.format('anchor * (1 - 0.008e0)')} AS buy_low, {_R.format('anchor * (1 + 0.008e0)')} AS buy_high, {_R.format('deep * (1 - 0.012e0)')} AS deep_buy_low, {_R.format('deep * (1 + 0.012e0)')} AS deep_buy_high,
    {_R.format('least(f61, deep * (1 - 0.012e0)) * (1 - 0.015e0)')} AS stop_price, {_R.format('greatest(close, coalesce(ma5, close))')} AS reclaim_price,
    least(greatest((runup_8 - 0.22e0) / 0.25e0, 0), 1) * 0.25e0 + least(greatest((max_gain_8 - 0.09e0) / 0.12e0, 0), 1) * 0.20e0 + least(greatest((amplitude - 0.075e0) / 0.12e0, 0), 1) * 0.20e0
        + least(greatest((abs(ret_1) - 0.035e0) / 0.10e0, 0), 1) * 0.15e0 + least(greatest((turnover - 5) / 15e0, 0), 1) * 0.10e0 + (1 - least(greatest(abs(close_to_ma10) / 0.12e0, 0), 1)) * 0.10e0 AS raw_score FROM p2)"""
_MET = "(SELECT * FROM f1 WHERE runup_8 >= 0.22 AND max_gain_8 >= 0.09 AND ret_1 <= -0.035 AND amplitude >= 0.075 AND turnover >= 5 AND amount >= 1000 AND close_to_ma10 >= -0.6)"
_TO_SIGNALS = f"""WITH {_SIGNALS},
{_PLAN.format(source=_MET)},
sig AS (SELECT *, floor(raw_score * 1e6 + 0.5e0) / 1e6 AS signal_score FROM plans)"""
_PLANS = "swing_low swing_high fib382 fib50 fib618 buy_low buy_high deep_buy_low deep_buy_high stop_price reclaim_price"


def with_turnover(panel):
    return panel.withColumn("turnover", F.col("volume") / 10)


@query("f6_buy_plan", "panel", keep="entity dt", doubles=_PLANS, digits=4, sql=f"WITH {_SIGNALS},\n{_PLAN.format(source='f1')}\nSELECT * FROM plans")
def f6(panel):
    return L.buy_plan(L.signal_features(with_turnover(panel), KEY, "dt"))


@query("p1_signal_selection", "panel", keep="entity dt signal_state", doubles=f"signal_score {_PLANS}", digits=4, sql=f"{_TO_SIGNALS}\nSELECT *, 'next_day_low_buy_watch' AS signal_state FROM sig")
def p1(panel):
    return L.select_signals(L.signal_features(with_turnover(panel), KEY, "dt"), RULES)


@query("f7_signal_score", "panel", keep="entity dt", doubles="signal_score", sql=f"WITH {_SIGNALS},\n{_PLAN.format(source='f1')}\nSELECT entity, dt, floor(raw_score * 1e6 + 0.5e0) / 1e6 AS signal_score FROM plans WHERE runup_8 IS NOT NULL AND max_gain_8 IS NOT NULL AND ret_1 IS NOT NULL AND close_to_ma10 IS NOT NULL")
def f7(panel):
    featured = L.signal_features(with_turnover(panel), KEY, "dt")
    return featured.withColumn("signal_score", L.signal_score()).filter("signal_score is not null")


_EVENTS = f"""{_TO_SIGNALS},
ev AS (SELECT entity, dt AS signal_date, t1_date AS entry_date, t2_date AS exit_date, signal_score, t1_open / close - 1 <= 0.03 AND t1_low <= buy_high AND t1_high >= buy_low AS touched, t2_close, buy_high,
    row_number() OVER (PARTITION BY dt ORDER BY signal_score DESC, entity) AS rank_in_day FROM sig WHERE t2_date IS NOT NULL),
events_ AS (SELECT *, CASE WHEN touched THEN t2_close / buy_high - 1 END AS ret, CASE WHEN touched THEN t2_close / buy_high - 1 ELSE 0 END AS planned FROM ev)"""
_SUMMARY = """count(*) AS signals, count(*) FILTER (touched) AS triggered, avg(CAST(touched AS DOUBLE)) AS rate, avg(ret) AS mean_ret, median(ret) AS median_ret,
    avg(CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS DOUBLE) END) AS win_rate, max(ret) AS best, min(ret) AS worst, avg(planned) AS mean_planned"""
_NUMBERS = "rate mean_ret median_ret win_rate best worst mean_planned"


def events(panel):
    return L.signal_events(with_turnover(panel), KEY, "dt", RULES)


@query("j9_next_row_events", "panel", keep="entity signal_date entry_date exit_date touched rank_in_day", doubles="signal_score ret planned", sql=f"{_EVENTS}\nSELECT * FROM events_")
def j9(panel):
    return events(panel)


@query("a25_event_summary", "panel", keep="signals triggered", doubles=_NUMBERS, sql=f"{_EVENTS}\nSELECT {_SUMMARY} FROM events_")
def a25(panel):
    return L.event_summary(events(panel), [])


@query("a27_daily_portfolio", "panel", keep="signal_date selected triggered", doubles="mean_planned", sql=f"{_EVENTS}\nSELECT signal_date, count(*) AS selected, count(*) FILTER (touched) AS triggered, avg(planned) AS mean_planned FROM events_ GROUP BY signal_date")
def a27(panel):
    return events(panel).groupBy("signal_date").agg(F.count(F.lit(1)).alias("selected"), F.count_if("touched").alias("triggered"), F.avg("planned").alias("mean_planned"))


@query("a26_split_summary", "panel", keep="split signals triggered days", doubles=f"{_NUMBERS} daily_mean daily_drawdown", sql=f"""{_EVENTS},
parts AS (SELECT e.*, s.split FROM events_ e JOIN (SELECT 'all' AS split UNION ALL SELECT 'in_sample' UNION ALL SELECT 'out_of_sample') s
    ON split = 'all' OR (split = 'in_sample' AND signal_date <= DATE '{SPLIT[0]}') OR (split = 'out_of_sample' AND signal_date >= DATE '{SPLIT[1]}')),
days AS (SELECT split, signal_date, avg(planned) AS day FROM parts GROUP BY split, signal_date),
curve AS (SELECT *, product(1 + day) OVER (PARTITION BY split ORDER BY signal_date) AS equity FROM days),
falls AS (SELECT split, count(*) AS days, avg(day) AS daily_mean, min(fall) AS daily_drawdown FROM (SELECT *, equity / max(equity) OVER (PARTITION BY split ORDER BY signal_date) - 1 AS fall FROM curve) q GROUP BY split),
sums AS (SELECT split, {_SUMMARY} FROM parts GROUP BY split)
SELECT sums.*, days, daily_mean, daily_drawdown FROM sums JOIN falls ON sums.split = falls.split""")
def a26(panel):
    """The split labels of a row are exploded, so one aggregation serves all splits."""
    return L.split_summary(events(panel), *SPLIT)


@query("p16_sample_split", "panel", keep="split n", sql=f"""
    SELECT split, count(*) AS n FROM panel JOIN (SELECT 'all' AS split UNION ALL SELECT 'in_sample' UNION ALL SELECT 'out_of_sample') s
    ON split = 'all' OR (split = 'in_sample' AND dt <= DATE '{SPLIT[0]}') OR (split = 'out_of_sample' AND dt >= DATE '{SPLIT[1]}') GROUP BY split""")
def p16(panel):
    return panel.withColumn("split", L.split_labels(F.col("dt"), *SPLIT)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_CHECKS = """runup_8 >= 0.5|amount >= 20000|amount >= 40000|amplitude >= 0.8|amplitude >= 2.0|(close - recent_low_10) / nullif(recent_high_10 - recent_low_10, 0) >= 0.65|rank_in_day <= 4|buy_high / close - 1 BETWEEN -0.8 AND 0.5""".split("|")


@query("p14_weighted_checks", "panel", keep="entity dt rank_in_day rebound_score level", sql=f"""{_TO_SIGNALS},
placed AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY signal_score DESC, entity) AS rank_in_day FROM sig),
checked AS (SELECT *, {', '.join(f'coalesce({c}, FALSE) AS c{i}' for i, c in enumerate(_CHECKS))} FROM placed),
summed AS (SELECT *, 2 * CAST(c0 AS INT) + {' + '.join(f'CAST(c{i} AS INT)' for i in range(1, 8))} AS rebound_score FROM checked)
SELECT *, CASE WHEN rebound_score >= 6 AND c0 AND c1 AND c5 THEN '{L.LEVELS[0]}' WHEN rebound_score >= 4 AND c0 THEN '{L.LEVELS[1]}' ELSE '{L.LEVELS[2]}' END AS level FROM summed""")
def p14(panel):
    signals = first_rank(p1(panel), ["dt"], "signal_score", KEY, "rank_in_day")
    return L.rebound_filter(signals, REBOUND)


_T = (1, 2, 3)
_RETS = "CASE WHEN {0} IS NULL AND {1} IS NULL AND {2} IS NULL THEN NULL ELSE greatest({0}, {1}, {2}) END"
_OUTCOMES = f"""{_TO_SIGNALS},
o0 AS (SELECT *, {', '.join(f'100 * (t{k}_close / {"close" if k == 1 else f"t{k - 1}_close"} - 1) AS t{k}_pct_change, t{k}_low <= buy_high AND t{k}_high >= buy_low AS t{k}_touch, t{k}_high / buy_high - 1 AS t{k}_high_ret, t{k}_close / buy_high - 1 AS t{k}_close_ret' for k in _T)} FROM sig),
o1 AS (SELECT *, greatest(t1_high_ret, t2_high_ret, t3_high_ret) AS max_high_1_3, greatest(t1_close_ret, t2_close_ret, t3_close_ret) AS max_close_1_3,
    greatest(t2_high_ret, t3_high_ret) AS max_high_2_3, greatest(t2_close_ret, t3_close_ret) AS max_close_2_3 FROM o0),
outs AS (SELECT *, t1_high_ret >= 0.1 AS t1_big, max_high_2_3 >= 0.1 AS t2_t3_big, max_high_1_3 >= 0.1 AS big, 'board' || substr(entity, 7, 1) AS board,
    CASE WHEN dt <= DATE '{SPLIT[0]}' THEN 'in_sample' ELSE 'out_of_sample' END AS split FROM o1)"""
_FLAGS = ("t1_touch", "t2_touch", "t3_touch", "t1_big", "t2_t3_big", "big")
_MAXIMA = "max_high_1_3 max_close_1_3 max_high_2_3 max_close_2_3"


def outcomes(panel):
    df = L.rebound_outcomes(with_turnover(panel), KEY, "dt", RULES)
    return df.withColumns({"board": F.concat(F.lit("board"), F.substring("entity", 7, 1)), "split": F.when(F.col("dt") <= SPLIT[0], "in_sample").otherwise("out_of_sample")})


@query("d1_next_rows", "panel", keep="entity dt board split t1_date t2_date t3_date t1_touch t2_touch t3_touch t1_big t2_t3_big big", digits=5,
       doubles=" ".join(f"t{k}_{c}" for k in _T for c in ("open", "high", "low", "close", "pct_change", "high_ret", "close_ret")) + f" {_MAXIMA}", sql=f"{_OUTCOMES}\nSELECT * REPLACE ({', '.join(f'CAST({c} AS INT) AS {c}' for c in _FLAGS)}) FROM outs")
def d1(panel):
    return outcomes(panel).withColumns({c: F.col(c).cast("int") for c in _FLAGS})


_FEATURES = ("runup_8", "amplitude", "ret_1", "signal_score")


@query("d2_feature_summary", "panel", keep="big feature n", doubles="mean median p25 p75", sql=f"""{_OUTCOMES},
long AS ({' UNION ALL '.join(f"SELECT big, '{c}' AS feature, {c} AS value FROM outs WHERE big IS NOT NULL" for c in _FEATURES)})
SELECT big, feature, count(value) AS n, avg(value) AS mean, median(value) AS median, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75 FROM long GROUP BY big, feature""")
def d2(panel):
    long = stored(outcomes(panel).filter("big is not null").unpivot("big", list(_FEATURES), "feature", "value"), "features")
    key, value = ["big", "feature"], F.col("value")
    means = long.groupBy(*key).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return joined(means, quantiles(long, key, {"median": (value, 0.5), "p25": (value, 0.25), "p75": (value, 0.75)}), key)


_COMBOS = {"all": "TRUE", "busy": "amount >= 20000", "steep": "runup_8 >= 0.5", "busy and steep": "amount >= 20000 AND runup_8 >= 0.5", "wide": "amplitude >= 0.8"}


@query("d3_condition_scan", "panel", keep="combo split n big_n", doubles="rate t1_rate t23_rate mean_max_high", sql=f"""{_OUTCOMES},
scan AS ({' UNION ALL '.join(f"SELECT '{n}' AS combo, * FROM outs WHERE big IS NOT NULL AND {c}" for n, c in _COMBOS.items())})
SELECT combo, split, count(*) AS n, count(*) FILTER (big) AS big_n, avg(CAST(big AS INT)) AS rate, avg(CAST(t1_big AS INT)) AS t1_rate, avg(CAST(t2_t3_big AS INT)) AS t23_rate, avg(max_high_1_3) AS mean_max_high FROM scan GROUP BY combo, split""")
def d3(panel):
    """A row is exploded to the conditions that it meets, so one pass serves them all."""
    met = F.array_compact(F.array(*(F.when(F.expr(c), n) for n, c in _COMBOS.items())))
    df = outcomes(panel).filter("big is not null").withColumn("combo", F.explode(met))
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return df.groupBy("combo", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if("big").alias("big_n"), rate("big").alias("rate"), rate("t1_big").alias("t1_rate"), rate("t2_t3_big").alias("t23_rate"), F.avg("max_high_1_3").alias("mean_max_high"))


@query("d4_lift_table", "panel", keep="feature bucket n big_n", doubles="rate lift mean_max_high mean_max_close", sql=f"""{_OUTCOMES},
base AS (SELECT avg(CAST(big AS INT)) AS base FROM outs WHERE big IS NOT NULL AND t1_touch),
cells AS (SELECT 'runup_8' AS feature, CAST(least(floor(runup_8 / 0.25e0), 8) AS INT) AS bucket, * FROM outs WHERE big IS NOT NULL UNION ALL SELECT 'amplitude', CAST(least(floor(amplitude / 0.25e0), 8) AS INT), * FROM outs WHERE big IS NOT NULL)
SELECT feature, bucket, count(*) AS n, count(*) FILTER (big) AS big_n, avg(CAST(big AS INT)) AS rate, avg(CAST(big AS INT)) / (SELECT base FROM base) AS lift, avg(max_high_1_3) AS mean_max_high, avg(max_close_1_3) AS mean_max_close FROM cells GROUP BY feature, bucket""")
def d4(panel):
    df = outcomes(panel).filter("big is not null")
    hit = F.avg(F.col("big").cast("int"))
    base = df.filter("t1_touch").agg(hit.alias("base"))
    long = df.select("big", "max_high_1_3", "max_close_1_3", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.least(F.floor(F.col(c) / 0.25), F.lit(8)).cast("int").alias("bucket")) for c in ("runup_8", "amplitude")))).alias("x"))
    out = long.groupBy("x.feature", "x.bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("big").alias("big_n"), hit.alias("rate"), F.avg("max_high_1_3").alias("mean_max_high"), F.avg("max_close_1_3").alias("mean_max_close"))
    return out.join(F.broadcast(base), F.lit(True)).withColumn("lift", F.col("rate") / F.col("base"))  # one row


@query("s20_prefilter", "panel", keep="entity dt place", doubles="ret_60 amount", sql=f"""WITH {_SIGNALS},
r AS (SELECT *, 100 * (close / lag(close, 3) OVER ({_W}) - 1) AS ret_60 FROM f1)
SELECT entity, dt, ret_60, amount, row_number() OVER (ORDER BY ret_60 DESC, amount DESC, entity, dt) AS place FROM (SELECT * FROM r WHERE close >= 3 AND close <= 5000 AND 100 * ret_1 <= -3 AND 100 * amplitude >= 7 AND turnover >= 5 AND amount >= 1000 AND ret_60 >= 20
    ORDER BY ret_60 DESC, amount DESC, entity, dt LIMIT 120) q""", digits=4)
def s20(panel):
    """Seven ranges, then the first rows by rise and amount: the limit is the operator."""
    df = L.signal_features(with_turnover(panel), KEY, "dt")
    from pyspark.sql.window import Window

    df = df.withColumn("ret_60", 100 * (F.col("close") / F.lag("close", 3).over(Window.partitionBy("entity").orderBy("dt")) - 1))
    met = df.filter("close >= 3 and close <= 5000 and 100 * ret_1 <= -3 and 100 * amplitude >= 7 and turnover >= 5 and amount >= 1000 and ret_60 >= 20")
    order = [F.desc("ret_60"), F.desc("amount"), "entity", "dt"]
    best = met.orderBy(*order).limit(120)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # 120 rows
