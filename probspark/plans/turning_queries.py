"""Queries of turning points, breadth snapshots and strategies over monthly bars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.operators import breadth as B
from probspark.operators import turning as T
from probspark.plans.panel_queries import _rank
from probspark.plans.registry import query
from probspark.sources.stored import fresh_path, stored
from probspark.streaming import monitors as M

E = ["entity"]
P = "p"
TOP = 10
_W = "PARTITION BY entity ORDER BY dt"


def _full(n: int, value: str, of: str = "*") -> str:
    return f"CASE WHEN count({of}) OVER w{n} = {n} THEN {value} OVER w{n} END"


_WINDOWS = f"WINDOW w AS ({_W}), " + ", ".join(f"w{n} AS ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 5, 10, 20))
_BARS = f"""bars0 AS (SELECT entity, dt, open, close, high, low, amount,
    {', '.join(f'close / nullif(lag(close, {k}) OVER w, 0) - 1 AS ret_{k}' for k in (1, 3, 5, 10, 20))},
    {', '.join(f'amount / nullif(lag(amount, {k}) OVER w, 0) - 1 AS amount_change_{k}' for k in (3, 5, 10, 20))},
    {', '.join(f'{_full(n, "avg(amount)")} AS am{n}' for n in (3, 5, 10, 20))}, {', '.join(f'{_full(n, "avg(close)")} AS ma{n}' for n in (5, 10, 20))},
    {_full(20, 'max(high)')} AS high_20, {_full(20, 'min(low)')} AS low_20,
    {', '.join(f'lead(close, {h}) OVER w / close - 1 AS fwd_ret_{h}, max(close) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1 AS fwd_mfe_{h}' for h in (3, 5))}
    FROM panel {_WINDOWS}),
bars1 AS (SELECT *, {_full(5, 'stddev_samp(ret_1)', 'ret_1')} AS sd5, {_full(20, 'stddev_samp(ret_1)', 'ret_1')} AS sd20 FROM bars0 {_WINDOWS}),
bars AS (SELECT *, am3 / am20 / (am10 / am20) - 1 AS amount_acceleration, am5 / am20 AS amount_ratio_5_20, ma5 / ma20 - 1 AS ma_gap_5_20, close / ma5 - 1 AS price_reclaim_5,
    close / ma20 - 1 AS price_reclaim_20, sd5 / nullif(sd20, 0) AS volatility_ratio_5_20, 1 - sd5 / nullif(sd20, 0) AS volatility_compression, close / high_20 - 1 AS drawdown_20,
    close / low_20 - 1 AS rebound_20, (close - low) / nullif(high - low, 0) AS intraday_position, (high - close) / nullif(high - low, 0) AS upper_shadow,
    (close - low) / nullif(high - low, 0) AS lower_shadow FROM bars1)"""
_DAILY = """daily0 AS (SELECT dt, count(*) AS universe, median(ret_1) AS ret_1_median, median(ret_3) AS ret_3_median, median(ret_5) AS ret_5_median, median(ret_10) AS ret_10_median,
    median(amount_ratio_5_20) AS amount_ratio_5_20_median, median(volatility_ratio_5_20) AS volatility_ratio_5_20_median, median(intraday_position) AS intraday_median,
    stddev_samp(ret_5) AS ret_5_dispersion, avg(CASE WHEN ret_1 > 0 THEN 1.0e0 ELSE 0.0e0 END) AS breadth_up_1, avg(CASE WHEN ret_5 > 0 THEN 1.0e0 ELSE 0.0e0 END) AS breadth_up_5,
    avg(CASE WHEN price_reclaim_20 > 0 THEN 1.0e0 ELSE 0.0e0 END) AS breadth_above_ma20, avg(CASE WHEN amount_ratio_5_20 > 1 THEN 1.0e0 ELSE 0.0e0 END) AS breadth_expand FROM bars GROUP BY dt),
daily1 AS (SELECT *, breadth_up_5 * 0.30e0 + breadth_above_ma20 * 0.30e0 + breadth_expand * 0.20e0 + coalesce(least(greatest(intraday_median, 0), 1), 0) * 0.20e0 AS regime_score FROM daily0),
daily AS (SELECT *, avg(regime_score) OVER (ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS regime_score_ma5, regime_score - lag(regime_score, 5) OVER (ORDER BY dt) AS regime_score_5_delta,
    CASE WHEN regime_score >= 0.62 THEN 'risk_on' WHEN regime_score >= 0.45 THEN 'mixed' ELSE 'risk_off' END AS regime FROM daily1)"""
_SCORES = f"""ranks AS (SELECT b.*, d.regime_score, d.regime, {', '.join(f'{_rank("b." + c, "b.dt")} AS {n}' for c, n in T.RANKED.items())} FROM bars b JOIN daily d ON b.dt = d.dt),
moves AS (SELECT *, ret_5_rank - lag(ret_5_rank, 3) OVER ({_W}) AS ret_flow_3, amount_rank - lag(amount_rank, 3) OVER ({_W}) AS amount_flow_3 FROM ranks),
raw AS (SELECT *, (1 - ret_5_rank) * 0.28e0 + amount_rank * 0.24e0 + intraday_rank * 0.18e0 + compression_rank * 0.15e0 + coalesce(greatest(ret_flow_3, 0), 0) * 0.10e0
        + coalesce(greatest(amount_flow_3, 0), 0) * 0.05e0 AS divergence_score,
    ret_3_rank * 0.20e0 + acceleration_rank * 0.22e0 + reclaim_5_rank * 0.18e0 + intraday_rank * 0.16e0 + coalesce(greatest(ret_flow_3, 0), 0) * 0.16e0
        + coalesce(greatest(amount_flow_3, 0), 0) * 0.08e0 AS visibility_score FROM moves),
placed AS (SELECT *, {_rank('divergence_score')} AS divergence_rank, {_rank('visibility_score')} AS visibility_rank FROM raw),
scored AS (SELECT *, CASE WHEN ret_5_rank IS NULL OR divergence_rank IS NULL THEN 'insufficient_history' WHEN ret_5_rank >= 0.82 AND visibility_rank >= 0.65 THEN 'already_extended'
    WHEN divergence_rank >= 0.72 AND visibility_rank >= 0.65 THEN 'visible_turn_candidate' WHEN divergence_rank >= 0.70 AND ret_5_rank <= 0.55 THEN 'hidden_divergence_candidate'
    WHEN ret_5_rank <= 0.35 AND amount_rank <= 0.45 AND ret_flow_3 < 0 THEN 'cooling_or_failed' ELSE 'neutral' END AS position_state FROM placed)"""
_LABELS = "labelled AS (SELECT *, " + ", ".join(
    f"CAST(coalesce({_rank(f'fwd_ret_{h}')} >= 0.8, FALSE) AND coalesce(fwd_mfe_{h} >= 0.1, FALSE) AS INT) AS label_main_wave_{h}, "
    f"CASE WHEN fwd_ret_{h} IS NOT NULL THEN CAST(coalesce({_rank(f'fwd_ret_{h}')} >= 0.8, FALSE) AND coalesce(fwd_mfe_{h} >= 0.1, FALSE) AND coalesce(ret_5_rank <= 0.8, FALSE) AS INT) END AS label_turn_{h}"
    for h in (3, 5)
) + " FROM scored)"
_RANKED = f"""chances AS (SELECT *, divergence_rank * 0.55e0 + visibility_rank * 0.40e0 + intraday_position * 0.05e0 AS p FROM labelled),
flows0 AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY p DESC, entity) AS rank_probability, (p - lag(p) OVER ({_W})) * 100 AS flow_pp FROM chances WHERE p IS NOT NULL),
flows1 AS (SELECT *, CASE WHEN count(flow_pp) OVER m = 3 THEN avg(flow_pp) OVER m END AS momentum_3 FROM flows0 WINDOW m AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
ranked0 AS (SELECT *, CASE WHEN rank_probability <= {TOP} AND p >= 0.65 AND coalesce(momentum_3, 0) > 0 AND visibility_rank >= 0.55 AND ret_5_rank <= 0.75
        THEN CASE WHEN regime_score < 0.45 THEN 'risk_off_divergence_watch' ELSE 'turning_visible' END
    WHEN p >= 0.55 AND divergence_rank >= 0.65 AND ret_5_rank <= 0.75 THEN CASE WHEN regime_score < 0.45 THEN 'risk_off_divergence_watch' ELSE 'early_divergence_watch' END
    WHEN ret_5_rank >= 0.82 AND p < 0.60 THEN 'already_extended' WHEN p < 0.35 AND coalesce(flow_pp, 0) < 0 THEN 'cooling_or_failed' ELSE 'neutral_or_wait' END AS signal_state FROM flows1),
ranked AS (SELECT *, (1 - least(greatest(coalesce((rank_probability - 1.0e0) / nullif(count(*) OVER (PARTITION BY dt) - 1.0e0, 0), 0), 0), 1)) * 0.42e0 + coalesce(divergence_rank, 0.5e0) * 0.22e0
    + coalesce(visibility_rank, 0.5e0) * 0.18e0 + coalesce({_rank('amount_ratio_5_20')}, 0.5e0) * 0.10e0 + (1 - coalesce(ret_5_rank, 0.5e0)) * 0.08e0 AS strategy_score FROM ranked0)"""
_TO_DAILY = f"WITH {_BARS},\n{_DAILY}"
_TO_SCORES = f"{_TO_DAILY},\n{_SCORES}"
_TO_LABELS = f"{_TO_SCORES},\n{_LABELS}"
_TO_RANKED = f"{_TO_LABELS},\n{_RANKED}"


def scored(panel):
    bars = stored(T.bar_features(panel, E, "dt"), "bars")  # the context and its join read it
    return T.turning_scores(bars.join(T.daily_context(bars, "dt").select("dt", "regime_score", "regime"), "dt"), E, "dt")


def ranked(panel):
    """The scored panel with a stand-in for a model's probability."""
    p = F.col("divergence_rank") * 0.55 + F.col("visibility_rank") * 0.40 + F.col("intraday_position") * 0.05
    df = T.turning_labels(scored(panel), "dt").withColumn(P, p)
    return T.strategy_score(T.rank_table(df, E, "dt", P, TOP), "dt")


@query("f11_bar_shape", "panel", keep="entity dt", doubles="intraday_position upper_shadow lower_shadow drawdown_20 rebound_20 volatility_compression amount_acceleration ma_gap_5_20", sql=f"WITH {_BARS}\nSELECT * FROM bars")
def f11(panel):
    return T.bar_features(panel, E, "dt")


_CONTEXT = "ret_1_median ret_3_median ret_5_median ret_10_median amount_ratio_5_20_median volatility_ratio_5_20_median intraday_median ret_5_dispersion breadth_up_1 breadth_up_5 breadth_above_ma20 breadth_expand regime_score"


@query("a24_market_context", "panel", keep="dt universe", doubles=_CONTEXT, sql=f"{_TO_DAILY}\nSELECT * FROM daily")
def a24(panel):
    return T.daily_context(stored(T.bar_features(panel, E, "dt"), "bars"), "dt")


@query("w11_series_context", "panel", keep="dt regime", doubles="regime_score regime_score_ma5 regime_score_5_delta", sql=f"{_TO_DAILY}\nSELECT * FROM daily")
def w11(panel):
    return T.daily_context(stored(T.bar_features(panel, E, "dt"), "bars"), "dt")


@query("j8_context_join", "panel", keep="entity dt universe regime", doubles="ret_5 ret_5_median regime_score", sql=f"{_TO_DAILY}\nSELECT b.entity, b.dt, b.ret_5, d.universe, d.regime, d.ret_5_median, d.regime_score FROM bars b LEFT JOIN daily d ON b.dt = d.dt")
def j8(panel):
    bars = T.bar_features(panel, E, "dt").select("entity", "dt", "ret_5", "ret_1", "ret_3", "ret_10", "amount_ratio_5_20", "volatility_ratio_5_20", "intraday_position", "price_reclaim_20")
    return bars.select("entity", "dt", "ret_5").join(T.daily_context(bars, "dt"), "dt", "left")


@query("f8_divergence_scores", "panel", keep="entity dt position_state", doubles="divergence_score visibility_score divergence_rank visibility_rank ret_flow_3", sql=f"{_TO_SCORES}\nSELECT * FROM scored")
def f8(panel):
    """Six-term divergence and visibility scores, their ranks in the date, and the position state."""
    return scored(panel)


@query("w22_labels", "panel", keep="entity dt label_main_wave_3 label_turn_3 label_main_wave_5 label_turn_5", sql=f"{_TO_LABELS}\nSELECT * FROM labelled")
def w22(panel):
    return T.turning_labels(scored(panel), "dt")


@query("w22_outperform_labels", "members groups", keep="grp member dt outperforms top_in_group", doubles="excess", sql=f"""
    WITH f AS (SELECT m.grp, m.member, m.dt, lead(m.close, 3) OVER w / m.close - 1 AS fwd, lead(g.close, 3) OVER w / g.close - 1 AS group_fwd FROM members m JOIN groups g ON m.grp = g.grp AND m.dt = g.dt
        WINDOW w AS (PARTITION BY m.grp, m.member ORDER BY m.dt))
SELECT *, fwd - group_fwd AS excess, CASE WHEN fwd - group_fwd IS NOT NULL THEN CAST(fwd - group_fwd > 0 AS INT) END AS outperforms,
    CASE WHEN fwd IS NOT NULL THEN CAST({_rank('fwd', 'grp, dt')} >= 0.8 AS INT) END AS top_in_group FROM f""")
def w22b(members, groups):
    """Forward returns of members against their group's."""
    from probspark.functions.expr import rank_pct

    df = members.select("grp", "member", "dt", "close").join(groups.select("grp", "dt", F.col("close").alias("group_close")), ["grp", "dt"])
    w = Window.partitionBy("grp", "member").orderBy("dt")
    df = df.withColumns({"fwd": F.lead("close", 3).over(w) / F.col("close") - 1, "group_fwd": F.lead("group_close", 3).over(w) / F.col("group_close") - 1})
    excess = F.col("fwd") - F.col("group_fwd")
    top = F.when(F.col("fwd").isNotNull(), (rank_pct(F.col("fwd"), ["grp", "dt"]) >= 0.8).cast("int"))
    return df.withColumns({"excess": excess, "outperforms": F.when(excess.isNotNull(), (excess > 0).cast("int")), "top_in_group": top})


@query("p15_label_tail", "panel", keep="entity dt label_turn_3", sql=f"{_TO_LABELS}\nSELECT entity, dt, label_turn_3 FROM labelled WHERE amount >= 10000 AND label_turn_3 IS NOT NULL")
def p15(panel):
    return T.labelled_panel(T.turning_labels(scored(panel), "dt"), 10000.0, ["label_turn_3"], False)


@query("p9_turning_signal", "panel", keep="entity dt rank_probability signal_state", doubles="p flow_pp momentum_3", sql=f"{_TO_RANKED}\nSELECT * FROM ranked")
def p9(panel):
    return ranked(panel)


@query("f10_composite_score", "panel", keep="entity dt", doubles="strategy_score", sql=f"{_TO_RANKED}\nSELECT * FROM ranked")
def f10(panel):
    return ranked(panel)


_CONFIGS = """configs AS (SELECT 'model_top30' AS config, 30 AS cap, 5 AS top_n, 0.0e0 AS least_p, 1.0e0 AS most_ret, NULL AS least_regime, TRUE AS watch, TRUE AS states, TRUE AS by_rank
    UNION ALL SELECT 'filtered', 60, 5, 0.5e0, 0.78e0, NULL, TRUE, FALSE, FALSE UNION ALL SELECT 'risk_adaptive', 60, 5, 0.5e0, 0.78e0, 0.35e0, FALSE, FALSE, FALSE),
passed AS (SELECT c.config, r.*, c.top_n, row_number() OVER (PARTITION BY c.config, r.dt ORDER BY CASE WHEN by_rank THEN -rank_probability ELSE strategy_score END DESC, rank_probability, entity) AS place
    FROM ranked r CROSS JOIN configs c WHERE rank_probability <= cap AND (least_p <= 0 OR p >= least_p) AND coalesce(ret_5_rank, 1) <= most_ret AND (least_regime IS NULL OR coalesce(regime_score, 0) >= least_regime)
    AND (watch OR signal_state <> 'risk_off_divergence_watch') AND (states OR (signal_state NOT IN ('cooling_or_failed', 'already_extended') AND position_state NOT IN ('cooling_or_failed', 'already_extended')))),
picked AS (SELECT * FROM passed WHERE place <= top_n)"""


@query("p2_configured_candidates", "panel", keep="config entity dt place", doubles="strategy_score", sql=f"{_TO_RANKED},\n{_CONFIGS}\nSELECT * FROM picked")
def p2(panel):
    """A small table of named configurations meets all rows; one predicate and one rank serve them all."""
    return T.candidates(ranked(panel), E, "dt", P)


_BACKTEST = """cal AS (SELECT dt, lead(dt, 5) OVER (ORDER BY dt) AS exit_date FROM (SELECT DISTINCT dt FROM panel) d),
grid AS (SELECT e.entity, c.dt, c.exit_date, last_value(q.close IGNORE NULLS) OVER (PARTITION BY e.entity ORDER BY c.dt) AS price
    FROM cal c CROSS JOIN (SELECT DISTINCT entity FROM panel) e LEFT JOIN panel q ON q.entity = e.entity AND q.dt = c.dt),
held AS (SELECT a.entity, a.dt, a.exit_date, b.price / nullif(a.price, 0) - 1 AS r FROM grid a LEFT JOIN grid b ON b.entity = a.entity AND b.dt = a.exit_date),
steps AS (SELECT dt FROM (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM ranked) d) q WHERE i % 3 = 0),
bench AS (SELECT k.dt, avg(h.r) AS bench, count(h.r) AS bench_count, median(k.regime_score) AS regime_median FROM ranked k JOIN steps USING (dt) JOIN held h ON h.entity = k.entity AND h.dt = k.dt GROUP BY k.dt),
modes AS (SELECT dt, regime AS regime_mode FROM (SELECT dt, regime, row_number() OVER (PARTITION BY dt ORDER BY count(*) DESC, regime) AS n FROM ranked GROUP BY dt, regime) q WHERE n = 1),
bt0 AS (SELECT k.dt, k.config, max(h.exit_date) AS exit_date, avg(h.r) AS ret, count(h.r) AS picks, string_agg(k.entity, ',' ORDER BY k.place) AS names, avg(k.p) AS mean_p,
    avg(k.rank_probability) AS mean_rank, avg(k.strategy_score) AS mean_score FROM picked k JOIN steps USING (dt) LEFT JOIN held h ON h.entity = k.entity AND h.dt = k.dt GROUP BY k.dt, k.config),
events AS (SELECT a.*, b.bench, b.bench_count, b.regime_median, m.regime_mode, a.ret - b.bench AS excess FROM bt0 a JOIN bench b ON a.dt = b.dt JOIN modes m ON a.dt = m.dt WHERE a.exit_date IS NOT NULL AND a.ret IS NOT NULL)"""


def backtested(panel):
    """Candidates, benchmark and prices read the ranked panel and the bars: both are stored once."""
    panel = stored(panel, "panel")
    return T.backtest(stored(ranked(panel), "ranked"), panel, "entity", "dt", P)


@query("j14_rebalanced_backtest", "panel", keep="dt config exit_date picks bench_count regime_mode names", doubles="ret bench excess regime_median mean_p mean_rank mean_score", digits=5, sql=f"{_TO_RANKED},\n{_CONFIGS},\n{_BACKTEST}\nSELECT * FROM events")
def j14(panel):
    return backtested(panel)


@query("a28_strategy_summary", "panel", keep="config events", doubles="mean_ret median_ret win_rate mean_bench mean_excess excess_win_rate best worst max_drawdown mean_picks", digits=5, sql=f"""{_TO_RANKED},
{_CONFIGS},
{_BACKTEST},
curve AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY config ORDER BY dt) AS equity FROM events),
peaks AS (SELECT *, equity / max(equity) OVER (PARTITION BY config ORDER BY dt) - 1 AS fall FROM curve)
SELECT config, count(*) AS events, avg(ret) AS mean_ret, median(ret) AS median_ret, avg(CAST(ret > 0 AS INT)) AS win_rate, avg(bench) AS mean_bench, avg(excess) AS mean_excess,
    avg(CAST(excess > 0 AS INT)) AS excess_win_rate, max(ret) AS best, min(ret) AS worst, min(fall) AS max_drawdown, avg(picks) AS mean_picks FROM peaks GROUP BY config""")
def a28(panel):
    return T.strategy_summary(backtested(panel), "dt")


_KNOWN = "SELECT * FROM ranked WHERE label_turn_3 IS NOT NULL"


@query("a29_state_summary", "panel", keep="signal_state n", doubles="hit_rate mean_p mean_ret mean_mfe", sql=f"""{_TO_RANKED}
SELECT signal_state, count(*) AS n, avg(label_turn_3) AS hit_rate, avg(p) AS mean_p, avg(fwd_ret_3) AS mean_ret, avg(fwd_mfe_3) AS mean_mfe FROM ({_KNOWN}) k GROUP BY signal_state""")
def a29(panel):
    known = ranked(panel).filter("label_turn_3 is not null")
    return known.groupBy("signal_state").agg(F.count(F.lit(1)).alias("n"), F.avg("label_turn_3").alias("hit_rate"), F.avg(P).alias("mean_p"), F.avg("fwd_ret_3").alias("mean_ret"), F.avg("fwd_mfe_3").alias("mean_mfe"))


@query("a29_daily_top_hits", "panel", keep="dt n", doubles="hit_rate mean_ret", sql=f"""{_TO_RANKED}
SELECT dt, count(*) AS n, avg(label_turn_3) AS hit_rate, avg(fwd_ret_3) AS mean_ret FROM ({_KNOWN}) k WHERE rank_probability <= 5 GROUP BY dt""")
def a29b(panel):
    top = ranked(panel).filter("label_turn_3 is not null and rank_probability <= 5")
    return top.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.avg("label_turn_3").alias("hit_rate"), F.avg("fwd_ret_3").alias("mean_ret"))


@query("a30_rank_quality", "panel", keep="n dates entities", doubles="base_rate brier auc top_hit_rate top_ret daily_top_hit_rate", sql=f"""{_TO_RANKED},
known AS ({_KNOWN}),
placed_p AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0e0 AS r FROM known)
SELECT count(*) AS n, count(DISTINCT dt) AS dates, count(DISTINCT entity) AS entities, avg(label_turn_3) AS base_rate, avg((p - label_turn_3) * (p - label_turn_3)) AS brier,
    (sum(CASE WHEN label_turn_3 = 1 THEN r END) - sum(label_turn_3) * (sum(label_turn_3) + 1) / 2.0e0) / (sum(label_turn_3) * (count(*) - sum(label_turn_3))) AS auc,
    avg(CASE WHEN rank_probability <= 5 THEN label_turn_3 END) AS top_hit_rate, avg(CASE WHEN rank_probability <= 5 THEN fwd_ret_3 END) AS top_ret,
    (SELECT avg(h) FROM (SELECT avg(label_turn_3) AS h FROM known WHERE rank_probability <= 5 GROUP BY dt) d) AS daily_top_hit_rate FROM placed_p""")
def a30(panel):
    from probspark.operators.scoring import rank_quality

    known = ranked(panel).filter("label_turn_3 is not null").select("dt", "entity", "p", F.col("label_turn_3").alias("y"), "rank_probability", "fwd_ret_3")
    return rank_quality(stored(known, "known"), date="dt", entity="entity", rank="rank_probability", forward="fwd_ret_3", top_n=5)


# Three horizons of probabilities: of entities among all, and of members inside their group.
def _horizon(df, key, within, h):
    """``p, rank, flow, momentum, ret_rank`` of a horizon: the return's rank, lifted by the close's place between the extremes."""
    from probspark.functions.expr import rank_pct
    from probspark.operators.windows import first_rank, probability_flow

    w = Window.partitionBy(*key).orderBy("dt")
    ret = F.try_divide(F.col("close"), F.lag("close", h).over(w)) - 1
    df = df.withColumn("ret", ret)
    df = df.withColumn("ret_rank", rank_pct(F.col("ret"), [*within, "dt"]))
    place = F.coalesce((F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.5))
    df = df.withColumn("p", F.col("ret_rank") * 0.7 + place * 0.3).filter("p is not null")
    df = first_rank(df, [*within, "dt"], "p", key)
    df = probability_flow(df, key, "dt", "p")
    return df.select(*key, "dt", "p", "rank", F.col("flow_pp").alias("flow"), F.col("momentum_3").alias("momentum"), "ret_rank")


def _horizon_sql(h: int, table: str, key: str, within: str) -> str:
    return f"""h{h}a AS (SELECT *, close / nullif(lag(close, {h}) OVER (PARTITION BY {key} ORDER BY dt), 0) - 1 AS ret FROM {table}),
h{h}b AS (SELECT *, {_rank('ret', within + 'dt')} AS ret_rank, coalesce((close - low) / nullif(high - low, 0), 0.5e0) AS pos FROM h{h}a),
h{h}c AS (SELECT *, ret_rank * 0.7e0 + pos * 0.3e0 AS p FROM h{h}b WHERE ret_rank IS NOT NULL),
h{h}d AS (SELECT *, row_number() OVER (PARTITION BY {within}dt ORDER BY p DESC, {key}) AS rank, (p - lag(p) OVER (PARTITION BY {key} ORDER BY dt)) * 100 AS flow FROM h{h}c),
h{h}e AS (SELECT *, CASE WHEN count(flow) OVER m = 3 THEN avg(flow) OVER m END AS momentum FROM h{h}d WINDOW m AS (PARTITION BY {key} ORDER BY dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
h{h} AS (SELECT * FROM h{h}e WHERE dt = (SELECT max(dt) FROM h{h}e))"""


def _joined_sql(key: list[str], within: str) -> str:
    same = lambda b: " AND ".join(f"a.{k} = {b}.{k}" for k in key)
    over = f"OVER (PARTITION BY {within}dt)" if within else "OVER ()"
    score = lambda h: f"coalesce(1 - (rank_{h} - 1.0e0) / nullif(count(*) {over} - 1.0e0, 0), 1)"
    return f"""uni AS (SELECT {', '.join(f'a.{k}' for k in key)}, a.dt, {', '.join(f'{t}.{c} AS {c}_{h}' for t, h in (('a', 1), ('b', 3), ('c', 5)) for c in ('p', 'rank', 'flow', 'momentum', 'ret_rank'))}
    FROM h1 a JOIN h3 b ON {same('b')} JOIN h5 c ON {same('c')}),
cons AS (SELECT *, ({score(1)} * 0.2e0 + {score(3)} * 0.5e0 + {score(5)} * 0.3e0) / (0.2e0 + 0.5e0 + 0.3e0) AS consensus FROM uni),
horizons AS (SELECT *, row_number() OVER (PARTITION BY {within}dt ORDER BY consensus DESC, {', '.join(key)}) AS place FROM cons)"""


_GROUPS = "WITH " + ",\n".join([*(_horizon_sql(h, "panel", "entity", "") for h in (1, 3, 5)), _joined_sql(["entity"], "")])
_MEMBERS = "WITH " + ",\n".join([*(_horizon_sql(h, "members", "grp, member", "grp, ") for h in (1, 3, 5)), _joined_sql(["grp", "member"], "grp, ")])
WEIGHTS = {1: 0.2, 3: 0.5, 5: 0.3}


def group_horizons(panel):
    return T.multi_horizon({h: _horizon(panel, E, [], h) for h in (1, 3, 5)}, E, "dt", WEIGHTS)


def member_horizons(members):
    key = ["grp", "member"]
    return T.multi_horizon({h: _horizon(members, key, ["grp"], h) for h in (1, 3, 5)}, key, "dt", WEIGHTS, ["grp"])


@query("j3_multi_horizon", "panel", keep="entity dt rank_1 rank_3 rank_5 place", doubles="consensus", sql=f"{_GROUPS}\nSELECT * FROM horizons")
def j3(panel):
    return group_horizons(panel)


@query("j4_member_horizons", "members", keep="grp member dt rank_1 rank_3 rank_5 place", doubles="consensus", sql=f"{_MEMBERS}\nSELECT * FROM horizons")
def j4(members):
    return member_horizons(members)


def _categories_sql(rules: list[tuple[str, str]]) -> str:
    first = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules)
    return f"coalesce({first}, 'watchlist') AS category, coalesce(nullif(concat_ws(',', {first}), ''), 'watchlist') AS categories"


_COOL = "((flow_3 <= -1.0) OR (momentum_3 <= -0.5 AND flow_3 <= 0.5))"
_GROUP_MAIN, _MEMBER_MAIN = "(rank_3 <= 5 AND rank_5 <= 5 AND p_3 >= 0.55)", "(rank_3 <= 5 AND rank_5 <= 5 AND p_3 >= 0.55)"
_G = {"main": 5, "launch_1": 6, "launch_3": 12, "crowd_1": 6, "crowd_mid": 16, "cool_3": 14}


@query("p3_group_categories", "panel", keep="entity dt category categories", sql=f"""{_GROUPS}
SELECT *, {_categories_sql([('mainline_candidate', _GROUP_MAIN), ('launch_candidate', f'(rank_1 <= 6 AND rank_3 <= 12 AND flow_3 >= 0.5 AND NOT {_GROUP_MAIN})'),
    ('crowded_short_term', '(rank_1 <= 6 AND (rank_3 > 16 OR rank_5 > 16))'), ('cooling_candidate', f'(rank_3 <= 14 AND {_COOL})')])} FROM horizons""")
def p3(panel):
    """The limits are set for 25 entities; ``GROUP_LIMITS`` holds those for hundreds."""
    return T.categories(group_horizons(panel), _G, T.GROUP_NAMES)


@query("p4_member_categories", "members", keep="grp member dt category categories", sql=f"""{_MEMBERS}
SELECT *, {_categories_sql([('leader_candidate', _MEMBER_MAIN), ('launch_candidate', f'(rank_1 <= 5 AND rank_3 <= 12 AND flow_3 >= 0.5 AND NOT {_MEMBER_MAIN})'),
    ('catchup_candidate', f'(rank_3 <= 12 AND flow_3 >= 0.5 AND ret_rank_3 <= 0.55 AND NOT {_MEMBER_MAIN})'),
    ('crowded_leader', '(rank_1 <= 5 AND (rank_3 > 15 OR rank_5 > 15))'), ('cooling_stock', f'(rank_3 <= 12 AND {_COOL})')])} FROM horizons""")
def p4(members):
    return T.categories(member_horizons(members), T.MEMBER_LIMITS, T.MEMBER_NAMES, catch_up=0.55)


# Breadth snapshots: a group's own bar and how many of its members rose, as item and value texts.
ITEMS = {n: n for n in ("up_down", "place", "board_change", "net_inflow", "amount", "volume", "open", "previous_close", "high", "low")}


def info_rows(panel, members):
    w = Window.partitionBy("grp", "member").orderBy("dt")
    moved = members.withColumn("d", F.col("close") - F.lag("close").over(w)).groupBy(F.col("member").alias("entity"), "dt").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    e = Window.partitionBy("entity").orderBy("dt")
    df = panel.withColumns({"previous_close": F.lag("close").over(e), "net_inflow": (F.col("amount") - F.lag("amount").over(e)) / 1000, "amount": F.col("amount") / 1000})
    df = df.withColumn("ret_1", F.col("close") / F.col("previous_close") - 1)
    df = df.withColumns({"place": F.row_number().over(Window.partitionBy("dt").orderBy(F.col("ret_1").desc_nulls_last(), "entity")), "places": F.count(F.lit(1)).over(Window.partitionBy("dt"))})
    text = lambda c: F.coalesce(F.format_string("%.6f", c), F.lit("--"))
    known = lambda c: F.when(c.isNotNull(), text(c)).otherwise("--")
    values = {"up_down": F.concat_ws("/", "up", "down"), "place": F.concat_ws(" / ", "place", "places"), "board_change": F.when(F.col("ret_1").isNotNull(), F.concat(text(F.col("ret_1") * 100), F.lit("%"))).otherwise("--")}
    values |= {n: known(F.col(n)) for n in ("net_inflow", "amount", "volume", "open", "previous_close", "high", "low")}
    rows = df.join(moved, ["entity", "dt"]).select("entity", "dt", F.explode(F.array(*(F.struct(F.lit(n).alias("item"), v.alias("value")) for n, v in values.items()))).alias("x"))
    return rows.select("entity", "dt", "x.item", "x.value")


_R4 = "floor(({}) * 1e6 + 0.5e0) / 1e6"
_INFO = f"""moved AS (SELECT member AS entity, dt, count(*) FILTER (d > 0) AS up_count, count(*) FILTER (d < 0) AS down_count FROM (
    SELECT *, close - lag(close) OVER (PARTITION BY grp, member ORDER BY dt) AS d FROM members) q GROUP BY member, dt),
board AS (SELECT *, close / previous_close - 1 AS r1 FROM (SELECT *, lag(close) OVER ({_W}) AS previous_close, (amount - lag(amount) OVER ({_W})) / 1000 AS inflow FROM panel) q),
wide AS (SELECT b.entity, b.dt, up_count, down_count, up_count * 1.0e0 / nullif(up_count + down_count, 0) AS up_ratio, {_R4.format('r1 * 100')} AS board_change, {_R4.format('inflow')} AS net_inflow,
    {_R4.format('amount / 1000')} AS amount, {_R4.format('volume')} AS volume, {_R4.format('b.open')} AS open, {_R4.format('previous_close')} AS previous_close, {_R4.format('high')} AS high, {_R4.format('low')} AS low,
    row_number() OVER (PARTITION BY b.dt ORDER BY r1 DESC NULLS LAST, b.entity) AS place, count(*) OVER (PARTITION BY b.dt) AS places FROM board b JOIN moved m ON b.entity = m.entity AND b.dt = m.dt),
record AS (SELECT *, CASE WHEN places > 1 THEN 1 - (place - 1) / (places - 1.0e0) END AS rank_strength FROM wide)"""


@query("s21_wide_record", "panel members", keep="entity dt up_count down_count place places", doubles="up_ratio rank_strength board_change net_inflow amount volume open previous_close high low", digits=4, sql=f"WITH {_INFO}\nSELECT * FROM record")
def s21(panel, members):
    return B.wide_records(info_rows(panel, members), ["entity", "dt"], ITEMS)


def rank_and_records(panel, members):
    panel = stored(panel, "panel")
    rank = ranked(panel).select("entity", "dt", "p", "rank_probability", "divergence_rank", "visibility_rank", "regime", "signal_state", "position_state")
    return rank, B.wide_records(info_rows(panel, members), ["entity", "dt"], ITEMS)


def breadth(panel, members):
    rank, record = rank_and_records(panel, members)
    df = B.breadth_scores(rank.join(record, ["entity", "dt"], "left"), ["dt"], E, P)
    df = B.rotation_breadth(df, ["dt"], E, P)
    return B.dashboard(B.snapshot_deltas(df, E, "dt"))


def _filled(column: str, value: str = "0") -> str:
    return _rank(f"coalesce({column}, {value})")


_BREADTH = f"""{_INFO},
met AS (SELECT k.entity, k.dt, k.p, k.rank_probability, k.divergence_rank, k.visibility_rank, k.regime, k.signal_state, k.position_state, r.up_ratio, r.rank_strength, r.board_change, r.net_inflow, r.amount
    FROM ranked k LEFT JOIN record r ON k.entity = r.entity AND k.dt = r.dt),
br0 AS (SELECT *, coalesce(up_ratio, 0.5e0) * 0.32e0 + coalesce(rank_strength, 0.5e0) * 0.22e0 + {_filled('board_change')} * 0.14e0 + {_filled('net_inflow')} * 0.20e0 + {_filled('amount')} * 0.12e0 AS member_breadth,
    coalesce(up_ratio, 0.5e0) * 0.35e0 + coalesce(rank_strength, 0.5e0) * 0.25e0 + {_filled('board_change')} * 0.10e0 + {_filled('net_inflow')} * 0.20e0 + {_filled('amount')} * 0.10e0 AS breadth,
    {_rank('p')} AS model_score, {_filled('divergence_rank', '0.5e0')} * 0.55e0 + {_filled('visibility_rank', '0.5e0')} * 0.45e0 AS position_score FROM met),
br1 AS (SELECT *, (model_score * 0.52e0 + {_rank('member_breadth')} * 0.30e0 + {_rank('position_score')} * 0.18e0) * CASE regime WHEN 'risk_off' THEN 0.86e0 WHEN 'mixed' THEN 0.95e0 ELSE 1.0e0 END AS turn_breadth,
    model_score * 0.65e0 + {_rank('breadth')} * 0.35e0 AS breadth_blend FROM br0),
br2 AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY turn_breadth DESC, entity) AS rank_turn_breadth, row_number() OVER (PARTITION BY dt ORDER BY breadth_blend DESC, entity) AS rank_breadth,
    CASE WHEN regime = 'risk_off' AND member_breadth >= 0.62 THEN 'risk_off_breadth_resilient' WHEN member_breadth >= 0.68 AND coalesce(up_ratio, 0) >= 0.58 THEN 'breadth_confirmed'
        WHEN member_breadth >= 0.55 AND (coalesce(rank_strength, 0) >= 0.55 OR coalesce(net_inflow, 0) > 0) THEN 'breadth_improving' WHEN member_breadth <= 0.42 THEN 'breadth_weak' ELSE 'breadth_neutral' END AS confirmation FROM br1),
br3 AS (SELECT *, rank_probability - rank_turn_breadth AS rank_change, rank_probability - rank_breadth AS rank_breadth_change, lag(dt) OVER ({_W}) AS previous_at,
    {', '.join(f'{c} - lag({c}) OVER ({_W}) AS {c}_delta' for c in B.DELTAS)} FROM br2),
br4 AS (SELECT *, CASE WHEN turn_breadth_delta IS NULL THEN 'intraday_first_snapshot'
    WHEN rank_turn_breadth <= 10 AND confirmation IN ('breadth_confirmed', 'risk_off_breadth_resilient') AND board_change_delta >= 0 AND up_ratio_delta >= 0 THEN 'intraday_confirming'
    WHEN rank_turn_breadth <= 15 AND turn_breadth_delta >= 0.03 AND board_change_delta > 0 THEN 'intraday_accelerating'
    WHEN confirmation = 'breadth_improving' AND turn_breadth_delta > 0 AND (up_ratio_delta > 0 OR net_inflow_delta > 0) THEN 'intraday_recovering'
    WHEN board_change_delta <= -0.5 OR up_ratio_delta <= -0.08 OR (turn_breadth_delta < 0 AND net_inflow_delta < 0) THEN 'intraday_fading' ELSE 'intraday_watch' END AS intraday_state,
    CASE WHEN rank_turn_breadth <= 10 AND confirmation IN ('breadth_confirmed', 'risk_off_breadth_resilient') THEN CASE WHEN regime = 'risk_off' THEN 'resilient_watchlist' ELSE 'confirmed_turning_candidate' END
    WHEN rank_turn_breadth <= 10 AND confirmation = 'breadth_neutral' THEN 'breadth_unconfirmed_watchlist' WHEN rank_turn_breadth <= 15 AND confirmation = 'breadth_improving' THEN 'breadth_improving_watchlist'
    WHEN confirmation = 'breadth_weak' AND rank_turn_breadth <= 20 THEN 'model_high_breadth_weak' WHEN position_state = 'already_extended' THEN 'already_extended'
    WHEN contains(signal_state, 'cooling') OR position_state = 'cooling_or_failed' THEN 'cooling_or_failed' ELSE 'neutral_or_wait' END AS dashboard_group FROM br3),
boards AS (SELECT *, CASE dashboard_group WHEN 'confirmed_turning_candidate' THEN 1 WHEN 'resilient_watchlist' THEN 2 WHEN 'breadth_unconfirmed_watchlist' THEN 3 WHEN 'breadth_improving_watchlist' THEN 4
    WHEN 'model_high_breadth_weak' THEN 5 WHEN 'already_extended' THEN 6 WHEN 'cooling_or_failed' THEN 7 ELSE 8 END AS priority FROM br4)"""
_TO_BREADTH = f"{_TO_RANKED},\n{_BREADTH}"


@query("f9_breadth_scores", "panel members", keep="entity dt rank_turn_breadth rank_change rank_breadth rank_breadth_change", doubles="member_breadth turn_breadth breadth breadth_blend", digits=5, sql=f"{_TO_BREADTH}\nSELECT * FROM boards")
def f9(panel, members):
    return breadth(panel, members)


@query("p11_confirmation_state", "panel members", keep="entity dt confirmation", sql=f"{_TO_BREADTH}\nSELECT * FROM boards")
def p11(panel, members):
    return breadth(panel, members)


@query("j6_previous_snapshot", "panel members", keep="entity dt previous_at", doubles=" ".join(f"{c}_delta" for c in B.DELTAS), digits=4, sql=f"{_TO_BREADTH}\nSELECT * FROM boards")
def j6(panel, members):
    return breadth(panel, members)


@query("p12_intraday_state", "panel members", keep="entity dt intraday_state", sql=f"{_TO_BREADTH}\nSELECT * FROM boards")
def p12(panel, members):
    return breadth(panel, members)


@query("p13_dashboard_groups", "panel members", keep="entity dt dashboard_group priority", sql=f"{_TO_BREADTH}\nSELECT * FROM boards")
def p13(panel, members):
    return breadth(panel, members)


def monitored(panel, members):
    """The breadth monitor over the records' snapshots: two years and more a file, one year coming again."""
    spark = panel.sparkSession
    rank, record = rank_and_records(panel, members)
    record = record.withColumn("part", F.greatest(F.lit(0), F.least(F.lit(2), F.floor((F.year("dt") - 1992) / 2.5))).cast("int"))
    again = record.filter("year(dt) = 1994").withColumn("part", F.lit(2))
    record = stored(record.unionByName(again), "records")
    path = M.stage_files(record, "part", 3, fresh_path(spark, "snapshots"))
    return M.BreadthMonitor(spark, stored(rank, "rank"), record.drop("part").schema, E, "dt", P).run(path)


@query("x1_breadth_monitor", "panel members", keep="entity dt rank_turn_breadth intraday_state dashboard_group priority previous_at", doubles="turn_breadth turn_breadth_delta", digits=4, sql=f"{_TO_BREADTH}\nSELECT * FROM boards")
def x1(panel, members):
    return monitored(panel, members).history()


@query("x1_dashboard", "panel members", keep="entity dt dashboard_group priority rank_turn_breadth intraday_state", sql=f"{_TO_BREADTH}\nSELECT * FROM boards WHERE dt = (SELECT max(dt) FROM boards)")
def x1b(panel, members):
    return monitored(panel, members).dashboard()
