"""Operators against hand-worked numbers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probspark.functions import expr as X
from probspark.operators import analysis, breadth, fusion, graph, history, lowbuy, models, online, ratings, turning, windows
from probspark.sources import stored
from probspark.sources.stored import tasks_for


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value,kind,want", [(2.0, "decimal_odds", 0.5), (0.9, "decimal_odds", 0.0), (0.7, "probability", 0.7), (75.0, "percentage", 0.75), (1.4, "other", 1.0)])
def test_quote_probability(spark, value, kind, want):
    assert one(spark, X.quote_probability(F.lit(value), F.lit(kind))) == pytest.approx(want)


@pytest.mark.parametrize("p,v,word,want", [(0.8, None, None, 0.8), (None, 0.3, "upward", 0.3), (None, None, "Upward", 0.65), (None, None, "downward", 0.35), (None, None, "sideways", 0.5), (None, None, None, 0.5)])
def test_evidence_probability(spark, p, v, word, want):
    args = F.lit(p).cast("double"), F.lit(v).cast("double"), F.lit(word).cast("string")
    assert one(spark, X.evidence_probability(*args)) == want


def test_true_probabilities(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (1, "b", 3.0), (1, "c", 6.0), (2, "a", 2.0), (2, "b", 2.0)], "subject long, outcome string, value double")
    rows = {(r.subject, r.outcome): r for r in fusion.true_probabilities(df, ["subject"]).collect()}
    assert rows[2, "a"].probability == 0.5 and rows[2, "a"].margin == 0
    assert rows[1, "a"].margin == pytest.approx(2 / 3 + 1 / 3 + 1 / 6 - 1)
    assert sum(rows[1, o].probability for o in "abc") == pytest.approx(1)


def test_margin_removal_is_a_fixed_point(spark):
    df = spark.createDataFrame([(1, o, v) for o, v in zip("abc", (1.5, 3.0, 6.0), strict=True)], "subject long, outcome string, value double")
    got = {r.outcome: r.p for r in online.remove_margin(df, ["subject"]).collect()}
    q = {o: 1 / v for o, v in zip("abc", (1.5, 3.0, 6.0), strict=True)}
    p, total = {o: x / sum(q.values()) for o, x in q.items()}, sum(q.values())
    for _ in range(100):
        root = sum(map(math.sqrt, p.values()))
        if root <= 1:
            break
        z = min((total - 1) / max(root - 1, 0.001), 0.999)
        p = {o: max((q[o] - z * math.sqrt(p[o])) / (1 - z * root), 1e-10) for o in q}
    assert got == pytest.approx({o: x / sum(p.values()) for o, x in p.items()})


def test_future_maximum_and_drawdown(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([10, 12, 11, 15])], "k string, t int, v double")
    assert [r.future_max_2 for r in windows.future_maximum(df, ["k"], "t", "v", 2).orderBy("t").collect()] == [12, 15, 15, None]
    returns = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.1, -0.5, None, 0.2])], "k string, t int, r double")
    assert windows.max_drawdown(returns, ["k"], "t", "r").first().max_drawdown == pytest.approx(-0.5)


def test_rank_percentile_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 9.0)], "id int, v double").withColumn("d", F.lit(1))
    got = {r.id: r.p for r in df.withColumn("p", X.rank_pct(F.col("v"), ["d"])).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: None, 4: 1.0}


@pytest.mark.parametrize("period,latest,now,want", [("1d", "2026-07-02 15:03:00", "2026-07-02 15:10:00", "2026-07-02 00:00:00"), ("15m", "2026-07-02 14:30:00", "2026-07-02 14:40:00", "2026-07-02 14:15:00"), ("15m", "2026-07-02 14:45:00", "2026-07-02 15:03:00", "2026-07-02 14:45:00")])
def test_reliable_time(spark, period, latest, now, want):
    assert str(one(spark, history.reliable_time(F.lit(period), F.to_timestamp(F.lit(latest)), F.to_timestamp(F.lit(now))))) == want


def test_load_plan(spark):
    stored = spark.createDataFrame([("a", "2020-01-05"), ("b", "2020-02-01")], "k string, d string").withColumn("d", F.to_date("d"))
    universe = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    rows = {r.k: (str(r.start_date), r.reason) for r in history.plan_loads(stored, universe, "k", "d", "2019-01-01", "2020-02-01", 0).collect()}
    assert rows == {"a": ("2020-01-06", "tail"), "b": ("2020-02-02", "up_to_date"), "c": ("2019-01-01", "no_history")}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_stacking_matches_a_plain_loop(spark):
    rows = [(k, i, s, p, 0.8) for k in (1, 2) for i in range(1, 31) for s, p in (("good", 0.8), ("bad", 0.2 + 0.01 * i)) if not (k == 2 and s == "bad" and i < 5)]
    df = frame(spark, rows, "stream_id long, seq long, source_id string, prediction double, actual double")
    got = {(r.stream_id, r.seq, r.source_id): r.weight for r in online.online_stacking(df).collect()}
    ridge = {(r.stream_id, r.seq, r.source_id): r.weight for r in online.ridge_stacking(df).collect()}
    assert len(got) == len(ridge) == len(rows)
    for k in (1, 2):
        w, xs = {}, []
        for i in range(1, 31):
            step = {s: p for kk, ii, s, p, _ in rows if (kk, ii) == (k, i)}
            w = {s: w.get(s, 1 / len(step)) for s in step}
            w = {s: max(w[s] / sum(w.values()) * (0.9 + 0.1 * max(1 - (p - 0.8) ** 2 / 0.8, 1e-6)), 1e-12) for s, p in step.items()}
            w = {s: 0.99 * v + 0.01 / len(step) for s, v in w.items()}
            w = {s: v / sum(w.values()) for s, v in w.items()}
            assert {s: got[k, i, s] for s in step} == pytest.approx(w)
            xs.append([step.get("bad", 0.0), step["good"]])
            x = np.array(xs)
            solved = np.maximum(np.linalg.solve(x.T @ x + np.eye(2), x.T @ np.full(len(x), 0.8)), 0)
            if "bad" in step or k == 1:
                assert [ridge[k, i, s] for s in ("bad", "good")] == pytest.approx(list(solved / solved.sum()))
    assert got[1, 30, "good"] > got[1, 30, "bad"]


@pytest.mark.parametrize("window", [None, 40])
def test_conformal_matches_a_plain_loop(spark, window):
    scores = [((i * 7919) % 1000) / 1000 for i in range(300)]
    df = frame(spark, [(7, i, s) for i, s in enumerate(scores)], "k long, seq long, score double").repartition(3)
    alpha, seen, misses = 0.1, [], []
    got = online.adaptive_conformal(df, {"k": "long"}, gamma=0.05, window=window).orderBy("seq").collect()
    for r, s in zip(got, scores, strict=True):
        n, own = len(seen), sorted(seen)
        threshold = own[min(max(math.ceil((n + 1) * (1 - alpha)), 1), n) - 1] if n else 1.0
        miss = int(s > threshold + 1e-12)
        alpha = min(max(alpha + 0.05 * (miss - 0.1), 0.001), 0.999)
        seen = (seen + [s])[-window if window else 0 :]
        misses.append(miss)
        assert (r.threshold, r.miss) == (threshold, miss) and r.alpha == pytest.approx(alpha)
    assert sum(misses) / len(misses) <= 0.15


def test_streams_of_a_batch_are_learned_in_one_frame():
    """A frame for each stream took most of the time where there are many streams."""
    rows = pd.DataFrame([(k, i, ((i * 7919 + (k or 9)) % 1000) / 1000) for k in (*range(40), None) for i in range(20)], columns=["k", "seq", "score"])
    for make in (online.AdaptiveConformal, online.AggregatedConformal):
        learners = {}
        halves = [online.learn_streams(rows[part].reset_index(drop=True), ["k"], ["seq"], make, learners) for part in (rows.seq < 9, rows.seq >= 9)]
        assert [len(h) for h in halves] == [41 * 9, 41 * 11] and len(learners) == 41
        for k, own in rows.groupby("k", dropna=False):
            one = make()
            want = [(*one.step(s), one.alpha) for s in own.score]
            got = pd.concat([h[h.k.isna() if pd.isna(k) else h.k == k] for h in halves])
            assert list(got[["threshold", "miss", "alpha"]].itertuples(index=False, name=None)) == want


def test_aggregated_conformal_keeps_uniform_weights():
    learner = online.AggregatedConformal()
    misses = [learner.update(((i * 7919) % 1000) / 1000) for i in range(200)]
    assert learner.weights == pytest.approx([0.25] * 4) and sum(misses) / 200 <= 0.15
    assert learner.alpha == pytest.approx(learner.alphas.mean())


def test_sorted_scores_find_every_rank():
    scores, plain = online.SortedScores(block=4), []
    for i in range(200):
        scores.add((i * 37) % 101)
        plain = sorted([*plain, (i * 37) % 101])
        assert [scores.kth(k) for k in range(len(plain))] == plain


def test_ratings_of_one_period(spark):
    teams = frame(spark, [("a",), ("b",), ("c",)], "team string")
    results = frame(spark, [("a", "b", 1.0), ("b", "a", 0.0)], "team string, opponent string, score double")
    rows = {r.team: r for r in ratings.rate_period(ratings.new_ratings(teams), results).collect()}
    assert rows["a"].rating > 1500 > rows["b"].rating and rows["a"].games == 1
    assert (rows["c"].rating, rows["c"].rd, rows["c"].games) == (1500, 350, 0)
    phi = 350 / 173.7178
    g = 1 / math.sqrt(1 + 3 * phi**2 / math.pi**2)
    v, d = 1 / (g * g * 0.25), g * 0.5
    sigma = 1.0 if abs(v * d) > 1 else 0.06
    new = 1 / math.sqrt(1 / (phi**2 + sigma**2) + 1 / v)
    assert rows["a"].rating == pytest.approx(1500 + 173.7178 * new**2 * d) and rows["a"].rd == pytest.approx(173.7178 * new)


def test_periods_read_results_that_are_worked_out_once(spark):
    """Every period worked out the results of all periods again."""
    rows = [(p, a, b, s) for p in (1, 2, 3) for a, b, s in (("a", "b", 1.0), ("b", "a", 0.0))]
    worked = spark.sparkContext.accumulator(0)

    def seen(score):
        worked.add(1)
        return score

    results = frame(spark, rows, "period int, team string, opponent string, score double").withColumn("score", F.udf(seen, "double").asNondeterministic()("score"))
    out = ratings.period_ratings(results, frame(spark, [("a",), ("b",), ("c",)], "team string"))
    assert {(r.period, r.team): r.games for r in out.collect()} == {(p, t): 0 if t == "c" else p for p in (1, 2, 3) for t in "abc"}
    assert worked.value == len(rows)


def test_wide_steps_get_more_tasks_for_more_rows(spark):
    assert tasks_for(spark.range(5)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark.range(9_500_000)) == 10


def test_situation_of_three_sources(spark):
    df = frame(spark, [("s", "1", 0.70, 0.8, "B", "2026-01-01"), ("s", "2", 0.68, 0.9, "A", "2026-01-01"), ("s", "3", 0.65, 0.5, "C", "2026-01-01")], "subject string, source string, p double, confidence double, grade string, ts string")
    df = df.withColumn("ts", F.to_date("ts"))
    r = analysis.assess(df, "2026-01-01").first()
    assert 0.6 < r.aggregate < 0.8 and r.consensus > 0.5 and r.sources == 3
    w = {"1": 0.64, "2": 0.9, "3": 0.3}
    p = {"1": 0.70, "2": 0.68, "3": 0.65}
    linear = sum(w[s] * p[s] for s in w) / 1.84
    log = 1 / (1 + math.exp(-sum(w[s] * math.log(p[s] / (1 - p[s])) for s in w) / 1.84))
    assert r.aggregate == pytest.approx((linear + 2 * log) / 3)


@pytest.mark.parametrize("c,odd,m,want", [(0.85, 0, 0.5, "stable"), (0.2, 0, 0.5, "unstable"), (0.5, 2, 0.5, "anomalous"), (0.5, 0, 5.0, "emerging"), (0.5, 0, 0.5, "ambiguous")])
def test_stability(spark, c, odd, m, want):
    assert one(spark, fusion.stability(F.lit(c), F.lit(odd), F.lit(m))) == want


@pytest.mark.parametrize("score,want", [(0.70, "risk_on"), (0.50, "mixed"), (0.20, "risk_off"), (None, "unknown")])
def test_regime(spark, score, want):
    assert one(spark, X.market_regime(F.lit(score).cast("double"))) == want


def test_prices_adjusted_by_the_latest_factor(spark):
    bars = frame(spark, [("a", "2025-01-01", 10.32906764), ("a", "2026-06-11", 11.3), ("a", "2026-06-12", 11.24)], "k string, d string, close double")
    bars = bars.select("k", F.to_date("d").alias("d"), *(F.col("close").alias(c) for c in history.PRICES))
    factors = frame(spark, [("a", "2025-10-15", 1.032906764), ("a", "2026-06-12", 1.0)], "k string, factor_date string, factor double").withColumn("factor_date", F.to_date("factor_date"))
    assert [r.close for r in history.adjusted_bars(bars, factors, "k", "d", "qfq").orderBy("d").collect()] == [10.0, 10.94, 11.24]
    with pytest.raises(Exception, match="no adjustment factors"):
        history.adjusted_bars(bars, factors.filter("k = 'z'"), "k", "d", "qfq").collect()


def test_unknown_periods_are_an_error(spark):
    assert one(spark, history.period_seconds(F.lit("60min"))) == 3600 and one(spark, history.period_seconds(F.lit("1h"))) == 3600
    with pytest.raises(Exception, match="unsupported period"):
        one(spark, history.period_seconds(F.lit("1w")))


def test_signal_plan_event_and_rebound_filter(spark):
    closes = [10.0, 10.2, 10.4, 10.7, 11.0, 12.2, 13.4, 14.6, 15.5, 14.2, 14.4, 14.9, 15.0]
    rows = [("600001", f"2026-01-{i + 1:02d}", c * 0.995, c, c * 1.06, c * 0.97, 1e6, 2.5e9, 8.0) for i, c in enumerate(closes)]
    df = frame(spark, rows, "code string, d string, open double, close double, high double, low double, volume double, amount double, turnover double").withColumn("d", F.to_date("d"))
    signals = lowbuy.select_signals(lowbuy.signal_features(df, ["code"], "d"))
    s = signals.collect()
    assert len(s) == 1 and str(s[0].d) == "2026-01-10" and s[0].stop_price < s[0].buy_low < s[0].buy_high
    event = lowbuy.signal_events(df, ["code"], "d").collect()
    assert len(event) == 1 and (str(event[0].entry_date), str(event[0].exit_date)) == ("2026-01-11", "2026-01-12")
    assert event[0].planned == (event[0].ret or 0.0)
    strong = signals.withColumns({"runup_8": F.lit(0.55), "amplitude": F.lit(0.16), "rank_in_day": F.lit(1)})
    top = lowbuy.rebound_filter(strong).first()
    assert top.rebound_score >= 4 and top.level in lowbuy.LEVELS[:2]


def test_filtered_strategy_leaves_out_the_extended(spark):
    names = "ABCDEF"
    rank = [("2026-01-01", n, i + 1, 0.9 - 0.05 * i, 0.95 if n == "A" else 0.4, 0.6, "mixed", "already_extended" if n == "A" else "turning_visible", "neutral", 0.6, 0.7, 1.1) for i, n in enumerate(names)]
    df = frame(spark, rank, "dt string, entity string, rank_probability int, p double, ret_5_rank double, regime_score double, regime string, signal_state string, position_state string, visibility_rank double, divergence_rank double, amount_ratio_5_20 double")
    panel = frame(spark, [(d, n, 100.0 if d == "2026-01-01" else 90.0 if n == "A" else 102.0) for d in ("2026-01-01", "2026-01-02") for n in names], "dt string, entity string, close double")
    out = {r.config: r for r in turning.backtest(turning.strategy_score(df, "dt"), panel, "entity", "dt", "p", hold=1, step=1).collect()}
    assert out["filtered"].ret > out["model_top30"].ret and "A" not in out["filtered"].names.split(",")
    assert out["filtered"].ret == pytest.approx(0.02) and out["model_top30"].bench == pytest.approx((5 * 0.02 - 0.1) / 6)


def test_dashboard_and_intraday_state(spark):
    rows = [(1, "t", 0.1, 0.5, 0.5, 1.0, 9.0, 0.60, 5, "breadth_neutral"), (2, "t", 0.5, 0.6, 0.6, 2.0, 9.0, 0.67, 3, "breadth_confirmed")]
    df = frame(spark, rows, "at int, entity string, board_change double, up_ratio double, rank_strength double, net_inflow double, amount double, turn_breadth double, rank_turn_breadth int, confirmation string")
    first, last = breadth.snapshot_deltas(df, ["entity"], "at").orderBy("at").collect()
    assert first.intraday_state == "intraday_first_snapshot" and last.intraday_state == "intraday_confirming"
    assert last.board_change_delta == pytest.approx(0.4) and last.turn_breadth_delta == pytest.approx(0.07)
    row = frame(spark, [("breadth_neutral", 3, "mixed", "neutral", "neutral_or_wait")], "confirmation string, rank_turn_breadth int, regime string, position_state string, signal_state string")
    got = breadth.dashboard(row).first()
    assert (got.dashboard_group, got.priority) == ("breadth_unconfirmed_watchlist", 3)


@pytest.mark.parametrize("text,want", [("-1,234.5 yuan", -1234.5), ("--", None), ("", None), ("up 3%", 3.0)])
def test_parsed_numbers(spark, text, want):
    assert one(spark, breadth.parse_number(F.lit(text))) == want


def test_amplification_spreads_along_a_chain(spark):
    flows = frame(spark, [(1, 0, n, 0.2, f, "upward" if f > 0 else "downward") for n, f in zip("abcdef", (9.0, 8.0, 7.0, -6.0, 5.0, 0.4), strict=True)], "graph_id long, ts int, outcome string, p double, flow double, direction string")
    edges = frame(spark, [(1, a, b) for a, b in zip("abcde", "bcdef", strict=True)], "graph_id long, src string, dst string")
    depth = {r.outcome: r.depth for r in graph.propagation(flows, edges).collect()}
    assert depth == {"a": 2, "b": 1, "c": 2, "d": 0, "e": 1, "f": 0}
    rows = {r.outcome: r for r in graph.amplification(flows, edges).collect()}
    assert (rows["f"].score, rows["f"].confidence, rows["f"].depth) == (0.0, 0.1, 0)


def test_group_files_that_are_gone_are_removed(spark, tmp_path):
    df = frame(spark, [("a", 1), ("b", 2), ("b", 3)], "g string, v int")
    stored.write_groups(df, "g", str(tmp_path / "x"))
    assert {r.g: r.n for r in stored.write_groups(df.filter("g = 'b'"), "g", str(tmp_path / "x")).collect()} == {"b": 2}
    assert [p.name for p in (tmp_path / "x").iterdir() if p.is_dir()] == ["__group=b"]


def test_walk_forward_keeps_the_embargo(spark):
    df = spark.range(600).select(F.add_months(F.lit("2000-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("dt"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("x"))
    df = df.withColumn("label", (F.col("x") > 0.5).cast("int"))
    refits = [r.dt for r in df.select("dt").distinct().orderBy("dt").collect()][20::5]
    out = models.walk_forward(df, ["x"], "label", "dt", refits, 3).collect()
    assert len(out) == 200 and sum((r.p > 0.5) == bool(r.label) for r in out) > 180
    assert models.walk_forward(df, ["x"], "label", "dt", refits, 40) is None
    trees = models.score_latest(df, ["x"], "label", "dt", None, 3, "boosted", 5).collect()
    assert len(trees) == 20 and sum((r.p > 0.5) == bool(r.label) for r in trees) > 15
    last = df.agg(F.max("dt")).first()[0]
    assert models.score_latest(df, ["x"], "label", "dt", last, 3) is None
    assert {r.dt for r in models.score_dates(df, ["x"], "label", "dt", last, 2, 0).collect()} == set(sorted({r.dt for r in df.collect()})[-2:])


def test_spread_in_rows_equals_spread_by_joins(spark, monkeypatch):
    import random

    rng, names = random.Random(3), [f"n{i}" for i in range(14)]
    flows = [(g, t, n, rng.choice([0.1, 0.2, 0.2, 0.5]), f, "stable" if abs(f) < 0.5 else "upward" if f > 0 else "downward") for g in (1, 2) for t in (0, 1) for n in names if rng.random() < 0.8 for f in [round(rng.uniform(-9, 9), 3)]]
    flows = frame(spark, flows, "graph_id long, ts int, outcome string, p double, flow double, direction string")
    edges = frame(spark, [(1, *rng.sample(names, 2)) for _ in range(18)] + [(1, "n1", "gone")], "graph_id long, src string, dst string")  # graph 2 has none
    key = ["graph_id", "ts", "outcome"]

    def rows():
        out = {}
        for df in (graph.amplification(flows, edges), graph.propagation(flows, edges), graph.consistency_and_momentum(flows, edges)):
            for r in df.select(*key, *sorted(set(df.columns) - set(key))).collect():
                out.setdefault(tuple(r[:3]), []).append(tuple(round(v, 9) if isinstance(v, float) else v for v in r[3:]))
        return out

    held = rows()
    monkeypatch.setattr(graph, "ROW_OUTCOMES", 3)
    assert not graph.fits_in_rows(flows, edges)
    assert rows() == held and len(held) == flows.count() and {x[0][2] for x in held.values()} >= {0, 1}
