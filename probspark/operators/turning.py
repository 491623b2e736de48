"""Turning points of a panel: bar features, daily context, divergence scores, labels, states, candidates and their backtest.

Rows are bars (``open, high, low, close, amount``) of a key, in the order of a date column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions.expr import clip, market_regime, rank_pct, rolling
from probspark.operators.windows import by, first_rank, price_grid, probability_flow
from probspark.operators.ranks import joined, quantiles
from probspark.sources.stored import stored

#: Weights of the regime score, the divergence score, the visibility score and the strategy score; fixed values.
REGIME = {"breadth_up_5": 0.30, "breadth_above_ma20": 0.30, "breadth_expand": 0.20, "intraday_median": 0.20}
DIVERGENCE = {"quiet": 0.28, "volume": 0.24, "close": 0.18, "compression": 0.15, "ret_flow": 0.10, "amount_flow": 0.05}
VISIBILITY = {"ret_3": 0.20, "acceleration": 0.22, "reclaim": 0.18, "close": 0.16, "ret_flow": 0.16, "amount_flow": 0.08}
STRATEGY = {"probability": 0.42, "divergence": 0.22, "visibility": 0.18, "amount": 0.10, "not_extended": 0.08}

RANKED = {
    "ret_1": "ret_1_rank", "ret_3": "ret_3_rank", "ret_5": "ret_5_rank", "ret_10": "ret_10_rank", "amount_ratio_5_20": "amount_rank",
    "amount_acceleration": "acceleration_rank", "intraday_position": "intraday_rank", "volatility_compression": "compression_rank",
    "ma_gap_5_20": "ma_gap_rank", "price_reclaim_5": "reclaim_5_rank", "price_reclaim_20": "reclaim_20_rank",
}

#: Named configurations of the candidate filter; fixed values.
CONFIGS = [
    {"config": "model_top30", "rank_cap": 30, "top_n": 5, "least_p": 0.0, "most_ret_rank": 1.0, "least_regime": None, "risk_off_watch": True, "cooling": True, "extended": True, "by_rank": True},
    {"config": "filtered", "rank_cap": 60, "top_n": 5, "least_p": 0.50, "most_ret_rank": 0.78, "least_regime": None, "risk_off_watch": True, "cooling": False, "extended": False, "by_rank": False},
    {"config": "risk_adaptive", "rank_cap": 60, "top_n": 5, "least_p": 0.50, "most_ret_rank": 0.78, "least_regime": 0.35, "risk_off_watch": False, "cooling": False, "extended": False, "by_rank": False},
]


def bar_features(panel: DataFrame, key: list[str], order: str, horizons: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Returns, amount ratios, gaps to means, volatility compression, distances to the 20-row extremes, bar shape and forward looks.

    A rolling value is null until its window is full; a range of 0 gives null shapes.  All windows share one sort.
    """
    w = by(key, [order])
    last = lambda n: w.rowsBetween(1 - n, 0)
    col, close = F.col, F.col("close")
    mean = lambda c, n: rolling(F.avg(c), col(c), last(n), n)
    change = lambda c, k: F.try_divide(col(c), F.lag(c, k).over(w)) - 1
    df = panel.withColumns({f"ret_{k}": change("close", k) for k in (1, 3, 5, 10, 20)} | {f"amount_change_{k}": change("amount", k) for k in (3, 5, 10, 20)})
    df = df.withColumns(
        {f"amount_ma_{n}": mean("amount", n) for n in (3, 5, 10, 20)}
        | {f"ma_{n}": mean("close", n) for n in (5, 10, 20)}
        | {f"ret_1_std_{n}": rolling(F.stddev_samp("ret_1"), col("ret_1"), last(n), n) for n in (5, 20)}
        | {"high_20": rolling(F.max("high"), col("high"), last(20), 20), "low_20": rolling(F.min("low"), col("low"), last(20), 20)}
        | {f"fwd_ret_{h}": F.lead("close", h).over(w) / close - 1 for h in horizons}
        | {f"fwd_mfe_{h}": F.max("close").over(w.rowsBetween(1, h)) / close - 1 for h in horizons}
    )
    span = F.nullif(col("high") - col("low"), F.lit(0.0))
    df = df.withColumns({f"amount_ratio_{n}_20": F.try_divide(col(f"amount_ma_{n}"), col("amount_ma_20")) for n in (3, 5, 10)} | {
        "ma_gap_5_20": F.try_divide(col("ma_5"), col("ma_20")) - 1,
        "price_reclaim_5": F.try_divide(close, col("ma_5")) - 1,
        "price_reclaim_20": F.try_divide(close, col("ma_20")) - 1,
        "volatility_ratio_5_20": F.try_divide(col("ret_1_std_5"), col("ret_1_std_20")),
        "drawdown_20": F.try_divide(close, col("high_20")) - 1,
        "rebound_20": F.try_divide(close, col("low_20")) - 1,
        "intraday_position": (close - col("low")) / span,
        "upper_shadow": (col("high") - close) / span,
        "lower_shadow": (close - col("low")) / span,
    })
    return df.withColumns({"amount_acceleration": F.try_divide(col("amount_ratio_3_20"), col("amount_ratio_10_20")) - 1, "volatility_compression": 1 - col("volatility_ratio_5_20")})


def daily_context(df: DataFrame, date: str) -> DataFrame:
    """One row per date: medians, dispersion, breadths, the regime score with its five-row mean and change, and the regime."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    daily = df.groupBy(date).agg(
        F.count(F.lit(1)).alias("universe"),
        F.stddev_samp("ret_5").alias("ret_5_dispersion"),
        share(F.col("ret_1") > 0).alias("breadth_up_1"),
        share(F.col("ret_5") > 0).alias("breadth_up_5"),
        share(F.col("price_reclaim_20") > 0).alias("breadth_above_ma20"),
        share(F.col("amount_ratio_5_20") > 1).alias("breadth_expand"),
    )
    medians = {f"{c}_median": (F.col(c), 0.5) for c in ("ret_1", "ret_3", "ret_5", "ret_10", "amount_ratio_5_20", "volatility_ratio_5_20")}
    medians["intraday_median"] = (F.col("intraday_position"), 0.5)
    daily = joined(daily, quantiles(df, [date], medians), [date], "left")
    score = None
    for name, weight in REGIME.items():
        part = F.coalesce(clip(F.col(name), 0.0, 1.0), F.lit(0.0)) * weight
        score = part if score is None else score + part
    daily = daily.withColumn("regime_score", score)
    w = Window.orderBy(date)  # a table of dates
    daily = daily.withColumns({"regime_score_ma5": F.avg("regime_score").over(w.rowsBetween(-4, 0)), "regime_score_5_delta": F.col("regime_score") - F.lag("regime_score", 5).over(w)})
    return daily.withColumn("regime", market_regime(F.col("regime_score")))


def turning_scores(df: DataFrame, key: list[str], date: str) -> DataFrame:
    """Rank percentiles in the date, their three-row flows, the divergence and visibility scores, their ranks and the position state."""
    df = df.withColumns({name: rank_pct(F.col(c), [date]) for c, name in RANKED.items()})
    w = by(key, [date])
    df = df.withColumns({"ret_flow_3": F.col("ret_5_rank") - F.lag("ret_5_rank", 3).over(w), "amount_flow_3": F.col("amount_rank") - F.lag("amount_rank", 3).over(w)})
    gain = {"ret_flow": F.coalesce(F.greatest("ret_flow_3", F.lit(0.0)), F.lit(0.0)), "amount_flow": F.coalesce(F.greatest("amount_flow_3", F.lit(0.0)), F.lit(0.0))}
    quiet = {"quiet": 1 - F.col("ret_5_rank"), "volume": F.col("amount_rank"), "close": F.col("intraday_rank"), "compression": F.col("compression_rank")} | gain
    seen = {"ret_3": F.col("ret_3_rank"), "acceleration": F.col("acceleration_rank"), "reclaim": F.col("reclaim_5_rank"), "close": F.col("intraday_rank")} | gain
    df = df.withColumns({"divergence_score": _weighted(quiet, DIVERGENCE), "visibility_score": _weighted(seen, VISIBILITY)})
    df = df.withColumns({f"{c}_rank": rank_pct(F.col(f"{c}_score"), [date]) for c in ("divergence", "visibility")})
    return df.withColumn("position_state", position_state(*(F.col(c) for c in ("ret_5_rank", "divergence_rank", "visibility_rank", "ret_flow_3", "amount_rank"))))


def _weighted(terms: dict[str, Column], weights: dict[str, float]) -> Column:
    total = None
    for name, weight in weights.items():
        total = terms[name] * weight if total is None else total + terms[name] * weight
    return total


def position_state(ret_rank: Column, divergence: Column, visibility: Column, ret_flow: Column, amount_rank: Column) -> Column:
    """Five ordered rules; unknown ranks give insufficient_history, a comparison with null is not met."""
    return (
        F.when(ret_rank.isNull() | divergence.isNull(), "insufficient_history")
        .when((ret_rank >= 0.82) & (visibility >= 0.65), "already_extended")
        .when((divergence >= 0.72) & (visibility >= 0.65), "visible_turn_candidate")
        .when((divergence >= 0.70) & (ret_rank <= 0.55), "hidden_divergence_candidate")
        .when((ret_rank <= 0.35) & (amount_rank <= 0.45) & (ret_flow < 0), "cooling_or_failed")
        .otherwise("neutral")
    )


def turning_labels(df: DataFrame, date: str, horizons: tuple[int, ...] = (3, 5), quantile: float = 0.8, least_runup: float = 0.1, most_entry_rank: float = 0.8) -> DataFrame:
    """Per horizon ``label_main_wave`` (0 also where the future is unknown) and ``label_turn`` (null there).

    A main wave is among the best forward returns of its date and runs up far enough; a turn is one that wasn't hot before.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    for h in horizons:
        wave = no(rank_pct(F.col(f"fwd_ret_{h}"), [date]) >= quantile) & no(F.col(f"fwd_mfe_{h}") >= least_runup)
        turn = wave & no(F.col("ret_5_rank") <= most_entry_rank)
        df = df.withColumns({f"label_main_wave_{h}": wave.cast("int"), f"label_turn_{h}": F.when(F.col(f"fwd_ret_{h}").isNotNull(), turn.cast("int"))})
    return df


def labelled_panel(df: DataFrame, least_amount: float, labels: list[str], keep_tail: bool) -> DataFrame:
    """Rows with enough amount; those without a label go unless the tail is kept."""
    df = df.filter(F.col("amount") >= least_amount)
    return df if keep_tail else df.dropna(subset=labels)


def signal_state(p: Column, flow: Column, momentum: Column, rank: Column, ret_rank: Column, divergence: Column, visibility: Column, regime: Column, top_n: int) -> Column:
    """State of a scored row; a weak market turns visible and early candidates into a watch."""
    weak = regime < 0.45
    calm = lambda name: F.when(weak, "risk_off_divergence_watch").otherwise(name)
    return (
        F.when((rank <= top_n) & (p >= 0.65) & (momentum > 0) & (visibility >= 0.55) & (ret_rank <= 0.75), calm("turning_visible"))
        .when((p >= 0.55) & (divergence >= 0.65) & (ret_rank <= 0.75), calm("early_divergence_watch"))
        .when((ret_rank >= 0.82) & (p < 0.60), "already_extended")
        .when((p < 0.35) & (flow < 0), "cooling_or_failed")
        .otherwise("neutral_or_wait")
    )


def rank_table(scored: DataFrame, key: list[str], date: str, probability: str, top_n: int = 10) -> DataFrame:
    """Scored rows with their rank in the date, probability flow and momentum, and the signal state."""
    df = scored.filter(F.col(probability).isNotNull())
    df = first_rank(df, [date], probability, key, "rank_probability")
    df = probability_flow(df, key, date, probability)
    flow, momentum = F.coalesce("flow_pp", F.lit(0.0)), F.coalesce("momentum_3", F.lit(0.0))
    state = signal_state(F.col(probability), flow, momentum, *(F.col(c) for c in ("rank_probability", "ret_5_rank", "divergence_rank", "visibility_rank", "regime_score")), top_n=top_n)
    return df.withColumn("signal_state", state)


def strategy_score(ranked: DataFrame, date: str) -> DataFrame:
    """Blend of probability rank, divergence, visibility, amount and how little the row has risen."""
    half = F.lit(0.5)
    n = F.count(F.lit(1)).over(Window.partitionBy(date))
    place = clip(F.try_divide(F.col("rank_probability") - 1.0, n - 1.0), 0.0, 1.0)
    terms = {
        "probability": 1 - F.coalesce(place, F.lit(0.0)),
        "divergence": F.coalesce("divergence_rank", half),
        "visibility": F.coalesce("visibility_rank", half),
        "amount": F.coalesce(rank_pct(F.col("amount_ratio_5_20"), [date]), half),
        "not_extended": 1 - F.coalesce("ret_5_rank", half),
    }
    return ranked.withColumn("strategy_score", _weighted(terms, STRATEGY))


def candidates(ranked: DataFrame, key: list[str], date: str, probability: str, configs: list[dict] = CONFIGS) -> DataFrame:
    """Per configuration and date the rows that pass it, ``top_n`` of them by rank or by strategy score (``place``)."""
    schema = "config string, rank_cap int, top_n int, least_p double, most_ret_rank double, least_regime double, risk_off_watch boolean, cooling boolean, extended boolean, by_rank boolean"
    table = ranked.sparkSession.createDataFrame(configs, schema)  # a few configurations
    c = F.col
    states = lambda name: (c("signal_state") == name) | (c("position_state") == name)
    passes = (
        (c("rank_probability") <= c("rank_cap"))
        & ((c("least_p") <= 0) | (c(probability) >= c("least_p")))
        & (F.coalesce("ret_5_rank", F.lit(1.0)) <= c("most_ret_rank"))
        & (c("least_regime").isNull() | (F.coalesce("regime_score", F.lit(0.0)) >= c("least_regime")))
        & (c("risk_off_watch") | (c("signal_state") != "risk_off_divergence_watch"))
        & (c("cooling") | ~states("cooling_or_failed"))
        & (c("extended") | ~states("already_extended"))
    )
    met = ranked.join(F.broadcast(table), passes)
    met = met.withColumn("__by", F.when(c("by_rank"), -c("rank_probability").cast("double")).otherwise(c("strategy_score")))
    return first_rank(met, ["config", date], "__by", ["rank_probability", *key], "place").filter("place <= top_n").drop("__by")


def backtest(ranked: DataFrame, panel: DataFrame, entity: str, date: str, probability: str, hold: int = 5, step: int = 3, bench_n: int = 0, configs: list[dict] = CONFIGS) -> DataFrame:
    """Every ``step``-th date of ``ranked``: each configuration's equal-weight return over ``hold`` dates against the benchmark.

    Prices are the last ones known on each date of the panel's calendar.  The benchmark holds all ranked names, or the first
    ``bench_n``.  No row without an exit date or without a pick that has both prices.
    """
    grid = price_grid(panel, entity, date, "close")
    w = Window.partitionBy(entity).orderBy(date)
    prices = grid.withColumns({"exit_date": F.lead(date, hold).over(w), "__r": F.try_divide(F.lead("close", hold).over(w), F.col("close")) - 1}).drop("close")
    dates = ranked.select(date).distinct()
    dates = dates.withColumn("i", F.row_number().over(Window.orderBy(date)) - 1).filter(F.col("i") % step == 0).select(date)  # a table of dates
    ranked = stored(ranked.join(F.broadcast(dates), date), "rebalance-rows")  # picks, benchmark and regime read it
    held = ranked.join(prices, [date, entity])
    bench = held if not bench_n else held.filter(F.col("rank_probability") <= bench_n)
    bench = bench.groupBy(date).agg(F.avg("__r").alias("bench"), F.count("__r").alias("bench_count"))
    modes = ranked.groupBy(date, "regime").count().groupBy(date).agg(F.min_by("regime", F.struct(-F.col("count"), F.col("regime"))).alias("regime_mode"))
    picks = candidates(ranked, [entity], date, probability, configs).join(prices, [date, entity], "left")
    out = picks.groupBy(date, "config").agg(
        F.max("exit_date").alias("exit_date"), F.avg("__r").alias("ret"), F.count("__r").alias("picks"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("place", entity))), lambda x: x[entity])).alias("names"),  # top_n at most
        F.avg(probability).alias("mean_p"), F.avg("rank_probability").alias("mean_rank"), F.avg("strategy_score").alias("mean_score"),
    ).filter("exit_date is not null and ret is not null")
    middle = ranked.groupBy(date).agg(F.median("regime_score").alias("regime_median"))
    out = out.join(bench, date, "left").join(modes, date).join(middle, date)
    return out.withColumn("excess", F.col("ret") - F.col("bench"))


def strategy_summary(events: DataFrame, date: str) -> DataFrame:
    """Per configuration its events, returns against the benchmark, extremes, drawdown and mean number of picks."""
    w = Window.partitionBy("config").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("__equity", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w)).withColumn("__peak", F.max("__equity").over(w))
    win = lambda c: F.avg((F.col(c) > 0).cast("int"))
    return rows.groupBy("config").agg(
        F.count(F.lit(1)).alias("events"), F.avg("ret").alias("mean_ret"), F.median("ret").alias("median_ret"), win("ret").alias("win_rate"), F.avg("bench").alias("mean_bench"),
        F.avg("excess").alias("mean_excess"), win("excess").alias("excess_win_rate"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
        F.min(F.col("__equity") / F.col("__peak") - 1).alias("max_drawdown"), F.avg("picks").alias("mean_picks"),
    )


def multi_horizon(tables: dict[int, DataFrame], key: list[str], date: str, weights: dict[int, float], within: list[str] | None = None) -> DataFrame:
    """Latest rows of several horizons' rank tables joined by key, with rank scores, their weighted consensus and its place.

    Each table has ``p, rank, flow, momentum`` (and more, named per horizon).  Scores count among the joined rows, or among
    those of the group ``within``; a group of one scores 1.  Tables whose latest dates differ raise an error.
    """
    within, joined = within or [], None
    for h, table in tables.items():
        latest = table.agg(F.max(date).alias("__last"))
        rows = table.join(F.broadcast(latest), table[date] == F.col("__last")).drop("__last")  # one row
        rows = rows.select(*key, F.col(date).alias(f"__date_{h}"), *(F.col(c).alias(f"{c}_{h}") for c in table.columns if c not in (*key, date)))
        joined = rows if joined is None else joined.join(rows, key)
    dates = [F.col(f"__date_{h}") for h in tables]
    same = dates[0] == dates[-1]
    for d in dates[1:-1]:
        same = same & (dates[0] == d)
    joined = joined.withColumn(date, F.when(same, dates[0]).otherwise(F.raise_error(F.lit("rank tables end on different dates")).cast("date"))).drop(*(f"__date_{h}" for h in tables))
    n = F.count(F.lit(1)).over(Window.partitionBy(*within, date))
    score = {h: F.coalesce(1 - F.try_divide(F.col(f"rank_{h}") - 1.0, n - 1.0), F.lit(1.0)) for h in tables}
    joined = joined.withColumns({f"score_{h}": s for h, s in score.items()})
    total = None
    for h, weight in weights.items():
        total = F.col(f"score_{h}") * weight if total is None else total + F.col(f"score_{h}") * weight
    joined = joined.withColumn("consensus", total / sum(weights.values()))
    return first_rank(joined, [*within, date], "consensus", key, "place")


def _flags(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    found = [F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]
    text = F.concat_ws(",", *found)
    return df.withColumns({"categories": F.when(text == "", "watchlist").otherwise(text), "category": F.coalesce(*found, F.lit("watchlist"))})


#: Limits of the group and member categories; fixed values.
GROUP_LIMITS = {"main": 20, "launch_1": 20, "launch_3": 45, "crowd_1": 20, "crowd_mid": 70, "cool_3": 60}
MEMBER_LIMITS = {"main": 5, "launch_1": 5, "launch_3": 12, "crowd_1": 5, "crowd_mid": 15, "cool_3": 12}


def categories(df: DataFrame, limits: dict[str, int], names: dict[str, str], floor: float = 0.55, up: float = 0.5, down: float = -1.0, slow: float = -0.5, catch_up: float | None = None) -> DataFrame:
    """All categories that a joined row (``multi_horizon`` over 1, 3 and 5) meets, and the first one; watchlist if none."""
    r = {h: F.col(f"rank_{h}") for h in (1, 3, 5)}
    main = (r[3] <= limits["main"]) & (r[5] <= limits["main"]) & (F.col("p_3") >= floor)
    rising = F.col("flow_3") >= up
    rules = {"main": main, "launch": (r[1] <= limits["launch_1"]) & (r[3] <= limits["launch_3"]) & rising & ~main}
    if catch_up is not None:
        rules["catch_up"] = (r[3] <= limits["launch_3"]) & rising & (F.col("ret_rank_3") <= catch_up) & ~main
    rules["crowded"] = (r[1] <= limits["crowd_1"]) & ((r[3] > limits["crowd_mid"]) | (r[5] > limits["crowd_mid"]))
    rules["cooling"] = (r[3] <= limits["cool_3"]) & ((F.col("flow_3") <= down) | ((F.col("momentum_3") <= slow) & (F.col("flow_3") <= up)))
    return _flags(df, {names[n]: c for n, c in rules.items()})


#: Names of the categories; fixed values.
GROUP_NAMES = {"main": "mainline_candidate", "launch": "launch_candidate", "crowded": "crowded_short_term", "cooling": "cooling_candidate"}
MEMBER_NAMES = {"main": "leader_candidate", "launch": "launch_candidate", "catch_up": "catchup_candidate", "crowded": "crowded_leader", "cooling": "cooling_stock"}
