"""Signals after a strong rise and a sharp fall: features, selection, retracement plan, score, rebound filter, events and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions.expr import clip, rolling, rounded
from probspark.operators.windows import by, first_rank, low_buy_features

#: Limits of the rules; fixed values.
RULES = {
    "runup": 0.22, "gain": 0.09, "drop": -0.035, "amplitude": 0.075, "turnover": 5.0, "amount": 300_000_000.0, "ma10_break": 0.08,
    "buy_band": 0.008, "deep_band": 0.012, "stop_buffer": 0.015, "entry_gap": 0.03, "hold": 1,
}
#: Limits of the rebound filter and the names of its levels; fixed values.
REBOUND = {"runup": 0.5, "amount": 1_000_000_000.0, "strong_amount": 2_000_000_000.0, "amplitude": 0.14, "extreme": 0.20, "position": 0.65, "low": -0.08, "high": -0.025, "priority": 6, "watch": 4}
LEVELS = ["优先入选", "备选观察", "原始信号/谨慎"]


def signal_features(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Bar features, largest gain of the eight rows before (three at least), and extremes of the rows before (five at least)."""
    w = by(key, [order])
    df = low_buy_features(df, key, order).withColumn("ret_1", F.try_divide(F.col("close"), F.col("prev_close")) - 1)
    before = lambda f, c, n, least: rolling(f(c), F.col(c), w.rowsBetween(-n, -1), least)
    return df.withColumns({
        "max_gain_8": before(F.max, "ret_1", 8, 3), "recent_high_10": before(F.max, "high", 10, 5),
        "recent_low_10": before(F.min, "low", 10, 5), "recent_low_8": before(F.min, "low", 8, 5),
    })


def buy_plan(df: DataFrame, rules: dict = RULES) -> DataFrame:
    """Swing low and high, retracement levels, buying and deep bands, stop and reclaim price, rounded to four digits."""
    c = F.col
    df = df.withColumns({"swing_low": F.coalesce("recent_low_8", "low"), "swing_high": F.greatest("recent_high_10", "high")})
    span, flat = c("swing_high") - c("swing_low"), c("swing_high") <= c("swing_low")
    level = lambda part, fall: F.when(flat, c("low") * fall).otherwise(c("swing_high") - span * part)
    df = df.withColumns({"fib382": level(0.382, 1.0), "fib50": level(0.5, 0.97), "fib618": level(0.618, 0.94)})
    anchor, deep = F.least("low", "fib382"), F.greatest(c("fib50"), F.coalesce("ma10", "close"), c("low") * 0.97)
    df = df.withColumns({
        "buy_low": anchor * (1 - rules["buy_band"]), "buy_high": anchor * (1 + rules["buy_band"]),
        "deep_buy_low": deep * (1 - rules["deep_band"]), "deep_buy_high": deep * (1 + rules["deep_band"]),
        "stop_price": F.least(c("fib618"), deep * (1 - rules["deep_band"])) * (1 - rules["stop_buffer"]),
        "reclaim_price": F.greatest(c("close"), F.coalesce("ma5", "close")),
    })
    names = ["swing_low", "swing_high", "fib382", "fib50", "fib618", "buy_low", "buy_high", "deep_buy_low", "deep_buy_high", "stop_price", "reclaim_price"]
    return df.withColumns({n: rounded(F.col(n), 4) for n in names})


def signal_score(rules: dict = RULES) -> Column:
    """Six clipped linear terms, rounded to six digits."""
    part = lambda x, low, width: clip((x - low) / width, 0.0, 1.0)
    c = F.col
    total = (
        part(c("runup_8"), rules["runup"], 0.25) * 0.25 + part(c("max_gain_8"), rules["gain"], 0.12) * 0.20 + part(c("amplitude"), rules["amplitude"], 0.12) * 0.20
        + part(F.abs("ret_1"), abs(rules["drop"]), 0.10) * 0.15 + part(c("turnover"), rules["turnover"], 15.0) * 0.10 + (1 - part(F.abs("close_to_ma10"), 0.0, 0.12)) * 0.10
    )
    return rounded(total, 6)


def select_signals(featured: DataFrame, rules: dict = RULES) -> DataFrame:
    """Rows that meet all seven conditions, with their plan, score and state."""
    c = F.col
    met = featured.filter(
        (c("runup_8") >= rules["runup"]) & (c("max_gain_8") >= rules["gain"]) & (c("ret_1") <= rules["drop"]) & (c("amplitude") >= rules["amplitude"])
        & (c("turnover") >= rules["turnover"]) & (c("amount") >= rules["amount"]) & (c("close_to_ma10") >= -rules["ma10_break"])
    )
    return buy_plan(met, rules).withColumns({"signal_score": signal_score(rules), "signal_state": F.lit("next_day_low_buy_watch")})


def rebound_filter(signals: DataFrame, limits: dict = REBOUND) -> DataFrame:
    """Eight checks as a weighted score (the run-up counts twice) and a level; an unknown value meets no check.

    ``rank_in_day`` is the signal's place by score among those of its date.
    """
    c = F.col
    position = F.try_divide(c("close") - c("recent_low_10"), c("recent_high_10") - c("recent_low_10"))
    checks = {
        "runup": c("runup_8") >= limits["runup"], "amount": c("amount") >= limits["amount"], "strong_amount": c("amount") >= limits["strong_amount"],
        "amplitude": c("amplitude") >= limits["amplitude"], "extreme": c("amplitude") >= limits["extreme"], "position": position >= limits["position"],
        "rank": c("rank_in_day") <= 4, "discount": (c("buy_high") / c("close") - 1).between(limits["low"], limits["high"]),
    }
    df = signals.withColumns({f"{n}_ok": F.coalesce(x, F.lit(False)) for n, x in checks.items()})
    score = F.col("runup_ok").cast("int") * 2
    for n in list(checks)[1:]:
        score = score + F.col(f"{n}_ok").cast("int")
    df = df.withColumn("rebound_score", score)
    first = (c("rebound_score") >= limits["priority"]) & c("runup_ok") & c("amount_ok") & c("position_ok")
    return df.withColumn("level", F.when(first, LEVELS[0]).when((c("rebound_score") >= limits["watch"]) & c("runup_ok"), LEVELS[1]).otherwise(LEVELS[2]))


def next_rows(df: DataFrame, key: list[str], order: str, rows: int) -> DataFrame:
    """Date and bar of the next rows as ``t1_date, t1_open, ...``: taken before any filter, in the features' own sort."""
    w = by(key, [order])
    return df.withColumns({f"t{k}_{c}": F.lead(s, k).over(w) for k in range(1, rows + 1) for c, s in (("date", order), ("open", "open"), ("high", "high"), ("low", "low"), ("close", "close"))})


def signal_events(panel: DataFrame, key: list[str], order: str, rules: dict = RULES) -> DataFrame:
    """Signals with the next row as entry and the one ``hold`` later as exit; no event without an exit.

    A plan is touched when the entry row doesn't open too high and meets the buying band; an untouched one returns 0.
    """
    last = 1 + rules["hold"]
    featured = next_rows(signal_features(panel, key, order), key, order, last)
    df = select_signals(featured, rules).filter(F.col(f"t{last}_date").isNotNull())
    touched = (F.col("t1_open") / F.col("close") - 1 <= rules["entry_gap"]) & (F.col("t1_low") <= F.col("buy_high")) & (F.col("t1_high") >= F.col("buy_low"))
    ret = F.when(F.col("touched"), F.col(f"t{last}_close") / F.col("buy_high") - 1)
    df = df.withColumn("touched", F.coalesce(touched, F.lit(False))).withColumn("ret", ret)
    df = df.withColumns({"planned": F.coalesce("ret", F.lit(0.0)), "entry_date": F.col("t1_date"), "exit_date": F.col(f"t{last}_date")})
    return first_rank(df.withColumnRenamed(order, "signal_date"), ["signal_date"], "signal_score", key, "rank_in_day")


def event_summary(events: DataFrame, by_: list[str]) -> DataFrame:
    win = F.avg((F.col("ret") > 0).cast("int").cast("double"))
    return events.groupBy(*by_).agg(
        F.count(F.lit(1)).alias("signals"), F.count_if("touched").alias("triggered"), F.avg(F.col("touched").cast("int")).alias("rate"), F.avg("ret").alias("mean_ret"),
        F.median("ret").alias("median_ret"), win.alias("win_rate"), F.max("ret").alias("best"), F.min("ret").alias("worst"), F.avg("planned").alias("mean_planned"),
    )


def split_labels(day: Column, train_end: str, test_start: str) -> Column:
    """The splits that a date belongs to, as rows."""
    return F.explode(F.array_compact(F.array(F.lit("all"), F.when(day <= train_end, "in_sample"), F.when(day >= test_start, "out_of_sample"))))


def split_summary(events: DataFrame, train_end: str, test_start: str) -> DataFrame:
    """Per split the event summary, its number of days, mean daily return and drawdown of the daily portfolio."""
    df = events.withColumn("split", split_labels(F.col("signal_date"), train_end, test_start))
    daily = df.groupBy("split", "signal_date").agg(F.avg("planned").alias("day"))
    w = Window.partitionBy("split").orderBy("signal_date").rowsBetween(Window.unboundedPreceding, 0)  # a row per date
    daily = daily.withColumn("equity", F.product(1 + F.col("day")).over(w)).withColumn("peak", F.max("equity").over(w))
    daily = daily.groupBy("split").agg(F.count(F.lit(1)).alias("days"), F.avg("day").alias("daily_mean"), F.min(F.col("equity") / F.col("peak") - 1).alias("daily_drawdown"))
    return event_summary(df, ["split"]).join(daily, "split")


def rebound_outcomes(panel: DataFrame, key: list[str], order: str, rules: dict = RULES, big: float = 0.10) -> DataFrame:
    """Signals with the next three rows: touches, returns from the band's upper edge, their maxima and large rebounds.

    Rows that end before the third one keep what is known.
    """
    df = select_signals(next_rows(signal_features(panel, key, order), key, order, 3), rules)
    high, close = F.col("buy_high"), F.col("close")
    for k in (1, 2, 3):
        before = close if k == 1 else F.col(f"t{k - 1}_close")
        df = df.withColumns({
            f"t{k}_pct_change": (F.col(f"t{k}_close") / before - 1) * 100,
            f"t{k}_touch": (F.col(f"t{k}_low") <= high) & (F.col(f"t{k}_high") >= F.col("buy_low")),
            f"t{k}_high_ret": F.col(f"t{k}_high") / high - 1,
            f"t{k}_close_ret": F.col(f"t{k}_close") / high - 1,
        })
    df = df.withColumns({f"max_{c}_{a}_3": F.greatest(*(f"t{k}_{c}_ret" for k in range(a, 4))) if a < 3 else F.col(f"t3_{c}_ret") for c in ("high", "close") for a in (1, 2)})
    return df.withColumns({"t1_big": F.col("t1_high_ret") >= big, "t2_t3_big": F.col("max_high_2_3") >= big, "big": F.col("max_high_1_3") >= big})
