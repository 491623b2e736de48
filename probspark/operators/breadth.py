"""Breadth snapshots of groups: parsed records, scores, confirmation, changes since the last snapshot and dashboard groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions.expr import rank_pct
from probspark.operators.windows import first_rank

#: Dashboard groups in order of priority; fixed values.
GROUPS = [
    "confirmed_turning_candidate", "resilient_watchlist", "breadth_unconfirmed_watchlist", "breadth_improving_watchlist",
    "model_high_breadth_weak", "already_extended", "cooling_or_failed", "neutral_or_wait",
]
#: Factors of the blended score in weak markets; fixed values.
REGIME_FACTOR = {"risk_off": 0.86, "mixed": 0.95}
DELTAS = ["board_change", "up_ratio", "rank_strength", "net_inflow", "amount", "turn_breadth", "rank_turn_breadth"]


def parse_number(text: Column) -> Column:
    """The first signed number of a text without thousands separators; null for an empty text, ``--`` or none."""
    return F.regexp_extract(F.replace(F.trim(text), F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def parse_pair(text: Column) -> tuple[Column, Column]:
    """Both numbers of ``a/b``; null without such a pair."""
    pattern = r"(-?\d+)\s*/\s*(-?\d+)"
    return F.regexp_extract(text, pattern, 1).try_cast("long"), F.regexp_extract(text, pattern, 2).try_cast("long")


def parse_percent(text: Column) -> Column:
    return parse_number(F.replace(text, F.lit("%"), F.lit("")))


def wide_records(info: DataFrame, key: list[str], items: dict[str, str]) -> DataFrame:
    """Item and value rows of a snapshot as one record: pairs, percents and numbers parsed, up_ratio and rank_strength derived.

    ``items`` names the text of each field: ``up_down, place, board_change, net_inflow, amount, volume, open, previous_close, high, low``.
    """
    wide = info.groupBy(*key).pivot("item", list(items.values())).agg(F.max("value"))
    at = lambda name: F.col(f"`{items[name]}`")
    up, down = parse_pair(at("up_down"))
    rank, total = parse_pair(at("place"))
    numbers = {n: parse_number(at(n)) for n in items if n not in ("up_down", "place", "board_change")}
    return wide.select(
        *key, up.alias("up_count"), down.alias("down_count"), F.try_divide(up, up + down).alias("up_ratio"), rank.alias("place"), total.alias("places"),
        F.when(total > 1, 1 - (rank - 1) / (total - 1)).alias("rank_strength"), parse_percent(at("board_change")).alias("board_change"), *(c.alias(n) for n, c in numbers.items()),
    )


def breadth_scores(df: DataFrame, snapshot: list[str], tie: list[str], probability: str) -> DataFrame:
    """Breadth of a group's members blended with the model's rank and its position, less in weak markets; place and change of place.

    Rows have ``up_ratio, rank_strength, board_change, net_inflow, amount, divergence_rank, visibility_rank, regime, rank_probability``.
    """
    zero, half = F.lit(0.0), F.lit(0.5)
    rank = lambda c, fill: rank_pct(F.coalesce(c, fill), snapshot)
    df = df.withColumns({
        "member_breadth": F.coalesce("up_ratio", half) * 0.32 + F.coalesce("rank_strength", half) * 0.22 + rank("board_change", zero) * 0.14 + rank("net_inflow", zero) * 0.20 + rank("amount", zero) * 0.12,
        "model_score": rank_pct(F.col(probability), snapshot),
        "position_score": rank("divergence_rank", half) * 0.55 + rank("visibility_rank", half) * 0.45,
    })
    factor = F.coalesce(*(F.when(F.col("regime") == n, f) for n, f in REGIME_FACTOR.items()), F.lit(1.0))
    blend = F.col("model_score") * 0.52 + rank_pct(F.col("member_breadth"), snapshot) * 0.30 + rank_pct(F.col("position_score"), snapshot) * 0.18
    df = df.withColumn("turn_breadth", blend * factor)
    df = first_rank(df, snapshot, "turn_breadth", tie, "rank_turn_breadth")
    df = df.withColumn("rank_change", F.col("rank_probability") - F.col("rank_turn_breadth"))
    return df.withColumn("confirmation", confirmation_state(F.col("member_breadth"), F.col("up_ratio"), F.col("rank_strength"), F.col("net_inflow"), F.col("regime")))


def rotation_breadth(df: DataFrame, snapshot: list[str], tie: list[str], probability: str) -> DataFrame:
    """The variant without position and regime: breadth, its blend with the probability's rank, place and change of place."""
    zero, half = F.lit(0.0), F.lit(0.5)
    rank = lambda c: rank_pct(F.coalesce(c, zero), snapshot)
    breadth = F.coalesce("up_ratio", half) * 0.35 + F.coalesce("rank_strength", half) * 0.25 + rank("board_change") * 0.10 + rank("net_inflow") * 0.20 + rank("amount") * 0.10
    df = df.withColumn("breadth", breadth)
    df = df.withColumn("breadth_blend", rank_pct(F.col(probability), snapshot) * 0.65 + rank_pct(F.col("breadth"), snapshot) * 0.35)
    df = first_rank(df, snapshot, "breadth_blend", tie, "rank_breadth")
    return df.withColumn("rank_breadth_change", F.col("rank_probability") - F.col("rank_breadth"))


def confirmation_state(score: Column, up_ratio: Column, strength: Column, inflow: Column, regime: Column) -> Column:
    zero = F.lit(0.0)
    return (
        F.when(score.isNull(), "breadth_unknown").when((regime == "risk_off") & (score >= 0.62), "risk_off_breadth_resilient")
        .when((score >= 0.68) & (F.coalesce(up_ratio, zero) >= 0.58), "breadth_confirmed")
        .when((score >= 0.55) & ((F.coalesce(strength, zero) >= 0.55) | (F.coalesce(inflow, zero) > 0)), "breadth_improving")
        .when(score <= 0.42, "breadth_weak").otherwise("breadth_neutral")
    )


def snapshot_deltas(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """Each row with the time of the key's snapshot before it, the seven changes since and the intraday state."""
    w = Window.partitionBy(*key).orderBy(at)
    df = df.withColumns({"previous_at": F.lag(at).over(w)} | {f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in DELTAS})
    return df.withColumn("intraday_state", intraday_state())


def intraday_state() -> Column:
    """From confirmation, place and changes; a change that isn't known meets no condition."""
    board, up, inflow, score = (F.col(f"{c}_delta") for c in ("board_change", "up_ratio", "net_inflow", "turn_breadth"))
    place, confirmed = F.coalesce(F.col("rank_turn_breadth"), F.lit(9999)), F.col("confirmation").isin("breadth_confirmed", "risk_off_breadth_resilient")
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(score.isNull(), "intraday_first_snapshot")
        .when((place <= 10) & confirmed & (board >= 0) & (up >= 0), "intraday_confirming")
        .when((place <= 15) & (score >= 0.03) & (board > 0), "intraday_accelerating")
        .when((F.col("confirmation") == "breadth_improving") & (score > 0) & (no(up > 0) | no(inflow > 0)), "intraday_recovering")
        .when(no(board <= -0.5) | no(up <= -0.08) | (no(score < 0) & no(inflow < 0)), "intraday_fading")
        .otherwise("intraday_watch")
    )


def dashboard(df: DataFrame) -> DataFrame:
    """``dashboard_group`` from place, confirmation, position, signal and regime, and its ``priority``."""
    place, confirmation = F.coalesce(F.col("rank_turn_breadth"), F.lit(9999)), F.col("confirmation")
    strong = (place <= 10) & confirmation.isin("breadth_confirmed", "risk_off_breadth_resilient")
    group = (
        F.when(strong & (F.col("regime") == "risk_off"), GROUPS[1]).when(strong, GROUPS[0])
        .when((place <= 10) & (confirmation == "breadth_neutral"), GROUPS[2])
        .when((place <= 15) & (confirmation == "breadth_improving"), GROUPS[3])
        .when((confirmation == "breadth_weak") & (place <= 20), GROUPS[4])
        .when(F.col("position_state") == "already_extended", GROUPS[5])
        .when(F.coalesce(F.col("signal_state").contains("cooling"), F.lit(False)) | (F.col("position_state") == "cooling_or_failed"), GROUPS[6])
        .otherwise(GROUPS[7])
    )
    priority = F.coalesce(*(F.when(F.col("dashboard_group") == g, i + 1) for i, g in enumerate(GROUPS)), F.lit(9))
    return df.withColumn("dashboard_group", group).withColumn("priority", priority)
