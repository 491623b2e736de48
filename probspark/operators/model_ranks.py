"""From bars to ranks by a fitted model: features, labels, walk-forward and latest scores, rank table, report.

Every date is scored by a model of rows whose label was known before it, the last date too, whose labels aren't known yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probspark.operators import models
from probspark.operators import turning as T
from probspark.operators.scoring import rank_quality
from probspark.sources.stored import stored

#: What the model sees: bar shapes, ranks in the date with their flows, the two scores, and the date's context.
BAR_FEATURES = [
    "ret_1", "ret_3", "ret_5", "ret_10", "amount_ratio_5_20", "amount_acceleration", "volatility_ratio_5_20", "volatility_compression", "ma_gap_5_20",
    "price_reclaim_5", "price_reclaim_20", "drawdown_20", "rebound_20", "intraday_position", "upper_shadow", "lower_shadow",
]
RANK_FEATURES = [*T.RANKED.values(), "ret_flow_3", "amount_flow_3", "divergence_score", "visibility_score", "divergence_rank", "visibility_rank"]
CONTEXT_FEATURES = [
    "ret_1_median", "ret_3_median", "ret_5_median", "ret_10_median", "amount_ratio_5_20_median", "volatility_ratio_5_20_median", "intraday_median",
    "ret_5_dispersion", "breadth_up_1", "breadth_up_5", "breadth_above_ma20", "breadth_expand", "regime_score", "regime_score_ma5", "regime_score_5_delta",
]
FEATURES = [*BAR_FEATURES, *RANK_FEATURES, *CONTEXT_FEATURES]


def model_table(panel: DataFrame, key: list[str], date: str, horizon: int = 3, quantile: float = 0.8, least_runup: float = 0.1) -> DataFrame:
    """Bars with all ``FEATURES``, the regime and the turn labels of ``horizon``, stored: fits and scores read it several times."""
    bars = stored(T.bar_features(panel, key, date, (horizon,)), "bars")  # the context and its join read it
    context = T.daily_context(bars, date).select(date, *CONTEXT_FEATURES, "regime")
    scored = T.turning_scores(bars.join(context, date), key, date)
    return stored(T.turning_labels(scored, date, (horizon,), quantile, least_runup), "model-table")


def model_scores(table: DataFrame, features: list[str], label: str, date: str, first: int, refit_every: int, embargo_months: int, kind: str = "logistic", rounds: int = 200) -> DataFrame | None:
    """Labelled rows from the ``first``-th of their dates on with the probability ``p`` of the latest refit, and the rows of the table's last date.

    Rows that lack a feature are neither learned from nor scored.  A refit comes every ``refit_every`` dates; the last date is
    scored by a model of its own where its labels aren't known.  None without rows of both classes to learn from.
    """
    complete = stored(table.dropna(subset=features), "complete")
    labelled = complete.filter(F.col(label).isNotNull())
    dates = models._dates(labelled, date)
    history = models.walk_forward(labelled, features, label, date, dates[first::refit_every], embargo_months, kind, rounds)
    latest = models.score_latest(complete, features, label, date, dates[-1], embargo_months, kind, rounds) if dates else None
    if history is None or latest is None:
        return history if latest is None else latest
    return history.unionByName(latest)


def model_ranks(scores: DataFrame, key: list[str], date: str, top_n: int = 10) -> DataFrame:
    """Scored rows with rank, probability flow and momentum, signal state and strategy score of the model's probability."""
    return T.strategy_score(T.rank_table(scores, key, date, "p", top_n), date)


def model_report(ranks: DataFrame, panel: DataFrame, entity: str, date: str, label: str, forward: str, top_n: int = 5) -> DataFrame:
    """Per configuration its backtest's summary, each with the quality of the probabilities over all labelled rows (``auc``, ``brier``, hit rates)."""
    known = ranks.filter(F.col(label).isNotNull()).select(date, entity, "p", F.col(label).alias("y"), "rank_probability", forward)
    quality = rank_quality(stored(known, "known"), date=date, entity=entity, rank="rank_probability", forward=forward, top_n=top_n)
    summary = T.strategy_summary(T.backtest(ranks, panel, entity, date, "p"), date)
    return summary.join(F.broadcast(quality), F.lit(True))  # one row
