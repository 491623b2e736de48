"""Scoring of panel rows with a classifier that is fitted on earlier dates only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probspark.operators import boosting, folds
from probspark.sources.stored import stored


def classifier(features: list[str], label: str, rows: int) -> Pipeline:
    """Median imputation, then a scaled logistic model with balanced classes (column ``weight``).

    The penalty is 1/``rows`` on scaled features, that of one unit on the sum of losses.
    """
    filled = [f"{c}__filled" for c in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw")]
    scaler = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True)
    return Pipeline(stages=[*stages, scaler, LogisticRegression(featuresCol="__scaled", labelCol=label, weightCol="weight", maxIter=2000, regParam=1 / max(rows, 1), standardization=False)])


def balanced(train: DataFrame, label: str) -> tuple[DataFrame, int] | None:
    """Training rows with weights that make both classes count the same, and their number; None where there is one class only."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    weight = reduce(lambda c, kv: c.when(F.col(label) == kv[0], total / (2 * kv[1])), counts.items(), F.when(F.lit(False), 1.0))
    return train.withColumn("weight", weight), total


def fold(panel: DataFrame, features: list[str], label: str, date: str, start, end, embargo_months: int, kind: str, rounds: int) -> DataFrame | None:
    """Rows from ``start`` up to ``end`` (all later ones for None), scored by a model of rows whose label was known by then; None without both classes."""
    known = panel.filter(F.col(label).isNotNull() & (F.col(date) < F.add_months(F.lit(start), -embargo_months)))
    rows = panel.filter((F.col(date) >= F.lit(start)) & (F.lit(True) if end is None else F.col(date) < F.lit(end)))
    if kind == "boosted":
        model = boosting.fit(known, features, label, rounds)
        scored = None if model is None else model.scored(rows)
    elif kind == "logistic":
        train = balanced(known, label)
        scored = None if train is None else classifier(features, label, train[1]).fit(train[0]).transform(rows).withColumn("p", vector_to_array("probability")[1])
    else:
        raise ValueError(f"unknown model: {kind}")
    if scored is None:
        return None
    return scored.select(*panel.columns, "p", F.lit(str(start)).alias("trained_until"), F.lit(embargo_months).alias("embargo"))


def side_by_side(panel: DataFrame, features: list[str], label: str, date: str, starts: list, until, embargo_months: int) -> DataFrame | None:
    """Rows from the first of ``starts`` on (up to ``until``), each scored by the logistic model of its fold; all folds are fitted together."""
    if not starts:
        return None
    spark = panel.sparkSession
    cutoffs = spark.range(1).select(*(F.add_months(F.lit(s), -embargo_months).alias(f"c{i}") for i, s in enumerate(starts))).first()
    model = folds.fit_folds(panel, features, label, date, list(cutoffs))
    if not model.rows.any():
        return None
    rows = panel if until is None else panel.filter(F.col(date) <= F.lit(until))
    scored = folds.score_folds(rows, features, date, starts, model)
    names = F.array(*(F.lit(str(s)) for s in starts))
    return scored.select(*panel.columns, "p", F.get(names, F.col("fold")).alias("trained_until"), F.lit(embargo_months).alias("embargo"))


def walk_forward(panel: DataFrame, features: list[str], label: str, date: str, refits: list, embargo_months: int, kind: str = "logistic", rounds: int = 200) -> DataFrame | None:
    """Rows from each refit date to the next, scored by a model of rows whose label was known ``embargo_months`` before it.

    A label with a horizon is known only later; the embargo keeps such rows out (0 leaves them in).  Logistic folds are fitted side
    by side, boosted ones one after the other over the stored panel; folds with one class are left out.
    """
    if kind == "logistic":
        return side_by_side(panel, features, label, date, refits, None, embargo_months)
    panel = stored(panel, "folds")
    parts = [fold(panel, features, label, date, start, end, embargo_months, kind, rounds) for start, end in zip(refits, [*refits[1:], None], strict=True)]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _dates(panel: DataFrame, date: str) -> list:
    return [r[0] for r in panel.select(date).filter(F.col(date).isNotNull()).distinct().orderBy(date).collect()]  # a calendar


def score_latest(panel: DataFrame, features: list[str], label: str, date: str, history_until, embargo_months: int, kind: str = "logistic", rounds: int = 200) -> DataFrame | None:
    """The last date's rows, labelled or not, scored by a model of all earlier ones; None where the history reaches it already."""
    last = _dates(panel, date)[-1]
    if history_until is not None and last <= history_until:
        return None
    return fold(panel, features, label, date, last, None, embargo_months, kind, rounds)


def score_dates(panel: DataFrame, features: list[str], label: str, date: str, at, look_back: int, embargo_months: int, kind: str = "logistic", rounds: int = 200) -> DataFrame | None:
    """The ``look_back`` dates up to ``at``, each scored by a model of the dates before it, so that flows can be taken."""
    dates = _dates(panel, date)
    if at not in dates:
        raise ValueError(f"no rows on {at}")
    until = dates.index(at)
    wanted = dates[max(0, until - look_back + 1) : until + 1]
    if kind == "logistic":
        return side_by_side(panel, features, label, date, wanted, at, embargo_months)
    panel = stored(panel.filter(F.col(date) <= F.lit(at)), "folds")
    after = [*dates, None]
    parts = [fold(panel, features, label, date, d, after[dates.index(d) + 1], embargo_months, kind, rounds) for d in wanted]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None
