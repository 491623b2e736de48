"""Logistic models of many folds, fitted side by side: every fold trains on all rows before its own cutoff date.

A labelled row belongs to the first fold whose cutoff lies after it, and to all later ones.  Counts, sums and ranges of values per
first fold therefore give every fold's medians, scales and class balance as running sums, and one pass over the rows gives the
gradients and Hessians of all folds for a Newton step.  No row is copied to several folds, and no fold reads the table for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.operators.ranks import BEFORE
from probspark.sources.stored import stored

STEPS = 50


@dataclass
class Folds:
    """One model per fold: medians, means and scales of the features (folds x features), coefficients with the intercept last; rows 0 mean no model."""

    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray  # of class 0 and 1
    rows: np.ndarray
    beta: np.ndarray

    def design(self, x: np.ndarray, k: int) -> np.ndarray:
        x = (np.where(np.isnan(x), self.medians[k], x) - self.means[k]) / self.scales[k]
        return np.column_stack([x, np.ones(len(x))])


def first_fold(date: str, cutoffs: list) -> Column:
    """The first fold whose cutoff (ascending) lies after the row's date; their number where none does."""
    if not cutoffs:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(c).cast("date") for c in cutoffs)), lambda c: c <= F.col(date).cast("date")))


def running_medians(train: DataFrame, features: list[str], n_folds: int) -> np.ndarray:
    """Exact medians (folds x features) of the rows with ``fold`` up to each fold; 0 for a feature without values."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("of"), F.col(c).alias("v")) for i, c in enumerate(features))))
    long = train.select("fold", values.alias("x")).select("fold", "x.of", "x.v").filter("v is not null")
    counts = long.groupBy("of", "v", "fold").agg(F.count(F.lit(1)).alias("n"))
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = stored(counts.repartitionByRange(parts, "of", "v").withColumn("range", F.spark_partition_id()), "fold-values")
    sums = held.groupBy("of", "range", "fold").agg(F.sum("n").alias("n")).collect()  # ranges x features x folds
    ranges = max((r.range for r in sums), default=0) + 1
    table = np.zeros((len(features), ranges, n_folds), np.int64)
    for r in sums:
        table[r.of, r.range, r.fold] += r.n
    table = table.cumsum(2)  # rows of each range that a fold trains on
    before = table.cumsum(1) - table
    total = table.sum(1)
    wanted = []
    for of in range(len(features)):
        for k in range(n_folds):
            for half, place in ((0, (total[of, k] - 1) // 2), (1, total[of, k] // 2)):
                if total[of, k]:
                    at = int(np.searchsorted(np.cumsum(table[of, :, k]), place, side="right"))
                    wanted.append((of, k, half, at, int(place - before[of, at, k])))
    out = np.zeros((n_folds, len(features), 2))
    if wanted:
        asked = train.sparkSession.createDataFrame(wanted, "of int, k int, half int, range int, place long")
        own = held.join(F.broadcast(asked), ["of", "range"]).filter("fold <= k").groupBy("of", "k", "half", "place", "v").agg(F.sum("n").alias("n"))  # features x folds x 2 rows
        start = F.coalesce(F.sum("n").over(Window.partitionBy("of", "k", "half").orderBy("v").rowsBetween(*BEFORE)), F.lit(0))
        for r in own.withColumn("start", start).filter("start <= place and place < start + n").collect():
            out[r.k, r.of, r.half] = r.v
    return out.mean(2)


def _statistics(train: DataFrame, features: list[str], label: str, n_folds: int) -> Folds:
    medians = running_medians(train, features, n_folds)
    middle = np.array([v or 0.0 for v in train.agg(*(F.avg(c) for c in features)).first()])  # sums of squares around it keep their digits
    parts = [F.count(F.lit(1)), F.sum(label)]
    for c, m in zip(features, middle.tolist(), strict=True):
        parts += [F.count(c), F.sum(F.col(c) - m), F.sum((F.col(c) - m) ** 2)]
    per = np.zeros((n_folds, 2 + 3 * len(features)))
    for r in train.groupBy("fold").agg(*(p.alias(f"s{i}") for i, p in enumerate(parts))).collect():  # one row per fold
        per[r.fold] = [r[f"s{i}"] or 0.0 for i in range(len(parts))]
    per = per.cumsum(0)
    n, ones = per[:, :1], per[:, 1]
    known, total, squares = (per[:, 2 + i :: 3] for i in range(3))
    filled = medians - middle
    with np.errstate(all="ignore"):
        mean = (total + (n - known) * filled) / n
        var = (squares + (n - known) * filled**2 - n * mean**2) / np.maximum(n - 1, 1)
        scale = np.sqrt(np.maximum(var, 0))
        weights = np.stack([n[:, 0] / (2 * (n[:, 0] - ones)), n[:, 0] / (2 * ones)], axis=1)
    usable = (ones > 0) & (ones < n[:, 0])
    scale = np.where(scale > 1e-12, scale, 1.0)
    return Folds(medians, np.nan_to_num(mean) + middle, scale, np.where(usable[:, None], weights, 0.0), np.where(usable, n[:, 0], 0).astype(int), np.zeros((n_folds, len(features) + 1)))


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features], axis=1) if len(batch) else np.zeros((0, len(features)))


def _newton(train: DataFrame, features: list[str], label: str, model: Folds, open_: list[int]) -> np.ndarray:
    """Sums over all rows of each open fold's gradient and Hessian (folds x (d + 1) x (d + 2))."""
    d = len(features) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(open_), d, d + 1))
        for batch in batches:
            x, y, fold = _matrix(batch, features), batch.column(label).to_numpy().astype(int), batch.column("fold").to_numpy()
            for i, k in enumerate(open_):
                own = fold <= k
                z = model.design(x[own], k)
                p, w = 1 / (1 + np.exp(-(z @ model.beta[k]))), model.weights[k][y[own]]
                total[i, :, 0] += z.T @ (w * (p - y[own]))
                total[i, :, 1:] += z.T @ (z * (w * p * (1 - p))[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["slot", "v"])

    found = train.mapInArrow(run, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()  # a row per number of the models
    out = np.zeros(len(open_) * d * (d + 1))
    out[found.column("slot").to_numpy()] = found.column("v").to_numpy()
    return out.reshape(len(open_), d, d + 1)


def fit_folds(panel: DataFrame, features: list[str], label: str, date: str, cutoffs: list) -> Folds:
    """A model per cutoff (ascending): balanced classes, scaled features, a penalty of one half on the squares of the coefficients.

    Rows without a label, or not before any cutoff, train nothing.  A fold with one class has no model.
    """
    n = len(cutoffs)
    train = panel.filter(F.col(label).isNotNull() & F.col(date).isNotNull()).select(first_fold(date, cutoffs).alias("fold"), F.col(label).cast("double").alias(label), *(F.col(c).cast("double").alias(c) for c in features))
    train = stored(train.filter(F.col("fold") < n), "fold-rows")
    model = _statistics(train, features, label, n)
    penalty = np.diag([1.0] * len(features) + [0.0])
    open_ = np.flatnonzero(model.rows).tolist()
    for _ in range(STEPS):
        if not open_:
            break
        sums = _newton(train, features, label, model, open_)
        left = []
        for k, own in zip(open_, sums, strict=True):
            step = np.linalg.solve(own[:, 1:] + penalty + 1e-12 * np.eye(len(penalty)), own[:, 0] + penalty @ model.beta[k])
            model.beta[k] -= step * min(1.0, 5.0 / np.abs(step).max(initial=1e-12))
            if np.abs(step).max() > 1e-9:
                left.append(k)
        open_ = left
    return model


def score_folds(rows: DataFrame, features: list[str], date: str, starts: list, model: Folds) -> DataFrame:
    """``rows`` from the first start on with ``p`` of the fold whose start is the last one not after them, and its number ``fold``; rows of folds without a model are left out."""
    kept = rows.columns
    numbered = rows.filter(F.col(date) >= F.lit(starts[0])).withColumn("fold", first_fold(date, starts) - 1)
    names = [f"__x{i}" for i in range(len(features))]
    numbered = numbered.select(*kept, "fold", *(F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _matrix(batch, names), batch.column("fold").to_numpy()
            p = np.full(len(x), np.nan)
            for k in np.unique(fold).tolist():
                if model.rows[k]:
                    own = fold == k
                    p[own] = 1 / (1 + np.exp(-(model.design(x[own], k) @ model.beta[k])))
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*kept, "fold"]), pa.array(p)], [*kept, "fold", "p"])
            yield out.filter(pa.array(~np.isnan(p)))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "fold int, p double"])
    return numbered.mapInArrow(run, schema)
