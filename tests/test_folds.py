"""Folds that are fitted side by side against one plain fit for each."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from probspark.operators import folds, models

FEATURES = ["a", "b", "flat"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(12)
    rows = []
    for m in range(24):
        for e in range(25):
            a, b = float(rng.normal() + m / 10), float(rng.choice([0.0, 1.0, 5.0]))
            y = int(rng.random() < 1 / (1 + np.exp(-(a - 1 - b / 3))))
            rows.append((e, date(2001 + m // 12, m % 12 + 1, 1), None if rng.random() < 0.1 else a, None if e == 3 else b, 2.0, None if m > 21 or rng.random() < 0.05 else y))
    return spark.createDataFrame(rows, "e int, dt date, a double, b double, flat double, y int").repartition(4)


def plain(known, rows):
    """Medians, scales, balanced classes and a penalised fit by Newton steps, on one fold's rows."""
    x, y = known[FEATURES].to_numpy(float), known.y.to_numpy(float)
    med = np.nanmedian(x, axis=0)
    fill = lambda v: np.where(np.isnan(v), med, v)
    mean, sd = fill(x).mean(0), fill(x).std(0, ddof=1)
    sd = np.where(sd > 1e-12, sd, 1.0)
    z = lambda v: np.column_stack([(fill(v) - mean) / sd, np.ones(len(v))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, pen = np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z(x) @ beta))
        beta -= np.linalg.solve(z(x).T @ (z(x) * (w * p * (1 - p))[:, None]) + pen + 1e-12 * np.eye(4), z(x).T @ (w * (p - y)) + pen @ beta)
    return med, 1 / (1 + np.exp(-z(rows[FEATURES].to_numpy(float)) @ beta))


@pytest.mark.parametrize("embargo", [0, 3])
def test_each_fold_is_that_of_its_own_rows(panel, embargo):
    starts = [date(2001, m, 1) for m in (2, 6, 9, 12)] + [date(2002, 8, 1)]
    got = models.walk_forward(panel, FEATURES, "y", "dt", starts, embargo).toPandas()
    all_rows = panel.toPandas()
    seen = 0
    for k, start in enumerate(starts):
        month = start.year * 12 + start.month - 1 - embargo
        cutoff = date(month // 12, month % 12 + 1, 1)
        known = all_rows[all_rows.y.notna() & (all_rows.dt < cutoff)]
        end = starts[k + 1] if k + 1 < len(starts) else date(2100, 1, 1)
        rows = all_rows[(all_rows.dt >= start) & (all_rows.dt < end)].sort_values(["dt", "e"])
        own = got[got.trained_until == str(start)].sort_values(["dt", "e"])
        if known.y.nunique() < 2:
            assert own.empty
            continue
        assert own.p.tolist() == pytest.approx(plain(known, rows)[1].tolist(), abs=1e-7)
        seen += len(rows)
    assert seen == len(got) > 300


def test_running_medians_are_exact(panel):
    cutoffs = [date(2001, 3, 1), date(2001, 4, 1), date(2002, 5, 1)]
    train = panel.filter("y is not null").select(folds.first_fold("dt", cutoffs).alias("fold"), *FEATURES).filter("fold < 3")
    got = folds.running_medians(train, FEATURES, 3)
    rows = train.toPandas()
    for k in range(3):
        assert got[k].tolist() == pytest.approx(np.nanmedian(rows[rows.fold <= k][FEATURES].to_numpy(float), axis=0).tolist())


def test_dates_scored_by_the_dates_before(panel):
    scored = models.score_dates(panel, FEATURES, "y", "dt", date(2002, 10, 1), 3, 0)
    assert {r.dt for r in scored.collect()} == {date(2002, m, 1) for m in (8, 9, 10)}
    assert scored.filter(F.col("trained_until") != F.col("dt").cast("string")).count() == 0
    with pytest.raises(ValueError):
        models.score_dates(panel, FEATURES, "y", "dt", date(2010, 1, 1), 3, 0)
