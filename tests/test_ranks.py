"""Ranks and quantiles by ranges against plain versions: ties, nulls, a value and a key with a third of all rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probspark.operators import ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    keys = [*["hot"] * 6, "a", "b", None]
    values = lambda: rng.choice([None, 0.0, 0.0, -0.0, 1.0, rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randint(-3, 3)), 1e300])
    out = [(rng.choice(keys), i, values(), values()) for i in range(900)] + [("hot", 1000 + i, 5.0, None) for i in range(450)]
    return out + [("only nulls", 2000, None, None), ("one", 2001, 7.0, None)] + out[:5]  # some rows twice


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, i long, x double, y double").repartition(5)


def test_average_ranks(df, rows):
    got = {(r.k, r.i): (r.rx, r.ry) for r in ranks.rank_percentiles(df, ["k"], {"rx": "x", "ry": "y"}).collect()}
    table = pd.DataFrame(rows, columns=["k", "i", "x", "y"])
    table["k"] = table.k.fillna("null key")
    want = {c: table.groupby("k")[c].rank(pct=True, method="average") for c in ("x", "y")}
    assert len(got) == len(set(zip(table.k, table.i)))
    for n in range(len(table)):
        key = (None if table.k[n] == "null key" else table.k[n], table.i[n])
        for g, w in zip(got[key], (want["x"][n], want["y"][n]), strict=True):
            assert (g is None) == np.isnan(w) and (g is None or g == pytest.approx(w, abs=1e-12))


def test_first_ranks(df, rows):
    got = ranks.first_ranks(df, ["k"], "x", ["i"], "place")
    found = {}
    for r in got.collect():
        found.setdefault(r.k, []).append((r.place, -np.inf if r.x is None else r.x, r.i))
    assert got.columns == ["k", "i", "x", "y", "place"] and sum(map(len, found.values())) == len(rows)
    for places in found.values():
        places.sort()
        assert [p for p, _, _ in places] == list(range(1, len(places) + 1))
        order = [(-x, i) for _, x, i in places]
        assert order == sorted(order)


@pytest.mark.parametrize("levels", [(0.5,), (0.0, 0.1, 0.25, 0.9, 1.0)])
def test_quantiles(df, rows, levels):
    wanted = {f"{c}{q}": (F.col(c), q) for c in ("x", "y") for q in levels}
    got = {r.k: r.asDict() for r in ranks.quantiles(df, ["k"], wanted).collect()}
    table = pd.DataFrame(rows, columns=["k", "i", "x", "y"])
    assert set(got) == {None if pd.isna(k) else k for k in table.k}
    for k, row in got.items():
        own = table[table.k.isna() if k is None else table.k == k]
        for c in ("x", "y"):
            values = own[c].dropna().to_numpy()
            for q in levels:
                assert row[f"{c}{q}"] == (pytest.approx(np.quantile(values, q), rel=1e-12) if len(values) else None)


def test_no_task_sorts_a_whole_key(spark):
    """A key with all rows is cut into ranges of about equal size."""
    df = spark.range(4000).select(F.lit("k").alias("k"), F.xxhash64("id").cast("double").alias("x"))
    held, starts = ranks.ranged(df, ["k"], [F.col("x")], F.lit(1))
    sizes = [r.n for r in held.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 2500 and starts.agg(F.max("__total")).first()[0] == 4000


def test_numbers_of_all_rows(df, rows):
    order = [F.col("k").desc_nulls_first(), F.col("i"), F.col("x")]
    got = sorted((r.n, r.k, r.i) for r in ranks.numbered(df, order, "n").collect())
    assert [r[0] for r in got] == list(range(len(rows)))
    want = sorted(rows, key=lambda r: r[1])
    want = [r[:2] for r in want if r[0] is None] + [r[:2] for r in sorted((r for r in want if r[0] is not None), key=lambda r: r[0], reverse=True)]
    assert [r[1:] for r in got] == want


def test_nothing(spark):
    none = spark.createDataFrame([], "k string, i long, x double")
    assert ranks.first_ranks(none, ["k"], "x", ["i"]).count() == 0
    assert ranks.rank_percentiles(none, ["k"], {"r": "x"}).count() == 0
    assert ranks.quantiles(none, ["k"], {"m": (F.col("x"), 0.5)}).count() == 0
