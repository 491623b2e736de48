"""Boosted trees against a plain recomputation on all rows at once, and against MLlib's on held-out rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from probspark.operators import boosting as B

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3)).round(2)
    chance = 1 / (1 + np.exp(-(2 * np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2])))
    y = (rng.random(1500) < chance).astype(float)
    x[rng.random((1500, 3)) < 0.05] = np.nan
    rows = [(int(i), *(None if np.isnan(v) else float(v) for v in r), None if i % 97 == 0 else int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "i long, a double, b double, c double, y int").repartition(4)


def plain(model, bins, y, rounds, how):
    """The same trees from one array: each node's best split by direct sums, best first."""
    raw, trees = np.full(len(y), model.first), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def sums(tree, nodes):
            at = tree.leaves(bins)
            out = np.zeros((len(nodes), bins.shape[1], B.BINS + 1, 3))
            for k, node in enumerate(nodes):
                for r in np.flatnonzero(at == node):
                    for f in range(bins.shape[1]):
                        out[k, f, bins[r, f]] += (g[r], h[r], 1)
            return out

        trees.append(B.grow(sums, bins.shape[1], how))
        raw = raw + trees[-1].scores(bins)
    return trees, raw


def test_trees_equal_a_plain_recomputation(spark, table, monkeypatch):
    monkeypatch.setattr(B, "STORED_EVERY", 2)
    how = B.Splitting(rate=0.3, leaves=6, levels=3)
    model = B.fit(table, FEATURES, "y", 3, how)
    known = table.filter("y is not null").toPandas()
    bins = model.bins(known[FEATURES].to_numpy(float))
    trees, raw = plain(model, bins, known.y.to_numpy(float), 3, how)
    for mine, theirs in zip(model.trees, trees, strict=True):
        assert (mine.feature, mine.bin, mine.left, mine.right) == (theirs.feature, theirs.bin, theirs.left, theirs.right)
        assert mine.value == pytest.approx(theirs.value)
        assert sum(f < 0 for f in mine.feature) <= 6
    scored = {r.i: r.p for r in model.scored(table).collect()}
    assert len(scored) == 1500
    assert [scored[i] for i in known.i] == pytest.approx((1 / (1 + np.exp(-raw))).tolist())


def test_a_leaf_is_a_newton_step_with_the_penalty():
    """Two bins, by hand: gain and values."""
    sums = np.zeros((1, 3, 3))
    sums[0, 0], sums[0, 1] = (-6.0, 5.0, 25), (4.0, 5.0, 25)
    how = B.Splitting(rate=0.1, penalty=0.5)
    gain, feature, at = B.best_split(sums, how)
    assert (feature, at) == (0, 0) and gain == pytest.approx(36 / 5.5 + 16 / 5.5 - 4 / 10.5)
    halves = {0: sums, 1: np.stack([[sums[0, 0], np.zeros(3), np.zeros(3)]]), 2: np.stack([[np.zeros(3), sums[0, 1], np.zeros(3)]])}
    tree = B.grow(lambda tree, nodes: np.stack([halves[n] for n in nodes]), 1, how)
    assert tree.value == pytest.approx([0.1 * 2 / 10.5, 0.1 * 6 / 5.5, -0.1 * 4 / 5.5])
    assert B.best_split(sums, B.Splitting(least_rows=26)) is None


def auc(p, y):
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_auc_is_not_below_mllibs(table):
    train, test = table.filter("y is not null and i % 3 > 0"), table.filter("y is not null and i % 3 = 0")
    mine = B.fit(train, FEATURES, "y", 12, B.Splitting(rate=0.2, levels=5)).scored(test).toPandas()
    filled = lambda df: VectorAssembler(inputCols=FEATURES, outputCol="x").transform(df.fillna(0.0, FEATURES))
    other = GBTClassifier(featuresCol="x", labelCol="y", maxIter=12, stepSize=0.2, maxDepth=5, seed=7).fit(filled(train)).transform(filled(test))
    other = other.select("y", vector_to_array("probability")[1].alias("p")).toPandas()
    own, theirs = auc(mine.p.to_numpy(), mine.y.to_numpy()), auc(other.p.to_numpy(), other.y.to_numpy())
    assert own > 0.75 and own >= theirs - 0.01


def test_one_class_or_no_rows_give_no_model(table):
    assert B.fit(table.filter("y = 1"), FEATURES, "y", 1) is None
    assert B.fit(table.filter("y is null"), FEATURES, "y", 1) is None
    odd = table.withColumn("a", F.lit(None).cast("double"))
    assert B.fit(odd, FEATURES, "y", 1).scored(odd.limit(3)).count() == 3
