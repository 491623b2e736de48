"""Boosted trees on histograms, grown from sums that executors add up.

Features become bins by quantile thresholds (nulls take the median first), and the binned rows are stored.  A level of a tree is
one pass over the rows: each task adds up gradients, Hessians and rows by (node, feature, bin), Spark sums the tasks, and the driver, which
holds a table of nodes x features x bins and nothing of the rows, picks the splits.  Leaves are Newton steps with an L2 penalty.
Of a tree's levels the splits with the largest gains are kept, best first, up to a number of leaves.  The rows' scores are
stored anew every few trees, so a pass re-evaluates only the trees since then.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probspark.sources.stored import stored

BINS = 255
STORED_EVERY = 10


@dataclass
class Tree:
    """Nodes in arrays: feature and bin of a split (bins up to it go left), children, value of a leaf (feature -1)."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(v)
        return len(self.value) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row (rows x features) where it comes to rest."""
        feature, cut, left, right = map(np.array, (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            down = bins[inner, feature[node]] <= cut[node]
            at[inner] = np.where(down, left[node], right[node])

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Splitting:
    """How trees grow."""

    rate: float = 0.05
    penalty: float = 0.05
    leaves: int = 31
    least_rows: int = 20
    levels: int = 6


def best_split(sums: np.ndarray, how: Splitting) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of a node from its sums (features x bins x (gradient, Hessian, rows)); None where no split gains."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums.sum(1)[:, None]
    right = whole - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + how.penalty)
    allowed = (left[..., 2] >= how.least_rows) & (right[..., 2] >= how.least_rows)
    gain = np.where(allowed, worth(left) + worth(right) - worth(whole), 0.0)
    if gain.size == 0 or gain.max() <= 1e-12:
        return None
    at = int(np.argmax(np.round(gain, 9)))  # sums of many tasks differ in their last digits: ties go to the first feature and bin
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def pruned(tree: Tree, gains: dict[int, float], how: Splitting) -> Tree:
    """The tree with its best ``leaves - 1`` splits, taken from the root by gain."""
    kept, open_, n = set(), [(-gains[0], 0)] if 0 in gains else [], 1
    while open_ and n < how.leaves:
        _, node = heapq.heappop(open_)
        kept.add(node)
        n += 1
        for child in (tree.left[node], tree.right[node]):
            if child in gains:
                heapq.heappush(open_, (-gains[child], child))
    out = Tree()

    def copy(node: int) -> int:
        new = out.add(tree.value[node])
        if node in kept:
            out.feature[new], out.bin[new] = tree.feature[node], tree.bin[node]
            out.left[new], out.right[new] = copy(tree.left[node]), copy(tree.right[node])
        return new

    copy(0)
    return out


def grow(level_sums, n_features: int, how: Splitting) -> Tree:
    """One tree; ``level_sums(tree, nodes)`` gives the sums of each of these nodes (nodes x features x bins x 3)."""
    tree, gains = Tree(), {}
    tree.add(0.0)
    level = [0]
    for depth in range(how.levels + 1):
        sums = level_sums(tree, level)
        new = []
        for node, own in zip(level, sums, strict=True):
            g, h, _ = own[0].sum(0)
            tree.value[node] = -how.rate * g / (h + how.penalty)
            split = best_split(own, how) if depth < how.levels else None
            if split is not None:
                gains[node], tree.feature[node], tree.bin[node] = split
                tree.left[node], tree.right[node] = tree.add(0.0), tree.add(0.0)
                new += [tree.left[node], tree.right[node]]
        if not new:
            break
        level = new
    return pruned(tree, gains, how)


@dataclass
class Boosted:
    """A fitted model: medians and thresholds of the features, the first score and the trees."""

    features: list[str]
    medians: np.ndarray
    thresholds: list[np.ndarray]
    first: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.medians, x)
        return np.stack([np.searchsorted(t, c) for t, c in zip(self.thresholds, x.T, strict=True)], axis=1).astype(np.uint8)

    def scored(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` with the probability of label 1."""
        features, kept = self.features, df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = self.bins(_matrix(batch, features))
                raw = self.first + sum((t.scores(bins) for t in self.trees), np.zeros(len(bins)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(1 / (1 + np.exp(-raw)))], [*kept, name])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{name} double"])
        return df.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    columns = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features]
    return np.stack(columns, axis=1) if len(batch) else np.zeros((0, len(features)))


def thresholds(train: DataFrame, features: list[str], bins: int = BINS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Medians of the features and, for each, at most ``bins`` - 1 values that part its rows about evenly."""
    shares = [i / bins for i in range(1, bins)]
    found = train.agg(*(F.percentile_approx(F.col(c).cast("double"), F.array(F.lit(0.5), *map(F.lit, shares)), F.lit(10_000)).alias(c) for c in features)).first()
    medians = np.array([np.nan if found[c] is None else found[c][0] for c in features])
    cuts = [np.zeros(0) if found[c] is None else np.unique([*found[c][1:], found[c][0]]) for c in features]
    return np.nan_to_num(medians), cuts


def fit(train: DataFrame, features: list[str], label: str, rounds: int = 200, how: Splitting | None = None) -> Boosted | None:
    """Trees for a 0/1 label by log loss; None where there is one class only.  Rows without a label are left out."""
    how = how or Splitting()
    train = train.filter(F.col(label).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("__y"))
    n, ones = train.agg(F.count(F.lit(1)), F.sum("__y")).first()
    if not n or not 0 < ones < n:
        return None
    medians, cuts = thresholds(train, features)
    model = Boosted(features, medians, cuts, float(np.log(ones / (n - ones))))
    empty = Boosted(features, medians, cuts, model.first)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = empty.bins(_matrix(batch, features))
            rows = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, batch.column("__y"), pa.array(np.full(len(bins), empty.first))], ["bins", "y", "raw"])

    rows = stored(train.mapInArrow(binned, "bins binary, y double, raw double"), "binned")
    since: list[Tree] = []
    for _ in range(rounds):
        tree = grow(lambda tree, nodes: level_sums(rows, since, tree, nodes, len(features)), len(features), how)
        model.trees.append(tree)
        since = [*since, tree]
        if len(since) == STORED_EVERY:
            rows, since = stored(moved(rows, since, len(features)), "binned"), []
    return model


def _bins(batch: pa.RecordBatch, n_features: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(batch), n_features)


def moved(rows: DataFrame, trees: list[Tree], n_features: int) -> DataFrame:
    """Rows with the scores of ``trees`` added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _bins(batch, n_features)
            raw = batch.column("raw").to_numpy() + sum((t.scores(bins) for t in trees), np.zeros(len(bins)))
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), pa.array(raw)], ["bins", "y", "raw"])

    return rows.mapInArrow(run, "bins binary, y double, raw double")


def histogram(bins: np.ndarray, y: np.ndarray, raw: np.ndarray, place: np.ndarray, n_nodes: int) -> np.ndarray:
    """Sums of gradient, Hessian and rows by (node, feature, bin); ``place`` is a row's node, -1 for none."""
    here = np.flatnonzero(place >= 0)
    p = 1 / (1 + np.exp(-raw[here]))
    parts = (p - y[here], p * (1 - p), np.ones(len(here)))
    n_features = bins.shape[1]
    slot = ((place[here, None] * n_features + np.arange(n_features)) * (BINS + 1) + bins[here]).reshape(-1)
    out = [np.bincount(slot, np.repeat(v, n_features), n_nodes * n_features * (BINS + 1)) for v in parts]
    return np.stack(out, axis=-1).reshape(n_nodes, n_features, BINS + 1, 3)


def level_sums(rows: DataFrame, since: list[Tree], tree: Tree, nodes: list[int], n_features: int) -> np.ndarray:
    """The sums of ``nodes`` over all rows: one row per slot that a task has, summed by Spark."""
    number = {node: i for i, node in enumerate(nodes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(nodes), n_features, BINS + 1, 3))
        of_node = np.full(len(tree.value), -1)
        of_node[list(number)] = list(number.values())
        for batch in batches:
            bins = _bins(batch, n_features)
            raw = batch.column("raw").to_numpy() + sum((t.scores(bins) for t in since), np.zeros(len(bins)))
            total += histogram(bins, batch.column("y").to_numpy(), raw, of_node[tree.leaves(bins)], len(nodes))
        flat = total.reshape(-1, 3)
        slot = np.flatnonzero(flat[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(slot), *(pa.array(flat[slot, i]) for i in range(3))], ["slot", "g", "h", "n"])

    found = rows.mapInArrow(run, "slot long, g double, h double, n double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(nodes) * n_features * (BINS + 1), 3))
    out[found.column("slot").to_numpy()] = np.stack([found.column(c).to_numpy() for c in ("g", "h", "n")], axis=1)
    return out.reshape(len(nodes), n_features, BINS + 1, 3)
