"""Learners whose state depends on the order of events.

A stream's rows come to one task sorted, in Arrow batches; only the learner's state and the last, maybe unfinished step are
carried from batch to batch, so a stream of any length fits.
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remove_margin(quotes: DataFrame, key: list[str], steps: int = 100) -> DataFrame:
    """Probabilities without the margin by a fixed point with square-root terms, all in one expression per subject.

    Each step takes z from the margin and the sum of roots, and subtracts z times the root of the last estimate;
    estimates stay above 1e-10.  Steps after convergence change nothing more than 1e-10.
    """
    groups = quotes.filter("value > 1").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("outcome", (1 / F.col("value")).alias("q")))).alias("o"))
    implied = F.transform("o", lambda x: x["q"])
    total = F.aggregate(implied, F.lit(0.0), lambda a, x: a + x)

    def step(state, _):
        root = F.aggregate(state, F.lit(0.0), lambda a, p: a + F.sqrt(p))
        z = F.least((total - 1) / F.greatest(root - 1, F.lit(0.001)), F.lit(0.999))
        moved = F.zip_with(implied, state, lambda q, p: F.greatest((q - z * F.sqrt(p)) / (1 - z * root), F.lit(1e-10)))
        return F.when(root <= 1, state).otherwise(moved)

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform(implied, lambda q: q / total), step)
    df = groups.withColumn("p", solved).withColumn("sum", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    return df.select(*key, F.explode(F.arrays_zip("o", "p")).alias("x"), "sum").select(*key, F.col("x.o.outcome").alias("outcome"), (F.col("x.p") / F.col("sum")).alias("p"))


#: ``learner()`` makes a stream's learner.  ``reads`` names the columns it is called with, as lists of whole steps in order; it answers
#: with a list for each of the columns that ``answers`` names, a value for each row.
Learner = Callable[..., tuple[list, ...]]


def learn_streams(rows: pd.DataFrame, keys: list[str], kept: list[str], learner: Callable[[], Learner], learners: dict[tuple, Learner]) -> pd.DataFrame:
    """Rows of many streams, each stream's together and in order, go through their streams' learners, which are found in and added to ``learners``.

    Comes back with ``keys``, the columns ``kept`` and the learners' answers: one frame, since a frame for each stream costs more than its learning.
    """
    if not len(rows):
        return pd.DataFrame(columns=[*keys, *kept])
    own = [(rows[k] if rows[k].dtype.kind == "O" or rows[k].isna().any() else rows[k].to_numpy()) for k in keys]
    new = np.ones(len(rows), bool)
    new[1:] = False
    for k in own:
        code = pd.factorize(k)[0]
        new[1:] |= code[1:] != code[:-1]
    starts = np.flatnonzero(new)
    names = zip(*(k.iloc[starts].astype(object).where(k.iloc[starts].notna(), None).tolist() if isinstance(k, pd.Series) else k[starts].tolist() for k in own), strict=True)
    found: list[list] | None = None
    columns: list[list] | None = None
    for name, a, b in zip(names, starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
        made = learners.get(name)
        if made is None:
            made = learners[name] = learner()
        if columns is None:
            columns, found = [rows[c].tolist() for c in made.reads], [[] for _ in made.answers]
        for out, part in zip(found, made(*(c[a:b] for c in columns)), strict=True):
            out += part
    return rows[[*keys, *kept]].assign(**{c: typed(values) for c, values in zip(made.answers, found, strict=True)})


def typed(values: list) -> pd.Series | list:
    """Whole numbers with gaps stay whole."""
    some = next((v for v in values if v is not None), None)
    return pd.array(values, dtype="Int64") if isinstance(some, int) else values


def by_stream(df: DataFrame, keys: list[str], step: list[str], learner: Callable[[], Learner], schema: str, kept: list[str]) -> DataFrame:
    """``learner()`` makes one learner per stream (``keys``); it is called with whole steps (``step`` names their order) in order.

    Its answer comes back with the stream's keys and the columns ``kept`` in front, by ``schema``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learners, held = {}, None

        def answer(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal learners
            out = learn_streams(rows, keys, kept, learner, learners)
            if learners:  # the streams before the last one are over
                learners = dict([learners.popitem()])
            return out

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = np.ones(len(rows), bool)
            for c in [*keys, step[0]]:
                end = rows[c].iloc[-1]
                last &= (rows[c].isna() if pd.isna(end) else rows[c] == end).to_numpy(bool)
            held = rows[last]
            if not last.all():
                yield answer(rows[~last])
        if held is not None and len(held):
            yield answer(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *step).mapInPandas(run, schema)


WEIGHTS = "stream_id long, seq long, source_id string, weight double"


def steps(seq: list) -> Iterator[tuple[int, int]]:
    """Where each step begins and ends."""
    a = 0
    for b in range(1, len(seq)):
        if seq[b] != seq[a]:
            yield a, b
            a = b
    if seq:
        yield a, len(seq)


class WeightLearner:
    """A learner with a weight for each source of a step."""

    reads, answers = ("seq", "source_id", "prediction", "actual"), ("weight",)


class Stacking(WeightLearner):
    """Multiplicative weights with a share of uniform ones; new sources enter at 1/n, absent ones are dropped."""

    def __init__(self, eta: float, mixing: float):
        self.eta, self.mixing, self.weights = eta, mixing, {}

    def __call__(self, seq: list, source: list, prediction: list, actual: list) -> tuple[list]:
        out, eta, mixing = [], self.eta, self.mixing
        for a, b in steps(seq):
            names, y, n = source[a:b], actual[a], b - a
            w = [self.weights.get(s, 1 / n) for s in names]
            total, scale = plain_sum(w), floor_at(abs(y), 1e-6)
            w = [floor_at(v / total * (1 - eta + eta * floor_at(1 - (x - y) ** 2 / scale, 1e-6)), 1e-12) for v, x in zip(w, prediction[a:b], strict=True)]
            w = [(1 - mixing) * v + mixing / n for v in w]
            total = plain_sum(w)
            w = [v / total for v in w]
            self.weights = dict(zip(names, w, strict=True))
            out += w
        return (out,)


def plain_sum(values: list[float]) -> float:
    """One after another, without the correction that ``sum`` adds: as arrays of few numbers are summed."""
    total = 0.0
    for v in values:
        total += v
    return total


def floor_at(value: float, least: float) -> float:
    """The larger one; what is not a number stays so."""
    return least if value < least else value


class Ridge(WeightLearner):
    """Weights from the ridge solution over all steps so far, held above 0 and scaled to 1 (kept where all are 0)."""

    #: Entries of the matrices that are solved together.
    block = 1 << 20

    def __init__(self, penalty: float):
        self.penalty, self.names, self.gram, self.sums, self.last = penalty, [], np.zeros((0, 0)), np.zeros(0), {}

    def __call__(self, seq: list, source: list, prediction: list, actual: list) -> tuple[list]:
        """Sources that come later have no share in a step before them, so all steps can be solved with all sources."""
        bounds, seen, known = list(steps(seq)), {s: i for i, s in enumerate(self.names)}, []
        for a, b in bounds:
            for s in source[a:b]:
                seen.setdefault(s, len(seen))
            known.append(len(seen))
        self.names = list(seen)
        k, at, out = len(seen), [seen[s] for s in source], []
        self.gram, self.sums = np.pad(self.gram, (0, k - len(self.gram))), np.pad(self.sums, (0, k - len(self.sums)))
        many = max(1, self.block // (k * k))
        for start in range(0, len(bounds), many):
            part = bounds[start : start + many]
            first, sizes = part[0][0], [b - a for a, b in part]
            row, own = np.repeat(np.arange(len(part)), sizes), at[first : part[-1][1]]
            x, y = np.zeros((len(part), k)), np.array([actual[a] for a, _ in part], float)
            x[row, own] = prediction[first : part[-1][1]]
            gram = np.add.accumulate(np.concatenate([self.gram[None], x[:, :, None] * x[:, None, :]]))[1:]
            sums = np.add.accumulate(np.concatenate([self.sums[None], x * y[:, None]]))[1:]
            self.gram, self.sums = gram[-1].copy(), sums[-1].copy()
            w = np.maximum(np.linalg.solve(gram + self.penalty * np.eye(k), sums[:, :, None])[:, :, 0], 0)
            total = w.sum(axis=1)
            solved = total > 0
            share = (w / np.where(solved, total, 1.0)[:, None]).tolist()
            for (a, b), ok, own_share, n in zip(part, solved.tolist(), share, known[start : start + many], strict=True):
                if ok:
                    self.last = dict(zip(self.names[:n], own_share, strict=False))
                elif not self.last:
                    self.last = {s: 1 / n for s in self.names[:n]}
                out += [self.last.get(s, 0.0) for s in source[a:b]]
        return (out,)


class ExpertWeights(WeightLearner):
    """Weights by losses so far: ``ewa`` by an exponential of the total, ``poly`` by the mean, both against the best of the step."""

    def __init__(self, kind: str, eta: float = 2.0):
        self.kind, self.eta, self.losses = kind, eta, {}

    def __call__(self, seq: list, source: list, prediction: list, actual: list) -> tuple[list]:
        out, losses, eta = [], self.losses, self.eta
        for a, b in steps(seq):
            for i in range(a, b):
                total, n = losses.get(source[i], (0.0, 0))
                losses[source[i]] = (total + (prediction[i] - actual[i]) ** 2, n + 1)
            so_far = [losses[s] for s in source[a:b]]
            if self.kind == "ewa":
                least = min(t for t, _ in so_far)
                raw = [math.exp(-eta * (t - least)) for t, _ in so_far]
            else:
                mean = [t / n for t, n in so_far]
                least = min(mean)
                raw = [1 / (1 + eta * (m - least)) for m in mean]
            total = plain_sum(raw)
            out += [w / total for w in raw]
        return (out,)


def online_stacking(forecasts: DataFrame, eta: float = 0.1, mixing: float = 0.01) -> DataFrame:
    """Weights after each step: ``stream_id, seq, source_id, weight`` for ``stream_id, seq, source_id, prediction, actual``."""
    return _weights(forecasts, lambda: Stacking(eta, mixing))


def ridge_stacking(forecasts: DataFrame, penalty: float = 1.0) -> DataFrame:
    return _weights(forecasts, lambda: Ridge(penalty))


def _weights(forecasts: DataFrame, learner: Callable[[], Learner]) -> DataFrame:
    return by_stream(forecasts.select("stream_id", "seq", "source_id", "prediction", "actual"), ["stream_id"], ["seq", "source_id"], learner, WEIGHTS, ["seq", "source_id"])


class SortedScores:
    """Sorted numbers in blocks, so that adding one moves a block only; with a window, the oldest one leaves."""

    def __init__(self, window: int | None = None, block: int = 1000):
        self.blocks, self.n, self.block, self.order = [[]], 0, block, deque() if window else None
        self.window = window

    def add(self, score: float) -> None:
        i = max(0, bisect.bisect_left([b[0] for b in self.blocks if b], score) - 1) if len(self.blocks) > 1 else 0
        bisect.insort(self.blocks[i], score)
        self.n += 1
        if len(self.blocks[i]) > 2 * self.block:
            b = self.blocks[i]
            self.blocks[i : i + 1] = [b[: self.block], b[self.block :]]
        if self.window:
            self.order.append(score)
            if self.n > self.window:
                self.remove(self.order.popleft())

    def remove(self, score: float) -> None:
        for i, b in enumerate(self.blocks):
            if b and b[0] <= score <= b[-1]:
                del b[bisect.bisect_left(b, score)]
                self.n -= 1
                if not b and len(self.blocks) > 1:
                    del self.blocks[i]
                return

    def kth(self, k: int) -> float:
        for b in self.blocks:
            if k < len(b):
                return b[k]
            k -= len(b)
        raise IndexError(k)

    def quantile(self, alpha: float) -> float:
        """The smallest score that covers 1 - alpha with the correction for a finite sample; 1 without scores."""
        n = self.n
        if not n:
            return 1.0
        k = math.ceil((n + 1) * (1 - alpha))
        k = n - 1 if k >= n else k - 1 if k > 0 else 0
        return self.blocks[0][k] if len(self.blocks) == 1 else self.kth(k)


class AdaptiveConformal:
    """Threshold, then update: the miss rate asked for moves with every miss."""

    reads, answers = ("score",), ("threshold", "miss", "alpha")

    def __init__(self, alpha: float = 0.1, gamma: float = 0.01, window: int | None = None):
        self.target, self.alpha, self.gamma, self.scores = alpha, alpha, gamma, SortedScores(window)

    def threshold(self) -> float:
        return self.scores.quantile(self.alpha)

    def update(self, score: float) -> int:
        """Whether the score was above the threshold; the score joins the others afterwards."""
        return self.step(score)[1]

    def step(self, score: float) -> tuple[float, int]:
        """The threshold and whether the score was above it."""
        threshold = self.threshold()
        miss = int(score > threshold + 1e-12)
        self.scores.add(score)
        self.moved(miss)
        return threshold, miss

    def moved(self, miss: int) -> None:
        self.alpha = min(max(self.alpha + self.gamma * (miss - self.target), 0.001), 0.999)

    def __call__(self, scores: list) -> tuple[list, list, list]:
        thresholds, misses, alphas = [], [], []
        for score in scores:
            threshold, miss = self.step(score)
            thresholds.append(threshold)
            misses.append(miss)
            alphas.append(self.alpha)
        return thresholds, misses, alphas


#: Rates of the aggregated learner; fixed values.
GAMMAS = (0.001, 0.01, 0.05, 0.1)


class AggregatedConformal(AdaptiveConformal):
    """Several rates at once: the weighted mean of their thresholds decides, and all see the same miss.

    Weights are a softmax of -2 times each rate's distance from the coverage asked for over the last 50 steps; as all see the
    same misses, these distances are one number and the weights stay equal, so they are not worked out again in each step.
    ``alpha`` is the weighted mean of the rates' own.
    """

    def __init__(self, alpha: float = 0.1, gammas: tuple[float, ...] = GAMMAS, window: int | None = None):
        super().__init__(alpha, 0.0, window)
        self.gammas, self.alphas = list(gammas), np.full(len(gammas), alpha)
        self.weights = [1 / len(gammas)] * len(gammas)

    @property
    def alphas(self) -> np.ndarray:
        return np.array(self.rates)

    @alphas.setter
    def alphas(self, values) -> None:
        self.rates = [float(a) for a in values]

    def threshold(self) -> float:
        total, weight, quantile = 0.0, 0.0, self.scores.quantile
        for w, a in zip(self.weights, self.rates, strict=True):
            total += w * quantile(a)
            weight += w
        return total / weight

    def moved(self, miss: int) -> None:
        off, total, rates = miss - self.target, 0.0, []
        for a, g, w in zip(self.rates, self.gammas, self.weights, strict=True):
            a += g * off
            a = 0.001 if a < 0.001 else 0.999 if a > 0.999 else a
            rates.append(a)
            total += a * w
        self.rates, self.alpha = rates, total


CONFORMAL = "seq long, threshold double, miss int, alpha double"


def adaptive_conformal(scored: DataFrame, keys: dict[str, str], alpha: float = 0.1, gamma: float = 0.01, window: int | None = None) -> DataFrame:
    """``keys..., seq, threshold, miss, alpha`` for ``keys..., seq, score``; ``keys`` gives the types of a stream's columns."""
    return _conformal(scored, keys, lambda: AdaptiveConformal(alpha, gamma, window))


def aggregated_conformal(scored: DataFrame, keys: dict[str, str], alpha: float = 0.1, gammas: tuple[float, ...] = GAMMAS, window: int | None = None) -> DataFrame:
    return _conformal(scored, keys, lambda: AggregatedConformal(alpha, gammas, window))


def _conformal(scored: DataFrame, keys: dict[str, str], learner: Callable[[], Learner]) -> DataFrame:
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + f", {CONFORMAL}"
    return by_stream(scored.select(*keys, "seq", "score"), list(keys), ["seq"], learner, schema, ["seq"])
