"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded
(byte classes and word statistics through a tanh layer), a gated attention gives
each passage a weight, and the weighted mean of the encodings is scored by a
logistic unit.  Encoder, attention and scorer are learned together, from document
labels alone, by Adam in numpy on a bounded sample; scoring reads every passage of
every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probspark.llm.common import by_bytes
from probspark.llm.words import pieces, spans, text_bytes, word_hashes

PASSAGE = 64
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 32 << 20

# Byte classes that a passage's features count.
_CLASSES = [
    range(ord("a"), ord("z") + 1), range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1), b" ", b"\n", b".", b",", b"!?", b"|",
    [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,!?|"],
    range(0xC0, 0x100), range(0x80, 0xA0), range(0xA0, 0xC0),
]
_CLASS_OF = np.full(256, 255, np.uint8)
for _k, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c)] = _k
FEATURES = len(_CLASSES) + 6


def passage_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, passages before each row); a text without words is one passage of zeros."""
    data, offsets = text_bytes(texts)
    start, end, before = spans(data, offsets)
    words = np.diff(before)
    count = np.maximum(1, -(-words // PASSAGE))
    bounds = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=bounds[1:])
    rank = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    first = np.repeat(before[:-1], count) + rank * PASSAGE
    n = np.minimum(np.repeat(before[1:], count) - first, PASSAGE)
    features = np.zeros((len(first), FEATURES), np.float32)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return features, bounds
    first, n = first[full], n[full]
    low, high = start[first], end[first + n - 1]
    # a passage's bytes go to the start of the next one; what lies between rows' texts is white space at most
    size = np.maximum(1, high - low).astype(np.float32)
    classes = _CLASS_OF[data]
    edges = np.empty(2 * len(low), np.int64)
    edges[0::2], edges[1::2] = low, high
    last = edges[-1] == len(data)
    edges = edges[:-1] if last else edges
    for k in range(len(_CLASSES)):
        features[full, k] = np.add.reduceat(classes == k, edges, dtype=np.int32)[0::2] / size
    hashes = word_hashes(data, start, end)
    at = first[:, None] + np.arange(PASSAGE)
    inside = np.arange(PASSAGE) < n[:, None]
    grid = np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
    repeat = (grid[:, 1:] == grid[:, :-1]) & inside[:, 1:]
    ordered = np.sort(grid, axis=1)
    distinct = (ordered[:, 1:] != ordered[:, :-1]).sum(1) + (n == PASSAGE)
    length = np.zeros(len(start) + 1, np.float64)
    np.cumsum(end - start, out=length[1:])
    short = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start <= 2, out=short[1:])
    k = len(_CLASSES)
    features[full, k] = distinct / n
    features[full, k + 1] = repeat.sum(1) / n
    features[full, k + 2] = (length[first + n] - length[first]) / n / 10
    features[full, k + 3] = (short[first + n] - short[first]) / n
    features[full, k + 4] = n / PASSAGE
    features[full, k + 5] = 1
    return features, bounds


@dataclass
class AttentionBag:
    """Weights of the encoder, the gated attention and the scorer; scales of the features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    @staticmethod
    def start(features: np.ndarray, hidden: int = 24, gate: int = 12, seed: int = 5) -> AttentionBag:
        rng = np.random.default_rng(seed)
        normal = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        f = features.shape[1]
        p = {"w": normal(f, hidden), "wb": np.zeros(hidden), "v": normal(hidden, gate), "u": normal(hidden, gate), "a": normal(gate, 1)[:, 0], "c": normal(hidden, 1)[:, 0], "d": np.zeros(1)}
        return AttentionBag(features.mean(0), features.std(0) + 1e-3, p)

    def forward(self, features: np.ndarray, bounds: np.ndarray) -> dict:
        p, first, count = self.p, bounds[:-1], np.diff(bounds)
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["wb"])
        tanh, gate = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-h @ p["u"]))
        e = (tanh * gate) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "tanh": tanh, "gate": gate, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradients(self, s: dict, bounds: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        """error: derivative of the loss by each document's logit."""
        p, first, count = self.p, bounds[:-1], np.diff(bounds)
        dz = np.repeat(error[:, None] * p["c"], count, axis=0)
        da = (dz * s["h"]).sum(1)
        de = s["a"] * (da - np.repeat(np.add.reduceat(s["a"] * da, first), count))
        dt = de[:, None] * p["a"] * s["gate"] * (1 - s["tanh"] ** 2)
        dg = de[:, None] * p["a"] * s["tanh"] * s["gate"] * (1 - s["gate"])
        dh = (s["a"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - s["h"] ** 2)
        return {"w": s["x"].T @ dh, "wb": dh.sum(0), "v": s["h"].T @ dt, "u": s["h"].T @ dg, "a": (s["tanh"] * s["gate"]).T @ de, "c": s["z"].T @ error, "d": error.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 6) -> AttentionBag:
        rng = np.random.default_rng(seed)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(bags), batch):
                own = order[at : at + batch]
                bounds = np.cumsum([0, *(len(bags[i]) for i in own)])
                s = self.forward(np.concatenate([bags[i] for i in own]), bounds)
                grads = self.gradients(s, bounds, weights[own] * (s["y"] - labels[own]) / len(own))
                t += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    step = m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * step
        return self


def labelled_sample(labels: DataFrame, label: str, learn: Column, rows: int, seed: int = 3) -> tuple[DataFrame, dict[int, int]]:
    """(``doc_id, label`` of at most ``rows`` rows, half of each class where there are enough; rows of each class).

    Rows come in a hashed order of the id.  Null labels and ids aren't used; an id with both labels has the larger.
    """
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.lit(seed), "doc_id")
    take = {c: min(n, max(rows // 2, rows - counts.get(1 - c, 0))) for c, n in counts.items()}
    parts = [known.filter(F.col("label") == c).orderBy(order, "doc_id").limit(n) for c, n in sorted(take.items())]
    return (parts[0].union(parts[1]) if len(parts) == 2 else parts[0] if parts else known.limit(0)), counts


def class_weights(labels: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the sample's classes their shares among all labelled rows, with mean 1."""
    total = max(1, sum(counts.values()))
    share = {c: counts.get(c, 0) / total / max(1e-9, float((labels == c).mean())) for c in (0, 1)}
    return np.where(labels == 1, share[1], share[0])


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, most_bytes: int, seed: int = 3) -> tuple[DataFrame | None, dict[int, int]]:
    """(``doc_id, label, text`` of a bounded sample; rows of each class): at most ``rows`` documents and ``most_bytes`` of text.

    Documents come in the sample's hashed order, whole; one that doesn't fit into what is left of the bytes is passed over.
    Of rows that repeat an id the smallest text counts, and a null text is empty.  None where there is nothing to learn from.
    """
    sample, counts = labelled_sample(labels, label, learn, rows, seed)
    if not counts:
        return None, counts
    text = F.coalesce("text", F.lit(""))
    known = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id")  # ``rows`` rows
    sizes = known.select("doc_id", "label", F.octet_length("text").alias("bytes")).groupBy("doc_id", "label").agg(F.max("bytes").alias("bytes"))
    left, taken = most_bytes, []
    for r in sizes.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").collect():  # ``rows`` rows
        if r["bytes"] <= left:
            left -= r["bytes"]
            taken.append((r["doc_id"], r["label"]))
    if not taken:
        return None, counts
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")), counts


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> AttentionBag | None:
    """The model learned from at most ``rows`` labelled documents of ``most_bytes`` in all; None where there are none.

    The executors turn the sampled texts into passage features; only these (a fifth of the texts' bytes) come to the driver.
    """
    chosen, counts = labelled_texts(docs, labels, label, learn, rows, most_bytes)
    if chosen is None:
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                x, bounds = passage_features(piece.column("text"))
                bags = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), piece.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    found = chosen.mapInArrow(features, "doc_id long, label int, bag binary").collect()  # ``rows`` rows
    found.sort(key=lambda r: r[0])
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in found]
    y = np.array([r[1] for r in found], float)
    return AttentionBag.start(np.concatenate(bags)).fit(bags, y, class_weights(y, counts))


def score_quality(docs: DataFrame, model: AttentionBag | None, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1; 0.5 without a model).  Null and empty texts are scored as an empty passage."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                x, bounds = passage_features(piece.column("text"))
                y = model.forward(x, bounds)["y"]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(y, pa.float64())], [*names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = SAMPLE_ROWS, name: str = "score") -> DataFrame:
    """``docs`` (``doc_id, text`` and more) with a quality score ``name`` for every row, from every passage of its whole text.

    ``learn`` is a condition on ``labels`` rows that may be learned from.  A column called ``name`` is replaced, others
    stay whatever their names.  Repeated rows and equal texts get equal scores; a text is scored as a whole, however long;
    an empty table gives no rows.
    """
    docs = by_bytes(docs.drop(name))
    return score_quality(docs, fit_quality(docs, labels, learn, label, rows), name)
