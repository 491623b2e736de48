"""Document toxicity from subword-bag embeddings averaged into a linear softmax.

A word's subwords are the character n-grams of ``<word>`` (bytes, A-Z lower-cased),
hashed into ``BUCKETS`` embeddings.  The embeddings of all subwords of a passage of
``PASSAGE`` words are averaged and go to a softmax over two classes.  Embeddings and
softmax are trained jointly in numpy, so an unseen misspelling shares the vectors of
its n-grams.  A document is as toxic as its most toxic passage: in training, passages
of a non-toxic document are all non-toxic, and a toxic document's label goes to its
passages in proportion to a softmax of their logits that sharpens with time.

Only subwords that ``LEAST_TOXIC`` toxic documents of the sample hold, at ``LEAST_LIFT`` times
the sample's odds or more, have vectors: a model over all of them learns its sample by heart.
Others weigh nothing, but count in the average.

With two classes a subword acts through one number, the product of its vector and the
difference of the class vectors, and so does its gradient; both are computed over
distinct words.
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
from probspark.llm.quality import class_weights, labelled_texts
from probspark.llm.words import _BYTE_VALUES, LOWER, mix, pieces, spans, text_bytes, word_hashes

PASSAGE = 8
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIM = 8
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 16 << 20
WORDS_AT_ONCE = 20_000
LEAST_TOXIC = 4  # toxic documents of the sample that a subword must occur in
LEAST_LIFT = 2.0  # odds of toxic among its documents, in odds of the whole sample: any class balance can be learned from


def word_subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, subwords before each word) of words given by byte spans; every word has one subword at least."""
    length = end - start
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length + 2, out=bounds[1:])
    total = int(bounds[-1])
    at = np.arange(total) - np.repeat(bounds[:-1], length + 2)
    source = np.repeat(start, length + 2) + at - 1
    marked = data[np.clip(source, 0, max(0, len(data) - 1))] if len(data) else np.zeros(total, np.uint8)
    marked[bounds[:-1]], marked[bounds[1:] - 1] = ord("<"), ord(">")
    values = _BYTE_VALUES[marked]
    left = np.repeat(bounds[1:], length + 2) - np.arange(total)  # bytes from here to the word's end
    word = np.repeat(np.arange(len(start)), length + 2)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        running = np.zeros(total, np.uint64)
        for n in range(1, max(GRAMS) + 1):
            running = running * np.uint64(0x9E3779B97F4A7C15)
            running[: total - n + 1] += values[n - 1 :]
            if n in GRAMS:
                own = np.flatnonzero(left >= n)
                buckets.append((mix(running[own] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
                owners.append(word[own])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.searchsorted(owners[order], np.arange(len(start) + 1))


@dataclass
class Passages:
    """Passages as runs of distinct-word numbers."""

    buckets: np.ndarray
    word_bounds: np.ndarray
    words: np.ndarray
    passage_bounds: np.ndarray
    document_bounds: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Passages:
        """A text without words is one passage without subwords."""
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        start, end, before = spans(data, offsets)
        _, first, which = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        buckets, word_bounds = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for low in range(0, len(first), WORDS_AT_ONCE):
            own = first[low : low + WORDS_AT_ONCE]
            some, bounds = word_subwords(data, start[own], end[own])
            word_bounds.append(bounds[1:] + word_bounds[-1][-1])
            buckets.append(some)
        buckets, word_bounds = np.concatenate(buckets), np.concatenate(word_bounds)
        count = np.maximum(1, -(-np.diff(before) // PASSAGE))
        documents = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=documents[1:])
        rank = np.arange(documents[-1]) - np.repeat(documents[:-1], count)
        low = np.repeat(before[:-1], count) + rank * PASSAGE
        return Passages(buckets, word_bounds, which.reshape(-1), np.append(low, len(start)), documents)

    def sums(self, of_bucket: np.ndarray) -> np.ndarray:
        """Sum over each passage's subwords."""
        by_word = _runs(of_bucket[self.buckets], self.word_bounds)
        return _runs(by_word[self.words], self.passage_bounds)

    def sizes(self) -> np.ndarray:
        return np.maximum(1, _runs(np.diff(self.word_bounds)[self.words], self.passage_bounds))

    def telling(self, labels: np.ndarray) -> np.ndarray:
        """Mask of the subwords that tell toxic documents (label 1) from others, by the documents that hold them."""
        document = np.repeat(np.repeat(np.arange(len(labels)), np.diff(self.document_bounds)), np.diff(self.passage_bounds))
        distinct = np.unique(document * (len(self.word_bounds) - 1) + self.words) if len(self.words) else np.zeros(0, np.int64)
        document, word = np.divmod(distinct, max(1, len(self.word_bounds) - 1))
        held, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        cuts = np.searchsorted(document, np.arange(len(labels) + 1))
        for i, label in enumerate(labels):  # one document's subwords at a time
            own = word[cuts[i] : cuts[i + 1]]
            n = self.word_bounds[own + 1] - self.word_bounds[own]
            at = np.repeat(self.word_bounds[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            b = np.unique(self.buckets[at])
            held[b] += 1
            toxic[b] += label
        clean = held - toxic
        return (toxic >= LEAST_TOXIC) & (toxic * (1 - labels).sum() >= LEAST_LIFT * labels.sum() * clean)

    def only(self, chosen: np.ndarray) -> Passages:
        """The same passages with the chosen subwords only, and with the words that hold some."""
        keep = chosen[self.buckets]
        kept = np.concatenate(([0], np.cumsum(keep)))[self.word_bounds]
        some = np.flatnonzero(np.diff(kept) > 0)
        number = np.full(len(self.word_bounds), -1, np.int64)
        number[some] = np.arange(len(some))
        place = number[self.words] >= 0
        before = np.concatenate(([0], np.cumsum(place)))[self.passage_bounds]
        return Passages(self.buckets[keep], np.append(kept[some], keep.sum()), number[self.words][place], before, self.document_bounds)

    def spread(self, of_passage: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
        """The transpose of ``sums``: per bucket the sum of its passages' values."""
        by_place = np.repeat(of_passage, np.diff(self.passage_bounds))
        by_word = np.bincount(self.words, by_place, len(self.word_bounds) - 1)
        return np.bincount(self.buckets, np.repeat(by_word, np.diff(self.word_bounds)), buckets)


def _runs(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[bounds])


@dataclass
class SubwordSoftmax:
    vectors: np.ndarray  # BUCKETS x DIM
    classes: np.ndarray  # 2 x DIM
    bias: np.ndarray  # 2

    def bucket_logits(self) -> np.ndarray:
        return self.vectors @ (self.classes[1] - self.classes[0])

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])

    @staticmethod
    def fit(texts: pa.Array, labels: np.ndarray, weights: np.ndarray, steps: int = 200, rate: float = 5.0, decay: float = 1e-6, seed: int = 8) -> SubwordSoftmax:
        rng = np.random.default_rng(seed)
        bags = Passages.of(texts)
        size, telling = bags.sizes(), bags.telling(labels)
        bags = bags.only(telling)
        bags.buckets = (np.cumsum(telling) - 1)[bags.buckets]  # numbers among the telling ones
        model = SubwordSoftmax(rng.normal(0, 0.1, (int(telling.sum()), DIM)), rng.normal(0, 0.5, (2, DIM)), np.zeros(2))
        first, count = bags.document_bounds[:-1], np.diff(bags.document_bounds)
        y = np.repeat(labels, count)
        m, v = [0.0] * 3, [0.0] * 3
        for step in range(1, steps + 1):
            difference = model.classes[1] - model.classes[0]
            logit = bags.sums(model.bucket_logits()) / size + model.offset()
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            sharp = 0.1 + 4.0 * min(1.0, step / (0.6 * steps))
            e = np.exp(sharp * (logit - np.repeat(np.maximum.reduceat(logit, first), count)))
            share = e / np.repeat(np.add.reduceat(e, first), count)
            # half of a clean document's weight is spread evenly, half goes where the model errs most
            share = np.where(y == 1, share, 0.5 * share + 0.5 / np.repeat(count, count))
            error = share * np.repeat(weights, count) * (p - y) / len(labels)
            by_bucket = bags.spread(error / size, len(model.vectors))
            grads = [by_bucket[:, None] * difference, np.outer([-1.0, 1.0], by_bucket @ model.vectors), np.array([-1.0, 1.0]) * error.sum()]
            for k, (value, g) in enumerate(zip((model.vectors, model.classes, model.bias), grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                # one step size for each array, so frequent subwords move most
                v[k] = 0.99 * v[k] + 0.01 * float((g * g).sum())
                value -= rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step) / ((v[k] / (1 - 0.99**step)) ** 0.5 + 1e-12) + decay * value)
        vectors = np.zeros((BUCKETS, DIM))
        vectors[telling] = model.vectors
        return SubwordSoftmax(vectors, model.classes, model.bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> SubwordSoftmax | None:
    """The model learned from at most ``rows`` labelled documents, whole, of ``most_bytes`` in all; None where there are none."""
    chosen, counts = labelled_texts(docs, labels, label, learn, rows, most_bytes, seed=4)
    if chosen is None:
        return None
    found = sorted(chosen.select("doc_id", "label", "text").collect(), key=lambda r: r[0])  # ``most_bytes`` of text
    y = np.array([r[1] for r in found], float)
    return SubwordSoftmax.fit(pa.array([r[2] for r in found], pa.large_string()), y, class_weights(y, counts))


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (``doc_id, text`` and more) with a toxicity ``score`` (0 to 1; 0.5 without labelled rows).

    ``learn`` is a condition on ``labels`` rows that may be learned from.  Null and empty
    texts score as a passage without subwords.  A column named ``score`` is replaced, others
    stay whatever their names.  Every passage of a text counts, however long it is: longer
    texts have more passages that may be taken for toxic.  Repeated rows and equal texts get
    equal scores; an empty table gives no rows.
    """
    docs = by_bytes(docs.drop("score"))
    model = fit_toxicity(docs, labels, learn, label, rows)
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    of_bucket, offset, names = model.bucket_logits().astype(np.float32), model.offset(), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(of_bucket)  # BUCKETS numbers, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                bags = Passages.of(piece.column("text"))
                logit = np.maximum.reduceat(bags.sums(shared.value) / bags.sizes() + offset, bags.document_bounds[:-1])
                y = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(y, pa.float64())], [*names, "score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
