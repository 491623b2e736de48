"""Learners on streams: rows of a key go to its learner in order of event time, also where files come late or twice.

Keys are dealt to a number of groups.  A group's rows wait in a list state until the watermark has passed them; a timer lets them go.  What
still waits when a run ends is not forced out: ``result`` reads the waiting rows and the learners from the
checkpoint, as a batch, and adds the answers they would get now.  So a folder can
be read again when new files have come, and nothing is ever written into it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from probspark.operators import online as O
from probspark.operators.online import Learner, learn_streams
from probspark.sources.stored import fresh_path
from probspark.streaming.monitors import appender, read_files, run_available, written

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: How many groups the keys are dealt to.  A group's waiting rows and its keys' learners are one task's work at a time, so many more keys want more.
BUCKETS = 512


class InOrder(StatefulProcessor):
    """Waiting rows, learners and histories of a group of keys as state.

    A row of state is a pickled frame: asking the state store once for each key and row takes longer than learning from it.
    Waiting rows are only added to until the watermark has passed the first of them.
    """

    def __init__(self, learner: Callable[[], Learner], keys: list[str], columns: list[str], order: list[str]):
        self.learner, self.keys, self.columns, self.order = learner, keys, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.times = handle.getValueState("times", "passed long, first long")
        self.memo = handle.getValueState("memo", "learners binary")
        self.history = handle.getListState("history", "numbers binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance([frame[[*self.keys, *self.columns]] for frame in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())

    def _advance(self, new: list[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        passed, before = self.times.get() if self.times.exists() else (NEVER, None)
        new = [f[f.event_us > passed * 1000] for f in new]
        new = [f for f in new if len(f)]
        first = min([int(f.event_us.min()) for f in new] + ([] if before is None else [before]), default=None)
        if first is None:
            return
        if first > watermark * 1000:
            if new:
                self.waiting.appendValue((packed(pd.concat(new, ignore_index=True)),))
                self._wait(passed, first, before)
            return
        rows = in_order([*(unpacked(x[0]) for x in self.waiting.get()), *new], self.keys, self.order)
        is_ready = rows.event_us <= watermark * 1000
        ready, left = rows[is_ready], rows[~is_ready]
        learners = restored(self.memo.get()[0] if self.memo.exists() else None, (x[0] for x in self.history.get()))
        yield learn_streams(ready, self.keys, list(self.learner().kept), self.learner, learners)
        memo, history = kept_apart(learners)
        self.memo.update((memo,))
        if history is not None:
            self.history.appendValue((history,))
        if len(left):
            self.waiting.put([(packed(left),)])
            self._wait(watermark, int(left.event_us.min()), None)
        else:
            self.waiting.clear()
            self.times.update((watermark, None))

    def _wait(self, passed: int, first: int, before: int | None) -> None:
        if before is None or first < before:
            self.handle.registerTimer(first // 1000 + 1)
        self.times.update((passed, first))

    def close(self) -> None:
        pass


#: A watermark before all times.
NEVER = -(1 << 50)


def packed(rows: pd.DataFrame) -> bytes:
    return pickle.dumps({c: rows[c].to_numpy() for c in rows.columns}, protocol=5)


def unpacked(rows: bytes) -> pd.DataFrame:
    return pd.DataFrame(pickle.loads(rows))


def in_order(frames: list[pd.DataFrame], keys: list[str], order: list[str]) -> pd.DataFrame:
    """Rows of each key by ``order``; a row that comes again is the same row."""
    rows = pd.concat(frames, ignore_index=True)
    return rows.drop_duplicates([*keys, *order], keep="last").sort_values([*keys, *order], kind="stable", ignore_index=True)


def kept_apart(learners: dict[tuple, Learner]) -> tuple[bytes, bytes | None]:
    """(learners without their histories, what their histories have got since the last time)."""
    added = {key: x.take_history() for key, x in learners.items() if hasattr(x, "take_history")}
    added = {key: numbers for key, numbers in added.items() if numbers}
    return pickle.dumps(learners, protocol=5), pickle.dumps(added, protocol=5) if added else None


def restored(memo: bytes | None, histories: Iterable[bytes]) -> dict[tuple, Learner]:
    learners = pickle.loads(memo) if memo else {}
    for numbers in histories:
        for key, own in pickle.loads(numbers).items():
            learners[key].add_history(own)
    return learners


class OrderedStream:
    """A folder of files read as a stream, with a learner for each key.

    ``time`` is the event-time column, ``order`` tells rows of a key apart and orders them (by event time first), ``late`` is how far behind
    the newest row a row may come; later rows, and rows without a time, are left out.  ``learner()`` makes a key's learner, which has ``reads`` and
    ``answers`` (see ``learn_streams``) and ``kept``, the columns that its answers keep; ``answer`` is the schema of both.  What a learner needs
    for the next rows is its pickled state and, if it has ``take_history``, numbers that are only ever added to.
    Null keys are a key; keys go through text and back, so their types must survive that.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, keys: list[str], time: str, order: list[str], late: str, learner: Callable[[], Learner], answer: str, name: str,
        buckets: int = BUCKETS, files: int = 1,
    ):
        self.spark, self.path, self.schema, self.keys, self.time, self.late, self.learner = spark, path, schema, keys, time, late, learner
        self.at, self.buckets, self.files = fresh_path(spark, name), buckets, files
        self.order = ["event_us", *(c for c in order if c != time)]
        self.columns = ["event_us", *(f.name for f in schema.fields if f.name not in (*keys, time))]
        types = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.text_schema = ", ".join([*(f"{k} string" for k in keys), answer])
        self.out_schema = ", ".join([*(f"{k} {types[k]}" for k in keys), answer])

    def run(self) -> OrderedStream:
        """Takes all files that are there and not taken yet; the state store is RocksDB for this stream only."""
        before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS_DB)
        try:
            rows = read_files(self.spark, self.path, self.schema, self.files).filter(F.col(self.time).isNotNull()).withWatermark(self.time, self.late)
            texts = rows.withColumn("event_us", F.unix_micros(F.col(self.time))).withColumns({k: F.col(k).cast("string") for k in self.keys})
            dealt = texts.withColumn("bucket", F.pmod(F.hash(*self.keys), F.lit(self.buckets))).select("bucket", self.time, *self.keys, *self.columns)
            processor = InOrder(self.learner, self.keys, self.columns, self.order)
            answers = dealt.groupBy("bucket").transformWithStateInPandas(processor, self.text_schema, "append", "eventTime")
            run_available(self._typed(answers), appender(self.at), "append", self.at)
        finally:
            self.spark.conf.unset(PROVIDER) if before is None else self.spark.conf.set(PROVIDER, before)
        return self

    def _typed(self, answers: DataFrame) -> DataFrame:
        """Keys as they came."""
        types = {f.name: f.dataType for f in self.schema.fields}
        return answers.withColumns({k: F.col(k).cast(types[k]) for k in self.keys})

    def passed(self) -> DataFrame:
        """Answers to rows that the watermark has passed: they don't change any more."""
        return written(self.spark, self.at, f"{self.out_schema}, batch int").drop("batch")

    def _state(self, variable: str, value: str) -> DataFrame:
        state = self.spark.read.format("statestore").option("stateVarName", variable).load(f"{self.at}/checkpoint")
        return state.select("key.bucket", F.lit(variable).alias("variable"), F.col(value).alias("data"))

    def waiting(self) -> DataFrame:
        """Answers that the waiting rows would get now, in order after the passed ones; they may change with the next files."""
        learner, keys, order = self.learner, self.keys, self.order
        state = self._state("waiting", "list_element.rows").unionByName(self._state("memo", "value.learners")).unionByName(self._state("history", "list_element.numbers"))

        def run(parts: pd.DataFrame) -> pd.DataFrame:
            found = {name: list(own) for name, own in parts.groupby("variable")["data"]}
            if "waiting" not in found:
                return pd.DataFrame(columns=[*keys, *list(learner().kept), *learner().answers])
            learners = restored(found["memo"][0] if "memo" in found else None, found.get("history", []))
            return learn_streams(in_order([unpacked(x) for x in found["waiting"]], keys, order), keys, list(learner().kept), learner, learners)

        return self._typed(state.groupBy("bucket").applyInPandas(run, self.text_schema))

    def result(self) -> DataFrame:
        """Passed and waiting rows' answers: those of a batch over all rows that came in time."""
        return self.passed().unionByName(self.waiting())


class Deltas:
    """Each row's ``value`` less that of the row before it."""

    reads, answers, kept = ("value",), ("delta",), ("event_id",)
    last: float | None = None

    def __call__(self, values: list) -> tuple[list]:
        before = [self.last, *values[:-1]]
        self.last = values[-1]
        return ([None if a is None else b - a for a, b in zip(before, values, strict=True)],)


class Kept:
    """A conformal learner whose scores are a history of their own, and its pickled state without them."""

    def __init__(self, make: Callable[[], O.AdaptiveConformal]):
        self.make, self.learner, self.new = make, make(), []

    def add_history(self, numbers: list[float]) -> None:
        for score in numbers:
            self.learner.scores.add(score)

    def take_history(self) -> list[float]:
        new, self.new = self.new, []
        return new

    def __getstate__(self) -> dict:
        return {"make": self.make, "learner": {k: v for k, v in vars(self.learner).items() if k != "scores"}}

    def __setstate__(self, held: dict) -> None:
        self.make, self.learner, self.new = held["make"], held["make"](), []
        vars(self.learner).update(held["learner"])

    def __call__(self, scores: list) -> tuple[list, list, list]:
        self.new += scores
        return self.learner(scores)


class Conformal(Kept):
    """A conformal learner of the key's own scores, ``value`` / 100 at most 1; scores are kept as history."""

    reads, answers, kept = ("value",), ("threshold", "miss", "alpha"), ("event_id",)

    def __call__(self, values: list) -> tuple[list, list, list]:
        return super().__call__([v if v != v else min(abs(v) / 100, 1.0) for v in values])


class Several:
    """Learners of forecasts side by side: ``weights`` have a weight per source, ``conformal`` a threshold per step of each source.

    Rows have ``seq, source_id, prediction, actual``.  The conformal learners score the distance of a source's forecast, at most 1.
    A row's answers are side by side, ``learned`` names them.
    """

    reads, kept = ("seq", "source_id", "prediction", "actual"), ("seq", "source_id")

    def __init__(self, weights: dict[str, Learner], conformal: dict[str, Callable[[], O.AdaptiveConformal]]):
        self.weights, self.conformal, self.own = weights, conformal, {}
        self.answers = (*weights, *(f"{n}_{c}" for n in conformal for c in ("threshold", "miss", "alpha")))

    def add_history(self, numbers: dict) -> None:
        for source, scores in numbers.items():
            for learner in self.own[source].values():
                learner.add_history(scores)

    def take_history(self) -> dict:
        """All new scores of each source."""
        added = {}
        for source, learners in self.own.items():
            for learner in learners.values():
                scores = learner.take_history()
                if scores:
                    added[source] = scores
        return added

    def __call__(self, seq: list, source: list, prediction: list, actual: list) -> tuple[list, ...]:
        weights = [learner(seq, source, prediction, actual)[0] for learner in self.weights.values()]
        places = {}
        for i, s in enumerate(source):
            places.setdefault(s, []).append(i)
        answers = [[None] * len(seq) for _ in range(3 * len(self.conformal))]
        for s, at in places.items():
            scores = [v if (v := abs(prediction[i] - actual[i])) <= 1.0 or v != v else 1.0 for i in at]
            learners = self.own.setdefault(s, {name: Kept(make) for name, make in self.conformal.items()})
            for n, learner in enumerate(learners.values()):
                for out, found in zip(answers[3 * n :], learner(scores), strict=False):
                    for i, v in zip(at, found, strict=True):
                        out[i] = v
        return (*weights, *answers)


def learned(several: Several) -> str:
    """The schema of its answers."""
    return ", ".join(["seq long, source_id string", *(f"{c} {'int' if c.endswith('_miss') else 'double'}" for c in several.answers)])


def one_row_each(answers: DataFrame, keys: list[str], several: Several) -> DataFrame:
    """A row for each learner: ``keys..., learner, seq, source_id, value, miss, alpha``."""
    none = [F.lit(None).cast("int").alias("miss"), F.lit(None).cast("double").alias("alpha")]
    rows = [F.struct(F.lit(n).alias("learner"), F.col(n).alias("value"), *none) for n in several.weights]
    rows += [F.struct(F.lit(n).alias("learner"), F.col(f"{n}_threshold").alias("value"), F.col(f"{n}_miss").alias("miss"), F.col(f"{n}_alpha").alias("alpha")) for n in several.conformal]
    return answers.select(*keys, "seq", "source_id", F.explode(F.array(*rows)).alias("x")).select(*keys, "x.learner", "seq", "source_id", "x.value", "x.miss", "x.alpha")
