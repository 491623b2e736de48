"""Streams against their batch operators: late files, rows that come twice, folders that are read again."""

import os
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from probspark.operators import online
from probspark.operators import scoring
from probspark.plans import sequential_queries as Q
from probspark.sources.inputs import load
from probspark.streaming import monitors, ordered

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
EVENTS = "user_id long, event_id long, ts timestamp, value double"


def write(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def deltas(spark, path):
    return ordered.OrderedStream(spark, path, spark.createDataFrame([], EVENTS).schema, ["user_id"], "ts", ["event_id"], "3 days", ordered.Deltas, "event_id long, delta double", "deltas")


def test_six_learners_on_a_stream_equal_the_batch(spark):
    rows = Q.x4_stream_learners(spark, SF).collect()
    got = {(r.learner, r.stream_id, r.seq, r.source_id): (r.value, r.miss, r.alpha) for r in rows}
    forecasts = load(spark, SF, "forecasts")
    weights = {
        "stacking": online.online_stacking(forecasts), "ridge": online.ridge_stacking(forecasts),
        "ewa": scoring.expert_weights(scoring.expert_losses(forecasts), "ewa"), "poly": scoring.expert_weights(scoring.expert_losses(forecasts), "poly"),
    }
    want = {}
    for name, df in weights.items():
        want |= {(name, r.stream_id, r.seq, r.source_id): (r.weight, None, None) for r in df.select("stream_id", "seq", "source_id", "weight").collect()}
    scores = Q._scores(spark, SF)
    for name, df in (("conformal", online.adaptive_conformal(scores, Q.KEYS)), ("aggregated", online.aggregated_conformal(scores, Q.KEYS))):
        want |= {(name, r.stream_id, r.seq, r.source_id): (r.threshold, r.miss, r.alpha) for r in df.collect()}
    assert len(rows) == len(got) and set(got) == set(want)
    for k, v in want.items():
        assert got[k][0] == pytest.approx(v[0], abs=1e-9) and got[k][1] == v[1] and (v[2] is None or got[k][2] == pytest.approx(v[2])), k


def test_conformal_learner_keeps_all_scores(spark):
    got = {r.event_id: (r.threshold, r.miss, r.alpha) for r in Q.x4_stream_learner(spark, SF).collect()}
    events = load(spark, SF, "events").toPandas().sort_values(["user_id", "ts", "event_id"])
    assert set(got) == set(events.event_id)
    for _, own in events.groupby("user_id"):
        learner = online.AdaptiveConformal()
        for i, v in zip(own.event_id, own.value, strict=True):
            assert got[i] == pytest.approx((learner.threshold(), learner.update(min(abs(v) / 100, 1.0)), learner.alpha))


def test_a_folder_is_read_again_and_late_rows_are_left_out(spark, tmp_path):
    path = str(tmp_path / "in")
    day = lambda n: T0 + timedelta(days=n)
    write(spark, path, [(1, 1, day(0), 5.0), (1, 3, day(2), 9.0), (2, 4, day(1), 1.0), (None, 9, day(1), 7.0)])
    stream = deltas(spark, path).run()
    assert {r.event_id: r.delta for r in stream.result().collect()} == {1: None, 3: 4.0, 4: None, 9: None}
    assert stream.passed().count() == 0  # all within three days: nothing is settled
    write(spark, path, [(1, 2, day(1), 6.0), (1, 3, day(2), 9.0), (1, 5, day(10), 20.0)])  # one late, one again
    stream.run()
    assert {r.event_id: r.delta for r in stream.result().collect()} == {1: None, 2: 1.0, 3: 3.0, 5: 11.0, 4: None, 9: None}
    assert {r.event_id for r in stream.passed().collect()} == {1, 2, 3, 4, 9}
    write(spark, path, [(2, 6, day(3), 50.0), (2, 7, day(11), 4.0)])  # the first is behind the watermark
    stream.run()
    assert {r.event_id: r.delta for r in stream.result().collect()} == {1: None, 2: 1.0, 3: 3.0, 5: 11.0, 4: None, 9: None, 7: 3.0}
    stream.run()  # nothing new
    assert stream.result().count() == 7
    assert spark.read.parquet(path).filter("event_id > 9 or ts > '2025-01-01'").count() == 0  # no row of ours in the folder


def test_keys_of_a_group_share_their_state(spark, tmp_path):
    """State that is asked for once for each key took most of the time where there are many keys."""
    path = str(tmp_path / "in")
    day = lambda n: T0 + timedelta(days=n)
    users = [*range(60), None, 2**60 + 1]
    write(spark, path, [(u, 1000 * n + i, day(n), float(n * i)) for i, u in enumerate(users) for n in range(5)])
    stream = ordered.OrderedStream(spark, path, spark.createDataFrame([], EVENTS).schema, ["user_id"], "ts", ["event_id"], "3 days", ordered.Deltas, "event_id long, delta double", "deltas", buckets=3).run()
    got = {(r.user_id, r.event_id): r.delta for r in stream.result().collect()}
    assert got == {(u, 1000 * n + i): float(i) if n else None for i, u in enumerate(users) for n in range(5)}
    assert 0 < stream.passed().count() < len(got) and stream._state("times", "value.first").count() <= 3


def test_a_part_is_staged_as_many_files(spark, tmp_path):
    """One task used to write, and to read, all rows of a part."""
    path = str(tmp_path / "in")
    monitors.stage_files(spark.range(4000).withColumn("part", F.col("id") % 2), "part", 2, path, 8)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) == 16 and spark.read.parquet(path).count() == 4000


def test_an_empty_folder_gives_nothing(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [])
    assert deltas(spark, path).run().result().count() == 0


def plain_days(files, late):
    newest, counts, behind = None, {}, 0
    for rows in files:
        boundary = None if newest is None else newest - late
        for _, i, t, v in rows:
            if boundary is not None and t < boundary:
                behind += 1
            else:
                counts.setdefault(t.date(), {})[i] = v
        newest = max([t for *_, t, _ in rows] + ([newest] if newest else []))
    return {d: (len(x), sum(x.values())) for d, x in counts.items()}, behind, newest - late


def test_days_close_once_and_open_days_are_not_stored(spark, tmp_path):
    path = str(tmp_path / "in")
    at = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    files = [
        [(1, 1, at(0, 1), 1.0), (1, 2, at(1, 2), 2.0), (1, 3, at(4), 3.0)],
        [(1, 4, at(0, 5), 10.0), (1, 5, at(2), 5.0), (1, 3, at(4), 3.0), (1, 6, at(8), 6.0)],  # one behind, one again
        [(1, 7, at(8, 3), 7.0), (1, 8, at(5), 8.0), (1, 9, at(6, 1), 9.0), (1, 10, at(3), 1.0)],
    ]
    days = monitors.BoundedDays(spark, spark.createDataFrame([], EVENTS).schema, "ts", "user_id", "event_id", "value", "2 days")
    for n in range(1, len(files) + 1):
        write(spark, path, files[n - 1])
        days.run(path)
        want, behind, boundary = plain_days(files[:n], timedelta(days=2))
        assert {r.day: (r.n, r.total) for r in days.counts().collect()} == want
        assert days.late_rows().count() == behind
        stored = {r.day for r in days.closed().collect()}
        assert stored == {d for d in want if d < boundary.date()} and not stored & {r.day for r in days.open().collect()}
    assert behind == 3


def test_streams_write_nothing_into_the_source(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(1, 1, T0, 1.0)])
    before = sorted(os.listdir(path))
    deltas(spark, path).run().result().collect()
    assert sorted(os.listdir(path)) == before


def test_late_rows_of_the_query_are_counted(spark):
    rows = Q.x5_stream_windows(spark, SF).toPandas()
    total = load(spark, SF, "events").count()
    again = Q._arrivals(spark, SF).count() - total
    assert rows.late.sum() > 0 and total <= rows.n.sum() + rows.late.sum() <= total + again
    assert isinstance(rows, pd.DataFrame) and Q._arrivals(spark, SF).filter(F.col("part").isNull()).count() == 0
