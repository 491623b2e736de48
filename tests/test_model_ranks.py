"""The chain from a feature table to ranks and a report, against plain recomputation."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probspark.operators import model_ranks as MR
from probspark.plans import sequential_queries as Q
from probspark.sources.stored import stored

MONTHS, ENTITIES, LAST = 30, 20, 3  # labels of the last three months aren't known


def month(i: int) -> date:
    return date(2001 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for m in range(MONTHS):
        for e in range(ENTITIES):
            a, b = float(rng.normal()), float(rng.normal())
            y = int(rng.random() < 1 / (1 + np.exp(-3 * a)))
            shares = [float(x) for x in rng.random(4)]
            out.append((f"e{e:02d}", month(m), None if (m + e) % 17 == 0 else a, b, None if m >= MONTHS - LAST else y, float(a + rng.normal()), *shares, float(rng.random()), "mixed", "neutral", 10.0 + m + e))
    return out


COLUMNS = "entity string, dt date, a double, b double, y int, fwd double, ret_5_rank double, divergence_rank double, visibility_rank double, amount_ratio_5_20 double, regime_score double, regime string, position_state string, close double"


@pytest.fixture(scope="module")
def ranks(spark, rows):
    table = spark.createDataFrame(rows, COLUMNS).repartition(3)
    scores = MR.model_scores(table, ["a", "b"], "y", "dt", 12, 6, 1)
    return stored(MR.model_ranks(scores, ["entity"], "dt", 5), "test-ranks")


def test_labelled_dates_and_the_last_one_are_scored(ranks, rows):
    got = ranks.toPandas()
    whole = [r for r in rows if r[2] is not None]
    wanted = {(r[0], r[1]) for r in whole if r[4] is not None and r[1] >= month(12)} | {(r[0], r[1]) for r in whole if r[1] == month(MONTHS - 1)}
    assert set(zip(got.entity, got.dt, strict=True)) == wanted and len(got) == len(wanted)
    assert got[got.dt == month(MONTHS - 1)].y.isna().all() and (got[got.dt == month(MONTHS - 1)].trained_until == str(month(MONTHS - 1))).all()


def test_later_labels_do_not_reach_earlier_scores(spark, ranks, rows):
    """Labels turned round from the second refit on leave the first two folds' probabilities as they were."""
    turned = [(*r[:4], None if r[4] is None else 1 - r[4] if r[1] >= month(17) else r[4], *r[5:]) for r in rows]
    other = MR.model_scores(spark.createDataFrame(turned, COLUMNS), ["a", "b"], "y", "dt", 12, 6, 1)
    both = ranks.select("entity", "dt", "p").join(other.select("entity", "dt", F.col("p").alias("q")), ["entity", "dt"]).toPandas()
    early = both[both.dt < month(24)]
    assert len(early) > 200 and np.allclose(early.p, early.q)
    late = both[both.dt == month(MONTHS - 1)]
    assert len(late) and not np.allclose(late.p, late.q, atol=0.05)


def test_ranks_and_flows_follow_the_probabilities(ranks):
    got = ranks.toPandas().sort_values(["dt", "p", "entity"], ascending=[True, False, True])
    assert (got.groupby("dt").cumcount() + 1 == got.rank_probability).all()
    own = got.sort_values(["entity", "dt"])
    flow = own.groupby("entity").p.diff() * 100
    assert np.allclose(flow.fillna(-1e9), own.flow_pp.astype(float).fillna(-1e9))
    mean = flow.groupby(own.entity).transform(lambda x: x.rolling(3).mean())
    assert np.allclose(mean.fillna(-1e9), own.momentum_3.astype(float).fillna(-1e9))


def test_report_counts_all_labelled_rows(spark, ranks, rows):
    prices = spark.createDataFrame([(r[0], r[1], r[13]) for r in rows], "entity string, dt date, close double")
    report = MR.model_report(ranks, prices, "entity", "dt", "y", "fwd").toPandas()
    known = ranks.filter("y is not null").toPandas()
    pos, neg = known[known.y == 1].p.to_numpy(), known[known.y == 0].p.to_numpy()
    auc = (np.sign(pos[:, None] - neg[None, :]) + 1).mean() / 2
    top = known[known.rank_probability <= 5]
    assert (report.n == len(known)).all() and np.allclose(report.auc, auc) and auc > 0.8
    assert np.allclose(report.brier, ((known.p - known.y) ** 2).mean()) and np.allclose(report.top_hit_rate, top.y.mean()) and np.allclose(report.top_ret, top.fwd.mean())
    plain = report[report.config == "model_top30"].iloc[0]
    returns = []
    close = pd.DataFrame([(r[0], r[1], r[13]) for r in rows], columns=["entity", "dt", "close"]).pivot(index="dt", columns="entity", values="close")
    for d in sorted(set(ranks.select("dt").toPandas().dt))[::3]:
        at = list(close.index).index(d)
        if at + 5 < len(close):
            names = [r.entity for r in ranks.filter(F.col("dt") == F.lit(d)).orderBy("rank_probability").limit(5).collect()]
            returns.append((close.iloc[at + 5][names] / close.iloc[at][names] - 1).mean())
    assert plain.events == len(returns) and np.isclose(plain.mean_ret, np.mean(returns))


def test_nothing_to_learn_from_gives_none(spark, rows):
    table = spark.createDataFrame([(*r[:4], None, *r[5:]) for r in rows], COLUMNS)
    assert MR.model_scores(table, ["a", "b"], "y", "dt", 12, 6, 1) is None


def test_latest_scores_work_labels_out_once(spark, monkeypatch):
    """Each step of the fit built bars, features and labels from the lines again."""
    plain, worked = Q._labelled, spark.sparkContext.accumulator(0)

    def seen(label):
        worked.add(1)
        return label

    def counted(spark, sf_dir):
        df = plain(spark, sf_dir)
        return df.withColumn("label", F.udf(seen, df.schema["label"].dataType)("label"))

    monkeypatch.setattr(Q, "_labelled", counted)
    assert Q.m3_score_latest(spark, "/root/testdata/sf0.01").count() > 0
    assert worked.value == plain(spark, "/root/testdata/sf0.01").count()
