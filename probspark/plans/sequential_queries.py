"""Queries of order-dependent learners, ratings, models and streams.  SQL expresses ratings and the streams' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.operators import model_ranks as MR
from probspark.operators import models as M
from probspark.operators import online as O
from probspark.operators import ratings as R
from probspark.operators import turning as T
from probspark.plans.registry import ORACLE_SQL, QUERIES, query
from probspark.sources.inputs import load
from probspark.sources.stored import fresh_path, stored
from probspark.streaming import monitors as S
from probspark.streaming import ordered as Ordered


def g9_margin_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.remove_margin(load(spark, sf_dir, "quotes"), ["subject", "ts"]).withColumn("p", F.round("p", 8))


def g11_online_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.online_stacking(load(spark, sf_dir, "forecasts"))


def g12_ridge_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ridge_stacking(load(spark, sf_dir, "forecasts"))


KEYS = {"stream_id": "long", "source_id": "string"}


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every stream is a stream of scores."""
    return load(spark, sf_dir, "forecasts").select("stream_id", "source_id", "seq", F.least(F.abs(F.col("prediction") - F.col("actual")), F.lit(1.0)).alias("score"))


def g13_adaptive_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.adaptive_conformal(_scores(spark, sf_dir), KEYS)


def g14_aggregated_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.aggregated_conformal(_scores(spark, sf_dir), KEYS)


_RESULTS = """sums AS (SELECT l_orderkey, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY l_orderkey, l_suppkey),
games AS (SELECT CAST(extract(year FROM o.o_orderdate) AS INT) AS period, h.l_suppkey AS home, a.l_suppkey AS away, CASE WHEN h.amount > 1.2 * a.amount THEN 1.0e0 WHEN a.amount > 1.2 * h.amount THEN 0.0e0 ELSE 0.5e0 END AS score
    FROM sums h JOIN sums a ON h.l_orderkey = a.l_orderkey AND h.l_suppkey < a.l_suppkey JOIN orders o ON h.l_orderkey = o.o_orderkey),
results AS MATERIALIZED (SELECT period, home AS team, away AS opponent, score FROM games UNION ALL SELECT period, away, home, 1 - score FROM games)"""


@query("g15_period_ratings", "lineitem orders supplier", keep="period team games", doubles="rating rd volatility", digits=4, sql=f"""
    WITH RECURSIVE {_RESULTS},
years AS (SELECT period, row_number() OVER (ORDER BY period) AS n FROM (SELECT DISTINCT period FROM results) d),
rated AS (SELECT CAST(0 AS BIGINT) AS k, s_suppkey AS team, 0.0e0 AS mu, 350 / 173.7178e0 AS phi, 0.06e0 AS sigma, CAST(0 AS BIGINT) AS games FROM supplier
    UNION ALL
    SELECT k + 1, team, CASE WHEN n IS NULL THEN mu ELSE mu + pn * pn * ds END, CASE WHEN n IS NULL THEN phi ELSE pn END, CASE WHEN n IS NULL THEN sigma ELSE sn END, games + coalesce(n, 0)
    FROM (SELECT *, 1 / sqrt(1 / (phi * phi + sn * sn) + vs) AS pn
        FROM (SELECT r.*, u.vs, u.ds, u.n, CASE WHEN abs(u.ds / u.vs) > 1 THEN 1.0e0 ELSE r.sigma END AS sn
            FROM rated r LEFT JOIN (SELECT team, sum(g * g * e * (1 - e)) AS vs, sum(g * (score - e)) AS ds, count(*) AS n
                FROM (SELECT *, 1 / (1 + exp(-g * (mu - mu_o))) AS e
                    FROM (SELECT x.team, x.score, t.mu, 1 / sqrt(1 + 3 * o.phi * o.phi / (pi() * pi())) AS g, o.mu AS mu_o
                        FROM results x JOIN years y ON x.period = y.period JOIN rated t ON x.team = t.team AND t.k + 1 = y.n JOIN rated o ON x.opponent = o.team) m) e GROUP BY team) u ON r.team = u.team
            WHERE r.k < (SELECT count(*) FROM years)) s) t)
SELECT y.period, r.team, 1500 + 173.7178e0 * r.mu AS rating, 173.7178e0 * r.phi AS rd, r.sigma AS volatility, r.games FROM years y JOIN rated r ON y.n = r.k""")
def g15(lineitem, orders, supplier):
    """Every two suppliers of one order have played each other; a year is a period."""
    sums = lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    home, away = (sums.select("l_orderkey", F.col("l_suppkey").alias(side), F.col("amount").alias(f"{side}_amount")) for side in ("home", "away"))
    games = home.join(away, "l_orderkey").filter("home < away").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("period")), "l_orderkey")
    score = F.when(F.expr("home_amount > 1.2 * away_amount"), 1.0).when(F.expr("away_amount > 1.2 * home_amount"), 0.0).otherwise(0.5)
    sides = [F.struct(F.col(a).alias("team"), F.col(b).alias("opponent"), s.alias("score")) for a, b, s in (("home", "away", score), ("away", "home", 1 - score))]
    return R.period_ratings(games.select("period", F.inline(F.array(*sides))), supplier.select(F.col("s_suppkey").alias("team")))


FEATURES = ["ret_1", "ret_3", "ret_5", "amount_ratio_5_20", "intraday_position", "ma_gap_5_20"]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = T.bar_features(load(spark, sf_dir, "panel"), ["entity"], "dt").withColumn("ret_5_rank", F.lit(0.5))
    return T.turning_labels(bars, "dt", quantile=0.6).select("entity", "dt", *FEATURES, F.col("label_turn_3").alias("label"), "fwd_ret_3")


def _or_none(scored: DataFrame | None, panel: DataFrame) -> DataFrame:
    empty = panel.limit(0).withColumns({"p": F.lit(0.0), "trained_until": F.lit(""), "embargo": F.lit(0)})
    return empty if scored is None else scored


def m1_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees (20 rounds here) fitted on all but the last year, which they score."""
    panel = stored(_labelled(spark, sf_dir), "labelled")
    refits = M._dates(panel, "dt")[-12:-11]
    return _or_none(M.walk_forward(panel, FEATURES, "label", "dt", refits, 3, "boosted", 20), panel)


def m2_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = stored(_labelled(spark, sf_dir), "labelled")
    return _or_none(M.walk_forward(panel, FEATURES, "label", "dt", M._dates(panel, "dt")[36::12], 3), panel)


def m3_score_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit reads its rows once for each step: bars, features and labels are worked out once, before it."""
    panel = stored(_labelled(spark, sf_dir), "labelled")
    return _or_none(M.score_latest(panel, FEATURES, "label", "dt", M._dates(panel.filter("label is not null"), "dt")[-1], 3), panel)


def m4_look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = stored(_labelled(spark, sf_dir), "labelled")
    return _or_none(M.score_dates(panel, FEATURES, "label", "dt", M._dates(panel, "dt")[-1], 3, 3), panel)


def _model_ranks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bars, ranks by a model that is refitted every twelve months from the 37th labelled one on)."""
    panel = stored(load(spark, sf_dir, "panel"), "panel")
    table = MR.model_table(panel, ["entity"], "dt", quantile=0.6, least_runup=0.02)
    scores = MR.model_scores(table, MR.FEATURES, "label_turn_3", "dt", 36, 12, 3)
    scores = _or_none(scores, table)
    return panel, stored(MR.model_ranks(scores, ["entity"], "dt"), "model-ranks")


def m2_model_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's probabilities with rank, flow, momentum, signal state and strategy score; the last date's rows have no label."""
    return _model_ranks(spark, sf_dir)[1].select("entity", "dt", "p", "rank_probability", "flow_pp", "momentum_3", "signal_state", "strategy_score", "label_turn_3", "trained_until")


def m2_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest of each configuration on the model's ranks, and the quality of its probabilities."""
    panel, ranks = _model_ranks(spark, sf_dir)
    return MR.model_report(ranks, panel, "entity", "dt", "label_turn_3", "fwd_ret_3")


PARTS = 4
LATE = "20 days"
#: Files of a part where a learner's result doesn't depend on micro-batches: within ``LATE`` their order is of no account.
FILES = 16


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the file they come in (``part``): a week and more a file, a tenth of the rows a file late, a tenth coming twice."""
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = events.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).first()
    width = max(1.0, (first.t1 - first.t0).total_seconds() / PARTS + 1) if first.t0 else 1.0
    part = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(first.t0))) / width)
    number = F.col("event_id") % 10
    late = F.least(part + F.when(number == 3, 1).otherwise(0), F.lit(PARTS - 1))
    parts = F.when(number == 7, F.array(late, F.least(late + 1, F.lit(PARTS - 1)))).otherwise(F.array(late))
    return events.withColumn("part", F.explode(parts)).withColumn("part", F.col("part").cast("int"))


def staged_events(spark: SparkSession, sf_dir: str) -> tuple[str, object]:
    """(folder, schema) of the arrivals as files."""
    rows = _arrivals(spark, sf_dir)
    return S.stage_files(rows, "part", PARTS, fresh_path(spark, "events")), rows.drop("part").schema


def read_twice(spark: SparkSession, rows: DataFrame, name: str, stream, files: int = 1) -> object:
    """``stream(folder, schema)`` run over the first two parts of ``rows``, and again when the others have come."""
    path, made, rows = fresh_path(spark, name), None, stored(rows, name)
    for first in (0, 2):
        S.stage_files(rows.filter(F.col("part").between(first, first + 1)).withColumn("part", F.col("part") - first), "part", 2, path, files)
        made = made or stream(path, rows.drop("part").schema)
        made.run()
    return made


def x1_snapshot_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = load(spark, sf_dir, "panel").select("entity", "dt", "amount").withColumn("part", F.when(F.year("dt") < 1997, 0).when(F.year("dt") < 1999, 1).otherwise(2))
    again = panel.filter("part = 1 and year(dt) = 1998").withColumn("part", F.lit(2))
    path = S.stage_files(panel.unionByName(again), "part", 3, fresh_path(spark, "snapshots"))
    history, _ = S.monitor_snapshots(spark, S.read_files(spark, path, panel.drop("part").schema), "entity", "dt", "amount")
    return history.select("entity", "dt", F.col("rank").cast("long").alias("rank"), F.round("rank_pct", 6).alias("rank_pct"))


def x2_stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir).select("user_id", "event_id", "ts", "value", "part")
    stream = lambda path, schema: Ordered.OrderedStream(spark, path, schema, ["user_id"], "ts", ["event_id"], LATE, Ordered.Deltas, "event_id long, delta double", "deltas", files=FILES)
    return read_twice(spark, rows, "events", stream, FILES).result().withColumn("delta", F.round("delta", 6))


def x3_stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = staged_events(spark, sf_dir)
    return S.upsert_history(spark, S.read_files(spark, path, schema), ["event_id"]).select("event_id", "user_id", "event_type")


def x4_stream_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive conformal learner of each user, predicting and then learning from every event in order, on all scores so far."""
    rows = _arrivals(spark, sf_dir).select("user_id", "event_id", "ts", "value", "part")
    learner = lambda: Ordered.Conformal(O.AdaptiveConformal)
    stream = lambda path, schema: Ordered.OrderedStream(spark, path, schema, ["user_id"], "ts", ["event_id"], LATE, learner, "event_id long, threshold double, miss int, alpha double", "learner", files=FILES)
    return read_twice(spark, rows, "events", stream, FILES).result()


def all_learners() -> Ordered.Several:
    """Every learner of forecasts, as the batch operators run them."""
    return Ordered.Several({"stacking": O.Stacking(0.1, 0.01), "ridge": O.Ridge(1.0), **expert_weights().weights}, {"conformal": O.AdaptiveConformal, "aggregated": O.AggregatedConformal})


def expert_weights() -> Ordered.Several:
    return Ordered.Several({"ewa": O.ExpertWeights("ewa"), "poly": O.ExpertWeights("poly")}, {})


def forecasts_on_stream(spark: SparkSession, sf_dir: str, learner) -> DataFrame:
    """The learners of each user's forecasts, on forecasts that come as files, late and twice."""
    keys = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = load(spark, sf_dir, "events").withColumn("seq", F.row_number().over(keys).cast("long")).select(F.col("user_id").alias("stream_id"), "seq", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    steps = steps.join(_arrivals(spark, sf_dir).select("event_id", "part"), "event_id")
    rows = load(spark, sf_dir, "forecasts").join(steps, ["stream_id", "seq"]).select("stream_id", "seq", "source_id", "prediction", "actual", "ts", "part")
    stream = lambda path, schema: Ordered.OrderedStream(spark, path, schema, ["stream_id"], "ts", ["seq", "source_id"], LATE, learner, Ordered.learned(learner()), "learners", files=FILES)
    return Ordered.one_row_each(read_twice(spark, rows, "forecasts", stream, FILES).result(), ["stream_id"], learner())


def x4_stream_learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six learners of each user's forecasts on one stream: weights of sources, thresholds of each source."""
    return forecasts_on_stream(spark, sf_dir, all_learners)


def x4_stream_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two weights by losses so far, on the stream of forecasts."""
    rows = forecasts_on_stream(spark, sf_dir, expert_weights)
    return rows.select("stream_id", "seq", "source_id", "learner", (F.floor(F.col("value") * 1e6 + 0.5) / 1e6).alias("weight"))


X5_LATE = "6 days"


def _days(spark: SparkSession, sf_dir: str) -> S.BoundedDays:
    rows = _arrivals(spark, sf_dir)
    stream = lambda path, schema: _Days(S.BoundedDays(spark, schema, "ts", "event_type", "event_id", "value", X5_LATE), path)
    return read_twice(spark, rows, "events", stream).days


class _Days:
    def __init__(self, days: S.BoundedDays, path: str):
        self.days, self.path = days, path

    def run(self) -> None:
        self.days.run(self.path)


def x5_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per day and type of the rows that came in time; every row behind the boundary is in the count of late rows of its day."""
    days = _days(spark, sf_dir)
    late = days.late_rows().groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("late"))
    return days.counts().join(late, ["day", "event_type"], "full").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.round("total", 3).alias("total"), F.coalesce("late", F.lit(0)).alias("late")
    )


QUERIES.update({f.__name__: f for f in (
    g9_margin_removal, g11_online_stacking, g12_ridge_stacking, g13_adaptive_conformal, g14_aggregated_conformal, m1_boosted_trees, m2_walk_forward, m3_score_latest, m4_look_back,
    m2_model_ranks, m2_model_report,
    x1_snapshot_monitor, x2_stream_deltas, x3_stream_history, x4_stream_learner, x4_stream_learners, x4_stream_weights, x5_stream_windows,
)})
ORACLE_SQL.update({
    "x1_snapshot_monitor": """WITH p AS (SELECT p_brand AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
        SELECT entity, dt, row_number() OVER (PARTITION BY dt ORDER BY amount DESC, entity) AS rank, round((rank() OVER (PARTITION BY dt ORDER BY amount) + (count(*) OVER (PARTITION BY dt, amount) - 1) / 2.0) / count(*) OVER (PARTITION BY dt), 6) AS rank_pct FROM p""",
    "x2_stream_deltas": "SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events",
    "x3_stream_history": "SELECT event_id, user_id, event_type FROM events",
    "x4_stream_weights": " UNION ALL ".join(
        f"SELECT stream_id, seq, source_id, '{name}' AS learner, weight FROM ({sql}) AS {name}" for name, sql in ((n, ORACLE_SQL[q]) for n, q in (("ewa", "w17_ewa_weights"), ("poly", "w18_poly_weights")))
    ),
    "x5_stream_windows": f"""WITH bounds AS (SELECT min(ts) AS t0, greatest(1.0e0, epoch(max(ts)) - epoch(min(ts))) / {PARTS} + 1 AS width FROM events),
        e AS (SELECT events.*, least(CAST(floor((floor(epoch(ts)) - floor(epoch(t0))) / width) AS INT) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END, {PARTS - 1}) AS part FROM events, bounds),
        a AS (SELECT * FROM e UNION ALL SELECT * REPLACE (least(part + 1, {PARTS - 1}) AS part) FROM e WHERE event_id % 10 = 7),
        seen AS (SELECT p.part, (SELECT max(ts) FROM a b WHERE b.part < p.part) - INTERVAL {X5_LATE} AS boundary FROM (SELECT DISTINCT part FROM a) p),
        s AS (SELECT a.*, boundary IS NOT NULL AND ts < boundary AS is_late FROM a JOIN seen ON a.part = seen.part),
        once AS (SELECT DISTINCT event_id, CAST(ts AS DATE) AS day, event_type, value FROM s WHERE NOT is_late),
        n AS (SELECT day, event_type, count(*) AS n, sum(value) AS total FROM once GROUP BY 1, 2),
        l AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS late FROM s WHERE is_late GROUP BY 1, 2)
        SELECT strftime(coalesce(n.day, l.day), '%Y-%m-%d') AS day, coalesce(n.event_type, l.event_type) AS event_type, coalesce(n, 0) AS n, round(total, 3) AS total, coalesce(late, 0) AS late
        FROM n FULL JOIN l ON n.day = l.day AND n.event_type = l.event_type""",
})
