"""Queries of the probability, source and scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions import expr as X
from probspark.operators import fusion as P
from probspark.operators import scoring as S
from probspark.operators.ranks import joined, quantiles
from probspark.plans.registry import query

AS_OF = "2001-12-01"
_LOGIT = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"


@query("f1_quote_probability", "quotes", keep="subject ts outcome", doubles="probability", sql="""
    SELECT subject, ts, outcome, CASE WHEN value > 1 THEN 1 / value ELSE 0 END AS probability FROM quotes""")
def f1(quotes):
    return quotes.withColumn("probability", X.quote_probability(F.col("value"), F.col("signal_type")))


@query("f2_evidence_probability", "supplier", keep="s_suppkey", doubles="probability", sql="""
    SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN least(greatest(s_acctbal / 10000, 0), 1) END,
        CASE s_suppkey % 4 WHEN 1 THEN 0.65e0 WHEN 2 THEN 0.35e0 END, 0.5e0) AS probability FROM supplier""")
def f2(supplier):
    number = F.col("s_suppkey")
    word = F.when(number % 4 == 1, "Upward").when(number % 4 == 2, "downward")
    value = F.when(number % 3 == 0, F.col("s_acctbal") / 10000)
    return supplier.withColumn("probability", X.evidence_probability(F.lit(None).cast("double"), value, word))


@query("f3_flow_confidence", "shares", keep="subject ts outcome", doubles="flow_confidence", sql="""
    SELECT subject, ts, outcome, least(least(abs(f) / 10, 1) + least(abs(f) / 5, 0.2e0), 1) AS flow_confidence FROM (
        SELECT *, (p - lag(p) OVER (PARTITION BY subject, outcome ORDER BY ts)) * 100 AS f FROM shares) q WHERE f IS NOT NULL""")
def f3(shares):
    w = Window.partitionBy("subject", "outcome").orderBy("ts")
    df = shares.withColumn("f", F.abs(F.col("p") - F.lag("p").over(w)) * 100).filter("f is not null")
    one = F.lit(1.0)
    return df.withColumn("flow_confidence", F.least(F.least(F.col("f") / 10, one) + F.least(F.col("f") / 5, F.lit(0.2)), one))


@query("f4_kelly", "quotes", keep="subject ts outcome", doubles="expected_value fraction", sql="""
    SELECT subject, ts, outcome, p * b - (1 - p) AS expected_value, greatest(0, (p * b - (1 - p)) / b) AS fraction FROM (
        SELECT *, value * 1.1e0 - 1 AS b, 1 / value AS p FROM quotes) q WHERE b > 0""")
def f4(quotes):
    value, fraction = X.kelly(1 / F.col("value"), F.col("value") * 1.1)
    return quotes.filter("value * 1.1 > 1").withColumns({"expected_value": value, "fraction": fraction})


@query("f15_losses", "forecasts", keep="stream_id seq source_id", doubles="square absolute log_loss", sql="""
    SELECT stream_id, seq, source_id, (prediction - actual) * (prediction - actual) AS square, abs(prediction - actual) AS absolute,
        -(a * ln(p) + (1 - a) * ln(1 - p)) AS log_loss FROM (
        SELECT *, least(greatest(prediction, 1e-6), 1 - 1e-6) AS p, least(greatest(actual, 1e-6), 1 - 1e-6) AS a FROM forecasts) q""")
def f15(forecasts):
    p, a = X.clip(F.col("prediction"), 1e-6, 1 - 1e-6), X.clip(F.col("actual"), 1e-6, 1 - 1e-6)
    gap = F.col("prediction") - F.col("actual")
    return forecasts.withColumns({"square": gap * gap, "absolute": F.abs(gap), "log_loss": -(a * F.ln(p) + (1 - a) * F.ln(1 - p))})


_TRUE = """SELECT subject, ts, outcome, total - 1 AS margin, (total - 1) / total AS margin_share, implied / total AS probability, n FROM (
    SELECT subject, ts, outcome, 1 / value AS implied, sum(1 / value) OVER (PARTITION BY subject, ts) AS total, count(*) OVER (PARTITION BY subject, ts) AS n
    FROM quotes WHERE value > 1) q"""


@query("a1_true_probability", "quotes", keep="subject ts outcome", doubles="margin margin_share probability", sql=_TRUE)
def a1(quotes):
    return P.true_probabilities(quotes, ["subject", "ts"])


@query("a2_wilson_interval", "quotes", keep="subject ts outcome", doubles="low high", sql=f"""
    SELECT subject, ts, outcome, greatest(0, c - h) AS low, least(1, c + h) AS high FROM (
        SELECT *, (probability + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) AS c,
            1.96e0 * sqrt(probability * (1 - probability) / n + 3.8416e0 / (4 * n * n)) / (1 + 3.8416e0 / n) AS h FROM ({_TRUE}) t) q""")
def a2(quotes):
    df = P.true_probabilities(quotes, ["subject", "ts"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("subject", "ts")))
    low, high = P.wilson_interval(F.col("probability"), F.col("n"))
    return df.withColumns({"low": low, "high": high})


@query("a4_conditional_probability", "shares", keep="subject ts outcome", doubles="conditional", sql="""
    SELECT subject, ts, outcome, p / sum(p) OVER (PARTITION BY subject, ts) AS conditional FROM shares WHERE outcome IN ('PROMO', 'STANDARD', 'ECONOMY')""")
def a4(shares):
    return P.conditional_probabilities(shares, ["subject", "ts"], F.col("outcome").isin("PROMO", "STANDARD", "ECONOMY"))


_BETA = """SELECT source, a / (a + b) AS mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd, a AS alpha, b AS beta FROM (
    SELECT source, 2 + sum(y) AS a, 2.0e0 + count(*) - sum(y) AS b FROM (SELECT d.source, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id) j GROUP BY source) q"""


@query("a5_beta_update", "documents labels", keep="source", doubles="alpha beta mean sd low high", sql=f"""
    SELECT *, greatest(0, mean - 1.96e0 * sd) AS low, least(1, mean + 1.96e0 * sd) AS high FROM ({_BETA}) b""")
def a5(documents, labels):
    counts = documents.select("doc_id", "source").join(labels, "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    return counts.select("source", *(c.alias(n) for n, c in P.beta_update(F.lit(2.0), F.lit(2.0), F.col("k"), F.col("n")).items()))


@query("a6_prior_pooling", "documents labels", keep="sources", doubles="pooled_alpha pooled_beta pooled_mean", sql=f"""
    SELECT count(*) AS sources, sum(w * alpha) / sum(w) AS pooled_alpha, sum(w * beta) / sum(w) AS pooled_beta,
        sum(w * alpha) / (sum(w * alpha) + sum(w * beta)) AS pooled_mean FROM (SELECT *, CASE WHEN source < 'src2' THEN 2.0e0 ELSE 1.0e0 END AS w FROM ({_BETA}) b) q""")
def a6(documents, labels):
    """Weighted means of the sources' posterior parameters."""
    w = F.when(F.col("source") < "src2", 2.0).otherwise(1.0)
    a, b = F.sum(w * F.col("alpha")), F.sum(w * F.col("beta"))
    return a5(documents, labels).agg(F.count(F.lit(1)).alias("sources"), (a / F.sum(w)).alias("pooled_alpha"), (b / F.sum(w)).alias("pooled_beta"), (a / (a + b)).alias("pooled_mean"))


_WEIGHTED = """SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY subject) <= 0 THEN 1.0e0 / count(*) OVER (PARTITION BY subject)
    ELSE raw / sum(raw) OVER (PARTITION BY subject) END AS weight FROM (
    SELECT *, CASE grade WHEN 'A' THEN 1.0e0 WHEN 'B' THEN 0.8e0 ELSE 0.6e0 END * confidence
        * pow(2.0e0, -greatest(date_diff('day', ts, DATE '2001-12-01') * 24.0e0, 0) / 720.0e0) AS raw FROM evidence) e"""


@query("a7_source_weights", "evidence", keep="subject source", doubles="weight", sql=_WEIGHTED, digits=9)
def a7(evidence):
    return P.source_weights(evidence, AS_OF, 720.0)


@query("a8_a12_pools", "evidence", keep="subject sources", doubles="linear log_odds bayesian hybrid consensus", sql=f"""
    SELECT *, (linear + 2 * log_odds) / 3 AS hybrid, log_odds AS bayesian, 1 - least(deviation / 0.5e0, 1) AS consensus FROM (
        SELECT subject, count(*) AS sources, sum(weight * p) AS linear, 1 / (1 + exp(-sum(weight * {_LOGIT.format('p')}))) AS log_odds,
            sqrt(sum(weight * (p - mean) * (p - mean))) AS deviation FROM (
            SELECT *, sum(weight * p) OVER (PARTITION BY subject) AS mean FROM ({_WEIGHTED}) w) m GROUP BY subject) q""")
def a8(evidence):
    """With weights that sum to 1 the prior cancels, so the Bayesian pool equals the log-odds pool."""
    return P.pools(P.source_weights(evidence, AS_OF, 720.0))


_ANOMALIES = f"""SELECT subject, source, distance FROM (SELECT *, abs(p - mean) / deviation AS distance FROM (
    SELECT *, sqrt(sum(weight * (p - mean) * (p - mean)) OVER (PARTITION BY subject)) AS deviation, count(*) OVER (PARTITION BY subject) AS n FROM (
        SELECT *, sum(weight * p) OVER (PARTITION BY subject) AS mean FROM ({_WEIGHTED}) w) m) d) q WHERE n >= 3 AND deviation >= 1e-6 AND distance > 2"""


@query("a13_anomalies", "evidence", keep="subject source", doubles="distance", sql=_ANOMALIES)
def a13(evidence):
    return P.anomalies(P.source_weights(evidence, AS_OF, 720.0))


@query("j13_source_diversity", "evidence", keep="subject n", doubles="mean_difference diversity effective", sql="""
    SELECT *, least(mean_difference / 0.5e0, 1) AS diversity, 1 + (n - 1) * least(mean_difference / 0.5e0, 1) AS effective FROM (
        SELECT a.subject, max(a.n) AS n, avg(abs(a.p - b.p)) AS mean_difference FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM evidence) a
        JOIN evidence b ON a.subject = b.subject AND a.source < b.source GROUP BY a.subject) q""")
def j13(evidence):
    return P.source_diversity(evidence)


_FORECAST = "SELECT subject, ts, outcome, p, row_number() OVER (PARTITION BY subject, ts ORDER BY amount, outcome) = 1 AS hit FROM shares"


def _with_hit(shares):
    return shares.withColumn("hit", F.row_number().over(Window.partitionBy("subject", "ts").orderBy("amount", "outcome")) == 1)


@query("a16_outcome_scores", "shares", keep="subject ts top", doubles="brier p_actual log_score", sql=f"""
    SELECT subject, ts, avg((p - CAST(hit AS DOUBLE)) * (p - CAST(hit AS DOUBLE))) AS brier, max(CASE WHEN hit THEN p END) AS p_actual,
        -ln(max(CASE WHEN hit THEN p END)) AS log_score, first(outcome ORDER BY p DESC, outcome) AS top FROM ({_FORECAST}) f GROUP BY subject, ts""")
def a16(shares):
    return S.outcome_scores(_with_hit(shares), ["subject", "ts"])


@query("a17_adjacent_score", "shares", keep="subject ts", doubles="score", sql=f"""
    SELECT subject, ts, -2 * max(CASE WHEN hit THEN ln(p) END) + coalesce(sum(step * step), 0) AS score FROM (
        SELECT *, ln(p) - lag(ln(p)) OVER (PARTITION BY subject, ts ORDER BY p DESC, outcome) AS step FROM ({_FORECAST}) f) q GROUP BY subject, ts""")
def a17(shares):
    return S.adjacent_score(_with_hit(shares), ["subject", "ts"])


_CURVE = "SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM class_forecasts GROUP BY 1"


@query("a19_calibration_curve", "class_forecasts", keep="bin n", doubles="mean_p observed", sql=_CURVE)
def a19(forecasts):
    return S.calibration_curve(forecasts)


@query("a18_brier_decomposition", "class_forecasts", keep="", doubles="reliability resolution uncertainty net", sql=f"""
    SELECT *, resolution - reliability AS net FROM (SELECT sum(n * (mean_p - observed) * (mean_p - observed)) / sum(n) AS reliability,
        sum(n * (observed - base) * (observed - base)) / sum(n) AS resolution, max(base * (1 - base)) AS uncertainty
        FROM ({_CURVE}) c CROSS JOIN (SELECT avg(y) AS base FROM class_forecasts) b) q""")
def a18(forecasts):
    return S.brier_decomposition(forecasts)


@query("a20_crps", "events", keep="event_type", doubles="crps", sql="""
    WITH pts AS (SELECT event_type, k / 10.0e0 AS f, q[k] AS x FROM (SELECT event_type, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q
        FROM events GROUP BY event_type) g CROSS JOIN range(1, 11) t(k)),
    act AS (SELECT event_type, last(value ORDER BY ts, event_id) AS y FROM events GROUP BY event_type),
    steps AS (SELECT p.event_type, p.f, p.x, a.y, lead(p.x) OVER (PARTITION BY p.event_type ORDER BY p.x, p.f) - p.x AS dx FROM pts p JOIN act a ON p.event_type = a.event_type)
SELECT event_type, sum((f - CAST(x >= y AS INT)) * (f - CAST(x >= y AS INT)) * dx) AS crps FROM steps WHERE dx > 0 GROUP BY event_type""")
def a20(events):
    """Left Riemann sum over the deciles of each event type against its latest value."""
    levels = [k / 10 for k in range(1, 11)]
    seen = events.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("y"))
    seen = joined(seen, quantiles(events, ["event_type"], {f"q{k}": (F.col("value"), q) for k, q in enumerate(levels)}), ["event_type"])
    points = seen.select("event_type", "y", F.posexplode(F.array(*(f"q{k}" for k in range(10)))).alias("k", "x")).withColumn("f", (F.col("k") + 1) / 10)
    steps = points.withColumn("dx", F.lead("x").over(Window.partitionBy("event_type").orderBy("x", "f")) - F.col("x")).filter("dx > 0")
    miss = F.col("f") - (F.col("x") >= F.col("y")).cast("int")
    return steps.groupBy("event_type").agg(F.sum(miss * miss * F.col("dx")).alias("crps"))


@query("a22_conformal_threshold", "documents class_forecasts", keep="source n", doubles="threshold", sql="""
    SELECT source, n, score AS threshold FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY score) AS place FROM (
        SELECT d.source, CASE WHEN f.y = 1 THEN 1 - f.p ELSE f.p END AS score FROM documents d JOIN class_forecasts f ON d.doc_id = f.forecast_id) s) q
    WHERE place = least(greatest(ceil((n + 1) * (1 - 0.1e0)), 1), n)""")
def a22(documents, forecasts):
    score = F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p"))
    df = forecasts.withColumn("score", score).join(documents.select(F.col("doc_id").alias("forecast_id"), "source"), "forecast_id")
    return S.conformal_threshold(df, ["source"], 0.1)


_SET = """t AS (SELECT score AS threshold FROM (SELECT 1 - p AS score, row_number() OVER (ORDER BY 1 - p) AS place, count(*) OVER () AS n FROM f WHERE hit) q WHERE place = least(greatest(ceil((n + 1) * (1 - 0.1e0)), 1), n))"""


@query("a23_prediction_set", "shares", keep="subject ts size outcomes is_empty is_full", doubles="target", sql=f"""
    WITH f AS ({_FORECAST}), {_SET}
SELECT subject, ts, count(*) FILTER (1 - p <= threshold + 1e-12) AS size, coalesce(string_agg(CASE WHEN 1 - p <= threshold + 1e-12 THEN outcome END, ',' ORDER BY outcome), '') AS outcomes,
    count(*) FILTER (1 - p <= threshold + 1e-12) = 0 AS is_empty, bool_and(1 - p <= threshold + 1e-12) AS is_full, 0.9e0 AS target FROM f CROSS JOIN t GROUP BY subject, ts""")
def a23(shares):
    """Outcomes within the threshold of all forecasts' scores of what happened."""
    df = _with_hit(shares)
    threshold = S.conformal_threshold(df.filter("hit").select((1 - F.col("p")).alias("score")), [], 0.1)
    return S.prediction_sets(df, ["subject", "ts"], threshold, 0.1)


_LOSSES = """SELECT *, sum(loss) OVER w AS total_loss, avg(loss) OVER w AS mean_loss,
    avg(loss) OVER (PARTITION BY stream_id, source_id ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS recent_loss FROM (
    SELECT *, (prediction - actual) * (prediction - actual) AS loss FROM forecasts) l WINDOW w AS (PARTITION BY stream_id, source_id ORDER BY seq)"""
_EWA = f"""SELECT *, raw / sum(raw) OVER (PARTITION BY stream_id, seq) AS weight FROM (
    SELECT *, exp(-2 * (total_loss - min(total_loss) OVER (PARTITION BY stream_id, seq))) AS raw FROM ({_LOSSES}) l) r"""


@query("w17_ewa_weights", "forecasts", keep="stream_id seq source_id", doubles="weight", sql=_EWA)
def w17(forecasts):
    return S.expert_weights(S.expert_losses(forecasts), "ewa")


@query("w18_poly_weights", "forecasts", keep="stream_id seq source_id", doubles="weight", sql=f"""
    SELECT *, raw / sum(raw) OVER (PARTITION BY stream_id, seq) AS weight FROM (
        SELECT *, 1 / (1 + 2 * (mean_loss - min(mean_loss) OVER (PARTITION BY stream_id, seq))) AS raw FROM ({_LOSSES}) l) r""")
def w18(forecasts):
    return S.expert_weights(S.expert_losses(forecasts), "poly")


@query("w19_combined_forecast", "forecasts", keep="stream_id seq", doubles="combined actual", sql=f"""
    SELECT stream_id, seq, sum(used * prediction) AS combined, max(actual) AS actual FROM (
        SELECT *, coalesce(lag(weight) OVER (PARTITION BY stream_id, source_id ORDER BY seq), 1.0e0 / 3) AS used FROM ({_EWA}) w) q GROUP BY stream_id, seq""")
def w19(forecasts):
    return S.combined_forecasts(S.expert_weights(S.expert_losses(forecasts), "ewa"))


@query("w20_expert_performance", "forecasts", keep="stream_id source_id n", doubles="total_loss mean_loss recent_loss", digits=4, sql=f"""
    SELECT stream_id, source_id, seq AS n, total_loss, mean_loss, recent_loss FROM (
        SELECT *, row_number() OVER (PARTITION BY stream_id, source_id ORDER BY seq DESC) AS back FROM ({_LOSSES}) l) q WHERE back = 1""")
def w20(forecasts):
    last = Window.partitionBy("stream_id", "source_id").orderBy(F.desc("seq"))
    return S.expert_losses(forecasts).withColumn("back", F.row_number().over(last)).filter("back = 1").withColumnRenamed("seq", "n")


@query("w21_rolling_coverage", "forecasts", keep="stream_id source_id seq", doubles="coverage", sql="""
    SELECT stream_id, source_id, seq, 1 - avg(miss) OVER (PARTITION BY stream_id, source_id ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS coverage FROM (
        SELECT *, CAST(abs(prediction - actual) > 0.2 AS INT) AS miss FROM forecasts) q""")
def w21(forecasts):
    w = Window.partitionBy("stream_id", "source_id").orderBy("seq").rowsBetween(-99, 0)
    miss = (F.abs(F.col("prediction") - F.col("actual")) > 0.2).cast("int")
    return forecasts.withColumn("coverage", 1 - F.avg(miss).over(w))


@query("a34_snapshot_validity", "shares", keep="subject ts valid", sql="SELECT subject, ts, sum(p) BETWEEN 0.95 AND 1.05 AS valid FROM shares GROUP BY subject, ts")
def a34(shares):
    return shares.groupBy("subject", "ts").agg(F.sum("p").between(0.95, 1.05).alias("valid"))

