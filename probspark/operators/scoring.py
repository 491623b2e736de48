"""Scores and calibration of forecasts, conformal thresholds and online expert weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 4096


def outcome_scores(df: DataFrame, key: list[str]) -> DataFrame:
    """Brier and log score, first maximum and the actual outcome's probability (``outcome, p, hit``)."""
    hit = F.col("hit").cast("double")
    actual = F.coalesce(F.max(F.when(F.col("hit"), F.col("p"))), F.lit(0.0))
    top = F.min_by("outcome", F.struct((-F.col("p")).alias("p"), F.col("outcome")))
    out = df.groupBy(*key).agg(F.avg((F.col("p") - hit) ** 2).alias("brier"), actual.alias("p_actual"), top.alias("top"))
    return out.withColumn("log_score", -F.ln(F.least(F.greatest(F.col("p_actual"), F.lit(1e-15)), F.lit(1 - 1e-15))))


def adjacent_score(df: DataFrame, key: list[str]) -> DataFrame:
    """-2 ln p(actual) plus the squared steps of ln p from the largest probability down."""
    logp = F.ln(F.greatest("p", F.lit(1e-15)))
    w = Window.partitionBy(*key).orderBy(F.desc("p"), "outcome")
    df = df.withColumn("logp", logp).withColumn("step", F.col("logp") - F.lag("logp").over(w))
    return df.groupBy(*key).agg((-2 * F.max(F.when(F.col("hit"), F.col("logp"))) + F.coalesce(F.sum(F.col("step") ** 2), F.lit(0.0))).alias("score"))


def calibration_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of ``p``: rows, mean forecast and observed rate of ``y``."""
    number = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", number).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed"))


def brier_decomposition(df: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability, resolution, uncertainty and net skill; one row, from two levels of aggregation."""
    curve = calibration_curve(df, bins)
    total = curve.agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("observed")) / F.sum("n")).alias("base"))
    joined = curve.join(F.broadcast(total), F.lit(True))  # bins x one row
    n, rows = F.col("n"), F.first("rows")
    reliability = F.sum(n * (F.col("mean_p") - F.col("observed")) ** 2) / rows
    resolution = F.sum(n * (F.col("observed") - F.col("base")) ** 2) / rows
    out = joined.agg(reliability.alias("reliability"), resolution.alias("resolution"), F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))
    return out.withColumn("net", F.col("resolution") - F.col("reliability"))


def _bucket(score: Column) -> Column:
    """One of BUCKETS equal ranges of a score within 0 and 1: sorts run inside a range, sums of ranges are a short table."""
    return F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * BUCKETS).cast("int")


def rank_quality(df: DataFrame, date: str | None = None, entity: str | None = None, rank: str | None = None, forward: str | None = None, top_n: int = 0) -> DataFrame:
    """Rows, base rate, Brier score and exact AUC (ties count half) of scores ``p`` within 0 and 1 against ``y``.

    With the other columns also distinct dates and entities, and hit rate and forward return of the first ``top_n`` ranks,
    over rows and as a mean over dates.
    """
    counts = df.groupBy("p").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"), F.sum((F.col("p") - F.col("y")) ** 2).alias("error"))
    counts = counts.withColumn("bucket", _bucket(F.col("p")))
    before = F.coalesce(F.sum("neg").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # BUCKETS rows
    starts = counts.groupBy("bucket").agg(F.sum("neg").alias("neg")).select("bucket", before.alias("start"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    counts = counts.withColumn("inside", inside).join(starts, "bucket").withColumn("pairs", F.col("pos") * (F.col("start") + F.col("inside") + F.col("neg") / 2))
    out = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("pairs").alias("pairs"), F.sum("error").alias("error"))
    n = F.col("pos") + F.col("neg")
    out = out.select(n.cast("long").alias("n"), (F.col("pos") / n).alias("base_rate"), (F.col("error") / n).alias("brier"), F.try_divide(F.col("pairs"), F.col("pos") * F.col("neg")).alias("auc"))
    if rank is None:
        return out
    top = F.col(rank) <= top_n
    over = df.agg(F.count_distinct(date).alias("dates"), F.count_distinct(entity).alias("entities"), F.avg(F.when(top, F.col("y"))).alias("top_hit_rate"), F.avg(F.when(top, F.col(forward))).alias("top_ret"))
    daily = df.filter(top).groupBy(date).agg(F.avg("y").alias("hit")).agg(F.avg("hit").alias("daily_top_hit_rate"))
    return out.join(over, F.lit(True)).join(daily, F.lit(True))  # one row each


def conformal_threshold(df: DataFrame, key: list[str], alpha: float) -> DataFrame:
    """The k-th smallest ``score`` (within 0 and 1) of each key, k = ceil((n+1)(1-alpha)) within 1 and n.

    Counts of score ranges find the range that holds it, and only that range is sorted.
    """
    values = df.groupBy(*key, _bucket(F.col("score")).alias("bucket"), "score").agg(F.count(F.lit(1)).alias("m"))
    ranges = values.groupBy(*key, "bucket").agg(F.sum("m").alias("m"))
    w = Window.partitionBy(*key)
    n, upto = F.sum("m").over(w), F.sum("m").over(w.orderBy("bucket"))  # BUCKETS rows a key
    k = F.least(F.greatest(F.ceil((F.col("n") + 1) * (1 - alpha)), F.lit(1)), F.col("n"))
    ranges = ranges.withColumns({"n": n, "upto": upto}).withColumn("rest", k - (F.col("upto") - F.col("m"))).filter("rest between 1 and m").drop("m", "upto")
    inside = values.join(ranges, [*key, "bucket"]).withColumn("running", F.sum("m").over(Window.partitionBy(*key, "bucket").orderBy("score")))
    return inside.filter("running >= rest").groupBy(*key, "n").agg(F.min("score").alias("threshold"))


def prediction_sets(df: DataFrame, key: list[str], threshold: DataFrame, alpha: float) -> DataFrame:
    """Per forecast the outcomes with 1 - p within the threshold (one row): their list and number, whether none or all are in, the coverage asked for."""
    inside = 1 - F.col("p") <= F.col("threshold") + 1e-12
    met = df.join(F.broadcast(threshold.select("threshold")), F.lit(True))  # one row
    out = met.groupBy(*key).agg(F.count(F.lit(1)).alias("outcomes_of"), F.sort_array(F.collect_list(F.when(inside, F.col("outcome")))).alias("set"))  # a question's outcomes
    size = F.size("set")
    return out.withColumns({"size": size, "outcomes": F.concat_ws(",", "set"), "is_empty": size == 0, "is_full": size == F.col("outcomes_of"), "target": F.lit(1 - alpha)})


def expert_losses(forecasts: DataFrame) -> DataFrame:
    """Squared loss of each forecast, its running sum and mean, and the last-20 mean per expert."""
    w = Window.partitionBy("stream_id", "source_id").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = forecasts.withColumn("loss", (F.col("prediction") - F.col("actual")) ** 2)
    return df.withColumns({"total_loss": F.sum("loss").over(so_far), "mean_loss": F.avg("loss").over(so_far), "recent_loss": F.avg("loss").over(w.rowsBetween(-19, 0))})


def expert_weights(losses: DataFrame, kind: str, eta: float = 2.0) -> DataFrame:
    """Weights after each step: exponential in the excess of the total loss (ewa), or 1/(1 + eta excess of the mean) (poly)."""
    w = Window.partitionBy("stream_id", "seq")
    column = "total_loss" if kind == "ewa" else "mean_loss"
    excess = F.col(column) - F.min(column).over(w)
    raw = F.exp(-eta * excess) if kind == "ewa" else 1 / (1 + eta * excess)
    return losses.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.sum("raw").over(w))


def combined_forecasts(weights: DataFrame) -> DataFrame:
    """Each step's forecast with the weights of the step before; equal ones at the first."""
    before = F.lag("weight").over(Window.partitionBy("stream_id", "source_id").orderBy("seq"))
    n = F.count(F.lit(1)).over(Window.partitionBy("stream_id", "seq"))
    df = weights.withColumn("used", F.coalesce(before, 1 / n))
    return df.groupBy("stream_id", "seq").agg(F.sum(F.col("used") * F.col("prediction")).alias("combined"), F.first("actual").alias("actual"))
