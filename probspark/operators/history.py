"""Incremental bar tables: replace, merge, plan and describe loads.  All are joins and windows; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions.expr import rounded
from probspark.operators.windows import keep_last


def replace_range(stored: DataFrame, batch: DataFrame, key: list[str], date: str) -> DataFrame:
    """``stored`` with each key's rows between the batch's first and last date of that key replaced by the batch's."""
    spans = batch.groupBy(*key).agg(F.min(date).alias("__from"), F.max(date).alias("__to"))
    matched = [stored[k] == spans[k] for k in key] + [stored[date].between(spans["__from"], spans["__to"])]
    return stored.join(spans, matched, "left_anti").unionByName(batch)


def replace_keys(stored: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with all rows of the batch's keys replaced: for series that are rebased as a whole, and for status rows."""
    return stored.join(batch.select(*key).distinct(), key, "left_anti").unionByName(batch)


def truncate_from(stored: DataFrame, date: str, boundary: str) -> tuple[DataFrame, DataFrame]:
    """(rows before the boundary, one row with the number removed)."""
    gone = F.col(date) >= F.lit(boundary).cast("date")
    return stored.filter(~gone), stored.agg(F.count_if(gone).alias("removed"))


def plan_loads(stored: DataFrame, universe: DataFrame, key: str, date: str, floor: str, end: str, overlap: int) -> DataFrame:
    """Next range to load for every key of the universe, and why."""
    latest = stored.groupBy(key).agg(F.max(date).alias("latest"))
    first, last = F.lit(floor).cast("date"), F.lit(end).cast("date")
    step = F.date_sub("latest", overlap) if overlap > 0 else F.date_add("latest", 1)
    df = universe.select(key).distinct().join(latest, key, "left")
    df = df.withColumn("start_date", F.when(F.col("latest").isNull(), first).otherwise(F.greatest(step, first)))
    reason = F.when(F.col("latest").isNull(), "no_history").when(F.col("latest") >= last, "up_to_date").otherwise("tail")
    return df.withColumn("end_date", last).withColumn("reason", reason)


def merge_last(cached: DataFrame, remote: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Both tables with the columns of either; of rows with one key the last remote one stays.

    ``order`` names the column that says which row of a batch came last; a batch has one row per key where it isn't given.
    """
    both = cached.withColumn("__batch", F.lit(0)).unionByName(remote.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, [F.desc("__batch")] + ([F.desc(order)] if order else [])).drop("__batch")


def serve_window(cached: DataFrame, key: str, date: str, start: str, end: str) -> DataFrame:
    """Per key whether the cache serves the range, its rows there, and the tail to load where it doesn't reach the end."""
    inside = F.count_if(F.col(date).between(start, end))
    df = cached.groupBy(key).agg(F.max(date).alias("latest"), inside.alias("rows_in_window"))
    short = F.col("latest") < F.lit(end).cast("date")
    tail = F.when(short, F.greatest(F.date_add("latest", 1), F.lit(start).cast("date")))
    return df.withColumns({"served": F.when(short, "tail").otherwise("cache"), "tail_start": tail})


def period_seconds(period: Column) -> Column:
    """Seconds of a period as ``1d, d, day, daily``, ``15min, 15m`` or ``2h``; another text is an error."""
    text = F.lower(F.trim(period))
    number = lambda pattern: F.regexp_extract(text, pattern, 1).try_cast("int")
    minutes, hours = number(r"^(\d+)m(?:in)?$"), number(r"^(\d+)h$")
    unknown = F.raise_error(F.concat(F.lit("unsupported period: "), F.coalesce(period, F.lit("null")))).cast("int")
    return F.when(text.isin("1d", "d", "day", "daily"), 86400).when(minutes.isNotNull(), minutes * 60).when(hours.isNotNull(), hours * 3600).otherwise(unknown)


def reliable_time(period: Column, latest: Column, as_of: Column) -> Column:
    """Until when bars can be trusted: the day of the latest daily bar; an intraday bar counts once the day has closed (15:03), else the one before it."""
    seconds = period_seconds(period)
    closed = F.date_format(as_of, "HH:mm") >= "15:03"
    before = F.timestamp_seconds(F.unix_timestamp(latest) - seconds)
    return F.when(seconds == 86400, F.date_trunc("day", latest)).when(closed, latest).otherwise(before)


def manifest(df: DataFrame, dataset: str, dates: list[str], provider: str, fetched_at: Column, params: dict[str, str]) -> DataFrame:
    """One row that describes a stored dataset: provider, rows, the latest of its date columns, when and with what it was fetched."""
    latest = F.greatest(*(F.max(d) for d in dates)) if len(dates) > 1 else F.max(dates[0])
    pairs = [x for k, v in sorted(params.items()) for x in (F.lit(k), F.lit(v))]
    return df.agg(
        F.lit(provider).alias("provider"), F.lit(dataset).alias("dataset"), F.count(F.lit(1)).alias("row_count"), latest.alias("reliable_time"),
        fetched_at.alias("fetched_at"), F.to_json(F.create_map(*pairs)).alias("params"),
    )


def code_of(text: Column) -> Column:
    """The first run of digits, padded with zeros to six."""
    digits = F.regexp_extract(text, r"(\d{1,6})", 1)
    return F.when(digits != "", F.lpad(digits, 6, "0"))


PRICES = ["open", "high", "low", "close"]


def normal_bars(raw: DataFrame, name: str = "stock_name") -> DataFrame:
    """Bars from text columns (``symbol, date, open, high, low, close, volume, amount, turnover``): codes of six digits, numbers cast.

    Bad numbers become null; turnover is a fraction and becomes per cent; rows that lack a date or a price are dropped.
    """
    number = lambda c: F.col(c).try_cast("double").alias(c)
    bars = raw.select(code_of(F.col("symbol")).alias("code"), F.col("date").try_cast("timestamp").cast("date").alias("trade_date"), F.col(name), *map(number, [*PRICES, "volume", "amount"]), (F.col("turnover").try_cast("double") * 100).alias("turnover_rate"))
    return bars.dropna(subset=["trade_date", *PRICES])


def live_bars(spot: DataFrame, day: Column, order: str) -> DataFrame:
    """Spot rows as bars of the snapshot's day: prices above 0, and of a code's rows the last by ``order``."""
    number = lambda c: F.col(c).try_cast("double").alias(c)
    rows = spot.select(code_of(F.col("symbol")).alias("code"), day.alias("trade_date"), "stock_name", *map(number, [*PRICES, "volume", "amount", "turnover_rate"]), order)
    rows = rows.dropna(subset=["code", "trade_date", *PRICES]).filter("close > 0")
    return keep_last(rows, ["code"], [F.desc(order)]).drop(order)


def normal_factors(raw: DataFrame, kind: str) -> DataFrame:
    """``code, factor_date, factor_type, factor`` from the text column ``<kind>_factor``; rows without date or number are dropped."""
    rows = raw.select(code_of(F.col("symbol")).alias("code"), F.col("date").try_cast("timestamp").cast("date").alias("factor_date"), F.lit(kind).alias("factor_type"), F.col(f"{kind}_factor").try_cast("double").alias("factor"))
    return rows.dropna(subset=["factor_date", "factor"])


def membership(rows: DataFrame, group: str, code: str, snapshot_at: Column, order: list, most: int = 0) -> DataFrame:
    """Rows of groups with the snapshot's time: the first of each code, and the first ``most`` codes of a group (all for 0)."""
    one = keep_last(rows, [group, code], order)
    if most:
        one = one.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= most)
    return one.withColumn("snapshot_at", snapshot_at)


def adjusted_bars(bars: DataFrame, factors: DataFrame, key: str, date: str, mode: str) -> DataFrame:
    """Prices by the latest factor up to each date (the first one before that): divided for ``qfq``, multiplied for ``hfq``, to two digits.

    Then ``change``, ``pct_change`` and ``amplitude`` from the close before.  A key without a factor is an error.  ``factors``
    has ``key, factor_date, factor``; both sides meet in one sort, so no range join is made.
    """
    if mode not in ("qfq", "hfq"):
        raise ValueError(f"unsupported adjustment: {mode}")
    events = bars.withColumn("__factor", F.lit(None).cast("double")).withColumn("__bar", F.lit(1)).unionByName(
        factors.select(key, F.col("factor_date").alias(date), F.col("factor").cast("double").alias("__factor"), F.lit(0).alias("__bar")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(date, "__bar")
    known = F.coalesce(F.last("__factor", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("__factor", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    missing = F.raise_error(F.concat(F.lit("no adjustment factors for "), F.col(key).cast("string"))).cast("double")
    rows = events.withColumn("__known", known).filter("__bar = 1").withColumn("__known", F.coalesce("__known", missing))
    by = F.try_divide(F.lit(1.0), F.col("__known")) if mode == "qfq" else F.col("__known")
    rows = rows.withColumns({c: rounded(F.col(c) * by, 2) for c in PRICES}).drop("__factor", "__bar", "__known")
    before = F.lag("close").over(Window.partitionBy(key).orderBy(date))
    rows = rows.withColumn("__before", before)
    return rows.withColumns({
        "change": F.col("close") - F.col("__before"), "pct_change": F.try_divide(F.col("close"), F.col("__before")) * 100 - 100,
        "amplitude": F.try_divide(F.col("high") - F.col("low"), F.col("__before")) * 100,
    }).drop("__before")


def overlay_live(stored: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Stored bars with the live ones of the same key in front; nothing is kept."""
    return merge_last(stored, live, key)
