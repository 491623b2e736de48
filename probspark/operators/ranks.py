"""Ranks and exact quantiles of keys of any size, by ranges of values.

Values are counted, dealt to ranges by sampled splitters (equal values stay in one range), and a range's place is the
sum of the ranges before it: a short table.  Sorts and running sums stay inside a range, so a key with a third of
all rows is spread over many tasks, and a value with as many rows is one counted row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.sources.stored import stored

BEFORE = (Window.unboundedPreceding, -1)


def _matches(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equality of all ``columns``, nulls included."""
    return reduce(lambda x, y: x & y, (a[f"`{c}`"].eqNullSafe(b[f"`{c}`"]) for c in columns))


def joined(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """A join on ``columns`` in which null equals null; b's own columns follow."""
    b = b.toDF(*b.columns)
    kept = [b[f"`{c}`"] for c in b.columns if c not in columns]
    return a.join(b, _matches(a, b, columns), how).select(*(a[f"`{c}`"] for c in a.columns), *kept)


def ranged(df: DataFrame, keys: list[str], order: list[Column], rows: Column) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``__range``, ``keys, __range, __start, __held, __total``) where ranges are consecutive parts of each key's order.

    ``__start`` and ``__held`` are sums of ``rows`` before and in a range, ``__total`` in the key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *(F.col(k).asc_nulls_first() for k in keys), *order)
    held = stored(dealt.withColumn("__range", F.spark_partition_id()), "ranges")  # a range's number must not change
    sums = held.groupBy(*keys, "__range").agg(F.sum(rows).alias("__held"))
    of_key = Window.partitionBy(*keys)  # ranges of a key
    starts = sums.withColumn("__start", F.coalesce(F.sum("__held").over(of_key.orderBy("__range").rowsBetween(*BEFORE)), F.lit(0)))
    return held, starts.withColumn("__total", F.sum("__held").over(of_key))


def first_ranks(df: DataFrame, keys: list[str], value: str, tie: list[str], name: str = "rank") -> DataFrame:
    """1, 2, ... from the largest value down in each key; ties by ``tie``; nulls come last."""
    order = [F.col(value).desc_nulls_last(), *map(F.col, tie)]
    held, starts = ranged(df, keys, order, F.lit(1))
    placed = held.withColumn("__place", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)))
    out = joined(placed, starts.select(*keys, "__range", "__start"), [*keys, "__range"])
    return out.withColumn(name, (F.col("__start") + F.col("__place")).cast("int")).select(*(c for c in df.columns if c != name), name)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with numbers from 0 in the order of all rows; no task sorts more than a range."""
    held, starts = ranged(df, [], order, F.lit(1))
    placed = held.withColumn("__place", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    out = joined(placed, starts.select("__range", "__start"), ["__range"])
    return out.withColumn(name, F.col("__start") + F.col("__place") - 1).select(*(c for c in df.columns if c != name), name)


def _counted(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Counts of the non-null values of several columns (``__of``, ``__value``, ``__n``) in ranges, and the ranges' places."""
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("of"), c.cast("double").alias("value")) for n, c in columns.items())))
    long = df.select(*keys, values.alias("__x")).select(*keys, F.col("__x.of").alias("__of"), F.col("__x.value").alias("__value")).filter("__value is not null")
    counts = long.groupBy(*keys, "__of", "__value").agg(F.count(F.lit(1)).alias("__n"))
    return ranged(counts, [*keys, "__of"], [F.col("__value")], F.col("__n"))


def rank_percentiles(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with, for each name in ``columns``, the average rank of ties of its column in the key over the key's non-null values.

    Null values and columns without values stay null.
    """
    held, starts = _counted(df, keys, {n: F.col(c) for n, c in columns.items()})
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys, "__of", "__range").orderBy("__value").rowsBetween(*BEFORE)), F.lit(0))
    placed = joined(held.withColumn("__inside", inside), starts, [*keys, "__of", "__range"])
    rank = (F.col("__start") + F.col("__inside") + (F.col("__n") + 1) / 2) / F.col("__total")
    ranks = stored(placed.select(*keys, "__of", "__value", rank.alias("__rank")), "ranks")
    for name, column in columns.items():
        own = ranks.filter(F.col("__of") == name).select(*keys, F.col("__value").alias("__match"), F.col("__rank").alias(name))
        df = joined(df.drop(name).withColumn("__match", F.col(column).cast("double")), own, [*keys, "__match"], "left").drop("__match")
    return df


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row per key with the exact quantile of each name in ``wanted`` (column, level), between neighbours linearly; null without values.

    Only ranges that hold a wanted place are sorted.
    """
    columns: dict[str, Column] = {}
    of = {}
    for name, (column, _) in wanted.items():  # a column asked for several levels is counted once
        of[name] = next((k for k, c in columns.items() if str(c) == str(column)), name)
        columns.setdefault(of[name], column)
    held, starts = _counted(df, keys, columns)
    places = F.create_map(*(x for k in columns for x in (F.lit(k), F.array(*(F.lit(float(q)) for n, (_, q) in wanted.items() if of[n] == k)))))
    at = lambda q: q * (F.col("__total") - 1)
    starts = starts.withColumn("__at", F.transform(F.try_element_at(places, F.col("__of")), at))
    has = lambda a: (F.ceil(a) >= F.col("__start")) & (F.floor(a) < F.col("__start") + F.col("__held"))
    asked = starts.filter(F.exists("__at", has))
    rows = joined(held, asked.select(*keys, "__of", "__range", "__start", "__total"), [*keys, "__of", "__range"])
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys, "__of", "__range").orderBy("__value").rowsBetween(*BEFORE)), F.lit(0))
    rows = rows.withColumn("__low", F.col("__start") + inside).withColumn("__high", F.col("__low") + F.col("__n"))
    out = []
    for name, (_, q) in wanted.items():
        place = F.lit(float(q)) * (F.col("__total") - 1)
        holds = lambda k: (F.col("__of") == of[name]) & (F.col("__low") <= k) & (k < F.col("__high"))  # noqa: B023, E731
        low, high = F.max(F.when(holds(F.floor(place)), F.col("__value"))), F.max(F.when(holds(F.ceil(place)), F.col("__value")))
        share = F.max(F.when(F.col("__of") == of[name], place - F.floor(place)))
        out.append((low + (high - low) * share).alias(name))
    found = rows.groupBy(*keys).agg(*out)
    return joined(df.select(*keys).distinct(), found, keys, "left")
