"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows fall into origins by a hash of their key; origins are counted.
2. The matrix of rows that go from each origin to each shard is drawn from the
   multivariate hypergeometric law, so its margins are the origins' counts and
   the shards' sizes exactly.  It has one row per 200000 input rows, ``MOST_ORIGINS`` at most.
3. Each origin permutes its rows (a rank by a keyed hash) and deals them out by
   its row of the matrix.
4. Each shard permutes what it got.  Origins and shards are ranked in cells of
   their hash range, with the cells' counts added up, so no task sorts a whole one.

The main path is DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.llm.common import stored

ROWS_PER_ORIGIN = 200_000
MOST_ORIGINS = 4096


def shuffle_into_shards(
    rows: DataFrame, shards: int, keys: list[str], seed: int = 17, rows_per_origin: int = ROWS_PER_ORIGIN, least_origins: int = 64
) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one at most.  ``keys`` order rows that hash alike and
    should tell rows apart; rows equal in all keys are interchangeable.  Null keys
    are a value like others.  A column named ``shard`` or ``slot`` in ``rows`` is
    replaced.  An empty table gives no rows.  The result depends on keys and seed
    only, not on how the input is partitioned.
    """
    rows = rows.drop("shard", "slot")
    number = rows.count()
    origins = min(MOST_ORIGINS, max(least_origins, -(-number // rows_per_origin)))
    hash_of = lambda salt: F.xxhash64(F.lit(seed * 10 + salt), *keys)
    rows = rows.withColumn("__origin", F.pmod(hash_of(1), F.lit(origins)).cast("int"))
    counts = dict(rows.groupBy("__origin").count().collect())  # MOST_ORIGINS rows
    bounds = _matrix_bounds(rows.sparkSession, counts, number, shards, seed)
    dealt = (
        _ranked(rows, "__origin", hash_of(2), keys, -(-number // (origins * rows_per_origin)), "__rank")
        .join(F.broadcast(bounds), "__origin")  # MOST_ORIGINS rows of one long per shard
        .withColumn("shard", F.size(F.filter("__bounds", lambda b: b <= F.col("__rank"))))
        .drop("__origin", "__rank", "__bounds")
    )
    return _ranked(stored(dealt, "shards"), "shard", hash_of(3), keys, max(1, -(-number // (shards * rows_per_origin))), "slot")


def _ranked(rows: DataFrame, part: str, order, keys: list[str], cells: int, name: str) -> DataFrame:
    """``rows`` with their rank from 0 in each ``part``, by a hash: ranks of ``cells`` ranges of it, and the ranges' counts before."""
    order = F.shiftrightunsigned(order, 2)  # 62 bits, never negative
    if cells <= 1:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(part).orderBy(order, *keys)) - 1).cast("long"))
    cell = F.least(F.floor(order / F.lit(float(1 << 62)) * cells), F.lit(cells - 1)).cast("int")
    rows = rows.withColumn("__order", order).withColumn("__cell", cell)
    before = Window.partitionBy(part).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part, "__cell").count().select(part, "__cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(part, "__cell").orderBy("__order", *keys)) - 1
    ranked = rows.withColumn("__place", place).join(starts, [part, "__cell"])
    return ranked.withColumn(name, (F.col("__start") + F.col("__place")).cast("long")).drop("__cell", "__order", "__place", "__start")


def communication_matrix(origin_counts: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Counts from each origin to each shard: hypergeometric, rows and columns with the given sums."""
    rng = np.random.default_rng(seed)
    left = np.array(shard_sizes, np.int64)
    matrix = np.zeros((len(origin_counts), len(left)), np.int64)
    for i, n in enumerate(origin_counts):
        # one binomial-like draw after the other: how many of this origin's rows each shard takes
        open_, total = int(n), int(left.sum())
        for j, room in enumerate(left):
            take = _hypergeometric(rng, int(room), total - int(room), open_)
            matrix[i, j], open_, total = take, open_ - take, total - int(room)
        left -= matrix[i]
    return matrix


NUMPY_LIMIT = 10**9


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good ones; beyond numpy's limit by the inverse of the exact law."""
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return min(drawn, good)
    if max(good, bad) < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    return exact_draw(rng.random(), good, bad, drawn)


def exact_draw(u: float, good: int, bad: int, drawn: int) -> int:
    """The hypergeometric law's value at ``u``: ratios of its neighbouring terms, from 14 deviations below the mean to as many above.

    What lies outside has less than 1e-40 of the mass, far below what a double tells apart.
    """
    total = good + bad
    p = good / total
    mean, deviation = drawn * p, (drawn * p * (1 - p) * (total - drawn) / max(1, total - 1)) ** 0.5
    low, high = max(0, drawn - bad, int(mean - 14 * deviation) - 20), min(good, drawn, int(mean + 14 * deviation) + 20)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    terms = np.concatenate(([0.0], np.cumsum(ratios)))
    sums = np.cumsum(np.exp(terms - terms.max()))
    return low + int(np.searchsorted(sums, u * sums[-1], side="right"))


def _matrix_bounds(spark, counts: dict[int, int], number: int, shards: int, seed: int) -> DataFrame:
    """Per origin the running sums of its matrix row: a rank's shard is how many of them it has reached."""
    sizes = [number // shards + (j < number % shards) for j in range(shards)]
    origins = sorted(counts)
    sums = communication_matrix([counts[o] for o in origins], sizes, seed).cumsum(axis=1)
    rows = [(int(o), [int(x) for x in s]) for o, s in zip(origins, sums, strict=True)]
    return spark.createDataFrame(rows, "__origin int, __bounds array<long>")
