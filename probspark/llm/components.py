"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probspark.llm.common import fresh_path, remove, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component_id`` for every node of ``edges`` (two long columns): the smallest node it reaches.

    Every round aggregates each node's smallest neighbour (partial sums before the
    shuffle) and hangs its other neighbours there; edges end as stars after a number
    of rounds that grows with the logarithm of the longest path.  Rounds are stored,
    so a lost executor repeats one round at most, and a round's table goes when the
    next one is written.  Loops and repeated edges are allowed.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    path = fresh_path(spark, "edges")
    stars = stored(edges.filter("u <> v").distinct(), "edges", path)
    before = None
    while (now := _fingerprint(stars)) != before and now[0]:
        before = now
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(stars.join(least, "u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), "m").union(least)
        done, path = path, fresh_path(spark, "edges")
        stars = stored(small.toDF("u", "v").filter("u <> v").distinct(), "edges", path)
        remove(spark, done)
    return nodes.join(stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component_id")
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
