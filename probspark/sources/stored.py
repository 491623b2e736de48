"""Tables kept in the shared folder between jobs, and plain files in and out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a new one in /tmp only on one machine, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: for a table that several branches of a plan read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of a wide step gets, about.
ROWS_A_TASK = 1_000_000


def tasks_for(df: DataFrame) -> int:
    """Partitions for a step over ``df``: more for more rows, so that what a task holds at once doesn't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS_A_TASK + 1)


def write_csv(df: DataFrame, path: str) -> None:
    """Text files with a header; null is an empty field, an empty text is quoted."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", '""').option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``write_csv`` or of any text files with a header, by a stated schema: codes stay text, dates are parsed, a bad field is null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_groups(df: DataFrame, group: str, path: str) -> DataFrame:
    """One folder of files per group under ``path``; folders of groups that are gone go too.  Returns ``group, n`` as written."""
    df.withColumn("__group", F.col(group)).write.mode("overwrite").partitionBy("__group").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).option("basePath", path).parquet(path)
    return kept.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary with nested columns as one JSON document."""
    df.coalesce(1).write.mode("overwrite").json(path)


def run_summary(df: DataFrame, date: str, metrics: dict[str, Column], top: list[Column], order: Column, top_n: int) -> DataFrame:
    """One row: number of rows, first and last date, metrics, and the first ``top_n`` rows as an array."""
    best = df.orderBy(order, *top).limit(top_n).select(F.struct(order.alias("key"), *top).alias("row"))
    rows = best.agg(F.sort_array(F.collect_list("row")).alias("top"))  # top_n rows
    facts = df.agg(F.count(F.lit(1)).alias("row_count"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), *(c.alias(n) for n, c in metrics.items()))
    return facts.join(rows, F.lit(True))
