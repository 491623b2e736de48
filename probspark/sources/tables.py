"""Stored tables that are changed in place: an upsert reads and rewrites only the partitions that it touches.

A table of bars is partitioned by the month of its date, a table of series or status rows by a hash of its key.  The new
content of the touched partitions is stored first and then written over them (dynamic partition overwrite), so a failed
upsert leaves the table readable and can be repeated.  Partitions change one by one: readers during the last step may see some
of them new.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from probspark.operators import history as H
from probspark.sources.stored import fresh_path, stored

PART = "__part"


class PartitionedTable:
    """A folder of Parquet partitions; ``date`` partitions by month, else ``keys`` by a hash in ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], date: str | None = None, buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.date, self.buckets = spark, path, schema, keys, date, buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], date: str | None = None, buckets: int = 64) -> PartitionedTable:
        table = cls(df.sparkSession, path, df.schema, keys, date, buckets)
        table._write(df)
        return table

    def _part(self) -> Column:
        if self.date is not None:
            return F.coalesce(F.date_format(self.date, "yyyy-MM"), F.lit("none"))
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")

    def _write(self, df: DataFrame) -> None:
        rows = df.select(*self.schema.names).withColumn(PART, self._part())
        rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def _read(self, parts: list[str] | None = None) -> DataFrame:
        rows = self.spark.read.schema(StructType([*self.schema.fields, StructField(PART, StringType())])).parquet(self.path)
        return rows if parts is None else rows.filter(F.col(PART).isin(parts))  # a filter on folders: others are not listed for the scan

    def read(self) -> DataFrame:
        return self._read().drop(PART)

    def _remove(self, parts: list[str]) -> None:
        for part in parts:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={part}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _change(self, touched: DataFrame, change) -> list[str]:
        """Rewrites the partitions named in ``touched`` with ``change`` of their rows; a partition left without rows goes."""
        parts = sorted(r[0] for r in touched.distinct().collect())  # months or buckets
        if not parts:
            return parts
        new = stored(change(self._read(parts).drop(PART)).select(*self.schema.names), "touched")
        left = {r[0] for r in new.select(self._part()).distinct().collect()}
        if extra := left - set(parts):
            raise ValueError(f"rows outside the touched partitions: {sorted(extra)}")
        self._write(new)
        self._remove([p for p in parts if p not in left])
        return parts

    def replace_range(self, batch: DataFrame) -> list[str]:
        """Each key's rows between the batch's first and last date of that key, replaced by the batch's; the touched months."""
        if self.date is None:
            raise ValueError("ranges need a table partitioned by date")
        batch = stored(batch.select(*self.schema.names), "batch")
        spans = batch.groupBy(*self.keys).agg(F.min(self.date).alias("a"), F.max(self.date).alias("b"))
        months = F.explode(F.sequence(F.trunc("a", "month"), F.col("b"), F.expr("INTERVAL 1 MONTH")))
        touched = spans.select(months.alias(self.date)).select(self._part()).union(batch.filter(F.col(self.date).isNull()).select(self._part()))
        return self._change(touched, lambda old: H.replace_range(old, batch, self.keys, self.date))

    def replace_keys(self, batch: DataFrame, key: list[str] | None = None) -> list[str]:
        """All rows of the batch's keys replaced; for tables partitioned by these keys."""
        if self.date is not None:
            raise ValueError("whole keys need a table partitioned by key")
        batch = stored(batch.select(*self.schema.names), "batch")
        return self._change(batch.select(self._part()), lambda old: H.replace_keys(old, batch, key or self.keys))

    def merge_last(self, batch: DataFrame, key: list[str], order: str | None = None) -> list[str]:
        """Of rows with one ``key`` the last one of the batch stays, else the table's; ``key`` holds what the partitions depend on."""
        batch = stored(batch, "batch")
        return self._change(batch.select(self._part()), lambda old: H.merge_last(old, batch, key, order))

    def truncate_from(self, boundary: str) -> list[str]:
        """Rows from ``boundary`` on go: whole months as folders, the boundary's month is rewritten."""
        if self.date is None:
            raise ValueError("a boundary needs a table partitioned by date")
        first = self.spark.range(1).select(F.date_format(F.lit(boundary).cast("date"), "yyyy-MM")).first()[0]
        later = sorted(r[0] for r in self._read().select(PART).filter((F.col(PART) > first) & (F.col(PART) != "none")).distinct().collect())
        self._remove(later)
        month = self.spark.createDataFrame([(first,)], "part string")
        return self._change(month, lambda old: H.truncate_from(old, self.date, boundary)[0]) + later


def fresh_table(df: DataFrame, keys: list[str], date: str | None = None, buckets: int = 64) -> PartitionedTable:
    return PartitionedTable.create(df, fresh_path(df.sparkSession, "table"), keys, date, buckets)
