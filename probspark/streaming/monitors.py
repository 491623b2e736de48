"""Streams whose result over a table is that of the batch operators, also where rows come late or twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from probspark.functions.expr import rank_pct
from probspark.operators import breadth as B
from probspark.operators.windows import first_rank
from probspark.sources.stored import fresh_path, write_csv, write_summary


def stage_files(df: DataFrame, part: str, parts: int, path: str, files: int = 1) -> str:
    """``df`` as files that a stream reads one after the other: rows of part 0 (column ``part``) first, and so on; ``files`` for each part."""
    for i in range(parts):
        rows = df.filter(F.col(part) == i).drop(part)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)
    return path


def read_files(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder as a file stream, so many files in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, at: str) -> None:
    """All that is there, in micro-batches that ``write`` takes."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def appender(at: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch's rows to a folder of its own, so that a batch which runs again replaces itself."""
    return lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/rows/b={batch}")


def more(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def written(spark: SparkSession, at: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/rows")


def latest_per_key(batches: DataFrame, key: list[str]) -> DataFrame:
    """Of all batches' rows the last written of each key."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))
    return batches.withColumn("__n", last).filter("__n = 1").drop("__n", "batch")


class BoundedDays:
    """Counts per day and group of a stream of which rows may come late, by a boundary ``late`` behind the newest row of earlier batches.

    Rows behind the boundary go to a side table and are counted nowhere else.  A day that the boundary has passed is counted
    once and stored; days that may still get rows, the last one among them, are counted anew from their rows
    whenever they are asked for, and never stored.  A row of one ``key`` counts once.
    """

    def __init__(self, spark: SparkSession, schema: StructType, time: str, by: str, key: str, value: str, late: str):
        self.spark, self.schema, self.time, self.by, self.key, self.value = spark, schema, time, by, key, value
        self.late, self.at = F.expr(f"INTERVAL {late}"), fresh_path(spark, "days")
        self.rows_schema = more(schema, "day date, batch int")

    def run(self, path: str) -> BoundedDays:
        """Takes the files of ``path`` that it has not taken yet."""
        run_available(read_files(self.spark, path, self.schema), self._take, "append", self.at)
        return self

    def _boundary(self, batches: str) -> DataFrame:
        """One row: ``boundary``, behind which rows of a batch after ``batches`` are late; null before the first."""
        return self._table("seen", "newest timestamp, batch int").filter(batches).agg((F.max("newest") - self.late).alias("boundary"))

    def _table(self, name: str, schema) -> DataFrame:
        at = f"{self.at}/{name}"
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if not jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(at)

    def _write(self, df: DataFrame, name: str, batch: int, *parts: str) -> None:
        """A batch's rows in a folder of its own: a batch that runs again replaces itself."""
        df.drop("batch").write.mode("overwrite").partitionBy(*parts).parquet(f"{self.at}/{name}/batch={batch}")

    def _take(self, df: DataFrame, batch: int) -> None:
        before = self._boundary(f"batch < {batch}").first().boundary
        held = df.withColumn("day", F.to_date(self.time))
        is_late = F.lit(False) if before is None else F.coalesce(F.col(self.time) < F.lit(before), F.lit(False))
        self._write(held.filter(is_late), "late", batch)
        self._write(held.filter(~is_late), "rows", batch, "day")
        self._write(df.agg(F.max(self.time).alias("newest")), "seen", batch)
        after = self._boundary(f"batch <= {batch}").first().boundary
        if after is not None:
            closed = F.col("day") < F.to_date(F.lit(after))
            if before is not None:
                closed &= F.col("day") >= F.to_date(F.lit(before))
            self._write(self._counts(self._rows().filter(f"batch <= {batch}").filter(closed)), "closed", batch)

    def _rows(self) -> DataFrame:
        return self._table("rows", self.rows_schema)

    def _counts(self, rows: DataFrame) -> DataFrame:
        once = rows.dropDuplicates(["day", self.key])
        return once.groupBy("day", self.by).agg(F.count(F.lit(1)).alias("n"), F.sum(self.value).alias("total"))

    def closed(self) -> DataFrame:
        kind = self.schema[self.by].dataType.simpleString()
        return self._table("closed", f"day date, {self.by} {kind}, n long, total double, batch int").drop("batch")

    def open(self) -> DataFrame:
        """Counts so far of the days that the boundary has not passed, from the rows of those days only."""
        boundary = self._boundary("true").first().boundary
        rows = self._rows()
        return self._counts(rows if boundary is None else rows.filter(F.col("day") >= F.to_date(F.lit(boundary))))

    def late_rows(self) -> DataFrame:
        return self._table("late", self.rows_schema).drop("batch")

    def counts(self) -> DataFrame:
        return self.closed().unionByName(self.open())


def upsert_history(spark: SparkSession, stream: DataFrame, key: list[str]) -> DataFrame:
    """History keyed by ``key``: rows that come again replace the earlier ones."""
    at = fresh_path(spark, "history")
    one = lambda df, batch: appender(at)(df.dropDuplicates(key), batch)
    run_available(stream, one, "append", at)
    return latest_per_key(written(spark, at, more(stream.schema, "batch int")), key)


def monitor_snapshots(spark: SparkSession, stream: DataFrame, entity: str, time: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(history, latest): each micro-batch scores its snapshots across all entities, is appended to the history and becomes the latest.

    A snapshot (all rows of one ``time``) comes whole in a batch; one that comes again replaces itself.
    """
    at = fresh_path(spark, "monitor")

    def once(df: DataFrame, batch: int) -> None:
        df = df.dropDuplicates([entity, time])
        scored = first_rank(df.withColumn("rank_pct", rank_pct(F.col(value), [time])), [time], value, [entity])
        appender(at)(scored, batch)
        newest = scored.agg(F.max(time).alias("__t"))
        scored.join(F.broadcast(newest), F.col(time) == F.col("__t")).drop("__t").write.mode("overwrite").parquet(f"{at}/latest")  # one row

    run_available(stream, once, "append", at)
    return latest_per_key(written(spark, at, more(stream.schema, "rank_pct double, rank int, batch int")), [entity, time]), spark.read.parquet(f"{at}/latest")


class BreadthMonitor:
    """Snapshots of breadth as they come, scored against a rank table: history, dashboard of the newest snapshot and its summary.

    ``rank`` has ``key, at`` and what ``breadth_scores`` reads of a model; a file of the stream has whole snapshots (all records of one
    ``at``).  A batch's rows get their changes since the key's snapshot before and join the history; a snapshot that comes again
    replaces itself there, and is compared with what was before it, not with what came in the meantime.
    """

    def __init__(self, spark: SparkSession, rank: DataFrame, schema: StructType, key: list[str], at: str, probability: str):
        self.spark, self.rank, self.schema, self.key, self.time, self.probability = spark, rank, schema, key, at, probability
        self.at, self.history_schema = fresh_path(spark, "breadth"), None

    def run(self, path: str) -> BreadthMonitor:
        """Takes the files of ``path`` that it has not taken yet."""
        run_available(read_files(self.spark, path, self.schema), self._take, "append", self.at)
        return self

    def _batches(self, name: str, condition: str) -> DataFrame | None:
        """Rows of earlier batches, if there are any."""
        if self.history_schema is None:
            return None
        return self.spark.read.schema(more(self.history_schema, "batch int")).option("basePath", f"{self.at}/{name}").parquet(f"{self.at}/{name}").filter(condition)

    def _take(self, df: DataFrame, batch: int) -> None:
        df = df.dropDuplicates([*self.key, self.time])
        first = df.agg(F.min(self.time)).first()[0]
        if first is None:
            return
        times = df.select(self.time).distinct()
        current = self.rank.join(times, self.time, "left_semi").join(df, [*self.key, self.time], "left")
        scored = B.rotation_breadth(B.breadth_scores(current, [self.time], self.key, self.probability), [self.time], self.key, self.probability)
        before = self._before(first, batch)
        both = scored.withColumn("current", F.lit(True))
        if before is not None:
            both = both.unionByName(before.select(*scored.columns).withColumn("current", F.lit(False)))
        rows = B.dashboard(B.snapshot_deltas(both, self.key, self.time)).filter("current").drop("current")
        rows.write.mode("overwrite").parquet(f"{self.at}/history/batch={batch}")
        self.history_schema = rows.schema
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.at}/history/batch={batch}")
        last = rows if before is None else rows.unionByName(self._batches("last", f"batch = {batch - 1}").drop("batch"))
        newest = F.row_number().over(Window.partitionBy(*self.key).orderBy(F.desc(self.time)))
        last.withColumn("__n", newest).filter("__n = 1").drop("__n").write.mode("overwrite").parquet(f"{self.at}/last/batch={batch}")

    def _before(self, first, batch: int) -> DataFrame | None:
        """Each key's last row before ``first``: of the table of last rows, or of the history where a snapshot comes again."""
        last = self._batches("last", f"batch = {batch - 1}")
        if last is None:
            return None
        if last.filter(F.col(self.time) >= F.lit(first)).isEmpty():
            return last.drop("batch")
        earlier = latest_per_key(self._batches("history", f"batch < {batch}").filter(F.col(self.time) < F.lit(first)), [*self.key, self.time])
        n = F.row_number().over(Window.partitionBy(*self.key).orderBy(F.desc(self.time)))
        return earlier.withColumn("__n", n).filter("__n = 1").drop("__n")

    def history(self) -> DataFrame:
        return latest_per_key(self._batches("history", "true"), [*self.key, self.time])

    def dashboard(self) -> DataFrame:
        """The newest snapshot's rows by priority and place."""
        history = self.history()
        newest = history.agg(F.max(self.time).alias("__t"))  # one row
        return history.join(F.broadcast(newest), F.col(self.time) == F.col("__t")).drop("__t").orderBy("priority", "rank_turn_breadth", *self.key)

    def write(self, folder: str) -> None:
        """The dashboard as text files, and its summary (rows, snapshot, states, groups) as one JSON document."""
        rows = self.dashboard()
        write_csv(rows, f"{folder}/dashboard")
        counts = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n"))))
        states, groups = (rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(counts(c).alias(f"{c}_counts")) for c in ("intraday_state", "dashboard_group"))  # a few states
        facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(self.time).alias("snapshot"))
        write_summary(facts.join(states, F.lit(True)).join(groups, F.lit(True)), f"{folder}/summary")
