"""A data source that loads planned ranges of keys: ``spark.read.format("planned_ranges")``.

A plan (a row per key with ``start_date`` and ``end_date``) is written as files of consecutive keys.  Each file is an
input partition: its task reads the file, asks the loader for these keys and dates, and drops what lies outside
a key's own range.  Filters on the key and the date are pushed into the ranges before anything is loaded.

Options: ``plan`` (folder of ``write_plan``), ``key``, ``date``, ``loader`` (``module:function``; rows of Parquet files under
``provider`` if not given), ``attempts`` and ``retry_seconds`` for a loader that fails.  A loader takes (ranges as an Arrow
table, options) and gives Arrow batches; it must be importable on workers.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator
from datetime import date as Date
from datetime import timedelta

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from probspark.sources.stored import fresh_path

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
FORMAT = "planned_ranges"


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    """File system (local or shared mount, hdfs, s3, gs) and path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith(("/", "file:")) else (fs.LocalFileSystem(), folder)


def write_plan(plan: DataFrame, key: str, path: str, parts: int) -> str:
    """The ranges of ``plan`` that are not up to date, as ``parts`` files of consecutive keys."""
    wanted = plan.filter("reason <> 'up_to_date'").select(key, "start_date", "end_date")
    wanted.repartitionByRange(parts, key).sortWithinPartitions(key).write.parquet(path)
    return path


def parquet_ranges(ranges: pa.Table, options: dict) -> Iterator[pa.RecordBatch]:
    """The provider's rows of these keys between the first and the last date asked for; row groups outside are not read."""
    system, root = _at(options["provider"])
    key, date = ds.field(options["key"]), ds.field(options["date"])
    near = key.isin(ranges.column(options["key"])) & (date >= pc.min(ranges.column("start_date"))) & (date <= pc.max(ranges.column("end_date")))
    yield from ds.dataset(root, filesystem=system, format="parquet").scanner(filter=near).to_batches()


class RangeFile(InputPartition):
    """One file of the plan."""

    def __init__(self, path: str):
        super().__init__(path)


class RangeReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, options
        self.first, self.last, self.keys = Date.min, Date.max, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the date and lists of keys are taken; others are left to Spark."""
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == (self.options["date"],) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, Date):
                day = timedelta(days=1)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + day if isinstance(f, GreaterThan) else f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value - day if isinstance(f, LessThan) else f.value)
            elif column == (self.options["key"],) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = own if self.keys is None else self.keys & own
            else:
                yield f

    def partitions(self) -> list[RangeFile]:
        system, root = _at(self.options["plan"])
        files = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".parquet")]
        return [RangeFile(f) for f in sorted(files)] or [RangeFile("")]

    def read(self, partition: RangeFile) -> Iterator[pa.RecordBatch]:
        key, date = self.options["key"], self.options["date"]
        if not partition.value:
            return
        system, _ = _at(self.options["plan"])
        with system.open_input_file(partition.value) as f:
            ranges = pq.read_table(f)
        start = pc.max_element_wise(ranges.column("start_date"), pa.scalar(self.first, pa.date32()))
        end = pc.min_element_wise(ranges.column("end_date"), pa.scalar(self.last, pa.date32()))
        ranges = pa.table({key: ranges.column(key), "start_date": start, "end_date": end}).filter(pc.less_equal(start, end))
        if self.keys is not None:
            ranges = ranges.filter(pc.is_in(ranges.column(key), pa.array(sorted(self.keys), ranges.schema.field(key).type)))
        if not len(ranges):
            return
        names = [f.name for f in self.schema.fields]
        for table in self._loaded(ranges):
            inside = pa.Table.from_batches([table]).join(ranges, key, join_type="inner")
            own = pc.and_(pc.greater_equal(inside.column(date), inside.column("start_date")), pc.less_equal(inside.column(date), inside.column("end_date")))
            yield from inside.filter(own).select(names).to_batches()

    def _loaded(self, ranges: pa.Table) -> list[pa.RecordBatch]:
        """What the loader gives for a file's ranges; a failed call is repeated whole, after ever longer waits."""
        module, _, name = self.options.get("loader", f"{__name__}:parquet_ranges").partition(":")
        attempts, wait = int(self.options.get("attempts", 1)), float(self.options.get("retry_seconds", 1.0))
        for attempt in range(attempts):
            try:
                return list(getattr(importlib.import_module(module), name)(ranges, self.options))
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(wait * 2**attempt)
        raise ValueError("attempts must be 1 or more")


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema) -> RangeReader:
        return RangeReader(schema, dict(self.options))


def load_planned(spark: SparkSession, plan: DataFrame, schema: str, key: str, date: str, parts: int = 8, **options: str) -> DataFrame:
    """Rows of the planned ranges (``key, start_date, end_date, reason``) as the loader of ``options`` gives them."""
    spark.dataSource.register(RangeSource)
    spark.conf.set(PUSHDOWN, "true")  # it concerns Python data sources only
    path = write_plan(plan, key, fresh_path(spark, "plan"), parts)
    return spark.read.format(FORMAT).schema(schema).options(plan=path, key=key, date=date, **options).load()
