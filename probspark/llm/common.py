"""Where the text operators keep tables that cut lineage, and small shared expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a new one in /tmp only on one machine, where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


def by_bytes(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches held to 4 MB: ten thousand rows of long texts are too much for one batch."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return docs


_within: ContextVar[str] = ContextVar("within", default="")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{_within.get()}{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs start from the table, not from its lineage."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of ``fresh_path``, on whatever file system it is; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def finished(spark: SparkSession, rows: Callable[[], DataFrame], name: str) -> DataFrame:
    """``rows()`` as a stored table; the tables stored on the way to it are removed, whether it succeeds or not."""
    path, folder = fresh_path(spark, name), fresh_path(spark, f"{name}-parts")
    before = _within.set(f"{_within.get()}{folder.rsplit('/', 1)[1]}/")
    try:
        return stored(rows(), name, path)
    finally:
        _within.reset(before)
        remove(spark, folder)


#: Words of 64 bits that ``may_be_in`` broadcasts at most.
MOST_WORDS = 1 << 20


def may_be_in(df: DataFrame, ids: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: true where ``column`` is among the distinct ``ids`` (one column), and by chance for 6 % of other values.

    Most rows then need no join.  Each id sets a bit of a table that is broadcast, with 16 bits for each id
    up to ``MOST_WORDS`` words; for more ids chance grows, not the table.  ``df`` may have columns of any other name.
    """
    words = min(MOST_WORDS, ids.count() // 4 + 1)

    def place(value: str) -> tuple[Column, Column]:
        bit = F.pmod(F.xxhash64(F.col(value).cast("long")), F.lit(words * 64))
        return F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))

    word, mask = place(ids.columns[0])
    bits = ids.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    word, mask = place(column)
    met = df.join(F.broadcast(bits.select(F.struct("word", "mask").alias(name))), word == F.col(f"{name}.word"), "left")
    return met.withColumn(name, F.coalesce(F.col(f"{name}.mask").bitwiseAND(mask) != 0, F.lit(False)))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(text, _UPPER, _LOWER)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``part`` modulo ``parts``; null ids count as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
