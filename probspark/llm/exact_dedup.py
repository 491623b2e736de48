"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text (A-Z
lower-cased).  A digit is a run of bytes; the first digit also holds the byte
length, and each later digit is four times as wide as the one before, so a text
of n bytes takes about log4(n) rounds.  A group that has one document, or whose
bytes have ended, is decided and leaves; only undecided texts go on.  Equality is
decided by the bytes themselves, never by a digest.

Each round aggregates on (group, digit) with partial sums before the shuffle, so
a group of copies that holds a third of all rows sends one row a task.  The
labelling join meets one row per group on its small side, which adaptive
execution can split by rows of the large side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probspark.llm.common import lower_ascii, stored

FIRST_DIGIT = 128


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty.  ``keep_id`` is the largest id of the equal texts;
    null ids are below all others, and a group of null ids alone keeps null.
    Rows that repeat the id of the kept row are that document again and are kept
    with it.  Other columns of ``docs`` are not read, so their names can't clash.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    decided = _partition(rows, F.sha2(lower_ascii(F.col("text")).cast("binary"), 256), first_digit)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return decided.select("doc_id", "keep_id", "group_size", kept, F.col("carried").alias("text_sha256"))


def drop_copies(docs: DataFrame, first_digit: int = FIRST_DIGIT) -> DataFrame:
    """``docs`` (all columns) without the rows whose text equals that of a row with a larger ``doc_id``.

    One row of each group stays, also where rows repeat the largest id or all ids are null.
    Null counts as empty and stays null.  Texts of any length are compared whole.  Other columns may
    have any name.  An empty table gives no rows.
    """
    names = docs.columns
    others = F.struct(*(n for n in names if n != "text"), F.col("text").isNull().alias("__null"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), others.alias("others"))
    text = F.when(~F.col("others.__null"), F.col("text")).alias("text")  # a text is sent once
    whole = F.struct(*(text if n == "text" else F.col("others")[n].alias(n) for n in names))
    kept = _partition(rows, whole, first_digit).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = kept.groupBy("round", "group_id").count().filter("count > 1")  # reads no text
    if not again.isEmpty():
        kept = kept.dropDuplicates(["round", "group_id"])
    return kept.select(*(F.col("carried")[n].alias(n) for n in names))


def _partition(rows: DataFrame, carried: Column, first_digit: int) -> DataFrame:
    """``rows`` (``doc_id, text`` and what ``carried`` needs) as ``doc_id, carried, keep_id, group_size, round, group_id``."""
    # lower-casing ASCII keeps every byte position, so a prefix can be normalised alone
    head = F.substring(F.col("text").cast("binary"), 1, first_digit)
    rows = rows.withColumn("bytes", F.octet_length("text")).withColumn("digit", _lower_bytes(head))
    groups = stored(_groups(rows, ["bytes", "digit"]), "radix-groups")
    # every group has one row here, so rows find their group without knowing their number
    found = rows.join(groups, ["bytes", "digit"])
    open_ = (F.col("group_size") > 1) & (F.col("bytes") > first_digit)
    columns = ["doc_id", carried.alias("carried"), "bytes", "keep_id", "group_size", "group_id", open_.alias("open")]
    rest = F.when(open_, lower_ascii(F.col("text")).cast("binary")).alias("rest")
    first = stored(found.select(*columns, F.lit(0).alias("round"), rest), "radix-first")
    decided = [first.filter(~F.col("open"))]
    undecided = first.filter("open")
    longest = undecided.agg(F.max("bytes")).first()[0] or 0
    low, width, number = first_digit, first_digit * 4, 0
    while low < longest:
        digit = F.substring(F.col("rest"), low + 1, width)
        rows = undecided.drop("keep_id", "group_size", "round").withColumnRenamed("group_id", "parent").withColumn("digit", digit)
        groups = stored(_groups(rows, ["parent", "digit"]), "radix-groups")
        low, width, number = low + width, width * 4, number + 1
        open_ = (F.col("group_size") > 1) & (F.col("bytes") > low)
        found = rows.join(groups, ["parent", "digit"]).drop("parent", "digit")
        found = stored(found.withColumn("open", open_).withColumn("round", F.lit(number)), "radix-round")
        decided.append(found.filter(~F.col("open")))
        undecided = found.filter("open")
    out = ["doc_id", "carried", "keep_id", "group_size", "round", "group_id"]
    result = decided[0].select(out)
    for part in decided[1:]:
        result = result.unionByName(part.select(out))
    return result


def _lower_bytes(head):
    """A-Z lower-cased in a byte prefix, which may end inside a character."""
    return lower_ascii(F.decode(head, "ISO-8859-1"))


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Count and largest id of each key, numbered; the numbers hold once the table is stored."""
    return (
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
        .withColumn("group_id", F.monotonically_increasing_id())
    )

