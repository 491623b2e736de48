"""Registered queries: a function of inputs, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probspark.sources.inputs import INPUTS, ctes, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _rounded(column: str, digits: int):
    """The same two operations in both engines; their own rounding differs on ties."""
    return F.floor(F.col(column) * 10.0**digits + 0.5) / F.lit(10.0**digits)


def query(name: str, inputs: str, sql: str, keep: str = "", doubles: str = "", digits: int = 6):
    """Registers a function of the named inputs and the SQL that uses them as tables.

    The result has the columns ``keep`` and, rounded, ``doubles``: sums taken in another order then compare equal.
    """
    names, kept, floats = inputs.split(), keep.split(), doubles.split()

    def register(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(load(spark, sf_dir, n) for n in names)).select(*kept, *(_rounded(c, digits).alias(c) for c in floats))

        QUERIES[name] = run
        derived = tuple(n for n in names if n in INPUTS)
        body, head = sql.strip(), ctes(*derived) + "\n" if derived else ""
        if body.upper().startswith("WITH "):  # its own tables come after the inputs, before the last SELECT
            marker = body.rindex("\nSELECT ")
            head = (ctes(*derived) + ",\n" if derived else "WITH ") + body[5:marker] + "\n"
            body = body[marker + 1 :]
        columns = ", ".join([*kept, *(f"floor({c} * 1e{digits} + 0.5e0) / 1e{digits} AS {c}" for c in floats)])
        ORACLE_SQL[name] = f"{head}SELECT {columns} FROM ({body}) AS result"
        return f

    return register
