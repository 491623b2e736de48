"""Planned ranges as a data source (partitions, pushed filters, retries), and tables changed in place."""

import glob
import os
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from probspark.sources import ranges, tables

PLAN = [("a", date(2020, 1, 1), date(2020, 3, 1), "tail"), ("b", date(2020, 2, 1), date(2020, 3, 1), "no_history"), ("c", date(2020, 1, 1), date(2020, 1, 5), "up_to_date"), ("d", date(2020, 2, 20), date(2020, 2, 25), "tail")]


def planned(spark):
    return spark.createDataFrame(PLAN, "k string, start_date date, end_date date, reason string")


def asked(folder):
    return sorted(line.split() for f in glob.glob(f"{folder}/asked-*") for line in open(f))


def load(spark, tmp_path, parts=3, **options):
    return ranges.load_planned(spark, planned(spark), "k string, d date, v double", "k", "d", parts, loader="tests.loaders:noted", notes=str(tmp_path), **options)


def test_only_missing_ranges_are_asked_for_by_several_tasks(spark, tmp_path):
    df = load(spark, tmp_path)
    assert df.rdd.getNumPartitions() == 3
    rows = sorted((r.k, str(r.d), r.v) for r in df.collect())
    assert asked(tmp_path) == [["a", "2020-01-01", "2020-03-01"], ["b", "2020-02-01", "2020-03-01"], ["d", "2020-02-20", "2020-02-25"]]
    assert len(glob.glob(f"{tmp_path}/asked-*")) == 3
    assert ("a", "2020-01-01", 1.0) in rows and ("b", "2020-03-01", 2.0) in rows and not [r for r in rows if r[0] == "d" and r[1] > "2020-02-25"]


def test_filters_narrow_the_ranges(spark, tmp_path):
    df = load(spark, tmp_path).filter((F.col("d") > F.lit("2020-02-10").cast("date")) & (F.col("d") <= F.lit("2020-02-22").cast("date")) & F.col("k").isin("a", "d") & (F.col("v") < 5))
    rows = df.collect()
    assert asked(tmp_path) == [["a", "2020-02-11", "2020-02-22"], ["d", "2020-02-20", "2020-02-22"]]
    assert {r.k for r in rows} == {"a", "d"} and all(date(2020, 2, 10) < r.d <= date(2020, 2, 22) for r in rows)


def test_a_failing_loader_is_asked_again(spark, tmp_path):
    df = load(spark, tmp_path, parts=1, fail_once="yes", attempts="3", retry_seconds="0.01")
    assert df.count() > 0 and len(glob.glob(f"{tmp_path}/failed")) == 1


def test_nothing_to_load(spark, tmp_path):
    plan = planned(spark).filter("reason = 'up_to_date'")
    df = ranges.load_planned(spark, plan, "k string, d date, v double", "k", "d", loader="tests.loaders:noted", notes=str(tmp_path))
    assert df.count() == 0 and asked(tmp_path) == []


def test_parquet_provider_reads_by_key_and_date(spark, tmp_path):
    provider = str(tmp_path / "provider")
    spark.range(400).select(F.concat(F.lit(""), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int"))).alias("k"), F.date_add(F.lit("2019-12-20").cast("date"), (F.col("id") / 4).cast("int")).alias("d"), F.col("id").cast("double").alias("v")).write.parquet(provider)
    got = {(r.k, r.d, r.v) for r in ranges.load_planned(spark, planned(spark), "k string, d date, v double", "k", "d", 2, provider=provider).collect()}
    of = {k: (a, b) for k, a, b, why in PLAN if why != "up_to_date"}
    want = {(r.k, r.d, r.v) for r in spark.read.parquet(provider).collect() if r.k in of and of[r.k][0] <= r.d <= of[r.k][1]}
    assert got == want and want


BARS = "k string, d date, v double"


def files(path):
    """Content files of a table by partition."""
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(f"{path}/*/*.parquet")}


def bars(spark, rows):
    return spark.createDataFrame([(k, date.fromisoformat(d) if d else None, v) for k, d, v in rows], BARS)


OLD = [(k, f"2020-{m:02d}-{d:02d}", float(m)) for k in "abc" for m in range(1, 13) for d in (1, 15)] + [("a", None, 0.5)]


def contents(table):
    return sorted((r.k, str(r.d), r.v) for r in table.read().collect())


def test_range_replace_touches_its_months_only(spark, tmp_path):
    table = tables.PartitionedTable.create(bars(spark, OLD), str(tmp_path / "t"), ["k"], "d")
    before = files(table.path)
    batch = [("a", "2020-03-10", 100.0), ("a", "2020-05-20", 101.0), ("b", "2020-04-02", 102.0)]
    assert table.replace_range(bars(spark, batch)) == ["2020-03", "2020-04", "2020-05"]
    want = [r for r in OLD if not (r[0] == "a" and r[1] and "2020-03-10" <= r[1] <= "2020-05-20")] + batch
    assert contents(table) == sorted((k, str(d), v) for k, d, v in want)
    after = files(table.path)
    same = {f for f in before if after.get(f) == before[f]}
    assert len(same) == len(before) - 3 and not [f for f in same if re.search("2020-0[345]", f)]


def test_merge_last_keeps_other_partitions_and_empty_ones_go(spark, tmp_path):
    table = tables.PartitionedTable.create(bars(spark, OLD), str(tmp_path / "t"), ["k"], "d")
    before = files(table.path)
    batch = bars(spark, [("a", "2020-07-01", 7.5), ("a", "2020-07-01", 8.5), ("z", "2021-01-01", 1.0)]).withColumn("w", F.col("v"))
    assert table.merge_last(batch, ["k", "d"], "w") == ["2020-07", "2021-01"]
    want = [r for r in OLD if r[:2] != ("a", "2020-07-01")] + [("a", "2020-07-01", 8.5), ("z", "2021-01-01", 1.0)]
    assert contents(table) == sorted((k, str(d), v) for k, d, v in want)
    assert sum(files(table.path).get(f) == t for f, t in before.items()) == len(before) - 1
    assert table.truncate_from("2020-06-10") == ["2020-06", *[f"2020-{m:02d}" for m in range(7, 13)], "2021-01"]
    assert contents(table) == sorted((k, str(d), v) for k, d, v in OLD if d is None or d < "2020-06-10")
    assert not glob.glob(f"{table.path}/__part=2021*")
    assert table.truncate_from("2020-01-01")[0] == "2020-01" and contents(table) == [("a", "None", 0.5)]


def test_keys_are_replaced_in_their_buckets(spark, tmp_path):
    table = tables.PartitionedTable.create(bars(spark, OLD), str(tmp_path / "t"), ["k"], buckets=16)
    before = files(table.path)
    touched = table.replace_keys(bars(spark, [("a", "2019-01-01", 1.0), ("new", "2019-01-01", 2.0)]))
    assert contents(table) == sorted([(k, str(d), v) for k, d, v in OLD if k != "a"] + [("a", "2019-01-01", 1.0), ("new", "2019-01-01", 2.0)])
    assert len(touched) <= 2 and sum(files(table.path).get(f) == t for f, t in before.items()) >= len(before) - len(touched) >= 1
    assert table.replace_keys(bars(spark, [])) == []
    with pytest.raises(ValueError):
        table.replace_range(bars(spark, [("a", "2020-01-01", 1.0)]))


def test_pruned_reads_list_the_touched_folders_only(spark, tmp_path):
    table = tables.PartitionedTable.create(bars(spark, OLD), str(tmp_path / "t"), ["k"], "d")
    plan = table._read(["2020-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__part" in plan and "2020-02" in plan
    assert len(table._read(["2020-02"]).inputFiles()) >= 1 and table._read(["2020-02"]).count() == 6
