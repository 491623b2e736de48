"""Queries of loads, set operations and snapshots over bar tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.operators import history as H
from probspark.operators import windows as W
from probspark.plans.registry import query
from probspark.sources.tables import fresh_table

_STORED = "SELECT * FROM panel WHERE dt < DATE '2000-01-01'"
_BATCH = "SELECT entity, dt, open, close * 2 AS close, high, low, volume, amount FROM panel WHERE dt BETWEEN DATE '1999-06-01' AND DATE '2000-06-01' AND entity < 'Brand#15'"


def _stored(panel):
    return panel.filter("dt < date '2000-01-01'")


def _batch(panel):
    return panel.filter("dt between date '1999-06-01' and date '2000-06-01' and entity < 'Brand#15'").withColumn("close", F.col("close") * 2)


@query("s1_bar_scan", "panel", keep="entity dt", doubles="open close", sql="""
    SELECT * FROM panel WHERE entity IN ('Brand#1', 'Brand#12') AND dt BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def s1(panel):
    return panel.filter(F.col("entity").isin("Brand#1", "Brand#12") & F.col("dt").between("1996-01-01", "1998-12-31"))


_REPLACED = f"""
    WITH st AS ({_STORED}), ba AS ({_BATCH}), sp AS (SELECT entity, min(dt) AS a, max(dt) AS b FROM ba GROUP BY entity)
SELECT entity, dt, close FROM st WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.entity = st.entity AND st.dt BETWEEN a AND b)
    UNION ALL SELECT entity, dt, close FROM ba"""


@query("s2_range_replace", "panel", keep="entity dt", doubles="close", sql=_REPLACED)
def s2(panel):
    return H.replace_range(_stored(panel), _batch(panel), ["entity"], "dt")


_REBASED = """
    SELECT entity, factor_date, CASE WHEN entity < 'Brand#15' THEN factor * 2 ELSE factor END AS factor FROM factors WHERE entity >= 'Brand#15' OR factor_date >= DATE '1998-01-01'"""


@query("s3_series_replace", "factors", keep="entity factor_date", doubles="factor", sql=_REBASED)
def s3(factors):
    batch = factors.filter("entity < 'Brand#15' and factor_date >= date '1998-01-01'").withColumn("factor", F.col("factor") * 2)
    return H.replace_keys(factors, batch, ["entity"])


_STATUS = """
    SELECT entity, 'daily' AS period, max(dt) AS reliable_day, CASE WHEN entity < 'Brand#15' THEN 'new' ELSE 'old' END AS source
    FROM panel WHERE entity < 'Brand#15' OR dt < DATE '2000-01-01' GROUP BY entity"""


@query("s4_status_upsert", "panel", keep="entity period reliable_day source", sql=_STATUS)
def s4(panel):
    status = lambda df, source: df.groupBy("entity").agg(F.lit("daily").alias("period"), F.max("dt").alias("reliable_day"), F.lit(source).alias("source"))
    return H.replace_keys(status(_stored(panel), "old"), status(panel.filter("entity < 'Brand#15'"), "new"), ["entity", "period"])


@query("s2_stored_replace", "panel", keep="entity dt", doubles="close", sql=_REPLACED)
def s2_stored(panel):
    """The same on a table in months: other months' files stay as they are."""
    table = fresh_table(_stored(panel), ["entity"], "dt")
    table.replace_range(_batch(panel))
    return table.read()


@query("s3_stored_series", "factors", keep="entity factor_date", doubles="factor", sql=_REBASED)
def s3_stored(factors):
    table = fresh_table(factors, ["entity"], buckets=8)
    table.replace_keys(factors.filter("entity < 'Brand#15' and factor_date >= date '1998-01-01'").withColumn("factor", F.col("factor") * 2))
    return table.read()


@query("s4_stored_status", "panel", keep="entity period reliable_day source", sql=_STATUS)
def s4_stored(panel):
    status = lambda df, source: df.groupBy("entity").agg(F.lit("daily").alias("period"), F.max("dt").alias("reliable_day"), F.lit(source).alias("source"))
    table = fresh_table(status(_stored(panel), "old"), ["entity", "period"], buckets=8)
    table.replace_keys(status(panel.filter("entity < 'Brand#15'"), "new"))
    return table.read()


@query("s5_stored_truncate", "panel", keep="entity dt", doubles="close", sql="SELECT entity, dt, close FROM panel WHERE dt < DATE '1997-05-01'")
def s5_stored(panel):
    table = fresh_table(panel, ["entity"], "dt")
    table.truncate_from("1997-05-01")
    return table.read()


@query("s5_boundary_truncate", "panel", keep="removed", sql="SELECT count(*) AS removed FROM panel WHERE dt >= DATE '2000-01-01'")
def s5(panel):
    return H.truncate_from(panel, "dt", "2000-01-01")[1]


@query("s6_load_plan", "panel part", keep="entity known_until start_date end_date reason", sql="""
    SELECT u.entity, coalesce(CAST(latest AS VARCHAR), 'never') AS known_until, CASE WHEN latest IS NULL THEN DATE '1995-01-01' ELSE greatest(CAST(latest - INTERVAL 30 DAY AS DATE), DATE '1995-01-01') END AS start_date,
        DATE '1999-12-01' AS end_date, CASE WHEN latest IS NULL THEN 'no_history' WHEN latest >= DATE '1999-12-01' THEN 'up_to_date' ELSE 'tail' END AS reason
    FROM (SELECT DISTINCT p_brand AS entity FROM part) u LEFT JOIN (SELECT entity, max(dt) AS latest FROM panel
        WHERE entity < 'Brand#20' AND dt < DATE '2000-01-01' AND (entity > 'Brand#12' OR dt < DATE '1999-01-01') GROUP BY entity) l ON u.entity = l.entity""")
def s6(panel, part):
    known = panel.filter("entity < 'Brand#20' and dt < date '2000-01-01' and (entity > 'Brand#12' or dt < date '1999-01-01')")
    plan = H.plan_loads(known, part.select(F.col("p_brand").alias("entity")), "entity", "dt", "1995-01-01", "1999-12-01", 30)
    return plan.withColumn("known_until", F.coalesce(F.col("latest").cast("string"), F.lit("never")))


@query("s15_series_normalisation", "panel", keep="entity dt", doubles="change_pct swing", digits=4, sql="""
    SELECT entity, dt, 100 * (close / prev - 1) AS change_pct, 100 * (high - low) / prev AS swing FROM (
        SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY dt) AS prev FROM panel) q""")
def s15(panel):
    """Repeated dates go (the later write stays) before changes are taken."""
    again = panel.withColumn("close", F.col("close") * 0)
    one = H.merge_last(again, panel, ["entity", "dt"])
    prev = F.lag("close").over(W.by(["entity"], ["dt"]))
    return one.withColumns({"change_pct": 100 * (F.col("close") / prev - 1), "swing": 100 * (F.col("high") - F.col("low")) / prev})


@query("s17_live_overlay", "panel", keep="entity dt", doubles="close", sql="""
    SELECT entity, dt, CASE WHEN dt = DATE '2000-01-01' THEN close + 1 ELSE close END AS close FROM panel WHERE dt <= DATE '2000-01-01'""")
def s17(panel):
    live = panel.filter("dt = date '2000-01-01' and close > 0").withColumn("close", F.col("close") + 1)
    return H.overlay_live(panel.filter("dt <= date '2000-01-01'"), live, ["entity", "dt"])


@query("s19_universe", "customer orders", keep="code segment", sql="""
    SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_mktsegment AS segment FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND NOT contains(c_mktsegment, 'AUTO') AND regexp_matches(CAST(c_custkey AS VARCHAR), '^[136]')""")
def s19(customer, orders):
    gone = orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    df = customer.join(gone, "c_custkey", "left_anti").filter(~F.col("c_mktsegment").contains("AUTO") & F.col("c_custkey").cast("string").rlike("^[136]"))
    return df.select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"), F.col("c_mktsegment").alias("segment"))


@query("u2_history_upsert", "panel", keep="entity dt written", doubles="close", sql="""
    SELECT entity, dt, CASE WHEN entity < 'Brand#12' THEN 2 ELSE 1 END AS written, CASE WHEN entity < 'Brand#12' THEN close * 3 ELSE close END AS close FROM panel""")
def u2(panel):
    later = panel.filter("entity < 'Brand#12'").withColumn("close", F.col("close") * 3).withColumn("written", F.lit(2))
    return W.keep_last(panel.withColumn("written", F.lit(1)).unionByName(later), ["entity", "dt"], [F.desc("written")])


@query("u3_snapshot_history", "events", keep="user_id snapshot n", sql="""
    SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS snapshot, count(*) AS n FROM events GROUP BY user_id, date_trunc('hour', ts)""")
def u3(events):
    """Snapshots that are written again replace the earlier ones; several of a day stay."""
    rows = events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("snapshot")).agg(F.count(F.lit(1)).alias("n"))
    return H.merge_last(rows.withColumn("n", F.lit(0).cast("long")), rows, ["user_id", "snapshot"])


@query("u4_set_difference", "customer orders supplier", keep="key", sql="""
    SELECT c_custkey AS key FROM customer EXCEPT (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT s_suppkey FROM supplier)""")
def u4(customer, orders, supplier):
    gone = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")).union(supplier.select("s_suppkey")).distinct()
    return customer.select(F.col("c_custkey").alias("key")).distinct().join(gone, "key", "left_anti")


@query("u5_keep_first", "events", keep="user_id event_id event_type", sql="""
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) q WHERE n = 1""")
def u5(events):
    return W.keep_last(events, ["user_id"], ["ts", "event_id"])


@query("j5_left_enrich", "panel part", keep="entity dt parts", doubles="close", sql="""
    SELECT p.entity, p.dt, p.close, b.parts FROM panel p LEFT JOIN (SELECT p_brand, count(*) AS parts FROM part WHERE p_size > 10 GROUP BY p_brand) b ON p.entity = b.p_brand""")
def j5(panel, part):
    return panel.join(part.filter("p_size > 10").groupBy(F.col("p_brand").alias("entity")).agg(F.count(F.lit(1)).alias("parts")), "entity", "left")


@query("j7_anti_semi", "customer orders", keep="c_custkey kind", sql="""
    SELECT c_custkey, 'none' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT c_custkey, 'large' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def j7(customer, orders):
    key = orders.withColumnRenamed("o_custkey", "c_custkey")
    none = customer.join(key, "c_custkey", "left_anti").select("c_custkey", F.lit("none").alias("kind"))
    return none.union(customer.join(key.filter("o_totalprice > 400000"), "c_custkey", "left_semi").select("c_custkey", F.lit("large").alias("kind")))
