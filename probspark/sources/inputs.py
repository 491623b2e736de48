"""Inputs of the operators, derived from the star-schema tables in SQL that Spark and DuckDB both read.

A probability question is a *subject* with *outcomes*; a panel has *entities* with one bar per month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"


def _bars(key: str, lines: str) -> str:
    return f"""SELECT {key}, dt, max(CASE WHEN a = 1 THEN price END) AS open, max(CASE WHEN a = n THEN price END) AS close,
        max(price) AS high, min(price) AS low, CAST(sum(CAST(qty AS DECIMAL(18,2))) AS DOUBLE) AS volume,
        CAST(sum(CAST(ext AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM {lines} GROUP BY {key}, dt"""


def _lines(key: str, partition: str) -> str:
    return f"""SELECT {key}, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS dt, l.l_extendedprice / l.l_quantity AS price,
        l.l_quantity AS qty, l.l_extendedprice AS ext,
        row_number() OVER (PARTITION BY {partition}, date_trunc('month', l.l_shipdate) ORDER BY {_ORDER}) AS a,
        count(*) OVER (PARTITION BY {partition}, date_trunc('month', l.l_shipdate)) AS n
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""


#: name -> (inputs it needs, SQL)
INPUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "panel_lines": ((), _lines("p.p_brand AS entity", "p.p_brand")),
    "panel": (("panel_lines",), _bars("entity", "panel_lines")),
    "member_lines": ((), _lines("p.p_type AS grp, p.p_brand AS member", "p.p_type, p.p_brand")),
    "members": (("member_lines",), _bars("grp, member", "member_lines")),
    "group_lines": ((), _lines("p.p_type AS grp", "p.p_type")),
    "groups": (("group_lines",), _bars("grp", "group_lines")),
    "factors": ((), """SELECT p.p_brand AS entity, CAST(date_trunc('quarter', l.l_shipdate) AS DATE) AS factor_date,
        1 + round(avg(l.l_discount), 6) AS factor FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
        GROUP BY p.p_brand, date_trunc('quarter', l.l_shipdate)"""),
    "shares": ((), """SELECT subject, ts, outcome, amount / sum(amount) OVER (PARTITION BY subject, ts) AS p, amount FROM (
        SELECT r.r_name AS subject, CAST(date_trunc('quarter', l.l_shipdate) AS DATE) AS ts, p.p_type AS outcome,
        CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
        GROUP BY r.r_name, date_trunc('quarter', l.l_shipdate), p.p_type) q"""),
    "quotes": (("shares",), """SELECT subject, ts, outcome, 1 / (1.05 * p) AS value, 'decimal_odds' AS signal_type FROM (
        SELECT *, max(p) OVER (PARTITION BY subject, ts) AS most FROM shares) q WHERE most < 0.95"""),
    "evidence": ((), """SELECT p.p_brand AS subject, l.l_suppkey AS source, round(avg(l.l_quantity) / 51, 9) AS p,
        round(1 - avg(l.l_tax), 9) AS confidence, CASE min(l.l_returnflag) WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS grade,
        CAST(max(l.l_shipdate) AS DATE) AS ts FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, l.l_suppkey"""),
    "class_forecasts": ((), """SELECT d.doc_id AS forecast_id, least(greatest(d.n_chars / 6000.0e0, 0.02e0), 0.98e0) AS p, l.quality AS y
        FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id"""),
    "user_events": ((), """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, value
        FROM events"""),
    "forecasts": (("user_events",), """SELECT user_id AS stream_id, seq, source_id,
        CASE source_id WHEN 'last' THEN a WHEN 'older' THEN b ELSE 0.5e0 END AS prediction, actual FROM (
        SELECT user_id, seq, value / 100 AS actual,
          coalesce(lag(value / 100, 1) OVER (PARTITION BY user_id ORDER BY seq), 0.5e0) AS a,
          coalesce(lag(value / 100, 2) OVER (PARTITION BY user_id ORDER BY seq), 0.4e0) AS b FROM user_events) q
        CROSS JOIN (SELECT 'last' AS source_id UNION ALL SELECT 'older' UNION ALL SELECT 'half') s"""),
    "edges": ((), """SELECT n1.n_regionkey AS graph_id, n1.n_name AS src, n2.n_name AS dst FROM nation n1 JOIN nation n2
        ON n1.n_regionkey = n2.n_regionkey AND n1.n_name < n2.n_name"""),
    "chain": ((), """SELECT graph_id, src, dst FROM (SELECT n_regionkey AS graph_id, n_name AS src, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS dst FROM nation) q
        WHERE dst IS NOT NULL"""),
    "nation_shares": ((), """SELECT graph_id, ts, outcome, amount / sum(amount) OVER (PARTITION BY graph_id, ts) AS p FROM (
        SELECT n.n_regionkey AS graph_id, CAST(date_trunc('year', l.l_shipdate) AS DATE) AS ts, n.n_name AS outcome,
        CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_regionkey, date_trunc('year', l.l_shipdate), n.n_name) q"""),
    "flows": (("nation_shares",), """SELECT graph_id, ts, outcome, p, flow, CASE WHEN abs(flow) < 0.5 THEN 'stable' WHEN flow > 0 THEN 'upward' ELSE 'downward' END AS direction
        FROM (SELECT *, (p - lag(p) OVER (PARTITION BY graph_id, outcome ORDER BY ts)) * 100 AS flow FROM nation_shares) q WHERE flow IS NOT NULL"""),
    "slot_evidence": (("shares",), """SELECT subject, ts, source, CASE k % 4 WHEN 0 THEN 'market' WHEN 1 THEN 'model' WHEN 2 THEN 'sensor' ELSE 'rumour' END AS source_type,
        CASE WHEN k % 3 = 0 THEN NULL ELSE outcome END AS outcome, p, 0.7e0 AS confidence, seen FROM (
        SELECT subject, ts, outcome || '-desk' AS source, outcome, round(least(greatest(p * 1.4e0, 0.02e0), 0.9e0), 9) AS p, CAST(ts + INTERVAL 30 DAY AS DATE) AS seen,
            row_number() OVER (PARTITION BY subject, ts ORDER BY outcome) AS k FROM shares) q"""),
    "legs": (("quotes",), """SELECT subject, ts, outcome, least(1 / value * 1.3e0, 0.9e0) AS p, value AS multiplier, 0.8e0 AS confidence FROM quotes"""),
    "features": (("panel",), """SELECT entity, dt, close, high, low, amount,
        close / lag(close, 1) OVER w - 1 AS ret_1, close / lag(close, 3) OVER w - 1 AS ret_3, close / lag(close, 5) OVER w - 1 AS ret_5,
        lead(close, 3) OVER w / close - 1 AS fwd_3,
        CASE WHEN count(*) OVER w20 = 20 THEN avg(amount) OVER w5 / avg(amount) OVER w20 END AS amount_ratio,
        CASE WHEN high > low THEN (close - low) / (high - low) END AS position_in_bar
        FROM panel WINDOW w AS (PARTITION BY entity ORDER BY dt), w5 AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
        w20 AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""),
}


#: Monthly bars and the columns of ``part`` that key them: Spark builds these from partial aggregates, see ``monthly_bars``.
BARS = {"panel": {"p_brand": "entity"}, "members": {"p_type": "grp", "p_brand": "member"}, "groups": {"p_type": "grp"}}


def _needed(names: tuple[str, ...], without: tuple[str, ...] = ()) -> list[str]:
    found: list[str] = []
    for name in (n for n in names if n not in without):
        for x in (*_needed(INPUTS[name][0], without), name):
            if x not in found:
                found.append(x)
    return found


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the named inputs."""
    return "WITH " + ",\n".join(f"{n} AS ({INPUTS[n][1]})" for n in _needed(names))


def monthly_bars(lineitem: DataFrame, part: DataFrame, key: dict[str, str]) -> DataFrame:
    """Bars per key and month: prices of the first and the last line in order, extremes and sums.

    The SQL of these bars numbers all lines of a key's month in one task; here each task sends one partial row per bar.
    """
    order, price = F.struct(*_ORDER.split(", ")), F.col("l_extendedprice") / F.col("l_quantity")
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    month = F.date_trunc("month", "l_shipdate").cast("date").alias("dt")
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(*(F.col(c).alias(n) for c, n in key.items()), month).agg(
        F.min_by(price, order).alias("open"), F.max_by(price, order).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"),
        total("l_quantity").alias("volume"), total("l_extendedprice").alias("amount"),
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or an input derived from base tables."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name in TABLES:
        return read(name)
    if name in BARS:
        return monthly_bars(read("lineitem"), read("part"), BARS[name])
    built = tuple(n for n in INPUTS[name][0] if n in BARS)
    for bars in built:
        load(spark, sf_dir, bars).createOrReplaceTempView(bars)
    needed = _needed((name,), built)
    sql = "WITH " + ",\n".join(f"{n} AS ({INPUTS[n][1]})" for n in needed) + f" SELECT * FROM {name}"
    for table in TABLES:
        if table in sql:
            read(table).createOrReplaceTempView(table)
    return spark.sql(sql)
