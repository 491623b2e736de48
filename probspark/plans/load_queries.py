"""Queries of loads, normalisation, sinks, adjustment and parsing over bar tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.operators import breadth as B
from probspark.operators import history as H
from probspark.plans.registry import query
from probspark.sources.tables import fresh_table
from probspark.sources import stored as S

_W = "(PARTITION BY entity ORDER BY dt)"
_ADJUST = """f AS (SELECT p.*, coalesce(a.factor, g.factor) AS factor FROM panel p ASOF LEFT JOIN factors a ON p.entity = a.entity AND p.dt >= a.factor_date
    LEFT JOIN (SELECT entity, arg_min(factor, factor_date) AS factor FROM factors GROUP BY entity) g ON p.entity = g.entity)"""


def _adjusted(name: str, by: str) -> str:
    price = lambda c: f"floor({c} * ({by}) * 1e2 + 0.5e0) / 1e2 AS {c}"
    return f"{name} AS (SELECT entity, dt, {', '.join(map(price, H.PRICES))} FROM f)"


@query("j1_asof_adjustment", "panel factors", keep="entity dt mode", doubles="open high low close change pct_change amplitude", digits=4, sql=f"""
    WITH {_ADJUST},
{_adjusted('q', '1 / factor')},
{_adjusted('h', 'factor')},
b AS (SELECT *, 'qfq' AS mode FROM q UNION ALL SELECT *, 'hfq' FROM h),
l AS (SELECT *, lag(close) OVER (PARTITION BY mode, entity ORDER BY dt) AS before FROM b)
SELECT *, close - before AS change, close / before * 100 - 100 AS pct_change, (high - low) / before * 100 AS amplitude FROM l""")
def j1(panel, factors):
    both = [H.adjusted_bars(panel, factors, "entity", "dt", mode).withColumn("mode", F.lit(mode)) for mode in ("qfq", "hfq")]
    return both[0].unionByName(both[1])


_MERGED = """
    WITH st AS (SELECT * FROM panel WHERE dt < DATE '2000-01-01'), ba AS (SELECT entity, dt, close * 3 AS close FROM panel WHERE dt >= DATE '1999-06-01' AND entity < 'Brand#15')
SELECT coalesce(b.entity, a.entity) AS entity, coalesce(b.dt, a.dt) AS dt, coalesce(b.close, a.close) AS close FROM st a FULL JOIN ba b ON a.entity = b.entity AND a.dt = b.dt"""


@query("s7_merge_last", "panel", keep="entity dt", doubles="close", sql=_MERGED)
def s7(panel):
    """The batch holds two rows of every key; the later written one stays."""
    batch = panel.filter("dt >= date '1999-06-01' and entity < 'Brand#15'").drop("volume")
    batch = batch.select("*", F.explode(F.array(F.lit(2), F.lit(3))).alias("written")).withColumn("close", F.col("close") * F.col("written"))
    return H.merge_last(panel.filter("dt < date '2000-01-01'"), batch, ["entity", "dt"], "written")


@query("s7_stored_merge", "panel", keep="entity dt", doubles="close", sql=_MERGED)
def s7_stored(panel):
    """The same on a table in months, of which only those of the batch are read and rewritten."""
    table = fresh_table(panel.filter("dt < date '2000-01-01'"), ["entity"], "dt")
    batch = panel.filter("dt >= date '1999-06-01' and entity < 'Brand#15'")
    batch = batch.select("*", F.explode(F.array(F.lit(2), F.lit(3))).alias("written")).withColumn("close", F.col("close") * F.col("written"))
    table.merge_last(batch, ["entity", "dt"], "written")
    return table.read()


@query("s8_coverage_window", "panel", keep="entity served tail_start rows_in_window", sql="""
    SELECT entity, CASE WHEN max(dt) >= DATE '1999-06-01' THEN 'cache' ELSE 'tail' END AS served, CASE WHEN max(dt) < DATE '1999-06-01' THEN greatest(CAST(max(dt) + INTERVAL 1 DAY AS DATE), DATE '1998-06-01') END AS tail_start,
        count(*) FILTER (dt BETWEEN DATE '1998-06-01' AND DATE '1999-06-01') AS rows_in_window FROM panel WHERE dt < DATE '1999-01-01' OR entity < 'Brand#15' GROUP BY entity""")
def s8(panel):
    return H.serve_window(panel.filter("dt < date '1999-01-01' or entity < 'Brand#15'"), "entity", "dt", "1998-06-01", "1999-06-01")


@query("s8_tail_load", "panel", keep="entity dt", doubles="close", sql="""
    SELECT entity, dt, close FROM panel WHERE (dt < DATE '1999-01-01' OR dt <= DATE '1999-06-01') AND dt <= DATE '1999-06-01' OR entity < 'Brand#15'""")
def s8b(panel):
    """The missing tails are loaded and merged; what is there stays."""
    cached = panel.filter("dt < date '1999-01-01' or entity < 'Brand#15'")
    tails = H.serve_window(cached, "entity", "dt", "1990-01-01", "1999-06-01").filter("served = 'tail'").select("entity", "tail_start")
    tail = panel.join(tails, "entity").filter("dt between tail_start and date '1999-06-01'").drop("tail_start")
    return H.merge_last(cached, tail, ["entity", "dt"])


@query("s9_reliable_time", "events", keep="event_id period reliable", sql="""
    SELECT event_id, period, CASE WHEN period IN ('1d', 'daily') THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' WHEN strftime(ts, '%H:%M') >= '15:03' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
        WHEN period = '15m' THEN strftime(ts - INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') WHEN period = '30min' THEN strftime(ts - INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS reliable
    FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN '1d' WHEN 1 THEN '15m' WHEN 2 THEN '30min' WHEN 3 THEN '2h' ELSE 'daily' END AS period FROM events) e""")
def s9(events):
    number = F.col("event_id") % 5
    df = events.withColumn("period", F.when(number == 0, "1d").when(number == 1, "15m").when(number == 2, "30min").when(number == 3, "2h").otherwise("daily"))
    reliable = H.reliable_time(F.col("period"), F.col("ts").cast("timestamp"), F.col("ts").cast("timestamp"))
    return df.withColumn("reliable", F.date_format(reliable, "yyyy-MM-dd HH:mm:ss"))


@query("s10_csv_round_trip", "panel", keep="code dt", doubles="close amount", digits=4, sql="SELECT lpad(regexp_replace(entity, '[^0-9]', '', 'g'), 6, '0') AS code, dt, close, amount FROM panel")
def s10(panel):
    """Written with a header and read by schema: codes keep their zeros, dates are dates."""
    path = S.fresh_path(panel.sparkSession, "csv")
    S.write_csv(panel.select(F.lpad(F.regexp_replace("entity", "[^0-9]", ""), 6, "0").alias("code"), "dt", "close", "amount"), path)
    return S.read_csv(panel.sparkSession, path, "code string, dt date, close double, amount double")


@query("s11_run_summary", "panel", keep="row_count first_date last_date top", doubles="mean_close", digits=4, sql="""
    SELECT count(*) AS row_count, strftime(min(dt), '%Y-%m-%d') AS first_date, strftime(max(dt), '%Y-%m-%d') AS last_date, avg(close) AS mean_close,
        (SELECT string_agg(entity || '@' || strftime(dt, '%Y-%m-%d'), ',' ORDER BY amount DESC, entity, dt) FROM (SELECT * FROM panel ORDER BY amount DESC, entity, dt LIMIT 5) t) AS top FROM panel""")
def s11(panel):
    """One JSON document with counts, dates, a metric and the top rows, read back as a row."""
    path = S.fresh_path(panel.sparkSession, "summary")
    top = [F.col("entity"), F.date_format("dt", "yyyy-MM-dd").alias("day")]
    S.write_summary(S.run_summary(panel, "dt", {"mean_close": F.avg("close")}, top, -F.col("amount"), 5), path)
    schema = "row_count long, first_date string, last_date string, mean_close double, top array<struct<key: double, entity: string, day: string>>"
    return panel.sparkSession.read.schema(schema).json(path).withColumn("top", F.concat_ws(",", F.transform("top", lambda x: F.concat(x["entity"], F.lit("@"), x["day"]))))


@query("s12_manifest", "panel", keep="provider dataset row_count reliable_time fetched_at params", sql="""
    SELECT 'local' AS provider, 'panel' AS dataset, count(*) AS row_count, max(dt) AS reliable_time, '2001-12-01 00:00:00' AS fetched_at, '{"end":"2001-11-30","step":"month"}' AS params FROM panel""")
def s12(panel):
    return H.manifest(panel, "panel", ["dt"], "local", F.lit("2001-12-01 00:00:00"), {"step": "month", "end": "2001-11-30"})


@query("s13_group_counts", "members", keep="grp n", sql="SELECT grp, count(*) AS n FROM members WHERE grp <> 'PROMO' GROUP BY grp")
def s13(members):
    """Files per group, written twice: the second run has a group less, whose files go."""
    path = S.fresh_path(members.sparkSession, "groups")
    S.write_groups(members, "grp", path)
    return S.write_groups(members.filter("grp <> 'PROMO'"), "grp", path)


def _text(c: str, bad: str):
    return F.when(F.expr(bad), "n/a").otherwise(F.col(c).cast("string"))


def raw_bars(panel):
    """The panel as a provider's text columns, with some bad numbers and dates."""
    number = F.regexp_extract("entity", r"(\d+)", 1)
    return panel.select(
        F.concat(F.lit("sh"), number).alias("symbol"), F.when(F.expr("month(dt) = 12 and entity < 'Brand#12'"), "soon").otherwise(F.date_format("dt", "yyyy-MM-dd")).alias("date"), F.col("entity").alias("stock_name"),
        F.col("open").cast("string").alias("open"), _text("high", "month(dt) = 3 and entity > 'Brand#20'").alias("high"), F.col("low").cast("string").alias("low"), F.col("close").cast("string").alias("close"),
        _text("volume", "month(dt) = 5").alias("volume"), F.col("amount").cast("string").alias("amount"), (F.col("volume") / 10000).cast("string").alias("turnover"),
    )


@query("s14_bar_normalisation", "panel", keep="code trade_date stock_name", doubles="open high low close volume amount turnover_rate", digits=4, sql="""
    SELECT lpad(regexp_extract(entity, '([0-9]+)', 1), 6, '0') AS code, dt AS trade_date, entity AS stock_name, open, high, low, close, CASE WHEN month(dt) <> 5 THEN volume END AS volume, amount, volume / 10000 * 100 AS turnover_rate FROM panel
    WHERE NOT (month(dt) = 12 AND entity < 'Brand#12') AND NOT (month(dt) = 3 AND entity > 'Brand#20')""")
def s14(panel):
    return H.normal_bars(raw_bars(panel))


@query("s16_live_snapshot", "panel", keep="code trade_date stock_name", doubles="open high low close amount", digits=4, sql="""
    SELECT lpad(regexp_extract(entity, '([0-9]+)', 1), 6, '0') AS code, DATE '2001-12-03' AS trade_date, entity AS stock_name, open, high, low, close, amount FROM (
        SELECT *, row_number() OVER (PARTITION BY entity ORDER BY dt DESC) AS n FROM panel WHERE month(dt) <> 11 AND NOT (month(dt) = 3 AND entity > 'Brand#20')) q WHERE n = 1""")
def s16(panel):
    """A spot table with several rows of a code, prices of 0 among them: the last one with a price stays."""
    number = F.regexp_extract("entity", r"(\d+)", 1)
    spot = panel.select(
        F.concat(F.lit("sh"), number).alias("symbol"), F.col("entity").alias("stock_name"), F.col("open").cast("string").alias("open"), _text("high", "month(dt) = 3 and entity > 'Brand#20'").alias("high"),
        F.col("low").cast("string").alias("low"), F.col("close").cast("string").alias("close"), F.col("volume").cast("string").alias("volume"), F.col("amount").cast("string").alias("amount"), F.lit("2.5").alias("turnover_rate"), F.col("dt").alias("written"),
    )
    spot = spot.withColumn("close", F.when(F.month("written") == 11, "0").otherwise(F.col("close")))
    return H.live_bars(spot, F.lit("2001-12-03").cast("date"), "written")


@query("s18_factor_normalisation", "factors", keep="code factor_date factor_type", doubles="factor", sql="""
    SELECT lpad(regexp_extract(entity, '([0-9]+)', 1), 6, '0') AS code, factor_date, 'qfq' AS factor_type, factor FROM factors WHERE NOT (month(factor_date) = 4 AND entity < 'Brand#15')""")
def s18(factors):
    number = F.regexp_extract("entity", r"(\d+)", 1)
    raw = factors.select(F.concat(F.lit("sz"), number).alias("symbol"), F.date_format("factor_date", "yyyy-MM-dd").alias("date"), F.when(F.expr("month(factor_date) = 4 and entity < 'Brand#15'"), "-").otherwise(F.col("factor").cast("string")).alias("qfq_factor"))
    return H.normal_factors(raw, "qfq")


@query("s22_membership", "members", keep="grp member place snapshot_at", sql="""
    SELECT grp, member, place, '2001-12-01 00:00:00' AS snapshot_at FROM (SELECT grp, member, row_number() OVER (PARTITION BY grp ORDER BY amount DESC, member) AS place FROM (
        SELECT grp, member, max(amount) AS amount FROM members GROUP BY grp, member) m) q WHERE place <= 8""")
def s22(members):
    """Every member comes many times; its largest row stands for it, and the first eight of a group stay."""
    return H.membership(members, "grp", "member", F.lit("2001-12-01 00:00:00"), [F.desc("amount"), "member", "dt"], 8)


@query("f13_string_parsing", "part", keep="p_partkey code up down", doubles="number percent missing", sql="""
    SELECT p_partkey, lpad(regexp_extract(p_brand, '([0-9]{1,6})', 1), 6, '0') AS code, p_size AS up, p_partkey % 97 AS down, -(floor(p_retailprice * 100) / 100) AS number, p_size / 4.0e0 AS percent, CAST(NULL AS DOUBLE) AS missing FROM part""")
def f13(part):
    """Numbers with a sign and thousands separators, pairs, percents, placeholders and codes, from text."""
    price = F.format_number(F.floor(F.col("p_retailprice") * 100) / 100, 2)
    df = part.select("p_partkey", "p_brand", F.concat(F.lit("price -"), price).alias("number"), F.concat_ws(" / ", "p_size", F.col("p_partkey") % 97).alias("pair"), F.concat((F.col("p_size") / 4).cast("string"), F.lit("%")).alias("percent"))
    up, down = B.parse_pair(F.col("pair"))
    return df.select("p_partkey", H.code_of(F.col("p_brand")).alias("code"), up.alias("up"), down.alias("down"), B.parse_number(F.col("number")).alias("number"), B.parse_percent(F.col("percent")).alias("percent"), B.parse_number(F.lit("--")).alias("missing"))


@query("f14_dates", "events", keep="event_id day hour next_week local_time step persisted_until", sql="""
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, strftime(CAST(ts AS DATE) + INTERVAL 7 DAY, '%Y%m%d') AS next_week, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local_time,
        CASE event_id % 3 WHEN 0 THEN 900 WHEN 1 THEN 7200 ELSE 86400 END AS step, strftime(CAST(ts + INTERVAL 8 HOUR AS DATE) - INTERVAL 1 DAY, '%Y%m%d') AS persisted_until FROM events""")
def f14(events):
    """Parts, offsets, another time zone, period texts, and the day before today as the last one that is kept."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai")
    period = F.when(F.col("event_id") % 3 == 0, "15min").when(F.col("event_id") % 3 == 1, "2h").otherwise("day")
    return events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").cast("long").alias("hour"), F.date_format(F.date_add(F.to_date("ts"), 7), "yyyyMMdd").alias("next_week"),
        F.date_format(local, "yyyy-MM-dd HH:mm").alias("local_time"), H.period_seconds(period).alias("step"), F.date_format(F.date_sub(F.to_date(local), 1), "yyyyMMdd").alias("persisted_until"),
    )


@query("u1_union_columns", "panel", keep="entity dt kind", doubles="close amount", sql="""
    SELECT entity, dt, 'a' AS kind, close, NULL::DOUBLE AS amount FROM panel WHERE dt < DATE '1998-01-01' UNION ALL SELECT entity, dt, NULL AS kind, close, amount FROM panel WHERE dt >= DATE '1998-01-01'""")
def u1(panel):
    first = panel.filter("dt < date '1998-01-01'").select("entity", "dt", F.lit("a").alias("kind"), "close")
    return first.unionByName(panel.filter("dt >= date '1998-01-01'").select("entity", "dt", "close", "amount"), allowMissingColumns=True)
