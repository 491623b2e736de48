"""Queries of signals, sources, flows over chains, bundles, and the analysis from quotes to allocation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions import expr as X
from probspark.operators import allocation as A
from probspark.operators import analysis as N
from probspark.operators import domain as D
from probspark.operators import fusion as P
from probspark.operators import graph as G
from probspark.plans.fusion_queries import _LOGIT, AS_OF
from probspark.plans.graph_queries import _ALLOCATED
from probspark.plans.registry import query
from probspark.sources.stored import fresh_path, stored, tasks_for

LIFE = 720.0

_MODIFIER = "0.4e0 + 0.1e0 * (length(outcome) % 5)"
_BOTH = "SELECT graph_id, src, dst FROM chain UNION SELECT graph_id, dst AS src, src AS dst FROM chain"
_STEPS = "CASE WHEN pull IS NULL THEN 1.0e0 WHEN pull > 3 THEN 1.5e0 WHEN pull > 1 THEN 1.3e0 WHEN pull > 0 THEN 1.1e0 WHEN pull > -1 THEN 0.9e0 WHEN pull > -3 THEN 0.8e0 ELSE 0.7e0 END"
_LEVEL = "CASE WHEN abs(score) < 1 THEN 'none' WHEN abs(score) < 3 THEN 'low' WHEN abs(score) < 6 THEN 'medium' WHEN abs(score) < 10 THEN 'high' WHEN abs(score) < 15 THEN 'very_high' ELSE 'exceptional' END"


def _same(d: int) -> str:
    """Whether the signal can pass d nodes of a chain to one of its sides: all of them known and of its sign."""
    side = lambda f: " AND ".join(f"coalesce(({f}{i} >= 0) = (flow >= 0), FALSE)" for i in range(1, d + 1))
    return f"(({side('n')}) OR ({side('b')}))"


_AMPLIFIED = f"""spots AS (SELECT n.graph_id, t.ts, n.outcome, f.flow FROM (SELECT n_regionkey AS graph_id, n_name AS outcome FROM nation) n JOIN (SELECT DISTINCT graph_id, ts FROM flows) t ON n.graph_id = t.graph_id
    LEFT JOIN flows f ON f.graph_id = n.graph_id AND f.ts = t.ts AND f.outcome = n.outcome),
sides AS (SELECT *, {', '.join(f'lead(flow, {i}) OVER w AS n{i}, lag(flow, {i}) OVER w AS b{i}' for i in (1, 2, 3))} FROM spots WINDOW w AS (PARTITION BY graph_id, ts ORDER BY outcome)),
deep AS (SELECT graph_id, ts, outcome, CASE WHEN abs(flow) * 0.7e0 < 1 OR NOT {_same(1)} THEN 0 WHEN abs(flow) * 0.343e0 < 1 OR NOT {_same(2)} THEN 1 WHEN abs(flow) * 0.117649e0 < 1 OR NOT {_same(3)} THEN 2 ELSE 3 END AS depth
    FROM sides WHERE flow IS NOT NULL),
near AS (SELECT f.graph_id, f.ts, f.outcome, f.flow, f.direction, g.p AS adj_p, g.flow AS adj_flow, g.direction AS adj_direction FROM flows f JOIN ({_BOTH}) e ON f.graph_id = e.graph_id AND f.outcome = e.src
    LEFT JOIN flows g ON g.graph_id = f.graph_id AND g.ts = f.ts AND g.outcome = e.dst),
pulls AS (SELECT graph_id, ts, outcome, avg(CASE WHEN adj_direction IS NULL THEN 0.0e0 WHEN direction <> 'stable' AND adj_direction = direction THEN 1.0e0 WHEN adj_direction = 'stable' THEN 0.5e0 ELSE 0.0e0 END) AS consistency,
    sum(CASE WHEN (flow >= 0) = (adj_flow >= 0) THEN 1 ELSE -1 END * abs(adj_flow) * greatest(adj_p, 0.01e0)) / sum(CASE WHEN adj_flow IS NOT NULL THEN greatest(adj_p, 0.01e0) END) AS pull FROM near GROUP BY graph_id, ts, outcome),
grads AS (SELECT *, {_MODIFIER} AS modifier, CASE WHEN max(p) OVER w = min(p) OVER w THEN 0.5e0 ELSE (max(p) OVER w - p) / (max(p) OVER w - min(p) OVER w) END AS gradient FROM flows WINDOW w AS (PARTITION BY graph_id, ts, direction)),
amp0 AS (SELECT g.graph_id, g.ts, g.outcome, flow, direction, CASE WHEN abs(flow) < 1 THEN 0.1e0 * modifier ELSE modifier END AS confidence, CASE WHEN abs(flow) < 1 THEN 0 ELSE depth END AS depth,
    CASE WHEN abs(flow) < 1 THEN 0.0e0 ELSE consistency END AS consistency, CASE WHEN abs(flow) < 1 THEN 0.0e0
        WHEN direction = 'upward' THEN flow * (0.5e0 + 0.5e0 * consistency) * (1 + gradient) * {_STEPS} * modifier ELSE flow * 0.3e0 * consistency * modifier END AS score
    FROM grads g JOIN pulls p ON g.graph_id = p.graph_id AND g.ts = p.ts AND g.outcome = p.outcome JOIN deep d ON g.graph_id = d.graph_id AND g.ts = d.ts AND g.outcome = d.outcome),
amp AS (SELECT *, {_LEVEL} AS level FROM amp0),
amplified AS (SELECT *, confidence >= 0.5 AND level <> 'none' AS reliable, least(abs(score) / 10, 1) AS strength FROM amp)"""
_TO_AMPLIFIED = f"WITH {_AMPLIFIED}"


def amplified(flows, chain):
    modifier = 0.4 + 0.1 * (F.length("outcome") % 5)
    return G.amplification(stored(flows.withColumn("modifier", modifier), "flows"), stored(chain, "edges"), modifier="modifier")


@query("g2_pair_flows", "nation_shares", keep="graph_id ts outcome direction significance", doubles="flow velocity", sql="""
    WITH steps AS (SELECT graph_id, ts, lead(ts) OVER (PARTITION BY graph_id ORDER BY ts) AS nxt FROM (SELECT DISTINCT graph_id, ts FROM nation_shares) d),
    a AS (SELECT s.*, k.nxt FROM nation_shares s JOIN steps k ON s.graph_id = k.graph_id AND s.ts = k.ts WHERE k.nxt IS NOT NULL),
    b AS (SELECT s.graph_id, k.ts, k.nxt, s.outcome, s.p FROM nation_shares s JOIN steps k ON s.graph_id = k.graph_id AND s.ts = k.nxt),
    j AS (SELECT coalesce(a.graph_id, b.graph_id) AS graph_id, coalesce(a.ts, b.ts) AS ts, coalesce(a.nxt, b.nxt) AS nxt, coalesce(a.outcome, b.outcome) AS outcome, (coalesce(b.p, a.p, 0) - coalesce(a.p, 0)) * 100 AS flow
        FROM a FULL JOIN b ON a.graph_id = b.graph_id AND a.ts = b.ts AND a.outcome = b.outcome)
SELECT graph_id, ts, outcome, flow, flow / (date_diff('day', ts, nxt) * 24.0e0) AS velocity, CASE WHEN abs(flow) < 0.5 THEN 'stable' WHEN flow > 0 THEN 'upward' ELSE 'downward' END AS direction,
        CASE WHEN abs(flow) < 2 THEN 'low' WHEN abs(flow) < 5 THEN 'medium' ELSE 'high' END AS significance FROM j""", digits=9)
def g2(shares):
    """Every snapshot of a graph against the next one."""
    steps = shares.select("graph_id", "ts").distinct().withColumn("nxt", F.lead("ts").over(Window.partitionBy("graph_id").orderBy("ts"))).filter("nxt is not null")
    steps = steps.withColumn("hours", F.datediff("nxt", "ts") * 24.0)
    first = shares.join(steps.select("graph_id", "ts", "hours"), ["graph_id", "ts"])
    last = shares.withColumnRenamed("ts", "nxt").join(steps, ["graph_id", "nxt"])
    return G.pair_flows(first, last, ["graph_id", "ts", "outcome", "hours"], F.col("hours"))


@query("j11_outcome_alignment", "shares", keep="subject ts outcome", doubles="p0 p1", sql="""
    WITH steps AS (SELECT subject, ts, lead(ts) OVER (PARTITION BY subject ORDER BY ts) AS nxt FROM (SELECT DISTINCT subject, ts FROM shares) d),
    a AS (SELECT s.* FROM shares s JOIN steps k ON s.subject = k.subject AND s.ts = k.ts WHERE k.nxt IS NOT NULL AND s.outcome <> 'PROMO'),
    b AS (SELECT s.subject, k.ts, s.outcome, s.p FROM shares s JOIN steps k ON s.subject = k.subject AND s.ts = k.nxt WHERE s.outcome <> 'SMALL')
SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.ts, b.ts) AS ts, coalesce(a.outcome, b.outcome) AS outcome, coalesce(a.p, 0) AS p0, coalesce(b.p, a.p, 0) AS p1
    FROM a FULL JOIN b ON a.subject = b.subject AND a.ts = b.ts AND a.outcome = b.outcome""")
def j11(shares):
    """Every quarter against the next, where the earlier lacks one outcome and the later another."""
    steps = shares.select("subject", "ts").distinct().withColumn("nxt", F.lead("ts").over(Window.partitionBy("subject").orderBy("ts"))).filter("nxt is not null")
    first = shares.filter("outcome <> 'PROMO'").join(steps.select("subject", "ts"), ["subject", "ts"])
    last = shares.filter("outcome <> 'SMALL'").withColumnRenamed("ts", "nxt").join(steps, ["subject", "nxt"])
    return G.pair_flows(first, last, ["subject", "ts", "outcome"], F.lit(1.0))


@query("g6_propagation_depth", "flows chain nation", keep="graph_id ts outcome depth", sql=f"{_TO_AMPLIFIED}\nSELECT * FROM deep")
def g6(flows, chain, nation):
    """Over chains, so that signals pass up to three nodes, end at the other sign and at nodes without a flow."""
    return G.propagation(stored(flows, "flows"), stored(chain, "edges"))


@query("g7_amplification", "flows chain nation", keep="graph_id ts outcome level depth", doubles="score confidence", digits=5, sql=f"{_TO_AMPLIFIED}\nSELECT * FROM amplified")
def g7(flows, chain, nation):
    return amplified(flows, chain)


@query("f16_report_flags", "flows chain nation", keep="graph_id ts outcome reliable", doubles="strength", digits=5, sql=f"{_TO_AMPLIFIED}\nSELECT * FROM amplified")
def f16(flows, chain, nation):
    return amplified(flows, chain)


@query("a31_flow_summary", "flows", keep="graph_id ts outcomes ups downs stables hours significant", doubles="momentum", sql="""
    WITH f AS (SELECT *, date_diff('day', prev, ts) * 24 AS hours FROM (SELECT *, date_trunc('year', ts - INTERVAL 1 DAY) AS prev FROM flows) q)
SELECT graph_id, ts, count(*) AS outcomes, count(*) FILTER (direction = 'upward') AS ups, count(*) FILTER (direction = 'downward') AS downs, count(*) FILTER (direction = 'stable') AS stables,
    CAST(max(hours) AS INT) AS hours, avg(flow) AS momentum, coalesce(string_agg(CASE WHEN abs(flow) >= 2 THEN outcome || ':' || CASE WHEN abs(flow) < 5 THEN 'medium' ELSE 'high' END END, ',' ORDER BY outcome), '') AS significant FROM f GROUP BY graph_id, ts""")
def a31(flows):
    before = F.date_trunc("year", F.date_sub("ts", 1))
    return G.flow_summary(flows.withColumn("hours", (F.datediff("ts", before) * 24).cast("int")))


@query("a32_amplification_summary", "flows chain nation", keep="graph_id ts outcomes strong reliable cascading top", doubles="momentum cascade_risk", digits=5, sql=f"""{_TO_AMPLIFIED},
placed AS (SELECT *, CASE WHEN level IN ('high', 'very_high', 'exceptional') THEN row_number() OVER (PARTITION BY graph_id, ts, level IN ('high', 'very_high', 'exceptional') ORDER BY score DESC, outcome) END AS place FROM amplified)
SELECT graph_id, ts, count(*) AS outcomes, avg(score) AS momentum, count(place) AS strong, count(*) FILTER (reliable) AS reliable, count(*) FILTER (place IS NOT NULL AND depth > 1) AS cascading,
    least(coalesce(0.2e0 * count(*) FILTER (score > 5 AND consistency < 0.5) / nullif(count(*) FILTER (score > 5), 0), 0), 1) AS cascade_risk,
    coalesce(string_agg(CASE WHEN place <= 5 THEN outcome || ':' || level END, ',' ORDER BY place), '') AS top FROM placed GROUP BY graph_id, ts""")
def a32(flows, chain, nation):
    return G.amplification_summary(amplified(flows, chain))


_LEGACY = f"""norm AS (SELECT graph_id, ts, outcome, p / sum(p) OVER (PARTITION BY graph_id, ts) AS p FROM nation_shares),
times AS (SELECT graph_id, ts, lead(ts) OVER (PARTITION BY graph_id ORDER BY ts) AS nxt FROM (SELECT DISTINCT graph_id, ts FROM norm) d),
l0 AS (SELECT a.graph_id, a.ts, a.outcome, coalesce(b.p, a.p) AS p, (coalesce(b.p, a.p) - a.p) * 100 AS flow FROM norm a JOIN times t ON a.graph_id = t.graph_id AND a.ts = t.ts AND t.nxt IS NOT NULL
    LEFT JOIN norm b ON b.graph_id = a.graph_id AND b.ts = t.nxt AND b.outcome = a.outcome),
l1 AS (SELECT *, CASE WHEN flow > 1 THEN 'positive' WHEN flow < -1 THEN 'negative' ELSE 'neutral' END AS direction, CASE WHEN abs(flow) >= 5 THEN 'high' WHEN abs(flow) >= 2 THEN 'medium' ELSE 'low' END AS significance FROM l0),
ln AS (SELECT f.graph_id, f.ts, f.outcome, avg(CASE WHEN g.direction = 'positive' THEN 1.0e0 ELSE 0.0e0 END) AS consistency, max(g.p) AS hi, min(g.p) AS lo FROM l1 f JOIN ({_BOTH}) e ON f.graph_id = e.graph_id AND f.outcome = e.src
    LEFT JOIN l1 g ON g.graph_id = f.graph_id AND g.ts = f.ts AND g.outcome = e.dst GROUP BY f.graph_id, f.ts, f.outcome),
l2 AS (SELECT l1.*, {_MODIFIER.replace('outcome', 'l1.outcome')} AS modifier, CASE WHEN abs(flow) >= 2 AND direction = 'positive' THEN flow * coalesce(consistency, 0) * (1 + CASE WHEN hi IS NULL THEN 0 WHEN hi = lo THEN 0.5e0 ELSE (hi - p) / (hi - lo) END) ELSE 0.0e0 END AS raw
    FROM l1 LEFT JOIN ln ON l1.graph_id = ln.graph_id AND l1.ts = ln.ts AND l1.outcome = ln.outcome)"""


@query("g8_legacy_amplification", "nation_shares chain", keep="graph_id ts outcome direction significance level", doubles="flow score confidence", digits=5, sql=f"""WITH {_LEGACY}
SELECT *, modifier AS confidence, CASE WHEN abs(flow) < 2 THEN 0 ELSE raw * modifier END AS score, CASE WHEN raw < 1 THEN 'none' WHEN raw < 3 THEN 'low' WHEN raw < 5 THEN 'medium' WHEN raw < 10 THEN 'high' ELSE 'very_high' END AS level FROM l2""")
def g8(shares, chain):
    steps = shares.select("graph_id", "ts").distinct().withColumn("nxt", F.lead("ts").over(Window.partitionBy("graph_id").orderBy("ts"))).filter("nxt is not null")
    last = shares.withColumnRenamed("ts", "nxt").join(steps, ["graph_id", "nxt"])
    first = shares.join(steps.select("graph_id", "ts"), ["graph_id", "ts"])
    flows = G.legacy_flows(first, last, ["graph_id", "ts"]).withColumn("modifier", 0.4 + 0.1 * (F.length("outcome") % 5))
    return G.legacy_amplification(flows, chain, modifier="modifier")


_BUNDLED = f"""{_TO_AMPLIFIED},
chosen AS (SELECT *, row_number() OVER (PARTITION BY graph_id, ts ORDER BY score DESC, outcome) AS place FROM amplified WHERE level <> 'none' AND confidence >= 0.5)"""


@query("k7_reliable_bundles", "flows chain nation", keep="graph_id ts outcome place risk", doubles="score stake allocated free", digits=5, sql=f"""{_BUNDLED}
SELECT *, 'conservative' AS risk, 10.0e0 AS stake, 10.0e0 * count(*) OVER (PARTITION BY graph_id, ts) AS allocated, 1000 - 10.0e0 * count(*) OVER (PARTITION BY graph_id, ts) AS free FROM chosen WHERE place <= 3""")
def k7(flows, chain, nation):
    return N.generate_bundles(amplified(flows, chain), ["graph_id", "ts"], 1000.0, 3)


@query("a33_concentration", "legs", keep="subject ts within_limit", doubles="diversification largest allocated free expected_total", sql=f"""
    SELECT subject, ts, 1 - sum(fraction * fraction) AS diversification, max(fraction) AS largest, sum(fraction * 1000) AS allocated, 1000 - sum(fraction * 1000) AS free,
        sum(value * fraction * 1000) AS expected_total, bool_and(fraction <= 0.2) AS within_limit FROM ({_ALLOCATED}) a GROUP BY subject, ts""", digits=5)
def a33(legs):
    return A.concentration(A.allocate(legs, ["subject", "ts"], 1000.0), ["subject", "ts"], 1000.0)


@query("f5_eligibility", "quotes", keep="subject ts outcome reason", sql="""
    SELECT subject, ts, outcome, CASE WHEN outcome = 'PROMO' THEN 'falling' WHEN p * (value * 1.1e0 - 1) - (1 - p) <= 0 THEN 'no expected gain' WHEN p < 0.05 THEN 'improbable'
        WHEN value * 1.1e0 < 1.1 THEN 'low multiplier' ELSE 'eligible' END AS reason FROM (SELECT *, 1 / value AS p FROM quotes) q""")
def f5(quotes):
    direction = F.when(F.col("outcome") == "PROMO", "downward").otherwise("stable")
    return quotes.withColumn("reason", A.eligibility(1 / F.col("value"), F.col("value") * 1.1, direction))


_BUNDLES = """SELECT o_orderkey, count(*) AS legs, product(l_quantity / 20 + 0.5e0) AS odds, count(DISTINCT l_suppkey || l_returnflag) AS places, min(l_discount) AS weakest, bool_or(l_returnflag = 'R') AS deep,
    max(o_orderkey % 120) AS multiplier, max(o_custkey % 20) AS stake FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o_orderkey"""


@query("a35_p19_bundle_rules", "orders lineitem", keep="o_orderkey legs risk errors", sql=f"""
    SELECT o_orderkey, legs, CASE WHEN odds < 5 THEN 'conservative' WHEN odds < 20 THEN 'balanced' WHEN odds < 100 THEN 'aggressive' ELSE 'extreme' END AS risk,
        concat_ws(',', CASE WHEN weakest <= 0 THEN 'flow' END, CASE WHEN odds < 3 THEN 'odds' END, CASE WHEN places < legs THEN 'same_match' END, CASE WHEN legs > CASE WHEN deep THEN 4 ELSE 8 END THEN 'depth' END,
        CASE WHEN multiplier > 99 THEN 'multiplier' END, CASE WHEN stake < 2 THEN 'stake' END) AS errors FROM ({_BUNDLES}) b""")
def a35(orders, lineitem):
    """Orders stand for bundles, their lines for legs, suppliers for matches and return flags for markets."""
    n = tasks_for(lineitem)
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 120).alias("multiplier"), (F.col("o_custkey") % 20).alias("stake")).repartition(n, "l_orderkey")
    legs = lineitem.select("l_orderkey", "l_quantity", "l_suppkey", "l_returnflag", "l_discount").repartition(n, "l_orderkey").join(o, "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")
    return N.check_bundles(legs.withColumns({"odds": F.col("l_quantity") / 20 + 0.5, "match": F.col("l_suppkey"), "market": F.col("l_returnflag"), "flow": F.col("l_discount")}), "o_orderkey", ["R"])


@query("a3_signal_ingestion", "quotes shares", keep="subject ts outcome", doubles="posterior", sql="""
    WITH raw AS (SELECT s.subject, s.ts, s.outcome, s.p AS prior, CASE WHEN s.outcome < 'MEDIUM' THEN q.value END AS odds,
            CASE WHEN s.outcome = 'SMALL' AND extract(year FROM s.ts) = 1997 THEN 1.0e0 WHEN s.outcome > 'PROMO' THEN s.p * 1.5e0 END AS direct
        FROM shares s LEFT JOIN quotes q ON s.subject = q.subject AND s.ts = q.ts AND s.outcome = q.outcome),
    full_ AS (SELECT *, CASE WHEN odds IS NULL AND direct IS NOT NULL AND count(odds) OVER (PARTITION BY subject, ts) > 0 THEN 1 / greatest(direct, 0.01e0) ELSE odds END AS o FROM raw),
    k AS (SELECT *, count(o) OVER w >= 2 AS market, count(o) OVER w >= 2 AND min(o) OVER w <= 1 AS broken, sum(1 / o) OVER w AS implied FROM full_ WINDOW w AS (PARTITION BY subject, ts)),
    d AS (SELECT *, CASE WHEN broken AND o > 1 THEN 1 / o WHEN broken AND o <= 1 THEN 0.5e0 ELSE direct END AS dd FROM k),
    m AS (SELECT *, coalesce(dd / CASE WHEN sum(dd) OVER (PARTITION BY subject, ts) > 1.05 THEN sum(dd) OVER (PARTITION BY subject, ts) ELSE 1 END, CASE WHEN market AND NOT broken THEN 1 / o / implied END, prior) AS merged FROM d)
SELECT subject, ts, outcome, merged / sum(merged) OVER (PARTITION BY subject, ts) AS posterior FROM m""")
def a3(quotes, shares):
    df = shares.withColumnRenamed("p", "prior").join(quotes.select("subject", "ts", "outcome", "value"), ["subject", "ts", "outcome"], "left")
    direct = F.when((F.col("outcome") == "SMALL") & (F.year("ts") == 1997), 1.0).when(F.col("outcome") > "PROMO", F.col("prior") * 1.5)
    return N.ingest_signals(df.withColumns({"odds": F.when(F.col("outcome") < "MEDIUM", F.col("value")), "direct": direct}), ["subject", "ts"])


_GRADES = "CASE grade WHEN 'A' THEN 1.0e0 WHEN 'B' THEN 0.8e0 WHEN 'C' THEN 0.6e0 WHEN 'D' THEN 0.4e0 WHEN 'E' THEN 0.2e0 ELSE 0.5e0 END"


def _assessed(name: str, source: str, age: str) -> str:
    """Tables ``name`` (and helpers) with the assessment of each subject of ``source``."""
    return f"""{name}_w0 AS (SELECT *, {_GRADES} * confidence * pow(2.0e0, -greatest({age} * 24.0e0, 0) / 720.0e0) AS raw FROM {source}),
{name}_w AS (SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY subject) <= 0 THEN 1.0e0 / count(*) OVER (PARTITION BY subject) ELSE raw / sum(raw) OVER (PARTITION BY subject) END AS weight FROM {name}_w0),
{name}_m AS (SELECT *, sum(weight * p) OVER (PARTITION BY subject) AS mean FROM {name}_w),
{name}_s AS (SELECT *, sqrt(sum(weight * (p - mean) * (p - mean)) OVER (PARTITION BY subject)) AS sd, count(*) OVER (PARTITION BY subject) AS n FROM {name}_m),
{name}_a AS (SELECT subject, count(*) AS sources, sum(weight * p) AS linear, 1 / (1 + exp(-sum(weight * {_LOGIT.format('p')}))) AS pooled, 1 - least(max(sd) / 0.5e0, 1) AS consensus, avg(raw) AS effective,
    avg({_GRADES}) AS reliability, count(*) FILTER (n >= 3 AND sd >= 1e-6 AND abs(p - mean) / sd > 2) AS anomalous FROM {name}_s GROUP BY subject),
{name}_b AS (SELECT *, (linear + 2 * pooled) / 3 AS aggregate, least(greatest(0.35e0 * consensus + 0.25e0 * least(sources / 5.0e0, 1) + 0.2e0 * least(effective, 1) + 0.2e0 * reliability - 0.05e0 * anomalous, 0), 1) AS confidence FROM {name}_a),
{name} AS (SELECT *, (aggregate - 0.5e0) * 100 AS momentum, consensus > 0.7 AS agreed, CASE WHEN anomalous > 0 THEN 'anomalous' WHEN consensus >= 0.7 THEN 'stable' WHEN consensus <= 0.3 THEN 'unstable'
    WHEN abs((aggregate - 0.5e0) * 100) > 2 THEN 'emerging' ELSE 'ambiguous' END AS stability FROM {name}_b)"""


_AGE = f"date_diff('day', ts, DATE '{AS_OF}')"


@query("a14_situation", "evidence part", keep="subject sources anomalous stability agreed", doubles="aggregate consensus confidence momentum", sql=f"""WITH {_assessed('one', 'evidence', _AGE)}
SELECT u.subject, coalesce(sources, 0) AS sources, coalesce(anomalous, 0) AS anomalous, coalesce(stability, 'ambiguous') AS stability, coalesce(agreed, FALSE) AS agreed, coalesce(aggregate, 0.5e0) AS aggregate,
    coalesce(consensus, 0) AS consensus, coalesce(confidence, 0) AS confidence, coalesce(momentum, 0) AS momentum FROM (SELECT DISTINCT p_brand AS subject FROM part UNION SELECT 'Brand#0') u LEFT JOIN one ON u.subject = one.subject""")
def a14(evidence, part):
    """All brands and one that no source speaks of."""
    subjects = part.select(F.col("p_brand").alias("subject")).union(part.sparkSession.sql("select 'Brand#0'"))
    return N.assess(evidence, AS_OF, subjects, half_life_hours=LIFE)


@query("a15_cross_validation", "evidence", keep="subject sources", doubles="p_a p_b combined delta agreement meta_confidence", sql=f"""
    WITH ea AS (SELECT * FROM evidence WHERE source % 2 = 0), eb AS (SELECT * FROM evidence WHERE source % 2 = 1),
{_assessed('a', 'ea', _AGE)},
{_assessed('b', 'eb', _AGE)},
{_assessed('c', 'evidence', _AGE)}
SELECT c.subject, c.sources, a.aggregate AS p_a, b.aggregate AS p_b, c.aggregate AS combined, coalesce(abs(a.aggregate - b.aggregate), 0) AS delta, coalesce(greatest(0, 1 - 2 * abs(a.aggregate - b.aggregate)), 0) * CAST(a.aggregate IS NOT NULL AND b.aggregate IS NOT NULL AS INT) AS agreement,
    CASE WHEN a.aggregate IS NULL OR b.aggregate IS NULL THEN 0 ELSE greatest(0, 1 - 2 * abs(a.aggregate - b.aggregate)) * 0.5e0 + c.consensus * 0.3e0 + least(c.sources / 8.0e0, 1) * 0.2e0 END AS meta_confidence
    FROM c LEFT JOIN a ON a.subject = c.subject LEFT JOIN b ON b.subject = c.subject""")
def a15(evidence):
    return N.cross_validate(evidence, F.col("source") % 2 == 0, AS_OF, half_life_hours=LIFE)


@query("p18_stability", "evidence", keep="subject anomalous stability grade", doubles="consensus", sql=f"""WITH {_assessed('one', 'evidence', _AGE)}
SELECT subject, consensus, anomalous, stability, CASE WHEN effective >= 0.9 THEN 'A' WHEN effective >= 0.7 THEN 'B' WHEN effective >= 0.5 THEN 'C' WHEN effective >= 0.3 THEN 'D' ELSE 'E' END AS grade FROM one""")
def p18(evidence):
    return N.assess(evidence, AS_OF, half_life_hours=LIFE).withColumn("grade", P.reliability_grade(F.col("effective")))


_SHIFT = "{w} * ({a} - {b})"
_UPDATE = f"""pr AS (SELECT subject, ts, outcome, p, p / sum(p) OVER (PARTITION BY subject, ts) AS share FROM {{prior}}),
mv AS (SELECT a.subject, a.ts, a.outcome, a.p, {_LOGIT.format('a.p')} + coalesce(sum(CASE WHEN e.weight IS NULL THEN 0 WHEN e.outcome IS NULL THEN a.share WHEN e.outcome = a.outcome THEN 1 ELSE 0 END
    * coalesce(e.weight, 0) * ({_LOGIT.format('coalesce(e.p, 0.5e0)')} - {_LOGIT.format('a.p')})), 0) AS lo, count(e.weight) > 0 AS informed FROM pr a LEFT JOIN {{said}} e ON a.subject = e.subject AND a.ts = e.ts GROUP BY a.subject, a.ts, a.outcome, a.p, a.share),
po AS (SELECT *, exp(lo) / sum(exp(lo)) OVER (PARTITION BY subject, ts) AS posterior FROM mv)"""
_SAID = f"""sg AS (SELECT {{key}} AS subject, subject AS s0, ts AS t0, source, outcome, p, confidence, seen, CASE source_type WHEN 'market' THEN 'A' WHEN 'model' THEN 'B' WHEN 'sensor' THEN 'B' ELSE 'C' END AS grade FROM slot_evidence),
{_assessed('rep', 'sg', "date_diff('day', seen, t0 + INTERVAL 90 DAY)")},
said AS (SELECT s0 AS subject, t0 AS ts, outcome, weight, p FROM rep_w)"""
_KEYED = _SAID.format(key="subject || '|' || CAST(ts AS VARCHAR)")


@query("g10_evidence_update", "shares slot_evidence", keep="subject ts outcome", doubles="posterior", sql=f"WITH {_KEYED},\n{_UPDATE.format(prior='shares', said='said')}\nSELECT * FROM po")
def g10(shares, slot_evidence):
    """Evidence of six desks on every region and quarter; a third of it speaks of no outcome."""
    domain = D.GenericDomain(shares, ["subject", "ts"])
    said = P.source_weights(D.graded(domain, slot_evidence), F.date_add("subject.ts", 90), LIFE).select("subject", "outcome", "weight", "p")
    prior = shares.select(F.struct("subject", "ts").alias("subject"), "outcome", "p")
    return N.evidence_update(prior, said).select("subject.subject", "subject.ts", "outcome", "posterior")


# The whole analysis: the prior is uniform, PROMO has a direct probability, the others odds; two regions have no evidence.
def question(shares, quotes, slot_evidence):
    signals = quotes.select("subject", "ts", "outcome", F.when(F.col("outcome") == "PROMO", 1 / F.col("value")).otherwise(F.col("value")).alias("value"), F.when(F.col("outcome") == "PROMO", "probability").otherwise("decimal_odds").alias("signal_type"))
    return D.GenericDomain(shares, ["subject", "ts"], quotes=signals, sources=slot_evidence.filter("subject not in ('AFRICA', 'ASIA')"))


_QUESTION = f"""prior0 AS (SELECT subject, ts, outcome, 1.0e0 / count(*) OVER (PARTITION BY subject, ts) AS prior FROM shares),
sig0 AS (SELECT a.*, CASE WHEN a.outcome <> 'PROMO' AND q.value > 1 THEN q.value END AS odds, CASE WHEN a.outcome = 'PROMO' THEN least(greatest(1 / q.value, 0), 1) WHEN q.value <= 1 THEN 0.0e0 END AS direct
    FROM prior0 a LEFT JOIN quotes q ON a.subject = q.subject AND a.ts = q.ts AND a.outcome = q.outcome),
sig1 AS (SELECT *, CASE WHEN odds IS NULL AND direct IS NOT NULL AND count(odds) OVER (PARTITION BY subject, ts) > 0 THEN 1 / greatest(direct, 0.01e0) ELSE odds END AS o FROM sig0),
sig2 AS (SELECT *, coalesce(direct, CASE WHEN count(o) OVER w >= 2 THEN 1 / o / sum(1 / o) OVER w END, prior) AS merged FROM sig1 WINDOW w AS (PARTITION BY subject, ts)),
p1 AS (SELECT subject, ts, outcome, merged / sum(merged) OVER (PARTITION BY subject, ts) AS p FROM sig2)"""
_ANALYSIS = f"""WITH {_QUESTION},
slot AS (SELECT * FROM slot_evidence WHERE subject NOT IN ('AFRICA', 'ASIA')),
{_KEYED.replace('FROM slot_evidence', 'FROM slot')},
{_UPDATE.format(prior='p1', said='said')},
fl AS (SELECT subject, ts, outcome, p AS p_signals, informed, CASE WHEN informed THEN posterior ELSE p END AS p, CASE WHEN informed THEN (posterior - p) * 100 END AS flow FROM po),
fd AS (SELECT *, CASE WHEN informed THEN CASE WHEN abs(flow) < 0.5 THEN 'stable' WHEN flow > 0 THEN 'upward' ELSE 'downward' END END AS direction FROM fl),
fn AS (SELECT *, {', '.join(f'lead({c}) OVER w AS n_{c}, lag({c}) OVER w AS b_{c}' for c in ('p', 'flow', 'direction'))}, {', '.join(f'lead(flow, {i}) OVER w AS n{i}, lag(flow, {i}) OVER w AS b{i}' for i in (1, 2, 3))},
    CASE WHEN max(p) OVER d = min(p) OVER d THEN 0.5e0 ELSE (max(p) OVER d - p) / (max(p) OVER d - min(p) OVER d) END AS gradient FROM fd WINDOW w AS (PARTITION BY subject, ts ORDER BY outcome), d AS (PARTITION BY subject, ts, direction)),
fc AS (SELECT *, (coalesce(CASE WHEN n_direction = direction AND direction <> 'stable' THEN 1.0e0 WHEN n_direction = 'stable' THEN 0.5e0 END, 0) + coalesce(CASE WHEN b_direction = direction AND direction <> 'stable' THEN 1.0e0 WHEN b_direction = 'stable' THEN 0.5e0 END, 0))
        / nullif(CAST(n_p IS NOT NULL AS INT) + CAST(b_p IS NOT NULL AS INT), 0) AS consistency,
    (coalesce(CASE WHEN (n_flow >= 0) = (flow >= 0) THEN 1 ELSE -1 END * abs(n_flow) * greatest(n_p, 0.01e0), 0) + coalesce(CASE WHEN (b_flow >= 0) = (flow >= 0) THEN 1 ELSE -1 END * abs(b_flow) * greatest(b_p, 0.01e0), 0))
        / nullif(coalesce(greatest(n_p, 0.01e0) * CAST(n_p IS NOT NULL AS INT), 0) + coalesce(greatest(b_p, 0.01e0) * CAST(b_p IS NOT NULL AS INT), 0), 0) AS pull FROM fn),
fs AS (SELECT *, CASE WHEN NOT informed THEN NULL WHEN abs(flow) < 1 THEN 0.0e0 WHEN direction = 'upward' THEN flow * (0.5e0 + 0.5e0 * consistency) * (1 + gradient) * {_STEPS} ELSE flow * 0.3e0 * consistency END AS score,
    CASE WHEN NOT informed THEN NULL WHEN abs(flow) < 1 OR abs(flow) * 0.7e0 < 1 OR NOT {_same(1)} THEN 0 WHEN abs(flow) * 0.343e0 < 1 OR NOT {_same(2)} THEN 1 WHEN abs(flow) * 0.117649e0 < 1 OR NOT {_same(3)} THEN 2 ELSE 3 END AS depth FROM fc),
lg AS (SELECT f.subject, f.ts, f.outcome, f.p, coalesce(q.value, 2) AS multiplier, 0.7e0 AS confidence FROM fs f LEFT JOIN quotes q ON f.subject = q.subject AND f.ts = q.ts AND f.outcome = q.outcome WHERE NOT (informed AND f.p < p_signals)),
al AS ({_ALLOCATED.replace('FROM legs', 'FROM lg')}),
done AS (SELECT f.*, CASE WHEN score IS NOT NULL THEN {_LEVEL} END AS level, coalesce(a.fraction, 0) AS fraction, coalesce(a.fraction, 0) * 1000 AS amount, 1 - f.p <= 0.8e0 + 1e-12 AS in_set, first_value(f.outcome) OVER (PARTITION BY f.subject, f.ts ORDER BY f.p DESC, f.outcome) AS likeliest,
    r.consensus, r.stability, r.confidence FROM fs f LEFT JOIN al a ON f.subject = a.subject AND f.ts = a.ts AND f.outcome = a.outcome LEFT JOIN rep r ON r.subject = f.subject || '|' || CAST(f.ts AS VARCHAR))"""


@query("g18_analysis", "shares quotes slot_evidence", keep="subject ts outcome informed direction level depth in_set likeliest stability", doubles="p_signals p flow score fraction amount consensus confidence", digits=5, sql=f"{_ANALYSIS}\nSELECT * FROM done")
def g18(shares, quotes, slot_evidence):
    multipliers = quotes.select("subject", "ts", "outcome", F.col("value").alias("multiplier"))
    return D.analyze(question(shares, quotes, slot_evidence), F.date_add("ts", 90), 1000.0, multipliers, threshold=0.8, half_life_hours=LIFE)


@query("e1_domain_tables", "shares quotes slot_evidence", keep="subject ts outcome next_outcome", doubles="prior p", sql=f"""WITH {_QUESTION}
SELECT a.subject, a.ts, a.outcome, coalesce(lead(a.outcome) OVER (PARTITION BY a.subject, a.ts ORDER BY a.outcome), '-') AS next_outcome, a.prior, b.p FROM prior0 a JOIN p1 b ON a.subject = b.subject AND a.ts = b.ts AND a.outcome = b.outcome""")
def e1(shares, quotes, slot_evidence):
    """What a domain gives: outcomes, uniform prior, chain of outcomes, and probabilities after its signals."""
    domain = question(shares, quotes, slot_evidence)
    edges = domain.edges().select("subject", "ts", F.col("src").alias("outcome"), "dst")
    df = domain.prior().join(D.after_signals(domain), ["subject", "ts", "outcome"]).join(edges, ["subject", "ts", "outcome"], "left")
    return df.withColumn("next_outcome", F.coalesce("dst", F.lit("-")))


_PLANNED = """cached AS (SELECT * FROM panel WHERE dt < DATE '2000-01-01' AND entity < 'Brand#20'),
plan AS (SELECT u.entity, coalesce(greatest(CAST(l.latest - INTERVAL 60 DAY AS DATE), DATE '1995-01-01'), DATE '1995-01-01') AS a FROM (SELECT DISTINCT entity FROM panel) u LEFT JOIN (SELECT entity, max(dt) AS latest FROM cached GROUP BY entity) l ON u.entity = l.entity)"""


_LOADED = f"""WITH {_PLANNED}
SELECT p.entity, p.dt, CASE WHEN c.entity IS NULL OR p.dt >= plan.a THEN p.close + 1 ELSE c.close END AS close FROM panel p JOIN plan ON p.entity = plan.entity LEFT JOIN cached c ON c.entity = p.entity AND c.dt = p.dt
    WHERE p.dt <= DATE '2001-06-01' AND (p.dt >= plan.a OR c.entity IS NOT NULL)"""


@query("e2_pluggable_loader", "panel", keep="entity dt", doubles="close", sql=_LOADED)
def e2(panel):
    """A loader is a function from planned ranges to rows; here it reads the panel itself, marked by a higher close."""
    from probspark.operators.history import plan_loads

    cached = panel.filter("dt < date '2000-01-01' and entity < 'Brand#20'")
    plan = plan_loads(cached, panel.select("entity"), "entity", "dt", "1995-01-01", "2001-06-01", 60)
    loader = lambda wanted: panel.join(wanted.select("entity"), "entity", "left_semi").withColumn("close", F.col("close") + 1)
    return D.load_ranges(cached, plan, loader, "entity", "dt")


@query("e2_range_source", "panel", keep="entity dt", doubles="close", sql=_LOADED)
def e2b(panel):
    """The same load through the data source: a task for each range of entities asks the provider's files for the missing dates only."""
    from probspark.operators.history import merge_last, plan_loads
    from probspark.sources.ranges import load_planned

    provider = fresh_path(panel.sparkSession, "provider")
    panel.withColumn("close", F.col("close") + 1).repartitionByRange(4, "entity").sortWithinPartitions("entity", "dt").write.parquet(provider)
    cached = panel.filter("dt < date '2000-01-01' and entity < 'Brand#20'")
    plan = plan_loads(cached, panel.select("entity"), "entity", "dt", "1995-01-01", "2001-12-01", 60)
    loaded = load_planned(panel.sparkSession, plan, "entity string, dt date, close double", "entity", "dt", provider=provider).filter("dt <= date '2001-06-01'")
    return merge_last(cached.select("entity", "dt", "close"), loaded, ["entity", "dt"])
