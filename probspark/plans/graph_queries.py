"""Queries of flows over graphs, allocation and signal states."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions import expr as X
from probspark.operators import allocation as A
from probspark.operators import fusion as P
from probspark.operators import graph as G
from probspark.operators import windows as W
from probspark.plans.registry import query
from probspark.sources.stored import stored

_BOTH = "SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, dst AS src, src AS dst FROM edges"
_NEAR = f"""SELECT f.graph_id, f.ts, f.outcome, f.flow, f.direction, e.dst AS adj, g.p AS adj_p, g.flow AS adj_flow, g.direction AS adj_direction
    FROM flows f JOIN ({_BOTH}) e ON f.graph_id = e.graph_id AND f.outcome = e.src
    LEFT JOIN flows g ON g.graph_id = f.graph_id AND g.ts = f.ts AND g.outcome = e.dst"""
_PULL = f"""SELECT graph_id, ts, outcome, consistency, CASE WHEN pull IS NULL THEN 1.0e0 WHEN pull > 3 THEN 1.5e0 WHEN pull > 1 THEN 1.3e0 WHEN pull > 0 THEN 1.1e0
    WHEN pull > -1 THEN 0.9e0 WHEN pull > -3 THEN 0.8e0 ELSE 0.7e0 END AS momentum FROM (
    SELECT graph_id, ts, outcome, avg(CASE WHEN adj_direction IS NULL THEN 0.0e0 WHEN direction <> 'stable' AND adj_direction = direction THEN 1.0e0
        WHEN adj_direction = 'stable' THEN 0.5e0 ELSE 0.0e0 END) AS consistency,
        sum(CASE WHEN (flow >= 0) = (adj_flow >= 0) THEN 1 ELSE -1 END * abs(adj_flow) * greatest(adj_p, 0.01e0)) / sum(CASE WHEN adj_flow IS NOT NULL THEN greatest(adj_p, 0.01e0) END) AS pull
    FROM ({_NEAR}) n GROUP BY graph_id, ts, outcome) q"""
_GRADIENT = """SELECT graph_id, ts, outcome, p, flow, direction, CASE WHEN max(p) OVER w = min(p) OVER w THEN 0.5e0 ELSE (max(p) OVER w - p) / (max(p) OVER w - min(p) OVER w) END AS gradient
    FROM flows WINDOW w AS (PARTITION BY graph_id, ts, direction)"""


@query("g1_graph_edges", "nation", keep="graph_id src dst kind", sql="""
    SELECT n_regionkey AS graph_id, n_name AS src, nxt AS dst, 'chain' AS kind FROM (SELECT *, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS nxt FROM nation) q WHERE nxt IS NOT NULL
    UNION ALL SELECT a.n_regionkey, a.n_name, b.n_name, 'complete' FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name""")
def g1(nation):
    chain = G.chain_edges(nation, "n_regionkey", "n_name").withColumn("kind", F.lit("chain"))
    a, b = nation.select("n_regionkey", F.col("n_name").alias("src")), nation.select("n_regionkey", F.col("n_name").alias("dst"))
    complete = a.join(b, "n_regionkey").filter("src < dst").select(F.col("n_regionkey").alias("graph_id"), "src", "dst", F.lit("complete").alias("kind"))
    return chain.unionByName(complete)


@query("g3_g5_consistency_momentum", "flows edges", keep="graph_id ts outcome", doubles="consistency momentum", sql=_PULL)
def g3(flows, edges):
    return G.consistency_and_momentum(stored(flows, "flows"), stored(edges, "edges"))


@query("g4_gradient_position", "flows", keep="graph_id ts outcome", doubles="gradient", sql=_GRADIENT)
def g4(flows):
    return G.gradient_position(flows)


@query("j12_adjacency", "flows edges", keep="graph_id ts outcome adj", doubles="adj_flow", sql=_NEAR)
def j12(flows, edges):
    return G.neighbours(flows, edges)


_ALLOCATED = """SELECT *, held / greatest(sum(held) OVER (PARTITION BY subject, ts), 1) AS fraction FROM (
    SELECT *, least(raw / greatest(sum(raw) OVER (PARTITION BY subject, ts), 1), 0.2e0) AS held FROM (
        SELECT *, optimal * 0.25e0 * confidence AS raw, row_number() OVER (PARTITION BY subject, ts ORDER BY value DESC, outcome) AS place FROM (
            SELECT *, p * (multiplier - 1) - (1 - p) AS value, greatest(0, (p * (multiplier - 1) - (1 - p)) / (multiplier - 1)) AS optimal FROM legs WHERE multiplier > 1) v
        WHERE value > 0 AND p >= 0.05 AND multiplier >= 1.1) r WHERE place <= 10) h"""


@query("g16_allocation", "legs", keep="subject ts outcome", doubles="fraction amount expected risk", sql=f"""
    SELECT *, fraction * 1000 AS amount, value * fraction * 1000 AS expected, least(optimal * (1 - p) + (1 - confidence) * 0.5e0, 1) AS risk FROM ({_ALLOCATED}) a""")
def g16(legs):
    return A.allocate(legs, ["subject", "ts"], 1000.0)


@query("k6_top_allocations", "legs", keep="subject ts outcome place", doubles="fraction", sql=f"""
    SELECT * FROM (SELECT subject, ts, outcome, fraction, row_number() OVER (PARTITION BY subject, ts ORDER BY fraction DESC, outcome) AS place FROM ({_ALLOCATED}) a) q WHERE place <= 2""")
def k6(legs):
    return W.first_rank(A.allocate(legs, ["subject", "ts"], 1000.0), ["subject", "ts"], "fraction", ["outcome"], "place").filter("place <= 2")


@query("g17_rebalancing", "legs", keep="subject ts outcome", doubles="rebalanced", sql=f"""
    WITH a AS ({_ALLOCATED}), b AS (SELECT *, count(*) OVER w AS n, 1 - sum(fraction * fraction) OVER w AS diversity FROM a WINDOW w AS (PARTITION BY subject, ts)),
    c AS (SELECT *, greatest(fraction - 1.0e0 / n, 0) AS o, greatest(1.0e0 / n - fraction, 0) AS u FROM b),
    d AS (SELECT *, fraction - o / 2 + coalesce(sum(o) OVER w / 2 * u / nullif(sum(u) OVER w, 0), 0) AS s FROM c WINDOW w AS (PARTITION BY subject, ts))
SELECT *, CASE WHEN diversity >= 0.99 OR n <= 1 THEN fraction ELSE s / sum(s) OVER (PARTITION BY subject, ts) END AS rebalanced FROM d""")
def g17(legs):
    return A.rebalance(A.allocate(legs, ["subject", "ts"], 1000.0), ["subject", "ts"], 0.99)


_STATE_IN = """SELECT entity, dt, ret_5, ret_1, amount_ratio, position_in_bar AS probability, row_number() OVER (PARTITION BY dt ORDER BY position_in_bar DESC NULLS LAST, entity) AS rank,
    (position_in_bar - lag(position_in_bar) OVER (PARTITION BY entity ORDER BY dt)) * 100 AS flow FROM features"""


def _states(features):
    flow = (F.col("probability") - F.lag("probability").over(W.by(["entity"], ["dt"]))) * 100
    df = features.withColumnRenamed("position_in_bar", "probability")
    return W.first_rank(df, ["dt"], "probability", ["entity"]).withColumn("flow", flow)


@query("p6_p7_regime_flow_states", "features", keep="entity dt regime direction significance", sql=f"""
    SELECT entity, dt, CASE WHEN probability IS NULL THEN 'unknown' WHEN probability >= 0.62 THEN 'risk_on' WHEN probability >= 0.45 THEN 'mixed' ELSE 'risk_off' END AS regime,
        CASE WHEN flow IS NULL OR abs(flow) < 2 THEN 'stable' WHEN flow > 0 THEN 'upward' ELSE 'downward' END AS direction,
        CASE WHEN flow IS NULL OR abs(flow) < 2 THEN 'low' WHEN abs(flow) < 5 THEN 'medium' ELSE 'high' END AS significance FROM ({_STATE_IN}) s""")
def p6(features):
    flow = F.col("flow")
    return _states(features).withColumns({"regime": X.market_regime(F.col("probability")), "direction": X.flow_direction(flow, 2), "significance": X.flow_significance(flow, 2, 5)})


#: States of a group and of a member, by place, probability, its change and the mean of three changes; fixed values.
GROUP_STATES = ["strong_rising_theme", "rising_candidate", "cooling_theme", "neutral_or_wait"]
MEMBER_STATES = ["leader_candidate", "rising_candidate", "weak_or_cooling", "neutral_or_wait"]


def _ranked_state(names: list[str], first: int, second: int, low: float):
    """The first state within place ``first``, the second within ``second``, the third below ``low``."""
    rank, p, flow, momentum = (F.col(c) for c in ("rank", "probability", "flow_pp", "momentum_3"))
    state = F.when((rank <= first) & (p >= 0.65) & (momentum > 0), names[0]).when((rank <= second) & (p >= 0.55) & (flow > 0), names[1])
    return state.when((p < low) & (flow < 0), names[2]).otherwise(names[3])


def _ranked_state_sql(names: list[str], first: int, second: int, low: float) -> str:
    return f"""CASE WHEN rank <= {first} AND probability >= 0.65 AND momentum_3 > 0 THEN '{names[0]}' WHEN rank <= {second} AND probability >= 0.55 AND flow > 0 THEN '{names[1]}'
        WHEN probability < {low} AND flow < 0 THEN '{names[2]}' ELSE '{names[3]}' END"""


@query("p8_p10_signal_states", "features", keep="entity dt group_state member_state", sql=f"""
    SELECT entity, dt, {_ranked_state_sql(GROUP_STATES, 10, 20, 0.35)} AS group_state, {_ranked_state_sql(MEMBER_STATES, 3, 10, 0.40)} AS member_state
    FROM (SELECT *, CASE WHEN count(flow) OVER m = 3 THEN avg(flow) OVER m END AS momentum_3 FROM ({_STATE_IN}) s WINDOW m AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) t""")
def p8(features):
    df = W.probability_flow(_states(features).drop("flow"), ["entity"], "dt", "probability")
    return df.withColumns({"group_state": _ranked_state(GROUP_STATES, 10, 20, 0.35), "member_state": _ranked_state(MEMBER_STATES, 3, 10, 0.40)})


@query("p17_coalesced_columns", "features", keep="entity dt", doubles="first_known", sql="SELECT entity, dt, coalesce(amount_ratio, ret_5, ret_1) AS first_known FROM features")
def p17(features):
    return features.withColumn("first_known", F.coalesce("amount_ratio", "ret_5", "ret_1"))


@query("p20_name_filters", "part", keep="p_partkey p_name", sql="""
    SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]') AND contains(lower(p_name), 'a')""")
def p20(part):
    return part.filter(F.col("p_name").rlike("[aeiou]") & F.lower("p_name").contains("a"))


@query("a36_state_counts", "flows", keep="direction n", sql="SELECT direction, count(*) AS n FROM flows GROUP BY direction")
def a36(flows):
    return flows.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))

