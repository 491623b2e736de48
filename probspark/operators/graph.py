"""Probability flow over time and over a graph of outcomes.

``flows``: ``graph_id, ts, outcome, p, flow, direction``, one row per outcome of a snapshot; ``edges``: ``graph_id, src, dst`` in either direction.

A snapshot is one row with its outcomes as an array and its graph's neighbour lists as a map, so consistency, pull, gradient and
the spread of signals are array functions after one grouping.  Graphs or snapshots too large for a row (``ROW_EDGES``, ``ROW_OUTCOMES``)
are joined step by step instead; both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions.expr import flow_direction, flow_significance, ladder
from probspark.operators.fusion import amplification_level

SNAPSHOT = ["graph_id", "ts"]
#: Most edges of a graph, and outcomes of a snapshot, that are held in a row.
ROW_EDGES, ROW_OUTCOMES = 100_000, 10_000


def chain_edges(outcomes: DataFrame, graph: str, outcome: str) -> DataFrame:
    """Each outcome with the next one in order."""
    w = Window.partitionBy(graph).orderBy(outcome)
    return outcomes.select(F.col(graph).alias("graph_id"), F.col(outcome).alias("src"), F.lead(outcome).over(w).alias("dst")).filter("dst is not null")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", "src", "dst").union(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def pair_flows(first: DataFrame, last: DataFrame, key: list[str], hours: Column) -> DataFrame:
    """Change of each outcome between two snapshots: missing ones start at 0 and end where they began.

    ``hours`` lie between the two (0.001 at least).
    """
    a, b = first.select(*key, F.col("p").alias("p0")), last.select(*key, F.col("p").alias("p1"))
    df = a.join(b, key, "full_outer").withColumn("p0", F.coalesce("p0", F.lit(0.0)))
    df = df.withColumn("p1", F.coalesce("p1", "p0")).withColumn("flow", (F.col("p1") - F.col("p0")) * 100)
    return df.withColumns({"direction": flow_direction(F.col("flow"), 0.5), "significance": flow_significance(F.col("flow"), 2.0, 5.0), "velocity": F.col("flow") / F.greatest(hours, F.lit(0.001))})


def neighbours(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """Each flow with the outcomes next to it (``adj``) and their flow, where they have one."""
    near = both_ways(edges).select("graph_id", F.col("src").alias("outcome"), F.col("dst").alias("adj"))
    other = flows.select(*SNAPSHOT, F.col("outcome").alias("adj"), F.col("p").alias("adj_p"), F.col("flow").alias("adj_flow"), F.col("direction").alias("adj_direction"))
    return flows.join(near, ["graph_id", "outcome"]).join(other, [*SNAPSHOT, "adj"], "left")


def _multiplier(pull: Column) -> Column:
    """The multiplier of a weighted signed flow of neighbours; fixed values."""
    return F.when(pull.isNull(), 1.0).when(pull > 3, 1.5).when(pull > 1, 1.3).when(pull > 0, 1.1).when(pull > -1, 0.9).when(pull > -3, 0.8).otherwise(0.7)


def _same_way(own: Column, other: Column) -> Column:
    """How far a neighbour of direction ``other`` (null: it has no flow) moves the same way."""
    return F.when(other.isNull(), 0.0).when((own != "stable") & (other == own), 1.0).when(other == "stable", 0.5).otherwise(0.0)


def _signed(own_flow: Column, flow: Column, p: Column) -> Column:
    return F.when((own_flow >= 0) == (flow >= 0), 1.0).otherwise(-1.0) * F.abs(flow) * F.greatest(p, F.lit(0.01))


def fits_in_rows(flows: DataFrame, edges: DataFrame) -> bool:
    """Whether each graph's edges and each snapshot's outcomes fit in a row; counted, not assumed."""
    most = lambda df, key: (df.groupBy(*key).count().agg(F.max("count")).first()[0]) or 0
    return most(edges, ["graph_id"]) * 2 <= ROW_EDGES and most(flows, SNAPSHOT) <= ROW_OUTCOMES


def snapshots(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per snapshot: its flows (``o``), flows by outcome (``by``), and the neighbours of each outcome (``near``)."""
    lists = edges.select("graph_id", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    lists = lists.repartition("graph_id").groupBy("graph_id", "e.src").agg(F.collect_set("e.dst").alias("dst"))  # ROW_EDGES at most
    near = lists.filter("src is not null").groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "dst"))).alias("near"))
    others = [c for c in flows.columns if c not in SNAPSHOT]
    held = flows.groupBy(*SNAPSHOT).agg(F.collect_list(F.struct(*others)).alias("o"))  # ROW_OUTCOMES at most
    by = F.map_from_entries(F.transform(F.filter("o", lambda x: x["outcome"].isNotNull()), lambda x: F.struct(x["outcome"], x)))
    return held.join(near, "graph_id", "left").withColumn("by", by)


def _near(x: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("near"), x), F.array().cast("array<string>"))


def _agreement(x: Column) -> tuple[Column, Column]:
    """(consistency, multiplier) of the outcome ``x`` of a snapshot's row."""
    names = _near(x["outcome"])
    met = F.transform(names, lambda n: F.try_element_at(F.col("by"), n))
    flowing = F.filter(met, lambda m: m.isNotNull())
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    consistency = F.when(F.size(names) > 0, total(F.transform(met, lambda m: _same_way(x["direction"], m["direction"]))) / F.size(names)).otherwise(0.0)
    weight = total(F.transform(flowing, lambda m: F.greatest(m["p"], F.lit(0.01))))
    pull = F.when(F.size(flowing) > 0, total(F.transform(flowing, lambda m: _signed(x["flow"], m["flow"], m["p"]))) / weight)
    return consistency, _multiplier(pull)


def _depth(x: Column, decay: float, least: float, depths: int) -> Column:
    """How many steps the signal of ``x`` spreads."""
    none = F.array().cast("array<string>")
    state = lambda at, seen, depth, strength: F.struct(at.alias("at"), seen.alias("seen"), depth.alias("depth"), strength.alias("strength"))

    def step(s: Column, d: Column) -> Column:
        met = F.array_except(F.array_distinct(F.flatten(F.transform(s["at"], _near))), s["seen"])
        strength = s["strength"] * F.pow(F.lit(decay), d)
        same = lambda n: F.coalesce((F.try_element_at(F.col("by"), n)["flow"] >= 0) == (x["flow"] >= 0), F.lit(False))
        passed = F.when(strength >= least, F.filter(met, same)).otherwise(none)
        return state(passed, F.array_union(s["seen"], met), F.when(F.size(passed) > 0, d).otherwise(s["depth"]), strength)

    own = F.array(x["outcome"]).cast("array<string>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(depths)), state(own, own, F.lit(0), F.abs(x["flow"])), step, lambda s: s["depth"])


def _rows(held: DataFrame, flows: DataFrame, added: dict) -> DataFrame:
    """The flows of ``held`` as rows again, each with the columns ``added`` (functions of an outcome's struct)."""
    out = F.transform("o", lambda x: F.struct(x.alias("x"), *(f(x).alias(n) for n, f in added.items())))
    df = held.select(*SNAPSHOT, F.explode(out).alias("r"))
    return df.select(*(F.col(c) if c in SNAPSHOT else F.col(f"r.x.{c}") for c in flows.columns), *(F.col(f"r.{n}") for n in added))


def consistency_and_momentum(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """How far neighbours move the same way, and the multiplier from their weighted signed flows."""
    if fits_in_rows(flows, edges):
        return _rows(snapshots(flows, edges), flows, {"consistency": lambda x: _agreement(x)[0], "momentum": lambda x: _agreement(x)[1]})
    weight = F.when(F.col("adj_flow").isNotNull(), F.greatest("adj_p", F.lit(0.01)))
    signed = F.when(F.col("adj_flow").isNotNull(), _signed(F.col("flow"), F.col("adj_flow"), F.col("adj_p")))
    same = _same_way(F.col("direction"), F.col("adj_direction"))
    df = neighbours(flows, edges).groupBy(*SNAPSHOT, "outcome").agg((F.sum(same) / F.count(F.lit(1))).alias("consistency"), (F.sum(signed) / F.sum(weight)).alias("pull"))
    df = flows.join(df, [*SNAPSHOT, "outcome"], "left")
    return df.withColumns({"consistency": F.coalesce("consistency", F.lit(0.0)), "momentum": _multiplier(F.col("pull"))}).drop("pull")


def gradient_position(flows: DataFrame) -> DataFrame:
    """Where an outcome lies from the likeliest (0) to the least likely (1) of its direction; one half where all are equal."""
    w = Window.partitionBy(*SNAPSHOT, "direction")
    high, low = F.max("p").over(w), F.min("p").over(w)
    return flows.withColumn("gradient", F.when(high == low, 0.5).otherwise((high - F.col("p")) / (high - low)))


def _ends() -> Column:
    """The highest and lowest probability of each direction of a snapshot's row."""
    of = lambda d: F.transform(F.filter("o", lambda x: x["direction"] == d), lambda x: x["p"])
    directions = F.filter(F.array_distinct(F.transform("o", lambda x: x["direction"])), lambda d: d.isNotNull())
    return F.map_from_entries(F.transform(directions, lambda d: F.struct(d, F.struct(F.array_max(of(d)).alias("high"), F.array_min(of(d)).alias("low")))))


def _gradient(x: Column) -> Column:
    ends = F.try_element_at(F.col("ends"), x["direction"])
    return F.when(ends["high"] == ends["low"], 0.5).otherwise((ends["high"] - x["p"]) / (ends["high"] - ends["low"]))


def propagation(flows: DataFrame, edges: DataFrame, decay: float = 0.7, least: float = 1.0, depths: int = 3) -> DataFrame:
    """How many steps a flow's signal spreads through neighbours of the same sign while its strength is ``least`` or more.

    A step's strength is the one before times decay^depth.  Outcomes once met are not met again.
    """
    if fits_in_rows(flows, edges):
        return _rows(snapshots(flows, edges), flows, {"depth": lambda x: _depth(x, decay, least, depths)}).select(*SNAPSHOT, "outcome", "depth")
    near = both_ways(edges).select("graph_id", F.col("src").alias("at"), F.col("dst").alias("to"))
    signs = flows.select(*SNAPSHOT, F.col("outcome").alias("to"), (F.col("flow") >= 0).alias("up"))
    origin = flows.select(*SNAPSHOT, "outcome", F.abs("flow").alias("strength"), (F.col("flow") >= 0).alias("sign"))
    key = [*SNAPSHOT, "outcome"]
    frontier = origin.withColumn("at", F.col("outcome"))
    seen = origin.select(*key, F.col("outcome").alias("to"))
    reached = []
    for d in range(1, depths + 1):
        met = frontier.join(near, ["graph_id", "at"]).select(*key, "strength", "sign", "to").distinct().join(seen, [*key, "to"], "left_anti")
        seen = seen.unionByName(met.select(*key, "to"))
        met = met.join(signs, [*SNAPSHOT, "to"]).filter("up = sign").withColumn("strength", F.col("strength") * decay**d)
        met = met.filter(F.col("strength") >= least)  # all of a depth are equally strong
        reached.append(met.select(*key, F.lit(d).alias("depth")).distinct())
        frontier = met.select(*key, "strength", "sign", F.col("to").alias("at"))
    deepest = reached[0]
    for r in reached[1:]:
        deepest = deepest.unionByName(r)
    return origin.select(*key).join(deepest.groupBy(*key).agg(F.max("depth").alias("depth")), key, "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


#: Levels of scores: of the standard variant (by absolute score) and of the legacy one; fixed values.
LEGACY_STEPS = [(1, "none"), (3, "low"), (5, "medium"), (10, "high")]


def amplification(flows: DataFrame, edges: DataFrame, least: float = 1.0, modifier: str | None = None) -> DataFrame:
    """Score, level, confidence and depth of each flow from its neighbours, its place and how far its signal spreads.

    ``modifier`` names a column of ``flows`` that multiplies the score (1 where null).  A flow below ``least`` scores 0 at
    depth 0 with a tenth of the confidence.
    """
    if fits_in_rows(flows, edges):
        added = {"consistency": lambda x: _agreement(x)[0], "momentum": lambda x: _agreement(x)[1], "gradient": _gradient, "depth": lambda x: _depth(x, 0.7, least, 3)}
        df = _rows(snapshots(flows, edges).withColumn("ends", _ends()), flows, added)
    else:
        df = gradient_position(consistency_and_momentum(flows, edges)).join(propagation(flows, edges, least=least), [*SNAPSHOT, "outcome"])
    weight = F.lit(1.0) if modifier is None else F.coalesce(F.col(modifier), F.lit(1.0))
    small = F.abs("flow") < least
    up = F.col("flow") * (0.5 + 0.5 * F.col("consistency")) * (1 + F.col("gradient")) * F.col("momentum")
    score = F.when(small, 0.0).otherwise(F.when(F.col("direction") == "upward", up).otherwise(F.col("flow") * 0.3 * F.col("consistency")) * weight)
    df = df.withColumns({"score": score, "confidence": F.when(small, 0.1 * weight).otherwise(weight), "depth": F.when(small, 0).otherwise(F.col("depth"))})
    df = df.withColumns({"consistency": F.when(small, 0.0).otherwise(F.col("consistency")), "level": amplification_level(F.col("score"))})
    reliable = (F.col("confidence") >= 0.5) & (F.col("level") != "none")
    return df.withColumns({"reliable": reliable, "strength": F.least(F.abs("score") / 10, F.lit(1.0))})


def flow_summary(flows: DataFrame, least: float = 2.0) -> DataFrame:
    """Per snapshot the flows by direction, their mean, hours since the snapshot before, and the significant ones as text."""
    n = lambda d: F.count_if(F.col("direction") == d)
    row = F.when(F.abs("flow") >= least, F.struct("outcome", flow_significance(F.col("flow"), 2.0, 5.0).alias("level")))
    named = F.transform(F.sort_array(F.collect_list(row)), lambda x: F.concat_ws(":", x["outcome"], x["level"]))  # a snapshot's outcomes
    return flows.groupBy(*SNAPSHOT).agg(
        F.count(F.lit(1)).alias("outcomes"), n("upward").alias("ups"), n("downward").alias("downs"), n("stable").alias("stables"), F.avg("flow").alias("momentum"),
        F.max("hours").alias("hours"), F.concat_ws(",", named).alias("significant"),
    )


def amplification_summary(amplified: DataFrame, top: int = 5) -> DataFrame:
    """Per snapshot the mean score, the risk of a cascade, the strong and reliable flows and the ``top`` strong ones by score.

    The risk is a fifth of the share of flows scoring above 5 whose neighbours mostly disagree.
    """
    strong = F.col("level").isin("high", "very_high", "exceptional")
    high = F.col("score") > 5
    row = F.when(strong, F.struct((-F.col("score")).alias("s"), "outcome", "level"))
    named = F.transform(F.slice(F.sort_array(F.collect_list(row)), 1, top), lambda x: F.concat_ws(":", x["outcome"], x["level"]))
    return amplified.groupBy(*SNAPSHOT).agg(
        F.count(F.lit(1)).alias("outcomes"), F.avg("score").alias("momentum"), F.count_if(strong).alias("strong"), F.count_if("reliable").alias("reliable"),
        F.least(F.coalesce(0.2 * F.try_divide(F.count_if(high & (F.col("consistency") < 0.5)), F.count_if(high)), F.lit(0.0)), F.lit(1.0)).alias("cascade_risk"),
        F.concat_ws(",", named).alias("top"), F.count_if(strong & (F.col("depth") > 1)).alias("cascading"),
    )


def legacy_flows(first: DataFrame, last: DataFrame, key: list[str]) -> DataFrame:
    """The other variant's flows: both snapshots (``key, outcome, p``) are normalised first, and only outcomes of the first count.

    Directions change beyond one point; ``p`` is the later probability.
    """
    w = Window.partitionBy(*key)
    a = first.select(*key, "outcome", (F.col("p") / F.sum("p").over(w)).alias("p0"))
    b = last.select(*key, "outcome", (F.col("p") / F.sum("p").over(w)).alias("p1"))
    df = a.join(b, [*key, "outcome"], "left").withColumn("p", F.coalesce("p1", "p0"))
    flow = (F.col("p") - F.col("p0")) * 100
    direction = F.when(F.col("flow") > 1, "positive").when(F.col("flow") < -1, "negative").otherwise("neutral")
    significance = F.when(F.abs("flow") >= 5, "high").when(F.abs("flow") >= 2, "medium").otherwise("low")
    return df.withColumn("flow", flow).withColumns({"direction": direction, "significance": significance})


def legacy_amplification(flows: DataFrame, edges: DataFrame, least: float = 2.0, modifier: str | None = None) -> DataFrame:
    """The other variant's scores: positive flows only, consistency by positive neighbours, place among the neighbours.

    The level comes before the confidence; flows below ``least`` score 0 with the modifier (0 where there is none) as confidence.
    """
    near = neighbours(flows, edges).groupBy(*SNAPSHOT, "outcome").agg(
        (F.count_if(F.col("adj_direction") == "positive") / F.count(F.lit(1))).alias("consistency"), F.max("adj_p").alias("high"), F.min("adj_p").alias("low")
    )
    df = flows.join(near, [*SNAPSHOT, "outcome"], "left")
    place = F.when(F.col("high").isNull(), 0.0).when(F.col("high") == F.col("low"), 0.5).otherwise((F.col("high") - F.col("p")) / (F.col("high") - F.col("low")))
    small, given = F.abs("flow") < least, F.lit(None).cast("double") if modifier is None else F.col(modifier)
    raw = F.when(~small & (F.col("direction") == "positive"), F.col("flow") * F.coalesce("consistency", F.lit(0.0)) * (1 + place)).otherwise(0.0)
    df = df.withColumn("raw", raw).withColumn("confidence", F.when(small, F.coalesce(given, F.lit(0.0))).otherwise(F.coalesce(given, F.lit(1.0))))
    return df.withColumns({"score": F.col("raw") * F.when(small, 0.0).otherwise(F.col("confidence")), "level": ladder(F.col("raw"), LEGACY_STEPS, "very_high")})
