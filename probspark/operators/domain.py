"""From a domain's tables to probabilities, flows, amplification, allocation and prediction sets, for all its subjects in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.functions.expr import flow_direction, quote_probability
from probspark.operators import allocation, graph
from probspark.operators.analysis import assess, evidence_update, ingest_signals
from probspark.operators.fusion import RELIABILITY, reliability_grade, source_weights
from probspark.operators.history import merge_last
from probspark.sources.stored import stored


class DomainAdapter:
    """What a domain tells the analysis, as tables whose rows carry the columns of ``key``.

    Override what differs: ``outcomes`` (``key, outcome``) is needed; ``prior`` is uniform, ``edges`` are the chain of
    outcomes, ``signals`` (``outcome, value, signal_type``) and ``evidence`` (``source, source_type, outcome, p, confidence,
    seen``) are absent, and ``reliability`` gives a weight for each source type (one half for others).
    """

    key: list[str]

    def outcomes(self) -> DataFrame:
        raise NotImplementedError

    def prior(self) -> DataFrame:
        return self.outcomes().withColumn("prior", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*self.key)))

    def edges(self) -> DataFrame:
        return chain(self.outcomes(), self.key)

    def signals(self) -> DataFrame | None:
        return None

    def evidence(self) -> DataFrame | None:
        return None

    def reliability(self) -> dict[str, float]:
        return RELIABILITY


def chain(outcomes: DataFrame, key: list[str]) -> DataFrame:
    """Each outcome of a subject with the next in order (``key, src, dst``)."""
    w = Window.partitionBy(*key).orderBy("outcome")
    return outcomes.select(*key, F.col("outcome").alias("src"), F.lead("outcome").over(w).alias("dst")).filter("dst is not null")


def complete(outcomes: DataFrame, key: list[str]) -> DataFrame:
    """Every pair of a subject's outcomes; outcomes of one question are few."""
    a, b = outcomes.select(*key, F.col("outcome").alias("src")), outcomes.select(*key, F.col("outcome").alias("dst"))
    return a.join(b, key).filter("src < dst")


@dataclass
class GenericDomain(DomainAdapter):
    """A domain given by its tables: outcomes, and what there is of signals, evidence and a kind of graph."""

    table: DataFrame
    key: list[str]
    graph: str = "chain"
    quotes: DataFrame | None = None
    sources: DataFrame | None = None

    def outcomes(self) -> DataFrame:
        return self.table.select(*self.key, "outcome").distinct()

    def edges(self) -> DataFrame:
        return (complete if self.graph == "fully_connected" else chain)(self.outcomes(), self.key)

    def signals(self) -> DataFrame | None:
        return self.quotes

    def evidence(self) -> DataFrame | None:
        return self.sources


def after_signals(domain: DomainAdapter) -> DataFrame:
    """``key, outcome, p``: the prior overlaid with the signals; odds above 1 count as odds, all else by its own probability."""
    prior, signals = domain.prior(), domain.signals()
    if signals is None:
        return prior.select(*domain.key, "outcome", F.col("prior").alias("p"))
    is_odds = (F.col("signal_type") == "decimal_odds") & (F.col("value") > 1)
    parsed = signals.select(*domain.key, "outcome", F.when(is_odds, F.col("value")).alias("odds"), F.when(~is_odds, quote_probability(F.col("value"), F.col("signal_type"))).alias("direct"))
    return ingest_signals(prior.join(parsed, [*domain.key, "outcome"], "left"), domain.key).select(*domain.key, "outcome", F.col("posterior").alias("p"))


def graded(domain: DomainAdapter, evidence: DataFrame) -> DataFrame:
    """Evidence with a grade from its source type's reliability, keyed by ``subject`` (a struct of the domain's key)."""
    known = domain.reliability()
    weight = F.coalesce(*(F.when(F.col("source_type") == t, F.lit(w)) for t, w in known.items()), F.lit(0.5))
    return evidence.select(F.struct(*domain.key).alias("subject"), "source", "outcome", "p", "confidence", F.col("seen").alias("ts"), reliability_grade(weight).alias("grade"))


def analyze(domain: DomainAdapter, as_of: Column, budget: float = 1000.0, multipliers: DataFrame | None = None, tier: str = "balanced", target: float = 0.6, threshold: float = 1.0, half_life_hours: float = 24.0) -> DataFrame:
    """One row per outcome: probabilities after signals and after evidence, flow, amplification, allocation and set membership.

    Each row also has its subject's likeliest outcome and the assessment of its evidence.  Subjects without evidence have one
    snapshot only: no flow, and legs that count as stable.  ``as_of`` is a column of the evidence's key; ``multipliers``
    (``key, outcome, multiplier``) are 2 where not given.  All steps keep the subject's key, so they share its partitioning.
    """
    key, subject = domain.key, F.struct(*domain.key).alias("subject")
    first = after_signals(domain)
    rows = stored(first.select(subject, "outcome", F.col("p").alias("p_signals")), "after-signals")
    evidence = domain.evidence()
    if evidence is None:
        rows = rows.withColumns({"p": F.col("p_signals"), "informed": F.lit(False), "consensus": F.lit(None).cast("double"), "stability": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    else:
        sources = graded(domain, evidence).join(evidence.select(*key, as_of.alias("as_of")).select(subject, "as_of").distinct(), "subject")
        weighted = source_weights(sources, F.col("as_of"), half_life_hours).select("subject", F.col("outcome").alias("__target"), "weight", "p")
        known = rows.select("subject", F.col("outcome").alias("__target"), F.lit(True).alias("known"))
        said = weighted.join(known, ["subject", "__target"], "left").select("subject", F.when(F.col("known"), F.col("__target")).alias("outcome"), "weight", "p")
        moved = evidence_update(rows.select("subject", "outcome", F.col("p_signals").alias("p")), said)
        report = assess(sources, F.col("as_of"), None, 0.5, "hybrid", half_life_hours).select("subject", "consensus", "stability", "confidence")
        rows = rows.join(moved, ["subject", "outcome"]).join(report, "subject", "left")
        informed = F.col("consensus").isNotNull()
        rows = rows.withColumns({"informed": informed, "p": F.when(informed, F.col("posterior")).otherwise(F.col("p_signals"))}).drop("posterior")
    flow = (F.col("p") - F.col("p_signals")) * 100
    rows = rows.withColumn("flow", F.when(F.col("informed"), flow)).withColumn("direction", F.when(F.col("informed"), flow_direction(F.col("flow"), 0.5)))
    rows = stored(rows, "analysis-rows")  # flows, every step of their spread, and legs read it
    flows = rows.filter("informed").select(F.col("subject").alias("graph_id"), F.lit(0).alias("ts"), "outcome", "p", "flow", "direction")
    edges = domain.edges().select(subject.alias("graph_id"), "src", "dst")
    amplified = graph.amplification(flows, edges).select(F.col("graph_id").alias("subject"), "outcome", "score", "level", "depth")
    legs = rows.select("subject.*", "outcome", "p", F.lit(0.7).alias("confidence"), F.when(F.col("informed") & (F.col("p") < F.col("p_signals")), "downward").otherwise("open").alias("direction"))
    if multipliers is None:
        legs = legs.withColumn("multiplier", F.lit(2.0))
    else:
        legs = legs.join(multipliers.select(*key, "outcome", "multiplier"), [*key, "outcome"], "left").withColumn("multiplier", F.coalesce("multiplier", F.lit(2.0)))
    shares = allocation.rebalance(allocation.allocate(legs, key, budget, tier=tier), key, target)
    shares = shares.select(subject, "outcome", F.col("rebalanced").alias("fraction"), (F.col("rebalanced") * budget).alias("amount"))
    out = rows.join(amplified, ["subject", "outcome"], "left").join(shares, ["subject", "outcome"], "left")
    best = F.first("outcome").over(Window.partitionBy("subject").orderBy(F.desc("p"), "outcome"))
    out = out.withColumns({"fraction": F.coalesce("fraction", F.lit(0.0)), "amount": F.coalesce("amount", F.lit(0.0)), "in_set": 1 - F.col("p") <= threshold + 1e-12, "likeliest": best})
    return out.select("subject.*", *(c for c in out.columns if c != "subject"))


def load_ranges(cached: DataFrame, plan: DataFrame, loader: Callable[[DataFrame], DataFrame], key: str, date: str, order: str | None = None) -> DataFrame:
    """``cached`` with what ``loader`` returns for the planned ranges (``key, start_date, end_date, reason``) merged over it.

    The loader takes the ranges that are not up to date and returns rows; rows outside their key's range are left out.
    """
    wanted = plan.filter("reason <> 'up_to_date'").select(key, "start_date", "end_date")
    loaded = loader(wanted)
    inside = loaded.join(wanted, key).filter(F.col(date).between(F.col("start_date"), F.col("end_date"))).drop("start_date", "end_date")
    return merge_last(cached, inside, [key, date], order)
