"""All stages composed: agents, fusion, response.

Stages hand over DataFrames. Results that several later stages read are stored once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion as fu
from ..operators import response as rs
from ..operators.evaluation import join_labels, tune_threshold
from ..operators.killchain import killchain_paths
from ..session import settle, settle_parts
from . import behavior_agent, flow_agent, packet_agent


@dataclass
class Tables:
    netflow: DataFrame
    zeek: DataFrame
    windows: DataFrame
    ueba: DataFrame
    hosts: DataFrame
    labels: DataFrame
    tickets: DataFrame


@dataclass
class Outputs:
    correlation: DataFrame
    responded: DataFrame
    shortlist: DataFrame
    coverage: DataFrame
    findings: DataFrame
    threshold: DataFrame


def fuse_and_respond(
    flows: DataFrame, t: Tables, flow_scores: DataFrame, packet: DataFrame, behavior_results: DataFrame,
    seeds: DataFrame | None = None, max_fpr: float = 0.10, top_n: int = 500,
    ja3_signal: DataFrame | None = None,
) -> Outputs:
    """From the agents' scores to decisions. ``flows`` has one row per flow_id."""
    behavior = behavior_agent.behavior_scores(behavior_results)
    spark, rest = flows.sparkSession, [c for c in flows.columns if c not in fu.FLOW_COLUMNS]

    def fused() -> DataFrame:
        return fu.correlate(flows.select(*fu.FLOW_COLUMNS), flow_scores, packet, behavior, seeds, ja3_signal)

    correlation = settle_parts(spark, [fused], "correlation")
    scored = correlation.select(
        "flow_id", "attack_probability", "severity", "agents_fired", "boost_applied",
        "mitre_technique", "predicted_category",
    )
    if rest:  # columns of the flows that fusion does not read
        others = flows.select(F.col("flow_id").alias("_id"), *rest)
        correlation = correlation.join(others, F.col("flow_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    threshold = tune_threshold(join_labels(scored, t.labels), max_fpr)
    responded = rs.respond(scored, flows, t.hosts, threshold, seeds)
    shortlist = rs.swift_shortlist(responded, behavior_results, top_n)
    coverage = rs.recall_check(rs.match_tickets(t.tickets, shortlist))
    return Outputs(
        correlation, responded, shortlist, coverage, killchain_paths(t.netflow, t.hosts), threshold
    )


def run(t: Tables, seeds: DataFrame | None = None, with_ja3: bool = False, **gbt) -> Outputs:
    """Trains and scores all agents, then fuses and responds; ``with_ja3`` takes up known fingerprints."""
    flows = flow_agent.prepare_flows(t.netflow, t.zeek, t.labels)
    art = flow_agent.train(flows, "both", **gbt)
    scores = flow_agent.flow_scores(flow_agent.score(flows, art))
    addresses = settle(packet_agent.run(t.windows, t.zeek), "addresses-scored")
    packet = packet_agent.packet_scores(addresses)
    signal = packet_agent.ja3_signal(addresses) if with_ja3 else None
    behavior = settle(behavior_agent.results(t.ueba, t.windows, t.hosts), "behavior")
    return fuse_and_respond(flows, t, scores, packet, behavior, seeds, ja3_signal=signal)
