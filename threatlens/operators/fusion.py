"""Fusion of the agents' scores into one threat score, category and severity per flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.expressions import (
    clip01,
    first_match,
    flag,
    fused_severity,
    gated_fusion,
    lookup,
    round_even,
    technique_of,
)
from .ordered import rolling_max_level

BOOST = 1.30
#: What fusion reads of a flow.
FLOW_COLUMNS = [
    "flow_id", "src_ip", "start_time", "segment", "dst_port", "bytes_sent", "is_internal_src", "is_internal_dst",
]


def join_agent_scores(
    flows: DataFrame, flow_scores: DataFrame, packet: DataFrame, behavior: DataFrame
) -> DataFrame:
    """Flows with their own score and the scores of their source; a missing score is 0.

    The per-address tables have one row per address. Spark broadcasts them only when their measured
    size allows; otherwise adaptive skew handling splits a busy source.
    """
    return (
        flows.join(flow_scores, "flow_id", "left")
        .join(packet, "src_ip", "left")
        .join(behavior, "src_ip", "left")
        .fillna(0.0, ["flow_score", "packet_score", "behavior_score"])
    )


def fuse(df: DataFrame) -> DataFrame:
    return df.withColumn("threat_score", gated_fusion("flow_score", "behavior_score", "packet_score"))


def amplify_by_segment(df: DataFrame) -> DataFrame:
    weight = lookup("segment", K.SEGMENT_WEIGHT, 1.0)
    return df.withColumn("threat_score", clip01(F.col("threat_score") * weight))


def agents_fired() -> Column:
    return sum(
        (flag(F.col(c) >= 0.50) for c in ("flow_score", "behavior_score", "packet_score")), F.lit(0)
    )


def co_occurrence_boost(df: DataFrame) -> DataFrame:
    """Raises the score where two agents fired together within the source's last five minutes."""
    timed = df.withColumns({"agents_fired": agents_fired(), "_us": F.unix_micros("start_time")})
    timed = rolling_max_level(
        timed, "src_ip", "_us", "agents_fired", 3, 5 * K.MINUTE, "max_agents_5min"
    )
    boosted = F.coalesce(F.col("max_agents_5min") >= 2, F.lit(False))
    return timed.drop("_us").withColumns(
        {
            "threat_score": F.when(
                boosted, F.least(F.col("threat_score") * BOOST, F.lit(1.0))
            ).otherwise(F.col("threat_score")),
            "boost_applied": boosted.cast("int"),
        }
    )


def category_column(ja3_match: Column | None = None) -> Column:
    """First matching attack category."""
    port, score = F.col("dst_port"), F.col("threat_score")
    beacon = port.isin(K.C2_PORTS)
    if ja3_match is not None:
        beacon = beacon | F.coalesce(ja3_match == 1, F.lit(False))
    inside = F.col("is_internal_src") & F.col("is_internal_dst")
    return first_match(
        [
            (F.coalesce(beacon, F.lit(False)), "C2_BEACON"),
            ((F.col("segment") == "SWIFT") & (port == K.SWIFT_SQL_PORT), "SWIFT_TAMPERING"),
            ((F.col("bytes_sent") > 500000) & ~F.col("is_internal_dst") & (score >= 0.6), "DATA_EXFIL"),
            (inside & (score >= 0.75), "LATERAL_MOVEMENT"),
            (score >= K.FUSED_LADDER[0][0], "ZERO_DAY"),
        ],
        "NORMAL",
    )


def classify(df: DataFrame) -> DataFrame:
    """Rounded probability, severity, category and technique from threat_score."""
    match = F.col("ind_ja3_c2_match") if "ind_ja3_c2_match" in df.columns else None
    return df.withColumns(
        {
            "attack_probability": round_even("threat_score", 6),
            "severity": fused_severity("threat_score"),
            "predicted_category": category_column(match),
        }
    ).withColumn("mitre_technique", technique_of("predicted_category"))


def seed_override(
    df: DataFrame, seeds: DataFrame, score: str, severity: str | None = None
) -> DataFrame:
    """Announced attack flows get score 1 and, where a severity column is given, CRITICAL."""
    marked = df.join(
        seeds.select("flow_id").distinct().withColumn("_seed", F.lit(True)), "flow_id", "left"
    )
    hit = F.coalesce("_seed", F.lit(False))
    out = marked.withColumn(score, F.when(hit, F.lit(1.0)).otherwise(F.col(score)))
    if severity:
        out = out.withColumn(severity, F.when(hit, "CRITICAL").otherwise(F.col(severity)))
    return out.drop("_seed")


def correlate(
    flows: DataFrame,
    flow_scores: DataFrame,
    packet: DataFrame,
    behavior: DataFrame,
    seeds: DataFrame | None = None,
    ja3_signal: DataFrame | None = None,
) -> DataFrame:
    """The whole fusion step: join, fuse, amplify, boost, override, classify.

    ``ja3_signal`` (src_ip, ind_ja3_c2_match), one row per address, lets a known fingerprint name a beacon;
    without it only the port does.
    """
    if ja3_signal is not None:
        flows = flows.join(ja3_signal.select("src_ip", "ind_ja3_c2_match"), "src_ip", "left")
    out = co_occurrence_boost(
        amplify_by_segment(fuse(join_agent_scores(flows, flow_scores, packet, behavior)))
    )
    if seeds is not None:
        out = seed_override(out, seeds, "threat_score")
    return classify(out)


def tier_distribution(df: DataFrame, column: str, tiers: list[str]) -> DataFrame:
    """Rows and share per tier; tiers without rows are listed with 0."""
    per_tier = [
        F.struct(F.lit(t).alias(column), F.count_if(F.col(column) == t).alias("n")) for t in tiers
    ]
    row = df.agg(F.array(*per_tier).alias("tiers"), F.count(F.lit(1)).alias("whole"))
    return row.select(F.explode("tiers").alias("t"), "whole").select(
        f"t.{column}", "t.n",
        F.when(F.col("whole") > 0, round_even(F.col("t.n") / F.col("whole"), 6)).otherwise(F.lit(0.0)).alias("share"),
    )
