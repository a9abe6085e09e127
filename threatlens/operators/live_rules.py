"""Deterministic signature rules on flows: overrides for graded tables and live classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.expressions import as_bool
from .flow_features import is_swift_sql

BEACON = "C2 Beacon (Malicious JA3)"
PROBE = "SWIFT SQL Injection Probe"
SMALL_PACKETS = "Data Exfiltration (Small Packets)"
SMALL_PACKET_BYTES = 500


def _bytes_per_packet():
    return F.coalesce("bytes_sent", F.lit(0.0)) / F.greatest("packets_sent", F.lit(1))


def cti_overrides(scored: DataFrame) -> DataFrame:
    """Known signatures force probability 1 and CRITICAL; the strongest rule names the attack.

    A source that is not known to be internal counts as external here.
    """
    small = ~as_bool("is_internal_src") & (_bytes_per_packet() < SMALL_PACKET_BYTES)
    kind = (
        F.when(F.coalesce(small, F.lit(False)), SMALL_PACKETS)
        .when(F.coalesce(is_swift_sql(), F.lit(False)), PROBE)
        .when(F.coalesce(F.col("ja3_hash") == K.KNOWN_C2_JA3, F.lit(False)), BEACON)
    )
    return scored.withColumn("_kind", kind).withColumns(
        {
            "attack_probability": F.when(F.col("_kind").isNotNull(), F.lit(1.0)).otherwise(F.col("attack_probability")),
            "severity": F.when(F.col("_kind").isNotNull(), "CRITICAL").otherwise(F.col("severity")),
            "attack_type": F.coalesce("_kind", F.lit("Anomalous Traffic (ML)")),
        }
    ).drop("_kind")


def classify_live(flows: DataFrame, score: str = "correlation_score") -> DataFrame:
    """Adds attack_name and live_severity of the first matching rule; both null when benign."""
    outside = ~as_bool("is_internal_src")
    port = F.col("dst_port")
    high = F.col(score) > K.LIVE_THRESHOLD
    rules = [
        (F.col("ja3_hash").isin(K.LIVE_MALICIOUS_JA3), BEACON, "CRITICAL"),
        (is_swift_sql(), PROBE, "CRITICAL"),
        (outside & (_bytes_per_packet() < SMALL_PACKET_BYTES), SMALL_PACKETS, "CRITICAL"),
        (high & (port == K.ENCRYPTED_DNS_PORT), "Suspicious Encrypted DNS", "HIGH"),
        (high & outside, "Anomalous External Access", "HIGH"),
        (high & port.isin(K.LATERAL_PORTS), "Anomalous Lateral Movement", "HIGH"),
        (high, "Unknown Anomaly (Correlation Detection)", "MEDIUM"),
    ]
    name = tier = None
    for condition, attack, severity in rules:
        name = F.when(condition, attack) if name is None else name.when(condition, attack)
        tier = F.when(condition, severity) if tier is None else tier.when(condition, severity)
    return flows.withColumns({"attack_name": name, "live_severity": tier})
