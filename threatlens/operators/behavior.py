"""Behavior results of all sources: union, per-address aggregation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import flag, flag_array, is_blank, join_flags, join_techniques, round_even

# indicator -> flags that raise it
INDICATORS = {
    "ind_off_hours": ["off_hours", "swift_off_hours", "weekend_early_morning"],
    "ind_high_deviation": ["high_peer_deviation", "elevated_peer_deviation"],
    "ind_large_transfer": ["large_data_transfer"],
    "ind_unauthorized_db": ["unauthorized_pumori"],
    "ind_swift_access": ["swift_off_hours", "new_swift_resource", "swift_query_velocity"],
    "ind_credential_dump": ["credential_dump"],
    "ind_log_cleared": ["audit_log_cleared"],
    "ind_brute_force": ["brute_force", "account_lockout"],
    "ind_new_service": ["new_service", "new_service_atm"],
    "ind_priv_escalation": ["priv_escalation"],
}


def union_results(*results: DataFrame) -> DataFrame:
    """Results of user events, Windows events and velocity hits in one layout."""
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def detail_table(results: DataFrame) -> DataFrame:
    """Printable form: flags and technique pairs joined to text."""
    return results.withColumns({"flags": join_flags("flags"), "mitre": join_techniques("mitre")})


def _raised(flags: list[str]) -> Column:
    return F.max(flag(F.arrays_overlap("flags", F.array(*[F.lit(f) for f in flags]))))


def behavior_by_ip(results: DataFrame) -> DataFrame:
    """One row per address. An address is anomalous with two events >= .70 or one >= .85.

    Only maxima and counts are kept per address, so no flag list grows with its events.
    """
    usable = results.where(~is_blank("source_ip") & (F.col("source_ip") != "LOCAL"))
    best = F.max("score")
    high = F.count_if(F.col("score") >= 0.70)
    critical = F.count_if(F.col("score") >= 0.85)
    anomalous = flag((best >= 0.70) & ((high >= 2) | (critical >= 1)))
    return usable.groupBy("source_ip").agg(
        round_even(best, 4).alias("behavior_score"),
        anomalous.alias("is_behavior_anomaly"),
        *[_raised(flags).alias(name) for name, flags in INDICATORS.items()],
        F.count(F.lit(1)).alias("behavior_event_count"),
    )


def top_anomalous_ips(by_ip: DataFrame, n: int = 10) -> DataFrame:
    """Highest addresses with the names of their indicators."""
    names = flag_array([(F.col(i) == 1, i.removeprefix("ind_")) for i in INDICATORS])
    listed = by_ip.orderBy(F.desc("behavior_score"), "source_ip").limit(n)
    return listed.select(
        "source_ip", "behavior_score",
        F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("ml_anomaly").alias("active_flags"),
    )


def score_summary(results: DataFrame, cut: float = 0.75) -> DataFrame:
    return results.agg(
        round_even(F.avg("score"), 4).alias("mean_score"),
        F.max("score").alias("max_score"),
        F.count_if(F.col("score") >= cut).alias("n_flagged"),
    )


def flag_counts(results: DataFrame) -> DataFrame:
    return (
        results.select(F.explode("flags").alias("flag"))
        .groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "flag")
    )
