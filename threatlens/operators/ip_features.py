"""Per-address features of Windows and Zeek logs, fingerprint rarity, indicators and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.expressions import flag
from .ordered import exact_quantiles


def busy_hours(events: DataFrame, time: str = "event_time") -> DataFrame:
    """Hours of the day whose event count reaches the median hour (at most 24 rows)."""
    counts = events.where(F.col(time).isNotNull()).groupBy(F.hour(time).alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
    median = F.percentile("n", F.lit(0.5)).over(Window.partitionBy())
    return counts.withColumn("median", median).where(F.col("n") >= F.col("median")).drop("median")


def mark_off_hours(df: DataFrame, busy: DataFrame, time: str) -> DataFrame:
    """is_off_hours = 1 where the hour is not busy. ``busy`` has at most 24 rows by construction."""
    hours = F.broadcast(busy.select(F.col("hour").alias("_hour"), F.lit(0).alias("_off")))
    return (
        df.join(hours, F.hour(time) == F.col("_hour"), "left")
        .withColumn("is_off_hours", F.coalesce("_off", F.lit(1)))
        .drop("_hour", "_off")
    )


def _sum_flag(condition: Column, name: str) -> Column:
    return F.sum(flag(condition)).alias(name)


def windows_aggregates() -> list[Column]:
    event, logon = F.col("event_id"), F.col("logon_type")
    return [
        F.count("event_log_id").alias("win_total_events"),
        F.countDistinct("hostname").alias("win_unique_hosts"),
        F.countDistinct("subject_username").alias("win_unique_users"),
        _sum_flag(event == 4625, "win_failed_logons"),
        _sum_flag(event == 4688, "win_process_creations"),
        _sum_flag(event == 4672, "win_privileged_logons"),
        _sum_flag(event == 7045, "win_service_installs"),
        _sum_flag(logon == 10, "win_rdp_logons"),
        _sum_flag(logon == 3, "win_network_logons"),
        F.sum("is_off_hours").alias("win_off_hours_events"),
    ]


def windows_ratios(df: DataFrame) -> DataFrame:
    n = F.greatest("win_total_events", F.lit(1))
    return df.withColumns(
        {
            "win_fail_ratio": F.col("win_failed_logons") / n,
            "win_priv_ratio": F.col("win_privileged_logons") / n,
            "win_process_ratio": F.col("win_process_creations") / n,
            "win_off_hours_ratio": F.col("win_off_hours_events") / n,
        }
    )


def windows_ip_features(events: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    busy = busy_hours(events) if busy is None else busy
    marked = mark_off_hours(events, busy, "event_time").withColumn(
        "source_ip", F.coalesce("source_ip", F.lit("LOCAL"))
    )
    return windows_ratios(marked.groupBy("source_ip").agg(*windows_aggregates()))


def zeek_aggregates() -> list[Column]:
    ratio = F.col("orig_bytes") / F.greatest("resp_bytes", F.lit(1))
    return [
        F.count("log_id").alias("zeek_total_conns"),
        F.countDistinct("id_resp_h").alias("zeek_unique_dst_ips"),
        F.countDistinct("id_resp_p").alias("zeek_unique_dst_ports"),
        _sum_flag(F.col("conn_state").isin("S0", "REJ"), "zeek_failed_conns"),
        _sum_flag(F.col("service").isin("ssl", "tls"), "zeek_encrypted_conns"),
        F.sum("is_off_hours").alias("zeek_off_hours_conns"),
        F.avg("duration").alias("zeek_mean_duration"),
        F.avg("orig_bytes").alias("zeek_mean_orig_bytes"),
        F.avg("resp_bytes").alias("zeek_mean_resp_bytes"),
        F.sum("orig_bytes").alias("zeek_total_orig_bytes"),
        F.avg(ratio).alias("zeek_mean_bytes_ratio"),
        F.avg("orig_pkts").alias("zeek_mean_orig_pkts"),
    ]


def zeek_ratios(df: DataFrame) -> DataFrame:
    n = F.greatest("zeek_total_conns", F.lit(1))
    return df.withColumns(
        {
            "zeek_fail_ratio": F.col("zeek_failed_conns") / n,
            "zeek_encrypted_ratio": F.col("zeek_encrypted_conns") / n,
            "zeek_off_hours_ratio": F.col("zeek_off_hours_conns") / n,
            "zeek_dst_diversity": F.col("zeek_unique_dst_ports")
            / F.greatest("zeek_unique_dst_ips", F.lit(1)),
        }
    )


def zeek_ip_features(zeek: DataFrame, busy: DataFrame) -> DataFrame:
    """``busy`` comes from the Windows events: both logs share one notion of off-hours."""
    marked = mark_off_hours(zeek, busy, "ts")
    return zeek_ratios(marked.groupBy(F.col("id_orig_h").alias("source_ip")).agg(*zeek_aggregates()))


def combined_ip_features(windows: DataFrame, zeek: DataFrame) -> DataFrame:
    """Addresses of either log; features missing on one side are 0. Both sides: one row per address."""
    joined = windows.join(zeek, "source_ip", "full")
    return joined.fillna(0, [c for c in joined.columns if c != "source_ip"])


def quantile_indicators(features: DataFrame, q: float = 0.90) -> DataFrame:
    """Marks addresses strictly above the exact quantile of three features."""
    named = {
        "ind_high_fail_ratio": "win_fail_ratio",
        "ind_high_upload_ratio": "zeek_mean_bytes_ratio",
        "ind_high_port_spread": "zeek_unique_dst_ports",
    }
    cuts = exact_quantiles(features, list(named.values()), q)
    row = cuts.agg(
        F.struct(
            *[F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(c) for c in named.values()]
        ).alias("cut")
    )
    return features.withColumn("_cut", row.scalar()).withColumns(
        {ind: flag(F.col(c) > F.col(f"_cut.{c}")) for ind, c in named.items()}
    ).drop("_cut")


# ── fingerprint rarity ────────────────────────────────────────────────────────────────────────


def has_hash() -> Column:
    return F.col("ja3_hash").isNotNull() & (F.col("ja3_hash") != "")


def ja3_baseline_frequency(zeek: DataFrame) -> DataFrame:
    """Share of each fingerprint within normal connections that carry one."""
    normal = zeek.where(has_hash() & ~F.col("is_anomaly"))
    total = normal.agg(F.count(F.lit(1)).cast("double")).scalar()
    return (
        normal.groupBy("ja3_hash").agg(F.count(F.lit(1)).alias("n"))
        .select("ja3_hash", (F.col("n") / total).alias("ja3_frequency_in_normal"))
    )


def ja3_row_flags(zeek: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rarity marks per connection; a connection without a fingerprint is never marked."""
    freq = F.col("ja3_frequency_in_normal")
    known = F.coalesce(freq, F.lit(0.0))
    return zeek.join(baseline, "ja3_hash", "left").withColumns(
        {
            "ja3_log_frequency": F.log1p(known * 10000),
            "ja3_never_seen_in_normal": flag(has_hash() & freq.isNull()),
            "ja3_is_rare": flag(has_hash() & (known < 0.0001)),
            "ja3_matches_known_c2": flag(F.col("ja3_hash") == K.KNOWN_C2_JA3),
        }
    )


def ja3_ip_signal(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(F.col("id_orig_h").alias("source_ip")).agg(
        F.sum("ja3_never_seen_in_normal").alias("ja3_never_seen_conns"),
        F.sum("ja3_is_rare").alias("ja3_rare_conns"),
        F.sum("ja3_matches_known_c2").alias("ja3_known_c2_conns"),
        F.min("ja3_frequency_in_normal").alias("ja3_min_frequency"),
    )


def join_ja3_signal(features: DataFrame, signal: DataFrame) -> DataFrame:
    counts = ["ja3_never_seen_conns", "ja3_rare_conns", "ja3_known_c2_conns"]
    return (
        features.join(signal, "source_ip", "left").fillna(0, counts)
        .withColumn("ind_ja3_c2_match", flag(F.col("ja3_known_c2_conns") > 0))
    )


def top_ja3_ips(signal: DataFrame, n: int = 20) -> DataFrame:
    hit = (F.col("ja3_known_c2_conns") > 0) | (F.col("ja3_rare_conns") > 0)
    order = [F.desc("ja3_known_c2_conns"), F.desc("ja3_rare_conns"), F.asc("source_ip")]
    return signal.where(hit).orderBy(*order).limit(n)


def top_threat_ips(scored: DataFrame, n: int = 20) -> DataFrame:
    return scored.where("is_anomaly = 1").orderBy(F.desc("threat_score"), "source_ip").limit(n)
