"""Per-flow features: traffic, segment, port, time, fingerprint, source aggregates, query rate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.expressions import finite, flag, lookup
from ..session import settle
from .ordered import rolling_counts


def is_swift_sql():
    return (F.col("segment") == "SWIFT") & (F.col("dst_port") == K.SWIFT_SQL_PORT)


def ja3_modes(zeek: DataFrame) -> DataFrame:
    """Most frequent fingerprint of each (source, destination) pair; ties take the smallest.

    Counting per hash first keeps a busy pair spread; the winner is a partial minimum.
    """
    counted = (
        zeek.where(F.col("ja3_hash").isNotNull())
        .groupBy(F.col("id_orig_h").alias("src_ip"), F.col("id_resp_h").alias("dst_ip"), "ja3_hash")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("src_ip", "dst_ip").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "ja3_hash")).alias("m")
    ).select("src_ip", "dst_ip", F.col("m.ja3_hash").alias("ja3_hash"))


def join_ja3_mode(flows: DataFrame, zeek: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Flows with the modal fingerprint of their pair; ``modes`` is its stored table where there is one."""
    modes = ja3_modes(zeek) if modes is None else modes
    return flows.join(modes, ["src_ip", "dst_ip"], "left").withColumn(
        "ja3_hash", F.coalesce("ja3_hash", F.lit("UNKNOWN"))
    )


def join_flow_labels(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """flow_label ATTACK or NORMAL; a flow without a label is NORMAL."""
    known = labels.select("flow_id", "is_attack").groupBy("flow_id").agg(
        F.max("is_attack").alias("is_attack")
    )
    return flows.join(known, "flow_id", "left").withColumn(
        "flow_label", F.when(F.col("is_attack"), "ATTACK").otherwise("NORMAL")
    )


def traffic_columns() -> dict:
    sent = F.coalesce("bytes_sent", F.lit(0.0))
    out, back = F.coalesce("packets_sent", F.lit(0)), F.coalesce("packets_recv", F.lit(0))
    return {
        "bytes_sent_per_sec": sent / F.greatest("duration_sec", F.lit(0.001)),
        "bytes_per_pkt": sent / F.greatest("packets_sent", F.lit(1)),
        "pkt_sent_ratio": out / F.greatest(out + back, F.lit(1)),
    }


def segment_columns() -> dict:
    to_ext = F.coalesce("is_internal_src", F.lit(True)) & ~F.coalesce("is_internal_dst", F.lit(False))
    return {
        "segment_risk": lookup("segment", K.SEGMENT_RISK, K.SEGMENT_RISK_DEFAULT),
        "is_internal_to_ext": flag(to_ext),
        "swift_direct_internet": flag((F.col("segment") == "SWIFT") & to_ext),
    }


def port_columns() -> dict:
    return {
        "dst_port_risk": lookup("dst_port", K.PORT_RISK, K.PORT_RISK_DEFAULT),
        "is_swift_sql": flag(is_swift_sql()),
        "is_encrypted_dns": flag(
            (F.col("dst_port") == K.ENCRYPTED_DNS_PORT) & (F.col("segment") == "WORKSTATION")
        ),
    }


def time_columns() -> dict:
    hour, day = F.hour("start_time"), F.weekday("start_time")
    hour_angle, day_angle = F.lit(2 * math.pi) * hour / 24, F.lit(2 * math.pi) * day / 7
    return {
        "hour_sin": F.sin(hour_angle),
        "hour_cos": F.cos(hour_angle),
        "dow_sin": F.sin(day_angle),
        "dow_cos": F.cos(day_angle),
        "is_c2_time_window": flag(
            (day == K.C2_WEEKDAY) & (hour >= K.C2_HOUR_FROM) & (hour < K.C2_HOUR_TO)
        ),
    }


def normal_fingerprints(labelled: DataFrame) -> DataFrame:
    """Fingerprints seen in flows labelled NORMAL."""
    return labelled.where("flow_label = 'NORMAL'").select("ja3_hash").distinct()


def fingerprint_columns(flows: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Known bad fingerprint, and fingerprint absent from the baseline (0 without a baseline)."""
    known = flag(F.col("ja3_hash") == K.KNOWN_C2_JA3)
    if baseline is None:
        return flows.withColumns({"is_known_c2_ja3": known, "ja3_unseen_in_normal": F.lit(0)})
    seen = baseline.select("ja3_hash").distinct().withColumn("_seen", F.lit(True))
    return flows.join(seen, "ja3_hash", "left").withColumns(
        {"is_known_c2_ja3": known, "ja3_unseen_in_normal": flag(F.col("_seen").isNull())}
    ).drop("_seen")


def unseen_fingerprints(flows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Flows whose fingerprint is not in the baseline."""
    return flows.join(baseline.select("ja3_hash"), "ja3_hash", "left_anti")


def source_stats(flows: DataFrame) -> DataFrame:
    """Distinct destinations and flow count per source."""
    return flows.groupBy("src_ip").agg(
        F.countDistinct("dst_ip").alias("unique_dst_ips"), F.count("flow_id").alias("flow_count")
    )


def join_source_stats(flows: DataFrame, stats: DataFrame) -> DataFrame:
    return flows.join(stats, "src_ip", "left").fillna(0, ["unique_dst_ips", "flow_count"])


def swift_rolling_counts(flows: DataFrame) -> DataFrame:
    """flow_id and its source's count of SWIFT database flows in the last two minutes."""
    swift = flows.where(is_swift_sql() & F.col("start_time").isNotNull()).select(
        "flow_id", "src_ip", F.unix_micros("start_time").alias("us")
    )
    return rolling_counts(swift, ["src_ip"], "us", "flow_id", {"count_2min": 2 * K.MINUTE})


def swift_rate_stats(counted: DataFrame) -> DataFrame:
    """One row: mean and sample deviation (plus 1e-9) of the two-minute counts."""
    return counted.agg(
        F.coalesce(F.avg("count_2min"), F.lit(0.0)).alias("mean"),
        (F.coalesce(F.stddev_samp("count_2min"), F.lit(0.0)) + 1e-9).alias("std"),
    )


def swift_rate_columns(flows: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Adds z-score and alarm of the two-minute count.

    Flows that are no SWIFT queries get 0 and take no part in the join.
    """
    counted = settle(swift_rolling_counts(flows), "swift-rate")
    stats = swift_rate_stats(counted) if stats is None else stats
    rated = counted.withColumn("s", stats.select(F.struct("mean", "std")).scalar()).select(
        "flow_id",
        ((F.col("count_2min") - F.col("s.mean")) / F.col("s.std")).alias("swift_query_zscore"),
        (F.col("count_2min") > 400).cast("int").alias("swift_rate_exceeded"),
    )
    swift = F.coalesce(is_swift_sql() & F.col("start_time").isNotNull(), F.lit(False))
    others = flows.where(~swift).withColumns(
        {"swift_query_zscore": F.lit(0.0), "swift_rate_exceeded": F.lit(0)}
    )
    found = flows.where(swift).join(rated, "flow_id", "left").fillna(0, ["swift_query_zscore", "swift_rate_exceeded"])
    return found.unionByName(others)


def flow_feature_vector(
    flows: DataFrame,
    baseline: DataFrame | None = None,
    rate_stats: DataFrame | None = None,
    src_stats: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """All model inputs of a flow. ``flows`` has one row per flow_id and carries ja3_hash.

    Statistics left out are computed from the flows themselves, as in training. The flows are read
    by several branches, so pass a stored table, not a long plan.
    """
    if baseline is None and "flow_label" in flows.columns:
        baseline = normal_fingerprints(flows)
    stats = source_stats(flows) if src_stats is None else src_stats
    out = swift_rate_columns(flows, rate_stats)
    out = join_source_stats(out, stats)
    out = fingerprint_columns(out, baseline)
    out = out.withColumns({**traffic_columns(), **segment_columns(), **port_columns(), **time_columns()})
    out = out.withColumn("flag_syn_only", flag(F.col("tcp_flags") == "S"))
    features = ["bytes_sent_per_sec", *K.CLASSIFIER_FEATURES]
    return out.select("flow_id", *(keep or []), *[finite(c).alias(c) for c in features])
