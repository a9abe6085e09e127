"""User behavior events: features, running baselines, rules, query velocity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.expressions import (
    as_bool,
    first_match,
    flag,
    flag_array,
    hybrid_score,
    is_blank,
    lookup,
    model_only,
    round_even,
    technique_pairs,
)
from .cleaning import host_context, resolve_source_ip
from .ordered import prefix_sums, rolling_counts


def _number(name: str):
    return F.coalesce(F.expr(f"try_cast({name} AS DOUBLE)"), F.lit(0.0))


def _whole(name: str):
    return F.coalesce(F.expr(f"try_cast({name} AS BIGINT)"), F.lit(0))


def ueba_features(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The nine model inputs of a user event; unparsable numbers are 0."""
    columns = {
        "bytes_transferred": _number("bytes_transferred"),
        "duration_sec": _number("duration_sec"),
        "failed_attempts_prior_1h": _number("failed_attempts_prior_1h"),
        "peer_group_deviation_score": _number("peer_group_deviation_score"),
        "is_off_hours_num": as_bool("is_off_hours").cast("int"),
        "is_new_resource_num": as_bool("is_new_resource").cast("int"),
        "hour_of_day": F.coalesce(F.hour("event_time"), F.lit(12)),
        "day_of_week": F.coalesce(F.weekday("event_time"), F.lit(0)),
        "event_type_risk": lookup("event_type", K.EVENT_TYPE_RISK, K.EVENT_TYPE_RISK_DEFAULT),
    }
    return events.select("ueba_id", *(keep or []), *[columns[c].alias(c) for c in K.USER_FEATURES])


def user_profiles(events: DataFrame) -> DataFrame:
    """Per user: event count, byte total and mean, mean peer score, hours seen (at most 24)."""
    return events.groupBy(F.coalesce("username", F.lit("unknown")).alias("username")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(_whole("bytes_transferred")).alias("bytes_total"),
        F.avg(_whole("bytes_transferred")).alias("bytes_mean"),
        F.avg(_number("peer_group_deviation_score")).alias("peer_mean"),
        F.sort_array(F.collect_set(F.hour("event_time"))).alias("login_hours"),
    )


def user_baseline_bytes(events: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Adds avg_bytes: mean bytes of the user's training rows and of the rows scored before this one.

    Training history is kept under the name as written, scored history under the lower-case name;
    the look-up uses the lower-case name, so a mixed-case user starts without history (mean 0).
    """
    training = events if training is None else training
    trained = training.groupBy(F.col("username").alias("_user")).agg(
        F.sum(_whole("bytes_transferred")).alias("_tb"), F.count(F.lit(1)).alias("_tn")
    ).where(F.col("_user") == F.lower("_user"))
    keyed = events.withColumn("_user", F.lower(F.coalesce("username", F.lit("unknown"))))
    # An event without a time has no place in the order; it is taken first.
    keyed = keyed.withColumn("_us", F.coalesce(F.unix_micros("event_time"), F.lit(0)))
    running = prefix_sums(
        keyed, ["_user"], "_us", "ueba_id",
        {"_pb": _whole("bytes_transferred"), "_pn": F.lit(1)},
    )
    total = F.coalesce("_tb", F.lit(0)) + F.col("_pb")
    count = F.coalesce("_tn", F.lit(0)) + F.col("_pn")
    return (
        running.join(trained, "_user", "left")
        .withColumn("avg_bytes", F.when(count > 0, total / count).otherwise(F.lit(0.0)))
        .select(*events.columns, "avg_bytes")
    )


def ueba_rules(events: DataFrame, hosts: DataFrame, whitelist: list[str] | None = None) -> DataFrame:
    """Adds rule_score, flags and mitre. ``events`` carries avg_bytes from ``user_baseline_bytes``."""
    allowed = [u.lower() for u in (whitelist or K.RESOURCE_WHITELIST)]
    host = host_context(hosts).select(
        "hostname", F.col("segment").alias("_segment"), F.col("is_honeypot").alias("_honeypot")
    )
    user = F.lower(F.coalesce("username", F.lit("")))
    resource = F.lower(F.coalesce("resource_accessed", F.lit("")))
    service = user.startswith("srv_") | user.startswith("svc_")
    off = as_bool("is_off_hours") & ~service
    weekend = off & F.coalesce(
        (F.weekday("event_time") == K.C2_WEEKDAY) & F.hour("event_time").between(3, 5), F.lit(False)
    )
    peer = _number("peer_group_deviation_score")
    size, failed = _whole("bytes_transferred"), _whole("failed_attempts_prior_1h")
    low_user = F.col("avg_bytes") < 5_000_000
    huge, big = (size > 100_000_000) & low_user, (size > 50_000_000) & low_user
    new = as_bool("is_new_resource")
    swift_resource = resource.contains("swift")
    swift_off = off & F.coalesce(F.col("_segment") == "SWIFT", F.lit(False))
    unauthorised = resource.contains("pumori") & ~user.isin(allowed)
    honeypot = F.coalesce("_honeypot", F.lit(False))

    def points(*cases):
        return first_match(list(cases), 0.0)

    score = (
        points((off, 0.08))
        + points((weekend, 0.10))
        + points((peer >= 0.80, 0.25), (peer >= 0.65, 0.10))
        + points((huge, 0.35), (big, 0.15))
        + points((new & swift_resource, 0.20), (new, 0.05))
        + points((failed >= 10, 0.30), (failed >= 5, 0.10))
        + points((swift_off, 0.30))
        + points((unauthorised, 0.55))
        + points((honeypot, 0.60))
    )
    named = [
        (off, "off_hours"),
        (weekend, "weekend_early_morning"),
        (peer >= 0.80, "high_peer_deviation"),
        ((peer >= 0.65) & (peer < 0.80), "elevated_peer_deviation"),
        (huge | big, "large_data_transfer"),
        (new & swift_resource, "new_swift_resource"),
        (new & ~swift_resource, "new_resource"),
        (failed >= 10, "failed_access_spike"),
        ((failed >= 5) & (failed < 10), "failed_access_elevated"),
        (swift_off, "swift_off_hours"),
        (unauthorised, "unauthorized_pumori"),
        (honeypot, "honeypot_contact"),
    ]
    # Without a technique: the weekend mark, an ordinary new resource, a honeypot contact, and a
    # transfer that only reaches the lower size step.
    silent = {"weekend_early_morning", "new_resource", "honeypot_contact"}
    paired = [(huge if n == "large_data_transfer" else c, n) for c, n in named if n not in silent]
    return (
        events.join(host, "hostname", "left")
        .withColumns(
            {
                "rule_score": F.least(score, F.lit(1.0)),
                "flags": flag_array(named),
                "mitre": technique_pairs(paired, K.USER_FLAG_TECHNIQUE),
            }
        )
        .drop("_segment", "_honeypot")
    )


def hybrid_results(ruled: DataFrame, hosts: DataFrame) -> DataFrame:
    """Final score per user event from ml_score and rule_score, in the common result layout."""
    alone = model_only("ml_score", "rule_score")
    extra = F.when(alone, F.array(F.lit("ml_anomaly"))).otherwise(F.array().cast("array<string>"))
    pair = K.USER_FLAG_TECHNIQUE["ml_anomaly"]
    extra_pair = technique_pairs([(alone, "ml_anomaly")], {"ml_anomaly": pair})
    scored = ruled.withColumns(
        {
            "score": round_even(hybrid_score("ml_score", "rule_score"), 4),
            "flags": F.concat("flags", extra),
            "mitre": F.concat("mitre", extra_pair),
        }
    )
    return resolve_blank_ip(scored, hosts).select(
        F.col("ueba_id").cast("string").alias("event_ref"),
        F.concat_ws("@", "username", "hostname").alias("entity"),
        F.lit("ueba").alias("source"),
        "event_time", "score",
        round_even("ml_score", 4).alias("ml_score"),
        round_even("rule_score", 4).alias("rule_score"),
        "flags", "mitre", "source_ip", "username", "hostname",
    )


def resolve_blank_ip(events: DataFrame, hosts: DataFrame) -> DataFrame:
    """User events only replace a missing address; unknown hosts give an empty one."""
    address = host_context(hosts).select("hostname", F.col("ip_address").alias("_host_ip"))
    return (
        events.join(address, "hostname", "left")
        .withColumn(
            "source_ip",
            F.when(is_blank("source_ip"), F.coalesce("_host_ip", F.lit(""))).otherwise(F.col("source_ip")),
        )
        .drop("_host_ip")
    )


def swift_queries(events: DataFrame, hosts: DataFrame) -> DataFrame:
    """Database queries on SWIFT hosts or touching a SWIFT resource."""
    swift_hosts = host_context(hosts).where("segment = 'SWIFT'").select(
        "hostname", F.lit(True).alias("_swift")
    )
    touches = F.coalesce(F.lower("resource_accessed").contains("swift"), F.lit(False))
    return (
        events.where("event_type = 'DB_QUERY'")
        .join(swift_hosts, "hostname", "left")
        .where(F.coalesce("_swift", F.lit(False)) | touches)
        .drop("_swift")
    )


def swift_query_velocity(events: DataFrame, hosts: DataFrame, limit: int = 400) -> DataFrame:
    """First event per user that makes more than ``limit`` SWIFT queries within [t-2 min, t]."""
    queries = (
        swift_queries(events, hosts)
        .where(F.col("event_time").isNotNull() & F.col("username").isNotNull())
        .withColumn("_us", F.unix_micros("event_time"))
    )
    counted = rolling_counts(
        queries, ["username"], "_us", "ueba_id", {"count_in_window": 2 * K.MINUTE}, include_left=True
    )
    hits = counted.where(F.col("count_in_window") > limit)
    first = hits.groupBy("username").agg(
        F.min(F.struct("_us", "count_in_window", "ueba_id", "event_time", "hostname", "source_ip")).alias("f")
    ).select("username", "f.ueba_id", "f.event_time", "f.count_in_window", "f.hostname", "f.source_ip")
    return resolve_blank_ip(first, hosts)


def velocity_results(hits: DataFrame) -> DataFrame:
    pair = [(F.lit(True), "swift_query_velocity")]
    return hits.select(
        F.col("ueba_id").cast("string").alias("event_ref"),
        F.concat_ws("@", "username", "hostname").alias("entity"),
        F.lit("ueba_velocity").alias("source"),
        "event_time",
        F.lit(1.0).alias("score"), F.lit(0.0).alias("ml_score"), F.lit(1.0).alias("rule_score"),
        flag_array(pair).alias("flags"),
        technique_pairs(pair, K.USER_FLAG_TECHNIQUE).alias("mitre"),
        "source_ip", "username", "hostname",
    )


def score_ueba(events: DataFrame, hosts: DataFrame, ml_scores: DataFrame) -> DataFrame:
    """Rules and model scores (ueba_id, ml_score) fused per user event."""
    ruled = ueba_rules(user_baseline_bytes(events), hosts)
    return hybrid_results(
        ruled.join(ml_scores, "ueba_id", "left").fillna(0.0, ["ml_score"]), hosts
    )
