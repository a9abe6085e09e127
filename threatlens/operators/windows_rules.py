"""Rules over Windows security events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.expressions import flag_array, high_value_name, off_hours_clock, technique_pairs
from .cleaning import host_context, resolve_source_ip
from .ordered import prefix_sums, rolling_counts

# event ids handled without looking at other events
PLAIN_IDS = [1102, 7045, 4688, 4672, 4648, 4740, 4698, 4720, 4771, 4769, 4624]
BRUTE_FORCE_LIMIT = 10
SHARE_LIMIT = 50


def _lowered(events: DataFrame) -> DataFrame:
    names = ["subject_username", "target_username", "process_name", "parent_process"]
    return events.withColumns(
        {**{f"_{n}": F.lower(F.coalesce(n, F.lit(""))) for n in names}, "_off": off_hours_clock("event_time")}
    )


def brute_force_window(events: DataFrame) -> DataFrame:
    """Failed logons with the target's count in (t-5 min, t] and the resulting alert, if any."""
    failed = (
        _lowered(events.where("event_id = 4625"))
        .where(F.col("event_time").isNotNull())
        .withColumn("_us", F.unix_micros("event_time"))
    )
    counted = rolling_counts(
        failed, ["_target_username"], "_us", "event_log_id",
        {"n_failures": 5 * K.MINUTE, "n_last_5s": 5 * K.SECOND},
    )
    many = F.col("n_failures") >= BRUTE_FORCE_LIMIT
    # All failures of the window lie within the last five seconds.
    fast = F.col("n_last_5s") == F.col("n_failures")
    lone = ~many & F.col("_off") & high_value_name("_target_username")
    return counted.withColumns(
        {
            "alert": F.when(many & fast, F.struct(F.lit(0.90).alias("score"), F.lit("brute_force").alias("flag")))
            .when(many, F.struct(F.lit(0.70).alias("score"), F.lit("brute_force").alias("flag")))
            .when(lone, F.struct(F.lit(0.80).alias("score"), F.lit("kerberoasting").alias("flag"))),
            "category": F.lit("BRUTE_FORCE"),
        }
    )


def share_access_running(events: DataFrame) -> DataFrame:
    """Share accesses with the running count of the user."""
    shares = _lowered(events.where("event_id = 5140")).withColumn(
        "_us", F.coalesce(F.unix_micros("event_time"), F.lit(0))
    )
    counted = prefix_sums(
        shares, ["_subject_username"], "_us", "event_log_id", {"_before": F.lit(1)}
    )
    return counted.withColumn("share_count", F.col("_before") + 1)


def _plain_alerts(case_fix: bool) -> tuple[Column, Column]:
    """(score, flag) and category of the rules that look at one event alone."""
    event, process, parent = F.col("event_id"), F.col("_process_name"), F.col("_parent_process")
    subject, off = F.col("_subject_username"), F.col("_off")

    def alert(score, name: str) -> Column:
        value = score if isinstance(score, Column) else F.lit(score)
        return F.struct(value.cast("double").alias("score"), F.lit(name).alias("flag"))

    late = F.when(off, F.lit(0.80)).otherwise(F.lit(0.50))
    listed = {(n.lower() if case_fix else n): v for n, v in K.LISTED_PROCESS.items()}

    service = F.when(F.col("hostname").startswith("ATM-"), alert(1.0, "new_service_atm"))
    created = None
    for (child, by), score in K.PARENT_COMBO.items():
        hit = (process == child) & (parent == by)
        value = alert(score, "suspicious_process")
        created = F.when(hit, value) if created is None else created.when(hit, value)
    for name, (mark, score) in listed.items():
        service = service.when(process == name, alert(score, "new_service"))
        created = created.when(process == name, alert(score, mark))
    service = service.otherwise(alert(0.45, "new_service"))

    sensitive = F.coalesce(F.col("_segment").isin("CORE_BANKING", "SWIFT"), F.lit(False))
    task = F.when(off | sensitive, F.lit(0.80)).otherwise(F.lit(0.50))
    shell = (F.col("logon_type") == 3) & process.isin(K.HASH_LOGON_PROCESS)
    unusual = F.coalesce(F.col("logon_type").isin(7, 8, 10), F.lit(False))
    logon = F.when(F.coalesce(shell, F.lit(False)), alert(0.85, "pass_the_hash")).when(
        off & unusual, alert(0.50, "off_hours_logon")
    )
    privileged = ~subject.isin(K.ADMIN_ACCOUNTS) & ~subject.endswith("$")
    found = (
        F.when(event == 1102, alert(1.0, "audit_log_cleared"))
        .when(event == 7045, service)
        .when(event == 4688, created)
        .when(event == 4672, F.when(privileged, alert(late, "priv_escalation")))
        .when(event == 4648, alert(late, "explicit_credential"))
        .when(event == 4740, alert(0.50, "account_lockout"))
        .when(event == 4698, alert(task, "scheduled_task"))
        .when(event == 4720, alert(late, "user_created"))
        .when(event == 4771, F.when(off & high_value_name("_target_username"), alert(0.80, "kerberoasting")))
        .when(
            event == 4769,
            F.when(
                off & high_value_name("_target_username", "_subject_username"), alert(0.80, "kerberoasting")
            ),
        )
        .when(event == 4624, logon)
    )
    name = F.col("alert.flag")
    category = (
        F.when(name == "new_service_atm", "ATM_JACKPOTTING")
        .when(name.isin("explicit_credential", "pass_the_hash"), "LATERAL_MOVEMENT")
        .when(name.isin("account_lockout", "kerberoasting"), "BRUTE_FORCE")
        .when(name == "off_hours_logon", F.lit(None).cast("string"))
        .otherwise("INSIDER_THREAT")
    )
    return found, category


def windows_event_rules(events: DataFrame, hosts: DataFrame, case_fix: bool = False) -> DataFrame:
    """One row per alert. Three branches by event id: plain rules, failed logons, share accesses.

    Listed process names are compared as written with the lower-cased name, so mixed-case entries
    never match unless ``case_fix`` is set.
    """
    context = host_context(hosts)
    segment = context.select("hostname", F.col("segment").alias("_segment"))
    found, category = _plain_alerts(case_fix)
    plain = (
        _lowered(events.where(F.col("event_id").isin(PLAIN_IDS)))
        .join(segment, "hostname", "left")
        .withColumn("alert", found)
        .withColumn("category", category)
    )
    shares = share_access_running(events).where(F.col("share_count") >= SHARE_LIMIT).withColumns(
        {
            "alert": F.struct(F.lit(0.75).alias("score"), F.lit("share_access_bulk").alias("flag")),
            "category": F.lit("RANSOMWARE_STAGING"),
        }
    )
    layout = [
        "event_log_id", "event_time", "event_id", "hostname", "source_ip",
        F.col("_subject_username").alias("username"),
        F.col("alert.score").alias("score"),
        F.col("alert.flag").alias("flag"),
        "category",
    ]
    parts = [p.where(F.col("alert").isNotNull()).select(*layout) for p in (plain, brute_force_window(events), shares)]
    alerts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return resolve_source_ip(alerts, hosts)


def windows_results(alerts: DataFrame) -> DataFrame:
    """Alerts in the common result layout."""
    marks = [(F.col("flag") == name, name) for name in K.WINDOWS_FLAG_TECHNIQUE]
    return alerts.select(
        F.col("event_log_id").alias("event_ref"),
        F.concat_ws("@", "username", "hostname").alias("entity"),
        F.lit("windows").alias("source"),
        "event_time", "score",
        F.lit(0.0).alias("ml_score"), F.col("score").alias("rule_score"),
        flag_array(marks).alias("flags"),
        technique_pairs(marks, K.WINDOWS_FLAG_TECHNIQUE).alias("mitre"),
        "source_ip", "username", "hostname", "event_log_id",
    )


def scores_back_to_events(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every event with the score of its alert, 0 without one."""
    scored = alerts.groupBy("event_log_id").agg(F.max("score").alias("score"))
    return events.join(scored, "event_log_id", "left").fillna(0.0, ["score"])
