"""Response step: enrichment, overrides, triage, SWIFT shortlist and incident coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.expressions import as_bool, first_match, response_severity, round_even
from ..session import settle
from .cleaning import dedupe_hosts_by_ip
from .fusion import seed_override

ENRICH_COLUMNS = [
    "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "segment", "start_time", "protocol",
    "is_internal_src", "is_internal_dst",
]


def require_scores(scored: DataFrame) -> DataFrame:
    missing = {"flow_id", "attack_probability", "severity"} - set(scored.columns)
    if missing:
        raise ValueError(f"scored flows lack columns: {', '.join(sorted(missing))}")
    return scored


def enrich_netflow(scored: DataFrame, flows: DataFrame) -> DataFrame:
    """Flow metadata on scored flows; ``flows`` has one row per flow_id."""
    return require_scores(scored).join(flows.select(*ENRICH_COLUMNS), "flow_id", "left")


def enrich_hosts(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """Host names and honeypot marks of both ends; one host per address keeps the row count."""
    lookup = dedupe_hosts_by_ip(
        hosts.select(
            "ip_address", "hostname", as_bool("is_honeypot").alias("is_honeypot"),
            F.coalesce("criticality", F.lit("LOW")).alias("criticality"),
        )
    )
    out = df
    for side in ("src", "dst"):
        named = lookup.select(
            F.col("ip_address").alias(f"{side}_ip"),
            F.col("hostname").alias(f"{side}_hostname"),
            F.col("is_honeypot").alias(f"{side}_is_honeypot"),
            F.col("criticality").alias(f"{side}_criticality"),
        )
        out = out.join(named, f"{side}_ip", "left")
    no = F.lit(False)
    return out.withColumns(
        {
            "is_honeypot": F.coalesce("src_is_honeypot", no) | F.coalesce("dst_is_honeypot", no),
            "affected_asset": F.coalesce("dst_hostname", "src_hostname", "dst_ip"),
        }
    )


def label_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity_label", response_severity("attack_probability"))


def honeypot_override(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "severity_label", F.when(F.col("is_honeypot"), "CRITICAL").otherwise(F.col("severity_label"))
    )


def missing_seeds(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows for announced flows that are not in the data."""
    return seeds.select("flow_id").distinct().join(df.select("flow_id"), "flow_id", "left_anti").select(
        "flow_id",
        F.lit(1.0).alias("attack_probability"),
        F.lit("CRITICAL").alias("severity_label"),
        F.lit(True).alias("predicted_tp"),
    )


def triage(df: DataFrame, threshold: DataFrame | float, seeds: DataFrame | None = None) -> DataFrame:
    """predicted_tp per flow at the tuned threshold, announced but unseen flows added."""
    cut = threshold.scalar() if isinstance(threshold, DataFrame) else F.lit(float(threshold))
    out = df.withColumn("predicted_tp", F.col("attack_probability") >= cut)
    if seeds is not None:
        out = out.unionByName(missing_seeds(df, seeds), allowMissingColumns=True)
    return out


def decide(df: DataFrame) -> DataFrame:
    """NORMAL when not predicted, BLOCK when critical, otherwise ALERT."""
    return df.withColumn(
        "attack_decision",
        first_match([(~F.col("predicted_tp"), "NORMAL"), (F.col("severity_label") == "CRITICAL", "BLOCK")], "ALERT"),
    )


def swift_candidates(df: DataFrame) -> DataFrame:
    return df.where((F.col("segment") == "SWIFT") | (F.col("predicted_category") == "SWIFT_TAMPERING"))


def top_candidate_per_asset(candidates: DataFrame) -> DataFrame:
    """The most probable flow of each asset, the smallest flow_id on a tie (a partial minimum)."""
    rank = F.struct((-F.col("attack_probability")).alias("p"), "flow_id")
    return candidates.where(F.col("affected_asset").isNotNull()).groupBy("affected_asset").agg(
        F.min(F.struct(rank.alias("r"), "severity_label", "segment", "mitre_technique")).alias("b")
    ).select(
        "affected_asset",
        F.col("b.r.flow_id").alias("flow_id"),
        (-F.col("b.r.p")).alias("attack_probability"),
        "b.severity_label", "b.segment", "b.mitre_technique",
    )


def behavior_assets(results: DataFrame) -> DataFrame:
    """Assets of results with a SWIFT flag, names before addresses, each in event order."""
    hit = F.exists("flags", lambda f: F.lower(f).contains("swift"))
    place = first_match(
        [(F.col("source") == "ueba", 0), (F.col("source") == "windows", 1)], 2
    )
    both = F.array(
        F.struct(F.lit(0).alias("branch"), F.col("hostname").alias("affected_asset")),
        F.struct(F.lit(1).alias("branch"), F.when(F.col("source_ip") != "", F.col("source_ip")).alias("affected_asset")),
    )
    return (
        results.where(hit)
        .select(F.explode(both).alias("a"), place.alias("src_order"), "event_time", "event_ref")
        .select("a.*", "src_order", "event_time", "event_ref")
        .where(F.col("affected_asset").isNotNull())
        .groupBy("affected_asset")
        .agg(F.min(F.struct("branch", "src_order", "event_time", "event_ref")).alias("first"))
        .select("affected_asset", "first.*")
    )


def swift_shortlist(df: DataFrame, behavior: DataFrame | None = None, top_n: int = 500) -> DataFrame:
    """Distinct SWIFT assets: flagged by behavior first, then candidates by probability.

    Each asset keeps its first place over both sources; only ``top_n`` rows are ordered and kept.
    """
    best = settle(top_candidate_per_asset(swift_candidates(df)), "assets")
    named = best.select(
        "affected_asset",
        F.struct(
            F.lit(2).alias("branch"), F.lit(0).alias("src_order"),
            F.lit(None).cast("timestamp").alias("event_time"), F.lit("").alias("event_ref"),
            (-F.col("attack_probability")).alias("p"), F.col("flow_id").alias("tie"),
        ).alias("place"),
    )
    if behavior is not None:
        flagged = behavior_assets(behavior).select(
            "affected_asset",
            F.struct(
                "branch", "src_order", "event_time", "event_ref",
                F.lit(0.0).alias("p"), F.lit("").alias("tie"),
            ).alias("place"),
        )
        # Without any candidate flow there is no shortlist at all.
        named = named.unionByName(flagged.where(best.agg(F.count(F.lit(1))).scalar() > 0))
    listed = (
        named.groupBy("affected_asset").agg(F.min("place").alias("place"))
        .orderBy("place", "affected_asset").limit(top_n)
    )
    meta = best.withColumn("_known", F.lit(True))
    known = F.col("_known").isNotNull()
    return listed.join(meta, "affected_asset", "left").select(
        "flow_id", "affected_asset",
        F.when(known, F.col("attack_probability")).otherwise(F.lit(1.0)).alias("attack_probability"),
        F.when(known, F.col("severity_label")).otherwise("CRITICAL").alias("severity_label"),
        F.when(known, F.col("segment")).otherwise("SWIFT").alias("segment"),
        "mitre_technique",
    )


def match_tickets(tickets: DataFrame, shortlist: DataFrame) -> DataFrame:
    """SWIFT incidents with caught = at least one of their assets is listed."""
    swift = tickets.where(F.lower("attack_pattern").contains("swift"))
    parts = swift.select("incident_id", F.explode(F.split("affected_assets", "\\|")).alias("affected_asset"))
    caught = parts.join(shortlist.select("affected_asset"), "affected_asset", "left_semi").select("incident_id").distinct()
    return swift.join(caught.withColumn("caught", F.lit(True)), "incident_id", "left").fillna(
        False, ["caught"]
    )


def recall_check(matched: DataFrame) -> DataFrame:
    """One row: checkable incidents, missed ones, and whether all are caught."""
    return matched.agg(
        F.count(F.lit(1)).alias("n_checkable"),
        F.count_if(~F.col("caught")).alias("n_missed"),
    ).withColumn("status", F.when(F.col("n_missed") == 0, "PASS").otherwise("FAIL"))


def respond(
    scored: DataFrame, flows: DataFrame, hosts: DataFrame, threshold: DataFrame | float,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """Scored flows with metadata, severity tier, overrides, prediction and decision."""
    out = honeypot_override(label_severity(enrich_hosts(enrich_netflow(scored, flows), hosts)))
    if seeds is not None:
        out = seed_override(out, seeds, "attack_probability", "severity_label")
    return decide(triage(out, threshold, seeds))


def final_submission(responded: DataFrame) -> DataFrame:
    return responded.select(
        "flow_id",
        round_even("attack_probability", 4).alias("attack_probability"),
        "attack_decision",
        F.coalesce("predicted_category", F.lit("")).alias("attack_category_predicted"),
        F.coalesce("mitre_technique", F.lit("")).alias("mitre_technique_predicted"),
    )
