"""Table readers with explicit schemas; unparsable fields become null instead of failing the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import finite_or_null

SCHEMAS = {
    "hosts": "hostname string, ip_address string, segment string, criticality string, is_honeypot string",
    "netflow": (
        "flow_id string, src_ip string, dst_ip string, start_time string, duration_sec double, bytes_sent double, "
        "packets_sent bigint, packets_recv bigint, segment string, is_internal_src boolean, is_internal_dst boolean, "
        "dst_port int, src_port int, protocol string, tcp_flags string"
    ),
    "flow_labels": "flow_id string, is_attack boolean",
    "zeek": (
        "log_id string, ts string, id_orig_h string, id_resp_h string, id_resp_p int, service string, "
        "conn_state string, duration double, orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, "
        "ja3_hash string, is_anomaly boolean"
    ),
    "windows_events": (
        "event_log_id string, event_time string, event_id int, hostname string, subject_username string, "
        "target_username string, process_name string, parent_process string, source_ip string, logon_type int, "
        "is_anomaly boolean"
    ),
    "ueba": (
        "ueba_id bigint, event_time string, username string, hostname string, source_ip string, event_type string, "
        "resource_accessed string, bytes_transferred string, duration_sec string, failed_attempts_prior_1h string, "
        "peer_group_deviation_score string, is_off_hours string, is_new_resource string, is_anomaly boolean"
    ),
    "tickets": "incident_id string, attack_pattern string, affected_assets string",
}
TIME_COLUMN = {
    "netflow": "start_time",
    "zeek": "ts",
    "windows_events": "event_time",
    "ueba": "event_time",
}
LIVE_SCHEMA = (
    "flow_id string, src_ip string, dst_ip string, start_time string, duration_sec string, packets_sent string, "
    "packets_recv string, bytes_sent string, bytes_recv string, segment string, is_internal_src string, "
    "is_internal_dst string, dst_port string, tcp_flags string, ja3_hash string, sim_packet_score string, "
    "sim_behavior_score string"
)


def require_columns(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Only the wanted columns, in order; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    return df.select(*columns)


def coerce_time(df: DataFrame, column: str) -> DataFrame:
    """Timestamp column; text that is no timestamp becomes null."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, F.try_to_timestamp(column))
    return df.withColumn(column, F.col(column).cast("timestamp"))


def read_table(
    spark: SparkSession, name: str, path: str, fmt: str = "csv", columns: list[str] | None = None
) -> DataFrame:
    """A log table with its schema; ``columns`` prunes the scan."""
    if fmt == "csv":
        df = spark.read.schema(SCHEMAS[name]).option("header", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    wanted = columns or [f.split()[0] for f in SCHEMAS[name].split(", ")]
    df = require_columns(df, wanted, name)
    time = TIME_COLUMN.get(name)
    return coerce_time(df, time) if time in wanted else df


def clean_netflow(df: DataFrame) -> DataFrame:
    """Infinite or NaN numbers become null; rows without source or destination are dropped."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return coerce_time(df, "start_time").withColumns(
        {c: finite_or_null(c) for c in numeric}
    ).dropna(subset=["src_ip", "dst_ip"])


def read_seed_list(spark: SparkSession, path: str) -> DataFrame:
    """One flow id per line; blank lines are ignored, repeated ids count once."""
    return (
        spark.read.text(path)
        .select(F.trim("value").alias("flow_id"))
        .where(F.col("flow_id") != "")
        .distinct()
    )


SCORE_NAMES = ["score", "threat_score", "behavior_score", "packet_score"]


def agent_scores(df: DataFrame | None, score_col: str, spark: SparkSession | None = None) -> DataFrame:
    """Largest score per src_ip. The score is looked for under its own and the usual other names."""
    if df is None or "source_ip" not in df.columns:
        session = spark or df.sparkSession
        return session.createDataFrame([], f"src_ip string, {score_col} double")
    found = next((c for c in [score_col, *SCORE_NAMES] if c in df.columns), None)
    score = F.col(found).cast("double") if found else F.lit(0.0)
    return (
        df.select(F.col("source_ip").alias("src_ip"), score.alias(score_col))
        .where(F.col("src_ip").isNotNull())
        .groupBy("src_ip").agg(F.max(score_col).alias(score_col))
    )
