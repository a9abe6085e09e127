"""Cleaning, deduplication and imputation.

"First row per key" is a minimum over a struct, not a window: partial minima are taken before the
shuffle, so a key with very many copies costs one row per task. Where keys are all but unique only the
repeated ones are exchanged at all.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_bool, is_blank
from ..session import settle


def _same_key(df: DataFrame, repeated: DataFrame, keys: list[str]):
    return reduce(and_, [df[k].eqNullSafe(repeated[f"_key_{k}"]) for k in keys])


def first_per_key(df: DataFrame, keys: list[str], order: list[str], repeated: DataFrame | None = None) -> DataFrame:
    """The first row per key in the given order, remaining columns breaking ties (nulls first)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    df = df if repeated is None else df.join(repeated, _same_key(df, repeated, keys), "left_semi")
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def first_where_repeated(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``first_per_key`` for keys that are nearly unique: whole rows of other keys are not exchanged.

    The repeated keys are found from the key columns alone and stored, so their measured size decides how they
    are joined; without any, the table is returned as it is.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = settle(counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys]), "repeated-keys")
    if repeated.isEmpty():
        return df
    once = df.join(repeated, _same_key(df, repeated, keys), "left_anti")
    return once.unionByName(first_per_key(df, keys, order, repeated))


def dedupe_flows(flows: DataFrame) -> DataFrame:
    """One row per flow_id: the earliest, then the smallest by the other columns."""
    return first_where_repeated(flows, ["flow_id"], ["start_time"])


def dedupe_windows_events(events: DataFrame) -> DataFrame:
    """Copies of an event fall on the same host, user, id and (nearest) second; the earliest stays."""
    second = F.bround(F.unix_micros("event_time") / F.lit(1e6)).cast("long")
    keyed = events.withColumn("_second", second)
    keys = ["hostname", "_second", "event_id", "subject_username"]
    return first_per_key(keyed, keys, ["event_time", "event_log_id"]).drop("_second")


def impute_local_ip(events: DataFrame, column: str = "source_ip") -> DataFrame:
    return events.withColumn(column, F.when(is_blank(column), F.lit("LOCAL")).otherwise(F.col(column)))


def dedupe_hosts_by_ip(hosts: DataFrame) -> DataFrame:
    """One host per address, so that enrichment cannot multiply flows."""
    return first_per_key(hosts, ["ip_address"], ["hostname"])


def host_context(hosts: DataFrame) -> DataFrame:
    """One row per host name with address, segment, criticality and honeypot mark, defaults filled."""
    cleaned = hosts.select(
        "hostname",
        "ip_address",
        F.coalesce("segment", F.lit("UNKNOWN")).alias("segment"),
        F.coalesce("criticality", F.lit("MEDIUM")).alias("criticality"),
        as_bool("is_honeypot").alias("is_honeypot"),
    )
    # Any honeypot entry marks the name; the other fields come from the largest entry.
    return cleaned.groupBy("hostname").agg(
        F.max(F.struct("ip_address", "segment", "criticality")).alias("h"),
        F.max("is_honeypot").alias("is_honeypot"),
    ).select("hostname", "h.ip_address", "h.segment", "h.criticality", "is_honeypot")


def resolve_source_ip(events: DataFrame, hosts: DataFrame, column: str = "source_ip") -> DataFrame:
    """Blank or LOCAL addresses are replaced by the host's address where it is known."""
    address = host_context(hosts).select("hostname", F.col("ip_address").alias("_host_ip"))
    known = F.when(~is_blank(column) & (F.col(column) != "LOCAL"), F.col(column))
    return (
        events.join(address, "hostname", "left")
        .withColumn(column, F.coalesce(known, "_host_ip", column))
        .select(*events.columns)
    )


def normalise_booleans(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: as_bool(c) for c in columns})
