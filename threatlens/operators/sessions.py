"""Activity sessions per address, session features and nearest-session alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.expressions import flag
from ..session import settle
from .ip_features import (
    mark_off_hours,
    windows_aggregates,
    windows_ratios,
    zeek_aggregates,
    zeek_ratios,
)
from .ordered import PART, ranged, running

GAP = 15 * K.MINUTE


def session_numbers(
    instants: DataFrame, key: str, at: str = "us", gap: int = GAP, parts: int | None = None
) -> DataFrame:
    """Session number of each distinct (key, instant): a gap above ``gap`` opens the next session.

    Instants are dealt into range partitions (see ``ordered``). The instant before the first one of a key in
    a partition and the number of sessions opened earlier come from a table of one row per key and partition.
    """
    cells = ranged(instants.select(key, at).distinct(), [F.col(key), F.col(at)], parts)
    inside = Window.partitionBy(key, PART).orderBy(at)
    cells = cells.withColumn("_prev", F.lag(at).over(inside))
    opens = flag(F.col(at) - F.col("_prev") > F.lit(gap))
    cells = cells.withColumn("_open", opens)

    over_parts = Window.partitionBy(key).orderBy(PART)
    blocks = cells.groupBy(key, PART).agg(
        F.min(at).alias("_first"), F.max(at).alias("_last"), F.sum("_open").alias("_opened")
    ).withColumn("_before", F.lag("_last").over(over_parts))
    first_opens = flag(F.col("_before").isNull() | (F.col("_first") - F.col("_before") > F.lit(gap)))
    blocks = blocks.withColumn("_first_opens", first_opens)
    earlier = F.coalesce(
        F.sum(F.col("_opened") + F.col("_first_opens")).over(
            over_parts.rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    base = (earlier + F.col("_first_opens")).alias("_base")
    # A key whole in one partition starts at 1; the others are at most one per border.
    blocks = blocks.withColumn("_base", base).where("_base <> 1").select(key, PART, "_base")
    opened = F.sum("_open").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cells.withColumn("_run", opened).join(F.broadcast(blocks), [key, PART], "left").select(
        key, at, (F.coalesce("_base", F.lit(1)) + F.col("_run")).cast("long").alias("session_seq")
    )


def sessionize(df: DataFrame, key: str, time: str, gap: int = GAP) -> DataFrame:
    """Adds session_seq (1, 2, … per key) and session_id = key_seq."""
    timed = df.where(F.col(time).isNotNull()).withColumn("us", F.unix_micros(time))
    numbered = session_numbers(timed, key, "us", gap)
    return (
        timed.join(numbered, [key, "us"])
        .withColumn("session_id", F.concat_ws("_", F.col(key), F.col("session_seq").cast("string")))
        .select(*df.columns, "session_seq", "session_id")
    )


def windows_sessions(events: DataFrame, busy: DataFrame, gap: int = GAP) -> DataFrame:
    """Windows features per (address, session) with session start and number of labelled events."""
    cleaned = events.withColumn("source_ip", F.coalesce("source_ip", F.lit("LOCAL")))
    numbered = sessionize(mark_off_hours(cleaned, busy, "event_time"), "source_ip", "event_time", gap)
    return windows_ratios(
        numbered.groupBy("source_ip", "session_id").agg(
            F.min("event_time").alias("win_session_start"),
            *windows_aggregates(),
            F.sum(flag(F.col("is_anomaly"))).alias("win_gt_anomaly_events"),
        )
    )


def zeek_sessions(zeek: DataFrame, busy: DataFrame, gap: int = GAP) -> DataFrame:
    numbered = sessionize(mark_off_hours(zeek, busy, "ts"), "id_orig_h", "ts", gap)
    return zeek_ratios(
        numbered.groupBy(F.col("id_orig_h").alias("source_ip"), "session_id").agg(
            F.min("ts").alias("zeek_session_start"),
            *zeek_aggregates(),
            F.sum(flag(F.col("is_anomaly"))).alias("zeek_gt_anomaly_conns"),
        )
    )


def nearest_start(
    left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, tolerance: int = GAP,
    parts: int | None = None,
) -> DataFrame:
    """For each left (key, instant) the nearest right instant within tolerance; a tie goes backward.

    Both sides are merged on one time line per key: the last right instant up to a left one and the first
    one after it are a running maximum and a minimum ahead.
    """
    lefts = left.select(key, F.col(left_at).alias("us")).distinct().withColumn("_side", F.lit(1))
    rights = right.select(key, F.col(right_at).alias("us")).distinct().withColumn("_side", F.lit(0))
    line = lefts.unionByName(rights).where(F.col(key).isNotNull() & F.col("us").isNotNull())
    own = F.when(F.col("_side") == 0, F.col("us"))
    near = running(
        line, [key], ["us", "_side"], maxima={"_back": own}, least_ahead={"_ahead": own}, parts=parts
    ).where("_side = 1")
    behind, before = F.col("us") - F.col("_back"), F.col("_ahead") - F.col("us")
    pick = (
        F.when(F.col("_ahead").isNull() | (behind <= before), F.col("_back"))
        .otherwise(F.col("_ahead"))
    )
    pick = F.when(F.abs(F.col("us") - pick) <= F.lit(tolerance), pick)
    return near.select(key, F.col("us").alias(left_at), pick.alias(right_at)).where(
        F.col(right_at).isNotNull()
    )


def align_sessions(windows: DataFrame, zeek: DataFrame, tolerance: int = GAP) -> DataFrame:
    """Windows sessions with their nearest Zeek session, plus Zeek sessions nobody matched.

    Missing numbers are 0; missing session starts stay null.
    """
    win = settle(windows.withColumn("_l", F.unix_micros("win_session_start")).drop("session_id"), "win")
    zk = settle(zeek.withColumn("_r", F.unix_micros("zeek_session_start")).drop("session_id"), "zeek")
    pairs = settle(nearest_start(win, zk, "source_ip", "_l", "_r", tolerance), "pairs")
    matched = win.join(pairs, ["source_ip", "_l"], "left").join(zk, ["source_ip", "_r"], "left")
    unmatched = zk.join(pairs.select("source_ip", "_r").distinct(), ["source_ip", "_r"], "left_anti")
    out = matched.unionByName(unmatched, allowMissingColumns=True).drop("_l", "_r")
    starts = ["source_ip", "win_session_start", "zeek_session_start"]
    return out.fillna(0, [c for c in out.columns if c not in starts])


def label_sessions(combined: DataFrame) -> DataFrame:
    """A session is anomalous if any event in it was labelled."""
    return combined.withColumn(
        "session_label",
        flag((F.col("win_gt_anomaly_events") > 0) | (F.col("zeek_gt_anomaly_conns") > 0)),
    )
