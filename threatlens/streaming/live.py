"""The live path as Structured Streaming jobs over appended flow records."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from ..functions.expressions import gated_fusion
from ..operators.flow_features import is_swift_sql
from ..operators.live_rules import classify_live
from ..operators.sessions import session_numbers
from ..session import fresh_folder, settle, stream_session
from ..sources.growing import follow_lines
from ..sources.readers import LIVE_SCHEMA
from .keyed_list import KeyedList

# The driver-side runner of stateful streams does not see shipped files, so the processor travels whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Scores of an alert, strongest evidence first.
ALERT_SCORES = ("correlation_score", "flow_score", "behavior_score", "packet_score")
ALERT_SCHEMA = "src_ip string, attack_name string, severity string, alert_time timestamp, " + ", ".join(
    f"{c} double" for c in ALERT_SCORES
)


def read_live_log(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Follows a flow log, or a folder of them, while records are appended; lines that do not parse are skipped."""
    return parse_live(follow_lines(spark, path, LIVE_SCHEMA, header))


def parse_live(raw: DataFrame) -> DataFrame:
    """Typed live records. A record whose numbers do not parse is malformed and dropped.

    The side scores fall back to .05 together when either is unusable.
    """
    def number(name: str, kind: str):
        return F.expr(f"try_cast({name} AS {kind})")

    packet, behavior = number("sim_packet_score", "DOUBLE"), number("sim_behavior_score", "DOUBLE")
    usable = packet.isNotNull() & behavior.isNotNull()
    typed = raw.withColumns(
        {
            "start_time": F.try_to_timestamp("start_time"),
            "packet_score": F.when(usable, packet).otherwise(F.lit(K.LIVE_DEFAULT_SCORE)),
            "behavior_score": F.when(usable, behavior).otherwise(F.lit(K.LIVE_DEFAULT_SCORE)),
            **{c: number(c, "DOUBLE") for c in ("duration_sec", "bytes_sent", "packets_sent", "packets_recv")},
            "dst_port": number("dst_port", "INT"),
            "is_internal_src": F.coalesce(F.col("is_internal_src") == "True", F.lit(False)),
            "is_internal_dst": F.coalesce(F.col("is_internal_dst") == "True", F.lit(False)),
        }
    )
    needed = ["duration_sec", "bytes_sent", "packets_sent", "packets_recv", "dst_port", "start_time"]
    return typed.dropna(subset=needed).drop("sim_packet_score", "sim_behavior_score")


def score_live(flows: DataFrame) -> DataFrame:
    """Fuses flow_score, behavior_score and packet_score and names the attack (stateless)."""
    fused = gated_fusion("flow_score", "behavior_score", "packet_score")
    return classify_live(flows.withColumn("correlation_score", fused))


def _candidates(scored: DataFrame) -> DataFrame:
    """One candidate per (source, attack, alert_time): severity and the scores of the strongest flow."""
    scores = F.struct(*ALERT_SCORES)
    # One condition on both columns stays above the watermark, so that benign flows move it on as well.
    named = F.when(F.col("alert_time").isNotNull(), F.col("attack_name")).isNotNull()
    return (
        scored.where(named)
        .groupBy("src_ip", "attack_name", "alert_time")
        .agg(F.min("live_severity").alias("severity"), F.max(scores).alias("s"))
        .select("src_ip", "attack_name", "severity", "alert_time", *[f"s.{c}" for c in ALERT_SCORES])
    )


def alert_candidates(scored: DataFrame) -> DataFrame:
    """One candidate per (source, attack, second): the log's time resolution.

    Batch form; the candidates of a key are bounded by its seconds, not by its flows.
    """
    return _candidates(scored.withColumn("alert_time", F.date_trunc("second", "start_time")))


class Cooldown(StatefulProcessor):
    """Emits a candidate when more than ``span`` microseconds have passed since the last emitted one.

    Candidates come once the watermark has passed them, so those of one batch are later than all before; the
    last emission is forgotten when the watermark has left its cooldown.
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("alert_time")
        micros = batch["alert_time"].astype("datetime64[us]").astype("int64").to_numpy()
        last = self.last.get()[0] if self.last.exists() else None
        kept = emitted(micros, self.span, last)
        if len(kept):
            last = int(micros[kept[-1]])
            self.last.update((last,))
            self.handle.registerTimer((last + self.span) // 1000 + 1)
            yield batch.iloc[kept][[c.split()[0] for c in ALERT_SCHEMA.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.span < expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def emitted(micros: np.ndarray, span: int, last: int | None = None) -> list[int]:
    """Places of the instants (ascending) that are emitted: jumps from one to the first beyond its cooldown."""
    kept, at = [], 0 if last is None else int(np.searchsorted(micros, last + span, "right"))
    while at < len(micros):
        kept.append(at)
        at = int(np.searchsorted(micros, micros[at] + span, "right"))
    return kept


def cooled_stream(scored: DataFrame, delay: str = "10 minutes", seconds: int = K.ALERT_COOLDOWN_SEC) -> DataFrame:
    """Streaming alerts with cooldown, emitted when the watermark has passed them.

    Flows may come out of order by up to ``delay``. They are first brought together per second, which keeps a
    busy source spread and its state bounded by the delay; then each (source, attack) is walked in time order.
    Needs a RocksDB state store (``stream_session``).
    """
    timed = scored.withColumn("alert_time", F.date_trunc("second", "start_time")).withWatermark("alert_time", delay)
    return _candidates(timed).groupBy("src_ip", "attack_name").transformWithStateInPandas(
        statefulProcessor=Cooldown(seconds * K.SECOND), outputStructType=ALERT_SCHEMA,
        outputMode="Append", timeMode="EventTime",
    )


def cooled_batch(candidates: DataFrame, seconds: int = K.ALERT_COOLDOWN_SEC) -> DataFrame:
    """Batch twin of the cooldown.

    A pause longer than the cooldown always lets the next alert through, so each stretch without such
    a pause stands alone: stretches, not sources, are spread over the tasks and walked in order.
    """
    timed = settle(candidates, "candidates").withColumns(
        {"us": F.unix_micros("alert_time"), "pair": F.concat_ws("\u0001", "src_ip", "attack_name")}
    )
    stretches = session_numbers(timed, "pair", "us", seconds * K.SECOND)
    columns = [c.split()[0] for c in ALERT_SCHEMA.split(", ")]
    ordered = (
        timed.join(stretches, ["pair", "us"])
        .repartition("pair", "session_seq")
        .sortWithinPartitions("pair", "session_seq", "us")
        .select("pair", "session_seq", "us", *columns)
    )

    span = seconds * K.SECOND

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A stretch arrives in order and may span batches, so only its last emission is kept.
        stretch, last = None, None
        for rows in batches:
            names = pd.MultiIndex.from_frame(rows[["pair", "session_seq"]])
            micros, edges = rows["us"].to_numpy(), np.flatnonzero(names[1:] != names[:-1]) + 1
            kept = []
            for a, b in zip([0, *edges], [*edges, len(rows)]):
                last = last if names[a] == stretch else None
                stretch = names[a]
                found = emitted(micros[a:b], span, last)
                last = int(micros[a + found[-1]]) if found else last
                kept += [a + i for i in found]
            yield rows.iloc[kept][columns]

    return ordered.mapInPandas(walk, ALERT_SCHEMA)


def counters(scored: DataFrame) -> DataFrame:
    """Total, benign and threat flows (a streaming aggregate in complete mode)."""
    return scored.groupBy().agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("attack_name").isNull()).alias("benign"),
        F.count_if(F.col("attack_name").isNotNull()).alias("threats"),
    )


class TrailingCount(StatefulProcessor):
    """Counts the arrivals of a source in (t - ``span``, t] at each of its instants, in microseconds.

    Instants come once the watermark has passed them, so those of one batch are later than all before. The state
    maps the instants of the last ``span`` to their arrivals; a timer clears it when the watermark has left them.
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrivals = handle.getMapState("arrivals", "us long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("start_time")
        kept = sorted((us[0], n[0]) for us, n in self.arrivals.iterator()) if self.arrivals.exists() else []
        fresh = batch["start_time"].astype("datetime64[us]").astype("int64").to_numpy()
        at = np.concatenate([np.array([us for us, _ in kept], dtype=np.int64), fresh])
        n = np.concatenate([np.array([n for _, n in kept], dtype=np.int64), batch["n"].to_numpy()])
        upto = np.cumsum(n)
        gone = np.searchsorted(at, at - self.span, side="right")
        trailing = upto - np.where(gone > 0, upto[gone - 1], 0)
        yield pd.DataFrame({
            "src_ip": key[0], "start_time": batch["start_time"].to_numpy(), "n_arrivals": batch["n"].to_numpy(),
            "count_2min": trailing[len(kept):],
        })
        last = int(at[-1])
        for us, _ in kept:
            if us <= last - self.span:
                self.arrivals.removeKey((us,))
        for us, count in zip(fresh, batch["n"], strict=True):
            if us > last - self.span:
                self.arrivals.updateValue((int(us),), (int(count),))
        self.handle.registerTimer((last + self.span) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.arrivals.exists():
            latest = max(us[0] for us in self.arrivals.keys())
            if latest + self.span < expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.arrivals.clear()
        yield from ()

    def close(self) -> None:
        pass


def arrival_rates(flows: DataFrame, delay: str = "10 minutes", seconds: int = 120) -> DataFrame:
    """Per source and instant its SWIFT database flows: n_arrivals, and count_2min in (t - 2 minutes, t].

    Exact at every arrival, as ``swift_rolling_counts`` is: the k-th flow of an instant has count_2min - n_arrivals + k.
    Flows may come out of order by up to ``delay``; an instant is emitted when the watermark has passed it. Flows are
    first brought together per (source, instant), so a busy source's flows are spread, and its state holds instants.
    Needs a RocksDB state store (``stream_session``).
    """
    swift = flows.where(is_swift_sql()).withWatermark("start_time", delay)
    instants = swift.groupBy("src_ip", "start_time").agg(F.count(F.lit(1)).alias("n"))
    return instants.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=TrailingCount(seconds * K.SECOND),
        outputStructType="src_ip string, start_time timestamp, n_arrivals long, count_2min long",
        outputMode="Append", timeMode="EventTime",
    )


def rate_windows(flows: DataFrame, delay: str = "10 minutes", size: str = "2 minutes", step: str = "10 seconds") -> DataFrame:
    """SWIFT database flows per source in sliding event-time windows.

    For append mode: a window is emitted once, when the watermark has passed its end, and leaves the state then;
    rows that come later than ``delay`` are dropped.
    """
    return (
        flows.where(is_swift_sql())
        .withWatermark("start_time", delay)
        .groupBy(F.window("start_time", size, step), "src_ip")
        .agg(F.count(F.lit(1)).alias("n_queries"))
        .select(
            "src_ip", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_queries"
        )
    )


# ── sinks ─────────────────────────────────────────────────────────────────────────────────────


def run_to_table(
    stream: Callable[[SparkSession], DataFrame], spark: SparkSession, label: str, fmt: str = "parquet",
    partitions: int | None = None,
) -> DataFrame:
    """Runs a stream over all available input into a new table below the shared folder; reads it back.

    ``stream`` builds the stream in a session of its own, whose settings (state store, number of state
    partitions) no other query sees.
    """
    own = stream_session(spark, partitions)
    df = stream(own)
    out, state = fresh_folder(spark, label), fresh_folder(spark, f"{label}-state")
    query = (
        df.writeStream.format(fmt).outputMode("append")
        .option("checkpointLocation", state).trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).format(fmt).load(out)


def run_complete(stream: DataFrame, label: str) -> DataFrame:
    """Runs a complete-mode aggregate of bounded size; every trigger replaces the table of its result."""
    spark = stream.sparkSession
    out, state = fresh_folder(spark, label), fresh_folder(spark, f"{label}-state")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def maintain_blocklist(scored: DataFrame, path: str, checkpoint: str, accepted: str | None = None):
    """Adds each attacking source once, loopback excluded, to the ``KeyedList`` at ``path``; returns the running query.

    With ``accepted`` the flows that are not rejected are written there: those of sources that neither an
    earlier batch nor an earlier flow of their own batch has blocked. Every micro-batch owns one folder of the
    accepted flows and overwrites it when it is run again; the list takes a batch's rows once.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        blocked = KeyedList(batch.sparkSession, path)
        stored = settle(batch, "live-batch")
        before = blocked.members(before=batch_id).select("src_ip", F.col("time").alias("block_time"))
        first = settle(block_times(stored).join(before.select("src_ip"), "src_ip", "left_anti"), "live-blocked")
        if accepted:
            passed = passed_traffic(stored, before.unionByName(first))
            passed.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        blocked.add(batch_id, first.select("src_ip", F.col("block_time").alias("time"), F.lit(True).alias("present")))

    return (
        scored.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def unblock(spark: SparkSession, path: str, released: DataFrame) -> None:
    """Takes sources (src_ip, unblock_time) off the kept list; a later attack adds them again."""
    KeyedList(spark, path).add(
        None, released.groupBy("src_ip").agg(F.max("unblock_time").alias("time")).withColumn("present", F.lit(False))
    )


def block_times(scored: DataFrame) -> DataFrame:
    """First attack time per source; loopback addresses are never blocked."""
    return (
        scored.where(F.col("attack_name").isNotNull() & ~F.col("src_ip").isin(K.LOOPBACK))
        .groupBy("src_ip").agg(F.min("start_time").alias("block_time"))
    )


def passed_traffic(flows: DataFrame, blocked: DataFrame) -> DataFrame:
    """Flows that were not rejected: their source was not blocked before them."""
    late = F.coalesce(F.col("start_time") > F.col("block_time"), F.lit(False))
    return flows.join(blocked, "src_ip", "left").where(~late).drop("block_time")


def current_blocklist(blocked: DataFrame, unblocked: DataFrame) -> DataFrame:
    """Blocked sources without a later release."""
    released = unblocked.groupBy("src_ip").agg(F.max("unblock_time").alias("unblock_time"))
    return blocked.join(released, "src_ip", "left").where(
        F.col("unblock_time").isNull() | (F.col("unblock_time") < F.col("block_time"))
    ).select("src_ip", "block_time")


def recent_alerts(alerts: DataFrame, n: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc("alert_time"), "src_ip", "attack_name").limit(n)
