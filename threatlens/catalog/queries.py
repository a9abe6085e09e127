"""Registered queries: each runs one operator over the driver's tables.

Model scores are replaced by fixed formulas over the data (``stand-in``) where an operator behind the
models is shown, so that its result can be compared exactly with SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import expressions as X
from ..models import iforest, scaler, trees
from ..operators import behavior as bh
from ..operators import cleaning as cl
from ..operators import evaluation as ev
from ..operators import flow_features as ff
from ..operators import fusion as fu
from ..operators import ip_features as ipf
from ..operators import killchain as kc
from ..operators import live_rules as lr
from ..operators import response as rs
from ..operators import sessions as ss
from ..operators import user_rules as ur
from ..operators import windows_rules as wr
from ..plans import behavior_agent, flow_agent, full_run, packet_agent
from ..session import SLICE_BYTES, fresh_folder, prepare, settle, settle_parts, sliced
from ..sources import fixtures, readers, sinks
from ..streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: State partitions of the cooldown stream. A stream keeps the number for life, so it is set by the expected
#: load and never by the machine of the first start.
STATE_PARTITIONS = 8


class Tables:
    """The security tables of one data folder, with the shared intermediate results."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in fixtures.VIEWS:
            raise AttributeError(name)
        return fixtures.load(self.spark, self.dir, name)

    @cached_property
    def flows(self) -> DataFrame:
        """One row per flow_id; stored, as most queries read it several times. A large table is cleaned in slices."""
        slices = sliced(readers.clean_netflow(self.netflow), "flow_id", 4 * SLICE_BYTES)
        return settle_parts(self.spark, [partial(cl.dedupe_flows, some) for some in slices], "flows")

    @cached_property
    def flows_ja3(self) -> DataFrame:
        return ff.join_ja3_mode(self.flows, self.zeek)

    @cached_property
    def labelled(self) -> DataFrame:
        return ff.join_flow_labels(self.flows_ja3, self.flow_labels)

    @cached_property
    def stored(self) -> DataFrame:
        """Labelled flows as a stored table, for operators that read them several times."""
        return flow_agent.prepare_flows(self.netflow, self.zeek, self.flow_labels)

    @cached_property
    def flow_scores(self) -> DataFrame:
        return self.flows.select("flow_id", stand_in_flow_score().alias("flow_score"))

    @cached_property
    def packet_scores(self) -> DataFrame:
        value = F.pmod(F.count(F.lit(1)) * 37, F.lit(101)) / F.lit(100.0)
        return self.zeek.groupBy(F.col("id_orig_h").alias("src_ip")).agg(value.alias("packet_score"))

    @cached_property
    def behavior_scores(self) -> DataFrame:
        value = F.pmod(F.count(F.lit(1)) * 53, F.lit(101)) / F.lit(100.0)
        known = self.windows_events.where(~X.is_blank("source_ip"))
        return known.groupBy(F.col("source_ip").alias("src_ip")).agg(value.alias("behavior_score"))

    @cached_property
    def correlated(self) -> DataFrame:
        """The fused flows, stored; in a large table some sources after others."""
        packet, behavior = settle(self.packet_scores, "packet"), settle(self.behavior_scores, "behavior")

        def fused(flows: DataFrame) -> DataFrame:
            scores = flows.select("flow_id", stand_in_flow_score().alias("flow_score"))
            return fu.correlate(flows.select(*fu.FLOW_COLUMNS), scores, packet, behavior).select(*sinks.CORRELATION_COLUMNS)

        return settle_parts(self.spark, [partial(fused, some) for some in sliced(self.flows, "src_ip")], "correlation")

    @cached_property
    def scored(self) -> DataFrame:
        return self.correlated

    @cached_property
    def enriched(self) -> DataFrame:
        return rs.enrich_hosts(rs.enrich_netflow(self.scored, self.flows), self.hosts)

    @cached_property
    def evaluated(self) -> DataFrame:
        """Labelled flows with the fused probability (six decimals)."""
        return ev.join_labels(self.correlated.select("flow_id", "attack_probability"), self.flow_labels)

    @cached_property
    def seeds(self) -> DataFrame:
        """Announced attacks: labelled attack flows on the beacon port, and one id that has no flow."""
        known = self.flow_labels.where("is_attack").join(
            self.flows.where("dst_port = 853").select("flow_id"), "flow_id", "left_semi"
        ).select("flow_id")
        absent = self.tickets.select(F.concat(F.lit("NF-X-"), "incident_id").alias("flow_id"))
        return known.unionByName(absent)

    @cached_property
    def windows_clean(self) -> DataFrame:
        return settle(behavior_agent.clean_windows(self.windows_events), "windows")

    @cached_property
    def ml_scores(self) -> DataFrame:
        value = F.pmod(F.col("ueba_id") * 31, F.lit(101)) / F.lit(100.0)
        return self.ueba.select("ueba_id", value.alias("ml_score"))

    @cached_property
    def results(self) -> DataFrame:
        return behavior_agent.results(self.ueba, self.windows_events, self.hosts, self.ml_scores)

    @cached_property
    def address_features(self) -> DataFrame:
        return packet_agent.address_features(self.windows_events, self.zeek)

    @cached_property
    def live_scored(self) -> DataFrame:
        return live.score_live(stand_in_live(self.flows_ja3))


def stand_in_flow_score():
    return F.pmod(F.col("src_port") * 31 + F.col("packets_sent") * 7, F.lit(101)) / F.lit(100.0)


def stand_in_live(flows: DataFrame) -> DataFrame:
    return flows.withColumns(
        {
            "flow_score": stand_in_flow_score(),
            "packet_score": F.pmod(F.col("src_port"), F.lit(100)) / F.lit(100.0),
            "behavior_score": F.pmod(F.col("src_port") * 3, F.lit(100)) / F.lit(100.0),
        }
    )


def us(column: str, name: str):
    return F.unix_micros(column).alias(name)


def r6(column: str):
    return X.round_even(column, 6).alias(column)


def query(fn: Callable[[Tables], DataFrame]):
    """Registers a query under the function's name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return fn


# ── scans, sources, sinks ─────────────────────────────────────────────────────────────────────


@query
def scan_netflow(t):
    return readers.clean_netflow(t.netflow).withColumn("start_us", F.unix_micros("start_time")).drop("start_time")


@query
def scan_typed_logs(t):
    wanted = {
        "zeek": ("log_id", "ts", ["log_id", "ts", "id_orig_h", "id_resp_h", "ja3_hash"], "ja3_hash"),
        "windows_events": ("event_log_id", "event_time", ["event_log_id", "event_time", "event_id", "source_ip"], "source_ip"),
        "ueba": ("ueba_id", "event_time", ["ueba_id", "event_time", "username", "bytes_transferred"], "username"),
    }
    out = None
    for name, (key, time, columns, nullable) in wanted.items():
        log = readers.coerce_time(readers.require_columns(getattr(t, name), columns, name), time)
        part = log.agg(
            F.count(key).alias("n_rows"), F.min(F.unix_micros(time)).alias("first_us"),
            F.max(F.unix_micros(time)).alias("last_us"), F.count_if(F.col(nullable).isNull()).alias("n_null"),
        ).select(F.lit(name).alias("log"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query
def load_agent_scores(t):
    raw = t.zeek.select(
        F.col("id_orig_h").alias("source_ip"),
        (F.pmod(F.col("orig_bytes"), F.lit(101)) / F.lit(100.0)).alias("threat_score"),
    )
    return readers.agent_scores(raw, "packet_score")


@query
def load_seed_list(t):
    path = fresh_folder(t.spark, "seeds")
    t.flow_labels.where("is_attack").select(F.concat(F.lit("  "), "flow_id", F.lit("\n  ")).alias("v")).write.text(path)
    return readers.read_seed_list(t.spark, path)


@query
def sink_tables(t):
    path = fresh_folder(t.spark, "correlation")
    sinks.write_table(sinks.shaped(t.scored, sinks.CORRELATION_COLUMNS, {"attack_probability": 4}), path)
    return t.spark.read.parquet(path)


@query
def sink_findings_json(t):
    path = fresh_folder(t.spark, "findings")
    found = kc.killchain_paths(t.netflow, t.hosts)
    sinks.write_findings(found, path)
    back = t.spark.read.schema(found.schema).json(path)
    return printable_paths(back)


def live_log_lines(t) -> DataFrame:
    """The flows as live log lines; some with an unusable number, some cut short."""
    columns = [c.split()[0] for c in readers.LIVE_SCHEMA.split(", ")]
    text = {
        "start_time": F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"),
        "is_internal_src": F.when(F.col("is_internal_src"), "True").otherwise("False"),
        "is_internal_dst": F.when(F.col("is_internal_dst"), "True").otherwise("False"),
        "bytes_recv": F.lit("2000"),
        "bytes_sent": F.coalesce(F.col("bytes_sent").cast("string"), F.lit("")),
        "packets_sent": F.when(F.col("src_port") % 53 == 0, "n/a").otherwise(F.col("packets_sent").cast("string")),
        "sim_packet_score": F.when(F.col("src_port") % 7 == 0, "-").otherwise((F.col("src_port") % 100 / 100.0).cast("string")),
        "sim_behavior_score": (F.col("src_port") * 3 % 100 / 100.0).cast("string"),
    }
    fields = [text.get(c, F.col(c).cast("string")) for c in columns]
    line = F.concat_ws(",", *fields)
    short = F.concat_ws(",", *fields[:9])
    return t.flows_ja3.select(F.when(F.col("src_port") % 59 == 0, short).otherwise(line).alias("value"))


@query
def stream_source_flows(t):
    path = fresh_folder(t.spark, "live-log")
    live_log_lines(t).write.text(path)
    table = live.run_to_table(lambda spark: live.read_live_log(spark, path, header=False), t.spark, "live-flows")
    return table.select(
        "flow_id", "src_ip", "dst_ip", us("start_time", "start_us"), "packets_sent", "bytes_sent", "dst_port",
        "is_internal_src", "ja3_hash", "packet_score", "behavior_score",
    )


def net_stream(t, spark: SparkSession | None = None) -> DataFrame:
    """Flow records arriving as a stream of Parquet files."""
    spark = spark or t.spark
    lineitem = spark.read.parquet(f"{t.dir}/lineitem.parquet").schema
    files = spark.readStream.schema(lineitem).option("pathGlobFilter", "lineitem.parquet").parquet(t.dir)
    return fixtures.over(spark, "netflow", lineitem=files)


def live_stream(t, spark: SparkSession | None = None) -> DataFrame:
    """Streaming flows with fingerprint (joined from a stored table), stand-in scores and classification."""
    spark = spark or t.spark
    path = fresh_folder(t.spark, "modes")
    ff.ja3_modes(t.zeek).write.parquet(path)
    return live.score_live(stand_in_live(ff.join_ja3_mode(net_stream(t, spark), t.zeek, spark.read.parquet(path))))


@query
def stream_sink_alerts(t):
    """The alert log: time, source, attack, severity and all scores, after the cooldown."""
    def log(spark):
        return live.cooled_stream(live_stream(t, spark)).select(
            us("alert_time", "alert_us"), F.col("src_ip").alias("ip"), "attack_name", "severity",
            *[X.round_even(c, 2).alias(c) for c in live.ALERT_SCORES],
        )

    return live.run_to_table(log, t.spark, "alerts", fmt="json", partitions=STATE_PARTITIONS)


@query
def recent_alerts(t):
    return live.recent_alerts(live.alert_candidates(t.live_scored), 50).select(
        "src_ip", "attack_name", "severity", us("alert_time", "alert_us")
    )


# ── cleaning ──────────────────────────────────────────────────────────────────────────────────


@query
def dedupe_flows(t):
    return t.flows.withColumn("start_us", F.unix_micros("start_time")).drop("start_time")


@query
def dedupe_windows_events(t):
    # Each event a second time, half a second later or less.
    copies = t.windows_events.withColumns(
        {
            "event_time": F.col("event_time") + F.make_dt_interval(secs=F.lit(0.3)),
            "event_log_id": F.concat("event_log_id", F.lit("-copy")),
        }
    )
    kept = cl.dedupe_windows_events(t.windows_events.unionByName(copies))
    return kept.select("event_log_id", us("event_time", "event_us"), "event_id", "hostname", "subject_username")


@query
def impute_local_ip(t):
    return cl.impute_local_ip(t.windows_events).select("event_log_id", "source_ip")


@query
def dedupe_hosts_by_ip(t):
    second = t.hosts.withColumn("hostname", F.concat(F.lit("Z-"), "hostname"))
    return cl.dedupe_hosts_by_ip(second.unionByName(t.hosts))


@query
def resolve_source_ip(t):
    return cl.resolve_source_ip(cl.impute_local_ip(t.windows_events), t.hosts).select("event_log_id", "source_ip")


@query
def bool_normalise(t):
    text = t.ueba.select(
        "ueba_id",
        F.when(F.col("ueba_id") % 5 == 0, F.col("is_off_hours").cast("int").cast("string"))
        .when(F.col("ueba_id") % 5 == 1, F.initcap(F.col("is_off_hours").cast("string")))
        .when(F.col("ueba_id") % 5 > 1, F.col("is_off_hours").cast("string")).alias("is_off_hours"),
    )
    return cl.normalise_booleans(text, ["is_off_hours"])


# ── joins ─────────────────────────────────────────────────────────────────────────────────────


@query
def join_ja3_mode(t):
    return t.flows_ja3.select("flow_id", "src_ip", "dst_ip", "ja3_hash")


@query
def join_flow_labels(t):
    return ff.join_flow_labels(t.flows, t.flow_labels).select("flow_id", "flow_label")


@query
def host_context(t):
    return cl.host_context(t.hosts)


@query
def join_labels_inner(t):
    return ev.join_labels(t.flow_scores, t.flow_labels)


@query
def join_agent_scores(t):
    return fu.join_agent_scores(
        t.flows.select("flow_id", "src_ip"), t.flow_scores, t.packet_scores, t.behavior_scores
    )


@query
def enrich_netflow(t):
    out = rs.enrich_netflow(t.scored, t.flows)
    return out.select(
        "flow_id", "severity", "src_ip", "dst_ip", "src_port", "dst_port", "segment", us("start_time", "start_us"),
        "protocol", "is_internal_src", "is_internal_dst",
    )


@query
def enrich_hosts_both_sides(t):
    return rs.enrich_hosts(t.flows, t.hosts).select(
        "flow_id", "src_hostname", "dst_hostname", "is_honeypot", "affected_asset", "src_criticality", "dst_criticality"
    )


@query
def outer_join_ip_features(t):
    cols = ["win_total_events", "win_unique_hosts", "win_failed_logons", "zeek_total_conns", "zeek_unique_dst_ports"]
    return t.address_features.select("source_ip", *cols)


@query
def asof_nearest_sessions(t):
    busy = ipf.busy_hours(t.windows_events)
    out = ss.align_sessions(ss.windows_sessions(t.windows_events, busy), ss.zeek_sessions(t.zeek, busy))
    return out.select(
        "source_ip", us("win_session_start", "win_us"), us("zeek_session_start", "zeek_us"),
        "win_total_events", "zeek_total_conns",
    )


@query
def match_tickets_to_shortlist(t):
    shortlist = rs.swift_shortlist(rs.label_severity(t.enriched))
    return rs.match_tickets(t.tickets, shortlist).select("incident_id", "caught")


@query
def windows_scores_back_to_events(t):
    alerts = wr.windows_event_rules(t.windows_clean, t.hosts)
    return wr.scores_back_to_events(t.windows_clean, alerts).select("event_log_id", "score", "is_anomaly")


@query
def seen_baseline_antijoin(t):
    hashed = t.zeek.where(ipf.has_hash())
    return ff.unseen_fingerprints(hashed, hashed.where("not is_anomaly").select("ja3_hash").distinct()).select(
        "log_id", "ja3_hash"
    )


def printable_paths(paths: DataFrame) -> DataFrame:
    return paths.select(
        "incident_id", "kill_chain", "source_host", F.array_join("chain_flow_ids", "|").alias("chain_flow_ids"),
        F.array_join("mitre_tactics", "|").alias("mitre_tactics"),
        F.array_join("mitre_techniques", "|").alias("mitre_techniques"), "confidence",
    )


@query
def killchain_paths(t):
    return printable_paths(kc.killchain_paths(t.netflow, t.hosts))


# ── per-flow features ─────────────────────────────────────────────────────────────────────────


@query
def flow_traffic_features(t):
    out = t.flows.withColumns(ff.traffic_columns())
    return out.select("flow_id", r6("bytes_sent_per_sec"), r6("bytes_per_pkt"), r6("pkt_sent_ratio"))


@query
def flow_segment_features(t):
    cols = ff.segment_columns()
    return t.flows.withColumns(cols).select("flow_id", *cols)


@query
def flow_port_features(t):
    cols = ff.port_columns()
    return t.flows.withColumns(cols).select("flow_id", *cols)


@query
def flow_time_features(t):
    out = t.flows.withColumns(ff.time_columns())
    return out.select("flow_id", r6("hour_sin"), r6("hour_cos"), r6("dow_sin"), r6("dow_cos"), "is_c2_time_window")


@query
def flow_ja3_features(t):
    out = ff.fingerprint_columns(t.labelled, ff.normal_fingerprints(t.labelled))
    return out.select("flow_id", "is_known_c2_ja3", "ja3_unseen_in_normal")


@query
def ip_is_internal(t):
    ends = t.flows.select("flow_id", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return ends.select("flow_id", "ip", X.ip_is_internal("ip").alias("is_internal"))


@query
def flow_flag_syn(t):
    return t.flows.select("flow_id", X.flag(F.col("tcp_flags") == "S").alias("flag_syn_only"))


@query
def flow_feature_vector(t):
    out = ff.flow_feature_vector(t.stored)
    return out.select("flow_id", *[r6(c) for c in out.columns if c != "flow_id"])


@query
def ueba_features(t):
    return ur.ueba_features(t.ueba).withColumn("event_type_risk", X.round_even("event_type_risk", 6))


@query
def ip_indicator_flags(t):
    return bh.behavior_by_ip(t.results).select("source_ip", *bh.INDICATORS)


@query
def assign_severity_flow(t):
    return t.flow_scores.withColumn("severity", X.flow_severity("flow_score"))


@query
def assign_severity_fused(t):
    return t.flow_scores.withColumn("severity", X.fused_severity("flow_score"))


@query
def assign_severity_response(t):
    return t.flow_scores.withColumn("severity_label", X.response_severity("flow_score"))


@query
def classify_category(t):
    return t.correlated.select(
        "flow_id", r6("attack_probability"), "severity", "predicted_category", "mitre_technique"
    )


@query
def map_mitre(t):
    kinds = t.correlated.groupBy("predicted_category").agg(F.count(F.lit(1)).alias("n"))
    return kinds.withColumn("mitre_technique", X.technique_of("predicted_category"))


@query
def attack_decision(t):
    out = rs.respond(t.scored, t.flows, t.hosts, 0.5)
    return rs.final_submission(out)


@query
def honeypot_override(t):
    out = rs.honeypot_override(rs.label_severity(t.enriched))
    return out.select("flow_id", "is_honeypot", "severity_label")


@query
def seed_override(t):
    out = fu.seed_override(rs.label_severity(t.scored), t.seeds, "attack_probability", "severity_label")
    return out.select("flow_id", r6("attack_probability"), "severity_label")


@query
def cti_overrides(t):
    scored = t.flows_ja3.withColumn("attack_probability", stand_in_flow_score())
    out = lr.cti_overrides(scored.withColumn("severity", X.flow_severity("attack_probability")))
    return out.select("flow_id", "attack_probability", "severity", "attack_type")


@query
def classify_live_attack(t):
    return t.live_scored.select("flow_id", "attack_name", "live_severity", r6("correlation_score"))


# ── rules and fusion ──────────────────────────────────────────────────────────────────────────


@query
def ueba_rules(t):
    ruled = ur.ueba_rules(ur.user_baseline_bytes(t.ueba), t.hosts)
    return ruled.select(
        "ueba_id", r6("rule_score"), X.join_flags("flags").alias("flags"), X.join_techniques("mitre").alias("mitre")
    )


@query
def user_baseline_bytes(t):
    return ur.user_baseline_bytes(t.ueba).select("ueba_id", X.round_even("avg_bytes", 4).alias("avg_bytes"))


@query
def windows_event_rules(t):
    return wr.windows_event_rules(t.windows_clean, t.hosts).select(
        "event_log_id", "event_id", "hostname", "username", "source_ip", "score", "flag", "category"
    )


@query
def hybrid_score(t):
    scored = ur.score_ueba(t.ueba, t.hosts, t.ml_scores)
    return scored.select("event_ref", "score", "ml_score", "rule_score", X.join_flags("flags").alias("flags"), "source_ip")


@query
def gated_fusion(t):
    joined = fu.join_agent_scores(t.flows, t.flow_scores, t.packet_scores, t.behavior_scores)
    return fu.fuse(joined).select("flow_id", r6("threat_score"))


@query
def segment_amplification(t):
    joined = fu.join_agent_scores(t.flows, t.flow_scores, t.packet_scores, t.behavior_scores)
    return fu.amplify_by_segment(fu.fuse(joined)).select("flow_id", r6("threat_score"))


@query
def ensemble_blend(t):
    both = t.flows.select(
        "flow_id", stand_in_flow_score().alias("classifier"),
        (F.col("packets_recv") / F.lit(10.0)).alias("anomaly"),
    )
    return both.select("flow_id", X.round_even(X.ensemble("classifier", "anomaly"), 6).alias("attack_probability"))


@query
def behavior_detail_union(t):
    return bh.detail_table(t.results).select(
        "event_ref", "source", "entity", "score", "ml_score", "rule_score", "flags", "mitre", "source_ip"
    )


@query
def behavior_by_ip(t):
    return bh.behavior_by_ip(t.results)


@query
def triage_decision(t):
    labelled = fu.seed_override(rs.label_severity(t.scored), t.seeds, "attack_probability", "severity_label")
    cut = ev.tune_threshold(t.evaluated)
    return sinks.shaped(rs.triage(labelled, cut, t.seeds), sinks.TRIAGE_COLUMNS, {"attack_probability": 4})


# ── aggregates ────────────────────────────────────────────────────────────────────────────────


@query
def src_stats(t):
    return ff.source_stats(t.flows)


@query
def windows_ip_features(t):
    out = ipf.windows_ip_features(t.windows_events)
    return out.select(*[r6(c) if c.endswith("ratio") else F.col(c) for c in out.columns])


def rounded_zeek(df: DataFrame, decimals: int = 4) -> DataFrame:
    soft = [c for c in df.columns if "mean" in c or "ratio" in c or "diversity" in c]
    return df.select(*[X.round_even(c, decimals).alias(c) if c in soft else F.col(c) for c in df.columns])


@query
def zeek_ip_features(t):
    return rounded_zeek(ipf.zeek_ip_features(t.zeek, ipf.busy_hours(t.windows_events)))


@query
def busy_hours(t):
    return ipf.busy_hours(t.windows_events)


@query
def ja3_baseline_frequency(t):
    return ipf.ja3_baseline_frequency(t.zeek).select("ja3_hash", X.round_even("ja3_frequency_in_normal", 8).alias("frequency"))


def flagged_zeek(t) -> DataFrame:
    return ipf.ja3_row_flags(t.zeek, ipf.ja3_baseline_frequency(t.zeek))


@query
def ja3_row_flags(t):
    return flagged_zeek(t).select(
        "log_id", r6("ja3_log_frequency"), "ja3_never_seen_in_normal", "ja3_is_rare", "ja3_matches_known_c2"
    )


@query
def ja3_ip_signal(t):
    out = ipf.join_ja3_signal(t.address_features.select("source_ip"), ipf.ja3_ip_signal(flagged_zeek(t)))
    return out.withColumn("ja3_min_frequency", X.round_even("ja3_min_frequency", 8))


@query
def quantile_indicators(t):
    return ipf.quantile_indicators(t.address_features).select(
        "source_ip", "ind_high_fail_ratio", "ind_high_upload_ratio", "ind_high_port_spread"
    )


@query
def severity_distribution(t):
    return fu.tier_distribution(rs.label_severity(t.scored), "severity_label", K.RESPONSE_TIERS)


@query
def score_summary(t):
    scored = settle(ur.score_ueba(t.ueba, t.hosts, t.ml_scores), "user-scores")
    batch, runner = bh.score_summary(scored, 0.75), bh.score_summary(scored, 0.70)
    return batch.withColumn("cut", F.lit("batch")).unionByName(runner.withColumn("cut", F.lit("runner")))


@query
def flag_counts(t):
    return bh.flag_counts(t.results)


@query
def swift_rate_stats(t):
    return ff.swift_rate_stats(ff.swift_rolling_counts(t.flows)).select(r6("mean"), r6("std"))


@query
def session_features(t):
    busy = ipf.busy_hours(t.windows_events)
    win = ss.windows_sessions(t.windows_events, busy).select(
        F.lit("windows").alias("log"), "source_ip", "session_id", us("win_session_start", "start_us"),
        F.col("win_total_events").alias("n_events"), F.col("win_unique_hosts").alias("n_targets"),
        F.col("win_off_hours_events").alias("n_off_hours"), r6("win_fail_ratio").alias("fail_ratio"),
        F.col("win_gt_anomaly_events").alias("n_labelled"),
    )
    zk = ss.zeek_sessions(t.zeek, busy).select(
        F.lit("zeek").alias("log"), "source_ip", "session_id", us("zeek_session_start", "start_us"),
        F.col("zeek_total_conns").alias("n_events"), F.col("zeek_unique_dst_ips").alias("n_targets"),
        F.col("zeek_off_hours_conns").alias("n_off_hours"), r6("zeek_fail_ratio").alias("fail_ratio"),
        F.col("zeek_gt_anomaly_conns").alias("n_labelled"),
    )
    return win.unionByName(zk)


@query
def session_label(t):
    sessions = packet_agent.labelled_sessions(t.windows_events, t.zeek)
    return sessions.select("session_key", "session_label")


@query
def user_profiles(t):
    return ur.user_profiles(t.ueba).select(
        "username", "event_count", "bytes_total", X.round_even("bytes_mean", 4).alias("bytes_mean"), r6("peer_mean"),
        F.array_join(F.transform("login_hours", lambda h: h.cast("string")), ",").alias("login_hours"),
    )


# ── windows ───────────────────────────────────────────────────────────────────────────────────


@query
def swift_rolling_rate(t):
    rated = ff.swift_rate_columns(t.flows)
    return rated.select("flow_id", r6("swift_query_zscore"), "swift_rate_exceeded")


@query
def swift_query_velocity(t):
    # A fifth of the default limit, so that the smallest data set has hits as well.
    hits = ur.swift_query_velocity(t.ueba, t.hosts, limit=80).withColumn("limit_", F.lit(80))
    default = ur.swift_query_velocity(t.ueba, t.hosts).withColumn("limit_", F.lit(400))
    return hits.unionByName(default).select(
        "limit_", "username", "ueba_id", us("event_time", "event_us"), "count_in_window", "hostname", "source_ip"
    )


@query
def brute_force_window(t):
    out = wr.brute_force_window(t.windows_clean)
    return out.select(
        "event_log_id", "n_failures", F.col("alert.score").alias("score"), F.col("alert.flag").alias("flag")
    )


@query
def share_access_running(t):
    return wr.share_access_running(t.windows_clean).select(
        "event_log_id", "share_count", (F.col("share_count") >= wr.SHARE_LIMIT).alias("alert")
    )


@query
def co_occurrence_boost(t):
    joined = fu.join_agent_scores(t.flows, t.flow_scores, t.packet_scores, t.behavior_scores)
    out = fu.co_occurrence_boost(fu.amplify_by_segment(fu.fuse(joined)))
    return out.select("flow_id", "agents_fired", "max_agents_5min", "boost_applied", r6("threat_score"))


@query
def sessionize(t):
    return ss.sessionize(t.zeek, "id_orig_h", "ts").select("log_id", "session_seq", "session_id")


@query
def top_candidate_per_asset(t):
    labelled = rs.label_severity(t.enriched)
    return rs.top_candidate_per_asset(rs.swift_candidates(labelled)).select(
        "affected_asset", "flow_id", r6("attack_probability"), "severity_label", "segment", "mitre_technique"
    )


# ── top lists and sets ────────────────────────────────────────────────────────────────────────


@query
def top_threat_ips(t):
    marked = ipf.quantile_indicators(calibrated_addresses(t))
    return ipf.top_threat_ips(marked).select(
        "source_ip", r6("threat_score"), "ind_high_fail_ratio", "ind_high_upload_ratio", "ind_high_port_spread",
        "win_failed_logons", "zeek_total_conns",
    )


@query
def packet_model_top_ips(t):
    return ipf.top_threat_ips(packet_agent.run(t.windows_events, t.zeek)).select(
        "source_ip", "threat_score", "ind_high_fail_ratio", "ind_high_upload_ratio", "ind_high_port_spread",
        "win_failed_logons", "zeek_total_conns",
    )


def calibrated_addresses(t) -> DataFrame:
    """Address features with a stand-in raw score through the packet agent's calibration."""
    raw = -(F.pmod(F.col("win_total_events") * 57 + F.col("zeek_total_conns") * 23 + F.col("win_failed_logons") * 3, F.lit(211)) + 1) / F.lit(212.0)
    return iforest.packet_calibration(t.address_features.withColumn("raw_score", raw))


@query
def packet_calibration(t):
    return calibrated_addresses(t).select("source_ip", r6("threat_score"), "is_anomaly")


@query
def user_calibration(t):
    raw = -(F.pmod(F.col("ueba_id") * 37, F.lit(997)) + 1) / F.lit(1000.0)
    return iforest.user_calibration(t.ueba.select("ueba_id", raw.alias("raw_score"))).select("ueba_id", "ml_score")


@query
def top_ja3_ips(t):
    return ipf.top_ja3_ips(ipf.ja3_ip_signal(flagged_zeek(t))).select(
        "source_ip", "ja3_known_c2_conns", "ja3_rare_conns", "ja3_never_seen_conns"
    )


@query
def swift_shortlist(t):
    out = rs.swift_shortlist(rs.label_severity(t.enriched), t.results)
    return sinks.shaped(out, sinks.SHORTLIST_COLUMNS, {"attack_probability": 6})


@query
def top_anomalous_ips(t):
    return bh.top_anomalous_ips(bh.behavior_by_ip(t.results))


@query
def union_injected_rows(t):
    labelled = rs.label_severity(t.scored).withColumn("predicted_tp", F.col("attack_probability") >= 0.5)
    out = labelled.select(*sinks.TRIAGE_COLUMNS).unionByName(rs.missing_seeds(labelled, t.seeds))
    return sinks.shaped(out, sinks.TRIAGE_COLUMNS, {"attack_probability": 4})


# ── evaluation ────────────────────────────────────────────────────────────────────────────────


@query
def confusion_at_threshold(t):
    out = ev.confusion_at_threshold(t.evaluated, 0.5)
    return out.select("threshold", "tp", "fp", "tn", "fn", r6("fpr"), r6("recall"), r6("precision"), "n_flagged")


@query
def threshold_sweep(t):
    out = ev.threshold_sweep(t.evaluated)
    return out.select("threshold", "tp", "fp", "tn", "fn", r6("fpr"), r6("recall"), r6("precision"), "n_flagged")


@query
def tune_threshold(t):
    strict = ev.tune_threshold(t.evaluated).withColumn("max_fpr", F.lit(0.10))
    loose = ev.tune_threshold(t.evaluated, 0.40).withColumn("max_fpr", F.lit(0.40))
    return strict.unionByName(loose)


@query
def roc_points(t):
    return ev.roc_points(t.evaluated).select("threshold", "tp", "fp", r6("fpr"), r6("tpr"), r6("precision"), "is_corner")


@query
def auroc(t):
    return ev.auroc(t.evaluated).select(r6("auroc"))


@query
def metrics_at_fpr(t):
    close = ev.metrics_at_fpr(t.evaluated, 0.05, "closest").withColumn("rule", F.lit("closest"))
    below = ev.metrics_at_fpr(t.evaluated, 0.05, "last_below").withColumn("rule", F.lit("last_below"))
    return close.unionByName(below).select(
        "rule", "threshold", "tp", "fp", "tn", "fn", r6("fpr"), r6("precision"), r6("recall"), r6("f1")
    )


@query
def average_precision(t):
    return ev.average_precision(t.evaluated).select(r6("average_precision"))


@query
def best_f1_threshold(t):
    return ev.best_f1_threshold(t.evaluated).select("threshold", r6("f1"), r6("precision"), r6("recall"))


@query
def threshold_at_recall(t):
    return ev.threshold_at_recall(t.evaluated).select("target_recall", "threshold", r6("precision"), r6("recall"))


@query
def attack_rate(t):
    whole = ev.attack_rate(t.flow_labels).withColumn("scope", F.lit("labels"))
    joined = ev.attack_rate(t.evaluated).withColumn("scope", F.lit("joined"))
    return whole.unionByName(joined).select("scope", "n_rows", "n_attacks", r6("attack_rate"))


@query
def classification_report(t):
    out = ev.classification_report(t.evaluated, 0.5)
    return out.select("class", r6("precision"), r6("recall"), r6("f1"), "support")


def labelled_features(t) -> DataFrame:
    return ev.join_labels(ff.flow_feature_vector(t.stored), t.flow_labels)


EVALUATED_FEATURES = ["bytes_sent_per_sec", *K.CLASSIFIER_FEATURES]


@query
def feature_auroc(t):
    return ev.feature_auroc(labelled_features(t), EVALUATED_FEATURES).select("feature", r6("auroc"))


def class_means_of(t) -> DataFrame:
    out = ev.class_means(labelled_features(t), EVALUATED_FEATURES)
    return out.select("feature", X.round_even("attack_mean", 4).alias("attack_mean"), X.round_even("normal_mean", 4).alias("normal_mean"))


@query
def class_means(t):
    return class_means_of(t)


@query
def disjoint_features(t):
    # The label itself, as a feature, is the one that must be found disjoint.
    data = labelled_features(t).withColumn("label_copy", F.col("is_attack").cast("int"))
    # These features are exact in every engine; sines and ratios are not.
    exact = ["segment_risk", "dst_port_risk", "is_internal_to_ext", "flag_syn_only", "flow_count", "label_copy"]
    return ev.disjoint_features(data, exact)


@query
def importance_share(t):
    # Stand-in importance: how far apart a feature's class means lie.
    means = class_means_of(t)
    apart = means.select("feature", F.abs(F.col("attack_mean") - F.col("normal_mean")).alias("importance"))
    return ev.importance_share(apart).select("family", r6("share"))


@query
def forest_importance_share(t):
    model, _ = session_forest(t)
    return ev.importance_share(model.importances())


# ── models ────────────────────────────────────────────────────────────────────────────────────


@query
def standard_scaler(t):
    features = ur.ueba_features(t.ueba)
    stats = scaler.fit_scaler(features, K.USER_FEATURES)
    out = scaler.apply_scaler(features, stats, K.USER_FEATURES)
    return out.select("ueba_id", *[X.round_even(c, 5).alias(c) for c in K.USER_FEATURES])


@query
def iforest_fit(t):
    features = settle(ff.flow_feature_vector(t.stored, keep=["flow_label"]), "features")
    model = iforest.fit(features.where("flow_label = 'NORMAL'"), "flow_id", K.ANOMALY_FEATURES)
    return t.spark.createDataFrame(model.nodes, iforest.NODE_SCHEMA)


@query
def iforest_score(t):
    features = settle(ff.flow_feature_vector(t.stored, keep=["flow_label"]), "features")
    model = iforest.fit(features.where("flow_label = 'NORMAL'"), "flow_id", K.ANOMALY_FEATURES)
    scored = iforest.score(features, model)
    return scored.select("flow_id", "raw_score", iforest.flow_calibration().alias("anomaly_score"))


@query
def user_model_scores(t):
    return behavior_agent.user_model_scores(t.ueba)


@query
def gbt_classifier(t):
    features = settle(ff.flow_feature_vector(t.stored, keep=["flow_label"]), "features")
    data = features.withColumn("label", (F.col("flow_label") != "NORMAL").cast("int"))
    model = trees.fit_gbt(data, "flow_id", K.CLASSIFIER_FEATURES)
    return trees.probability(data, model, "classifier_score").select(
        "flow_id", "label", "classifier_score"
    )


def session_forest(t):
    sessions = packet_agent.labelled_sessions(t.windows_events, t.zeek)
    return packet_agent.score_sessions(sessions)


@query
def rf_session_classifier(t):
    _, scored = session_forest(t)
    return scored.select(
        "session_key", "session_label", "is_test", "rf_threat_score", "rf_flag_default", "rf_flag_best_f1"
    )


@query
def stratified_split(t):
    labels = t.flow_labels.withColumn("label", F.col("is_attack").cast("int"))
    return trees.stratified_split(labels, "flow_id", "label", 0.2).select("flow_id", "label", "is_test")


def trained_anomaly(t) -> flow_agent.FlowArtifacts:
    """Artifacts with the anomaly model, stored and read back."""
    path = fresh_folder(t.spark, "artifacts")
    flow_agent.train(t.stored, "anomaly").save(t.spark, path)
    return flow_agent.FlowArtifacts.load(t.spark, path, with_classifier=False)


@query
def train_stats_artifacts(t):
    art = trained_anomaly(t)
    return art.rate_stats.select(
        F.lit("rate").alias("artifact"), F.lit(1).cast("long").alias("n_rows"), r6("mean"), r6("std")
    ).unionByName(
        art.src_stats.agg(
            F.lit("source").alias("artifact"), F.count(F.lit(1)).alias("n_rows"),
            X.round_even(F.avg("flow_count"), 6).alias("mean"), X.round_even(F.stddev_samp("flow_count"), 6).alias("std"),
        )
    ).unionByName(
        art.baseline.agg(
            F.lit("baseline").alias("artifact"), F.count(F.lit(1)).alias("n_rows"),
            F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"),
        )
    )


@query
def grade_flows(t):
    return flow_agent.grade(t.stored, trained_anomaly(t))


def graded_apart(t) -> DataFrame:
    """All flows: of two halves by the hash of flow_id, each is graded by both models trained on the other one,
    stored and reloaded. The halves train side by side, as most of their jobs are small."""
    half = F.pmod(F.xxhash64("flow_id"), F.lit(2))
    halves = [settle(t.stored.where(half == k), f"half-{k}") for k in (0, 1)]

    def trained(known: DataFrame) -> flow_agent.FlowArtifacts:
        return flow_agent.train_or_load(t.spark, fresh_folder(t.spark, "artifacts"), known)

    with ThreadPoolExecutor(len(halves)) as both:
        first, second = (flow_agent.grade(rest, art) for rest, art in zip(halves[::-1], both.map(trained, halves)))
    return first.unionByName(second)


@query
def grade_other_table(t):
    return graded_apart(t)


@query
def threat_report(t):
    graded = settle(graded_apart(t), "graded")
    whole = flow_agent.count_threats(graded).select(
        F.lit("all").alias("severity"), F.lit("all").alias("attack_type"), F.col("n_threats").alias("n_flows"),
    )
    return flow_agent.threat_report(graded).unionByName(whole, allowMissingColumns=True)


@query
def full_run_decisions(t):
    """Agents' stand-in scores through fusion and response to the final decisions."""
    tables = full_run.Tables(t.netflow, t.zeek, t.windows_events, t.ueba, t.hosts, t.flow_labels, t.tickets)
    out = full_run.fuse_and_respond(t.flows, tables, t.flow_scores, t.packet_scores, t.results)
    return rs.final_submission(out.responded)


# ── streams ───────────────────────────────────────────────────────────────────────────────────


@query
def stream_score_flows(t):
    def scored(spark):
        return live_stream(t, spark).select("flow_id", r6("correlation_score"), "attack_name", "live_severity")

    return live.run_to_table(scored, t.spark, "scored")


@query
def stream_alert_cooldown(t):
    def cooled(spark):
        return live.cooled_stream(live_stream(t, spark))

    return live.run_to_table(cooled, t.spark, "cooled", partitions=STATE_PARTITIONS).select(
        "src_ip", "attack_name", "severity", us("alert_time", "alert_us")
    )


@query
def alert_cooldown_batch(t):
    return live.cooled_batch(live.alert_candidates(t.live_scored)).select(
        "src_ip", "attack_name", "severity", us("alert_time", "alert_us")
    )


@query
def stream_blocklist(t):
    path, state = fresh_folder(t.spark, "blocked"), fresh_folder(t.spark, "blocked-state")
    accepted = fresh_folder(t.spark, "accepted")
    live.maintain_blocklist(live_stream(t), path, state, accepted).awaitTermination()
    passed = t.spark.read.parquet(accepted)
    return passed.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n_passed"))


@query
def blocked_sources(t):
    return live.block_times(t.live_scored).select("src_ip", us("block_time", "block_us"))


@query
def unblock_ip(t):
    cleared = ev.join_labels(t.flows, t.flow_labels).where("not is_attack and packets_recv = 0").select(
        "src_ip", F.col("start_time").alias("unblock_time")
    )
    return live.current_blocklist(live.block_times(t.live_scored), cleared).select("src_ip", us("block_time", "block_us"))


@query
def stream_counters(t):
    return live.run_complete(live.counters(live_stream(t)), "counters")


@query
def stream_arrival_rate(t):
    def rates(spark):
        return live.arrival_rates(net_stream(t, spark))

    return live.run_to_table(rates, t.spark, "arrivals", partitions=STATE_PARTITIONS).select(
        "src_ip", us("start_time", "start_us"), "n_arrivals", "count_2min"
    )


@query
def stream_rate_window(t):
    def rates(spark):
        return live.rate_windows(net_stream(t, spark))

    return live.run_to_table(rates, t.spark, "rates", partitions=STATE_PARTITIONS).select(
        "src_ip", us("window_start", "start_us"), us("window_end", "end_us"), "n_queries"
    )
