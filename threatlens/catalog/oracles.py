"""SQL twins of the registered queries, for DuckDB over the driver's tables.

Written with plain windows and joins, independently of how the operators distribute the work.
"""

from __future__ import annotations

import re

from .. import constants as K
from ..operators.behavior import INDICATORS
from ..sources.fixtures import VIEWS, view_sql

ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {name: view_sql(name) for name in VIEWS}


def even(sql: str) -> str:
    """Writes ROUND(x, n) as scaled rounding to even, which both engines compute alike."""
    while found := re.search(r"\bROUND\(", sql):
        depth, comma, i = 1, 0, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        scale = f"1e{sql[comma + 1:i - 1].strip()}"
        inner = sql[found.end():comma]
        sql = f"{sql[:found.start()]}(ROUND_EVEN(({inner})*{scale}, 0)/{scale} + 0e0){sql[i:]}"
    return sql


def cte(name: str, sql: str) -> None:
    CTES[name] = even(sql)


def _used(sql: str, found: set[str]) -> set[str]:
    for name in CTES:
        if name not in found and re.search(rf"\b{name}\b", sql):
            found.add(name)
            _used(CTES[name], found)
    return found


def oracle(name: str, sql: str) -> None:
    sql = even(sql)
    used = _used(sql, set())
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in used]
    ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql


def case(column: str, table: dict, default: str) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else (f"{v}e0" if isinstance(v, float) else str(v))

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def clip(x: str) -> str:
    return f"GREATEST(0e0, LEAST(1e0, {x}))"


def ladder(x: str, steps, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b}e0 THEN '{t}'" for b, t in steps) + f" ELSE '{default}' END"


def slice_of(c: str) -> str:
    return f"SUBSTR(MD5(CAST({c} AS VARCHAR)), 1, 2)"


REST = (
    "src_ip, dst_ip, duration_sec, bytes_sent, packets_sent, packets_recv, segment, is_internal_src, "
    "is_internal_dst, dst_port, src_port, protocol, tcp_flags"
)
NF_ORDER = ", ".join(f"{c} NULLS FIRST" for c in REST.split(", "))
SWIFT_SQL = "segment = 'SWIFT' AND dst_port = 1433"
OFF = "(HOUR({t}) < 8 OR HOUR({t}) >= 18 OR ISODOW({t}) >= 6)"

cte("flows", f"SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY flow_id ORDER BY start_time NULLS FIRST, {NF_ORDER}) AS rn FROM netflow) WHERE rn = 1")
cte("ja3mode", "SELECT src_ip, dst_ip, ja3_hash FROM (SELECT id_orig_h AS src_ip, id_resp_h AS dst_ip, ja3_hash, ROW_NUMBER() OVER (PARTITION BY id_orig_h, id_resp_h ORDER BY COUNT(*) DESC, ja3_hash) AS rn FROM zeek WHERE ja3_hash IS NOT NULL GROUP BY 1, 2, 3) WHERE rn = 1")
cte("flows_ja3", "SELECT f.*, COALESCE(m.ja3_hash, 'UNKNOWN') AS ja3_hash FROM flows f LEFT JOIN ja3mode m ON f.src_ip = m.src_ip AND f.dst_ip = m.dst_ip")
cte("labelled", "SELECT f.*, l.is_attack, CASE WHEN l.is_attack THEN 'ATTACK' ELSE 'NORMAL' END AS flow_label FROM flows_ja3 f LEFT JOIN flow_labels l USING (flow_id)")
FSCORE = "((src_port*31 + packets_sent*7) % 101)/100e0"
cte("fscore", f"SELECT flow_id, {FSCORE} AS flow_score FROM flows")
cte("pscore", "SELECT id_orig_h AS src_ip, ((COUNT(*)*37) % 101)/100e0 AS packet_score FROM zeek GROUP BY 1")
cte("bscore", "SELECT source_ip AS src_ip, ((COUNT(*)*53) % 101)/100e0 AS behavior_score FROM windows_events WHERE source_ip IS NOT NULL AND TRIM(source_ip) <> '' GROUP BY 1")
cte("joined", "SELECT f.*, s.flow_score, COALESCE(p.packet_score, 0e0) AS packet_score, COALESCE(b.behavior_score, 0e0) AS behavior_score FROM flows f LEFT JOIN fscore s USING (flow_id) LEFT JOIN pscore p USING (src_ip) LEFT JOIN bscore b USING (src_ip)")


def fusion(f: str, b: str, p: str) -> str:
    g = f"(1e0/(1e0+EXP(-({f}-{b}))))"
    return clip(f"0.85e0*({g}*{f}+(1e0-{g})*{b})+0.15e0*{p}")


cte("fused", f"SELECT *, {fusion('flow_score', 'behavior_score', 'packet_score')} AS threat_raw FROM joined")
cte("amplified", f"SELECT *, {clip('threat_raw*' + case('segment', K.SEGMENT_WEIGHT, '1e0'))} AS threat_amp, CAST(flow_score >= 0.5 AS INT) + CAST(behavior_score >= 0.5 AS INT) + CAST(packet_score >= 0.5 AS INT) AS agents_fired FROM fused")
cte("windowed", "SELECT *, MAX(agents_fired) OVER (PARTITION BY src_ip ORDER BY EPOCH_US(start_time) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS max_agents_5min FROM amplified")
cte("boosted", "SELECT *, CAST(max_agents_5min >= 2 AS INT) AS boost_applied, CASE WHEN max_agents_5min >= 2 THEN LEAST(threat_amp*1.3e0, 1e0) ELSE threat_amp END AS threat_score FROM windowed")
CATEGORY = (
    "CASE WHEN dst_port IN (853, 4444) THEN 'C2_BEACON' WHEN segment = 'SWIFT' AND dst_port = 1433 THEN 'SWIFT_TAMPERING'"
    " WHEN bytes_sent > 500000 AND NOT is_internal_dst AND threat_score >= 0.6e0 THEN 'DATA_EXFIL'"
    " WHEN is_internal_src AND is_internal_dst AND threat_score >= 0.75e0 THEN 'LATERAL_MOVEMENT'"
    " WHEN threat_score >= 0.85e0 THEN 'ZERO_DAY' ELSE 'NORMAL' END"
)
cte("categorised", f"SELECT *, ROUND(threat_score, 6) AS attack_probability, {ladder('threat_score', K.FUSED_LADDER, 'NORMAL')} AS severity, {CATEGORY} AS predicted_category FROM boosted")
cte("correlated", f"SELECT *, {case('predicted_category', K.CATEGORY_TECHNIQUE, chr(39)*2)} AS mitre_technique FROM categorised")
cte("evaluated", "SELECT c.flow_id, c.attack_probability, l.is_attack FROM correlated c JOIN flow_labels l USING (flow_id)")
cte("byip", "SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ip_address ORDER BY hostname) AS rn FROM hosts) WHERE rn = 1")
cte("enriched", "SELECT c.*, s.hostname AS src_hostname, d.hostname AS dst_hostname, COALESCE(s.is_honeypot, FALSE) OR COALESCE(d.is_honeypot, FALSE) AS is_honeypot, CASE WHEN s.hostname IS NOT NULL THEN COALESCE(s.criticality, 'LOW') END AS src_criticality, CASE WHEN d.hostname IS NOT NULL THEN COALESCE(d.criticality, 'LOW') END AS dst_criticality, COALESCE(d.hostname, s.hostname, c.dst_ip) AS affected_asset FROM correlated c LEFT JOIN byip s ON c.src_ip = s.ip_address LEFT JOIN byip d ON c.dst_ip = d.ip_address")
cte("tiered", f"SELECT *, {ladder('attack_probability', K.RESPONSE_LADDER, 'LOW')} AS severity_label FROM enriched")
cte("seeds", "SELECT l.flow_id FROM flow_labels l JOIN flows f USING (flow_id) WHERE l.is_attack AND f.dst_port = 853 UNION SELECT 'NF-X-'||incident_id FROM tickets")

# ── sources ──
oracle("scan_netflow", f"SELECT flow_id, {REST}, EPOCH_US(start_time) AS start_us FROM netflow WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL")
oracle("scan_typed_logs", " UNION ALL ".join(
    f"SELECT '{v}' AS log, COUNT({k}) AS n_rows, MIN(EPOCH_US({ts})) AS first_us, MAX(EPOCH_US({ts})) AS last_us, COUNT(*) - COUNT({n}) AS n_null FROM {v}"
    for v, k, ts, n in [("zeek", "log_id", "ts", "ja3_hash"), ("windows_events", "event_log_id", "event_time", "source_ip"), ("ueba", "ueba_id", "event_time", "username")]
))
oracle("load_agent_scores", "SELECT id_orig_h AS src_ip, MAX((orig_bytes % 101)/100e0) AS packet_score FROM zeek GROUP BY 1")
oracle("load_seed_list", "SELECT DISTINCT flow_id FROM flow_labels WHERE is_attack")
oracle("sink_tables", "SELECT flow_id, ROUND(attack_probability, 4) AS attack_probability, severity, agents_fired, boost_applied, mitre_technique, predicted_category FROM correlated")

# ── cleaning ──
oracle("dedupe_flows", f"SELECT flow_id, {REST}, EPOCH_US(start_time) AS start_us FROM flows")
oracle("dedupe_windows_events", "SELECT event_log_id, EPOCH_US(event_time) AS event_us, event_id, hostname, subject_username FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY hostname, ROUND_EVEN(EPOCH_US(event_time)/1e6, 0), event_id, subject_username ORDER BY event_time, event_log_id) AS rn FROM (SELECT * FROM windows_events UNION ALL SELECT * REPLACE (event_time + INTERVAL 300 MILLISECOND AS event_time, event_log_id||'-copy' AS event_log_id) FROM windows_events)) WHERE rn = 1")
cte("wclean", "SELECT * EXCLUDE (rn) REPLACE (CASE WHEN source_ip IS NULL OR TRIM(source_ip) = '' THEN 'LOCAL' ELSE source_ip END AS source_ip) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY hostname, ROUND_EVEN(EPOCH_US(event_time)/1e6, 0), event_id, subject_username ORDER BY event_time, event_log_id) AS rn FROM windows_events) WHERE rn = 1")
oracle("impute_local_ip", "SELECT event_log_id, CASE WHEN source_ip IS NULL OR TRIM(source_ip) = '' THEN 'LOCAL' ELSE source_ip END AS source_ip FROM windows_events")
oracle("dedupe_hosts_by_ip", "SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ip_address ORDER BY hostname) AS rn FROM (SELECT * FROM hosts UNION ALL SELECT * REPLACE ('Z-'||hostname AS hostname) FROM hosts)) WHERE rn = 1")
cte("hctx", "SELECT hostname, MAX(ip_address) AS ip_address, MAX(COALESCE(segment, 'UNKNOWN')) AS segment, MAX(COALESCE(criticality, 'MEDIUM')) AS criticality, BOOL_OR(COALESCE(is_honeypot, FALSE)) AS is_honeypot FROM hosts GROUP BY 1")
oracle("host_context", "SELECT * FROM hctx")
RESOLVED = "CASE WHEN e.source_ip IS NOT NULL AND TRIM(e.source_ip) <> '' AND e.source_ip <> 'LOCAL' THEN e.source_ip ELSE COALESCE(h.ip_address, e.source_ip) END AS source_ip"
oracle("resolve_source_ip", f"SELECT e.event_log_id, {RESOLVED} FROM (SELECT * REPLACE (CASE WHEN source_ip IS NULL OR TRIM(source_ip) = '' THEN 'LOCAL' ELSE source_ip END AS source_ip) FROM windows_events) e LEFT JOIN hctx h USING (hostname)")
oracle("bool_normalise", "SELECT ueba_id, is_off_hours FROM ueba")

# ── joins ──
oracle("join_ja3_mode", "SELECT flow_id, src_ip, dst_ip, ja3_hash FROM flows_ja3")
oracle("join_flow_labels", "SELECT flow_id, flow_label FROM labelled")
oracle("join_labels_inner", "SELECT flow_id, flow_score, is_attack FROM fscore JOIN flow_labels USING (flow_id)")
oracle("join_agent_scores", "SELECT src_ip, flow_id, flow_score, packet_score, behavior_score FROM joined")
oracle("enrich_netflow", "SELECT flow_id, severity, src_ip, dst_ip, src_port, dst_port, segment, EPOCH_US(start_time) AS start_us, protocol, is_internal_src, is_internal_dst FROM correlated")
oracle("enrich_hosts_both_sides", "SELECT flow_id, src_hostname, dst_hostname, is_honeypot, affected_asset, src_criticality, dst_criticality FROM enriched")

cte("hourly", "SELECT HOUR(event_time) AS hour, COUNT(*) AS n FROM windows_events GROUP BY 1")
cte("busyhours", "SELECT hour, n FROM hourly WHERE n >= (SELECT QUANTILE_CONT(n, 0.5) FROM hourly)")
cte("wmarked", "SELECT * REPLACE (COALESCE(source_ip, 'LOCAL') AS source_ip), CAST(HOUR(event_time) NOT IN (SELECT hour FROM busyhours) AS INT) AS off FROM windows_events")
cte("zmarked", "SELECT *, CAST(HOUR(ts) NOT IN (SELECT hour FROM busyhours) AS INT) AS off FROM zeek")
WIN_AGG = (
    "COUNT(event_log_id) AS win_total_events, COUNT(DISTINCT hostname) AS win_unique_hosts, COUNT(DISTINCT subject_username) AS win_unique_users,"
    " COUNT(*) FILTER (event_id = 4625) AS win_failed_logons, COUNT(*) FILTER (event_id = 4688) AS win_process_creations,"
    " COUNT(*) FILTER (event_id = 4672) AS win_privileged_logons, COUNT(*) FILTER (event_id = 7045) AS win_service_installs,"
    " COUNT(*) FILTER (logon_type = 10) AS win_rdp_logons, COUNT(*) FILTER (logon_type = 3) AS win_network_logons,"
    " COUNT(*) FILTER (off = 1) AS win_off_hours_events"
)
ZEEK_AGG = (
    "COUNT(log_id) AS zeek_total_conns, COUNT(DISTINCT id_resp_h) AS zeek_unique_dst_ips, COUNT(DISTINCT id_resp_p) AS zeek_unique_dst_ports,"
    " COUNT(*) FILTER (conn_state IN ('S0', 'REJ')) AS zeek_failed_conns, COUNT(*) FILTER (service IN ('ssl', 'tls')) AS zeek_encrypted_conns,"
    " COUNT(*) FILTER (off = 1) AS zeek_off_hours_conns, AVG(duration) AS zeek_mean_duration, AVG(orig_bytes) AS zeek_mean_orig_bytes,"
    " AVG(resp_bytes) AS zeek_mean_resp_bytes, CAST(SUM(orig_bytes) AS BIGINT) AS zeek_total_orig_bytes,"
    " AVG(orig_bytes/CAST(GREATEST(resp_bytes, 1) AS DOUBLE)) AS zeek_mean_bytes_ratio, AVG(orig_pkts) AS zeek_mean_orig_pkts"
)
cte("winip", f"SELECT *, win_failed_logons/win_total_events AS win_fail_ratio, win_privileged_logons/win_total_events AS win_priv_ratio, win_process_creations/win_total_events AS win_process_ratio, win_off_hours_events/win_total_events AS win_off_hours_ratio FROM (SELECT source_ip, {WIN_AGG} FROM wmarked GROUP BY 1)")
cte("zeekip", f"SELECT *, zeek_failed_conns/zeek_total_conns AS zeek_fail_ratio, zeek_encrypted_conns/zeek_total_conns AS zeek_encrypted_ratio, zeek_off_hours_conns/zeek_total_conns AS zeek_off_hours_ratio, zeek_unique_dst_ports/GREATEST(zeek_unique_dst_ips, 1) AS zeek_dst_diversity FROM (SELECT id_orig_h AS source_ip, {ZEEK_AGG} FROM zmarked GROUP BY 1)")
cte("addresses", "SELECT COALESCE(w.source_ip, z.source_ip) AS source_ip, COALESCE(win_total_events, 0) AS win_total_events, COALESCE(win_unique_hosts, 0) AS win_unique_hosts, COALESCE(win_failed_logons, 0) AS win_failed_logons, COALESCE(zeek_total_conns, 0) AS zeek_total_conns, COALESCE(zeek_unique_dst_ports, 0) AS zeek_unique_dst_ports, COALESCE(win_fail_ratio, 0) AS win_fail_ratio, COALESCE(zeek_mean_bytes_ratio, 0) AS zeek_mean_bytes_ratio FROM winip w FULL JOIN zeekip z ON w.source_ip = z.source_ip")
oracle("outer_join_ip_features", "SELECT source_ip, win_total_events, win_unique_hosts, win_failed_logons, zeek_total_conns, zeek_unique_dst_ports FROM addresses")


def session_ctes(prefix: str, source: str, ip: str, ts: str) -> None:
    cte(f"{prefix}seq", f"SELECT *, CAST(SUM(opens) OVER (PARTITION BY {ip} ORDER BY {ts} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_seq FROM (SELECT *, CASE WHEN LAG({ts}) OVER (PARTITION BY {ip} ORDER BY {ts}) IS NULL OR EPOCH_US({ts}) - EPOCH_US(LAG({ts}) OVER (PARTITION BY {ip} ORDER BY {ts})) > 900000000 THEN 1 ELSE 0 END AS opens FROM {source})")


session_ctes("w", "wmarked", "source_ip", "event_time")
session_ctes("z", "zmarked", "id_orig_h", "ts")
cte("wsess", f"SELECT source_ip, source_ip||'_'||session_seq AS session_id, EPOCH_US(MIN(event_time)) AS start_us, {WIN_AGG}, COUNT(*) FILTER (is_anomaly) AS n_labelled FROM wseq GROUP BY 1, 2")
cte("zsess", f"SELECT id_orig_h AS source_ip, id_orig_h||'_'||session_seq AS session_id, EPOCH_US(MIN(ts)) AS start_us, {ZEEK_AGG}, COUNT(*) FILTER (is_anomaly) AS n_labelled FROM zseq GROUP BY 1, 2")
oracle("sessionize", "SELECT log_id, session_seq, id_orig_h||'_'||session_seq AS session_id FROM zseq")
oracle("session_features", "SELECT 'windows' AS log, source_ip, session_id, start_us, win_total_events AS n_events, win_unique_hosts AS n_targets, win_off_hours_events AS n_off_hours, ROUND(win_failed_logons/win_total_events, 6) AS fail_ratio, n_labelled FROM wsess UNION ALL SELECT 'zeek', source_ip, session_id, start_us, zeek_total_conns, zeek_unique_dst_ips, zeek_off_hours_conns, ROUND(zeek_failed_conns/zeek_total_conns, 6), n_labelled FROM zsess")
cte("nearest", "SELECT * FROM (SELECT w.source_ip, w.start_us AS win_us, z.start_us AS zeek_us, ROW_NUMBER() OVER (PARTITION BY w.source_ip, w.start_us ORDER BY ABS(w.start_us - z.start_us), z.start_us) AS rn FROM wsess w JOIN zsess z ON w.source_ip = z.source_ip AND ABS(w.start_us - z.start_us) <= 900000000) WHERE rn = 1")
cte("aligned", "SELECT w.source_ip, w.start_us AS win_us, z.start_us AS zeek_us, w.win_total_events, COALESCE(z.zeek_total_conns, 0) AS zeek_total_conns, w.n_labelled AS wl, COALESCE(z.n_labelled, 0) AS zl FROM wsess w LEFT JOIN nearest n ON w.source_ip = n.source_ip AND w.start_us = n.win_us LEFT JOIN zsess z ON z.source_ip = n.source_ip AND z.start_us = n.zeek_us UNION ALL SELECT z.source_ip, NULL, z.start_us, 0, z.zeek_total_conns, 0, z.n_labelled FROM zsess z WHERE NOT EXISTS (SELECT 1 FROM nearest n WHERE n.source_ip = z.source_ip AND n.zeek_us = z.start_us)")
oracle("asof_nearest_sessions", "SELECT source_ip, win_us, zeek_us, win_total_events, zeek_total_conns FROM aligned")
oracle("session_label", "SELECT source_ip||'|'||COALESCE(CAST(win_us AS VARCHAR), '')||'|'||COALESCE(CAST(zeek_us AS VARCHAR), '') AS session_key, CAST(wl > 0 OR zl > 0 AS INT) AS session_label FROM aligned")
oracle("seen_baseline_antijoin", "SELECT log_id, ja3_hash FROM zeek WHERE ja3_hash IS NOT NULL AND ja3_hash <> '' AND ja3_hash NOT IN (SELECT ja3_hash FROM zeek WHERE NOT is_anomaly AND ja3_hash IS NOT NULL)")

cte("edges", "SELECT src_ip, dst_ip, flow_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src_ip, dst_ip ORDER BY start_time DESC, flow_id DESC) AS rn FROM netflow WHERE COALESCE(is_internal_src, FALSE) AND COALESCE(is_internal_dst, FALSE)) WHERE rn = 1")
PATHS = (
    "SELECT 'COMM-018' AS incident_id, a.src_ip||'→'||b.src_ip||'→'||c.src_ip||'→'||c.dst_ip AS kill_chain, a.src_ip AS source_host,"
    " a.flow_id||'|'||b.flow_id||'|'||c.flow_id AS chain_flow_ids, '" + "|".join(K.KILL_CHAIN_TACTICS) + "' AS mitre_tactics, '"
    + "|".join(K.KILL_CHAIN_TECHNIQUES) + "' AS mitre_techniques, 0.95e0 AS confidence"
    " FROM edges a JOIN edges b ON a.dst_ip = b.src_ip JOIN edges c ON b.dst_ip = c.src_ip"
    " WHERE a.src_ip IN (SELECT ip_address FROM hosts WHERE hostname LIKE 'WS-KTM-%') AND b.src_ip IN (SELECT ip_address FROM hosts WHERE hostname = 'SRV-DC-01')"
    " AND c.src_ip IN (SELECT ip_address FROM hosts WHERE hostname = 'SRV-SQL-01') AND c.dst_ip IN (SELECT ip_address FROM hosts WHERE hostname = 'SWIFT-GW-01')"
)
oracle("killchain_paths", PATHS)
oracle("sink_findings_json", PATHS)

# ── per-flow features ──
FEATURES = {
    "bytes_sent_per_sec": "COALESCE(bytes_sent, 0)/GREATEST(duration_sec, 0.001e0)",
    "bytes_per_pkt": "COALESCE(bytes_sent, 0)/GREATEST(packets_sent, 1)",
    "pkt_sent_ratio": "packets_sent/GREATEST(packets_sent + packets_recv, 1)",
    "segment_risk": case("segment", K.SEGMENT_RISK, "0.1e0"),
    "dst_port_risk": case("dst_port", K.PORT_RISK, "0.05e0"),
    "is_internal_to_ext": "CAST(COALESCE(is_internal_src, TRUE) AND NOT COALESCE(is_internal_dst, FALSE) AS INT)",
    "flag_syn_only": "CAST(tcp_flags = 'S' AS INT)",
    "hour_sin": "SIN(2*PI()*HOUR(start_time)/24)",
    "hour_cos": "COS(2*PI()*HOUR(start_time)/24)",
    "dow_sin": "SIN(2*PI()*(ISODOW(start_time)-1)/7)",
    "dow_cos": "COS(2*PI()*(ISODOW(start_time)-1)/7)",
    "is_c2_time_window": "CAST(ISODOW(start_time) = 6 AND HOUR(start_time) >= 3 AND HOUR(start_time) < 5 AS INT)",
    "is_swift_sql": f"CAST({SWIFT_SQL} AS INT)",
    "is_encrypted_dns": "CAST(dst_port = 853 AND segment = 'WORKSTATION' AS INT)",
    "swift_direct_internet": "CAST(segment = 'SWIFT' AND COALESCE(is_internal_src, TRUE) AND NOT COALESCE(is_internal_dst, FALSE) AS INT)",
    "is_known_c2_ja3": f"CAST(ja3_hash = '{K.KNOWN_C2_JA3}' AS INT)",
    "ja3_unseen_in_normal": "CAST(ja3_hash NOT IN (SELECT ja3_hash FROM labelled WHERE flow_label = 'NORMAL') AS INT)",
}


def features(names, decimals=None) -> str:
    return ", ".join(f"ROUND({FEATURES[n]}, {decimals}) AS {n}" if decimals else f"{FEATURES[n]} AS {n}" for n in names)


TIMES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]
oracle("flow_traffic_features", f"SELECT flow_id, {features(['bytes_sent_per_sec', 'bytes_per_pkt', 'pkt_sent_ratio'], 6)} FROM flows")
oracle("flow_segment_features", f"SELECT flow_id, {features(['segment_risk', 'is_internal_to_ext', 'swift_direct_internet'])} FROM flows")
oracle("flow_port_features", f"SELECT flow_id, {features(['dst_port_risk', 'is_swift_sql', 'is_encrypted_dns'])} FROM flows")
oracle("flow_time_features", f"SELECT flow_id, {features(TIMES, 6)}, {features(['is_c2_time_window'])} FROM flows")
oracle("flow_ja3_features", f"SELECT flow_id, {features(['is_known_c2_ja3', 'ja3_unseen_in_normal'])} FROM labelled")
oracle("ip_is_internal", "SELECT flow_id, ip, STARTS_WITH(ip, '10.') OR STARTS_WITH(ip, '192.168.') OR STARTS_WITH(ip, '172.16.') AS is_internal FROM (SELECT flow_id, src_ip AS ip FROM flows UNION ALL SELECT flow_id, dst_ip FROM flows)")
oracle("flow_flag_syn", f"SELECT flow_id, {features(['flag_syn_only'])} FROM flows")
cte("srcstats", "SELECT src_ip, COUNT(DISTINCT dst_ip) AS unique_dst_ips, COUNT(flow_id) AS flow_count FROM flows GROUP BY 1")
oracle("src_stats", "SELECT * FROM srcstats")
cte("ranked", f"SELECT flow_id, src_ip, EPOCH_US(start_time) AS us, ROW_NUMBER() OVER (PARTITION BY src_ip ORDER BY EPOCH_US(start_time), {slice_of('flow_id')}, flow_id) AS rn FROM flows WHERE {SWIFT_SQL}")
cte("counted", "SELECT *, rn - MIN(rn) OVER (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 119999999 PRECEDING AND CURRENT ROW) + 1 AS count_2min FROM ranked")
cte("ratestats", "SELECT AVG(count_2min) AS mean, STDDEV_SAMP(count_2min) + 1e-9 AS std FROM counted")
oracle("swift_rate_stats", "SELECT ROUND(mean, 6) AS mean, ROUND(std, 6) AS std FROM ratestats")
cte("rated", "SELECT flow_id, (count_2min - (SELECT mean FROM ratestats))/(SELECT std FROM ratestats) AS z, CAST(count_2min > 400 AS INT) AS over FROM counted")
oracle("swift_rolling_rate", "SELECT f.flow_id, ROUND(COALESCE(r.z, 0), 6) AS swift_query_zscore, COALESCE(r.over, 0) AS swift_rate_exceeded FROM flows f LEFT JOIN rated r USING (flow_id)")
cte("vectors", f"SELECT l.flow_id, {features(FEATURES)}, s.unique_dst_ips, s.flow_count, COALESCE(r.z, 0) AS swift_query_zscore, COALESCE(r.over, 0) AS swift_rate_exceeded, l.is_attack FROM labelled l LEFT JOIN srcstats s USING (src_ip) LEFT JOIN rated r USING (flow_id)")
ALL = ["bytes_sent_per_sec", *K.CLASSIFIER_FEATURES]
oracle("flow_feature_vector", "SELECT flow_id, " + ", ".join(f"ROUND(CAST({c} AS DOUBLE), 6) AS {c}" for c in ALL) + " FROM vectors")
RISK = case("event_type", K.EVENT_TYPE_RISK, "0.05e0")
cte("uvec", f"SELECT ueba_id, CAST(bytes_transferred AS DOUBLE) AS bytes_transferred, duration_sec, CAST(failed_attempts_prior_1h AS DOUBLE) AS failed_attempts_prior_1h, peer_group_deviation_score, CAST(is_off_hours AS INT) AS is_off_hours_num, CAST(is_new_resource AS INT) AS is_new_resource_num, CAST(HOUR(event_time) AS INT) AS hour_of_day, CAST(ISODOW(event_time) - 1 AS INT) AS day_of_week, {RISK} AS event_type_risk FROM ueba")
oracle("ueba_features", "SELECT * REPLACE (ROUND(event_type_risk, 6) AS event_type_risk) FROM uvec")
oracle("standard_scaler", "SELECT ueba_id, " + ", ".join(f"ROUND(({c} - (SELECT AVG({c}) FROM uvec))/(SELECT CASE WHEN STDDEV_POP({c}) > 0 THEN STDDEV_POP({c}) ELSE 1 END FROM uvec), 5) AS {c}" for c in K.USER_FEATURES) + " FROM uvec")
FLOW_BINS = "CASE WHEN {p} > 0 AND {p} <= 0.6e0 THEN 'NORMAL' WHEN {p} > 0.6e0 AND {p} <= 0.75e0 THEN 'MEDIUM' WHEN {p} > 0.75e0 AND {p} <= 0.9e0 THEN 'HIGH' WHEN {p} > 0.9e0 AND {p} <= 1 THEN 'CRITICAL' END"
oracle("assign_severity_flow", f"SELECT *, {FLOW_BINS.format(p='flow_score')} AS severity FROM fscore")
oracle("assign_severity_fused", f"SELECT *, {ladder('flow_score', K.FUSED_LADDER, 'NORMAL')} AS severity FROM fscore")
oracle("assign_severity_response", f"SELECT *, {ladder('flow_score', K.RESPONSE_LADDER, 'LOW')} AS severity_label FROM fscore")
oracle("classify_category", "SELECT flow_id, attack_probability, severity, predicted_category, mitre_technique FROM correlated")
oracle("map_mitre", "SELECT predicted_category, COUNT(*) AS n, ANY_VALUE(mitre_technique) AS mitre_technique FROM correlated GROUP BY 1")
FINAL = "SELECT flow_id, ROUND(attack_probability, 4) AS attack_probability, CASE WHEN NOT attack_probability >= {t} THEN 'NORMAL' WHEN is_honeypot OR severity_label = 'CRITICAL' THEN 'BLOCK' ELSE 'ALERT' END AS attack_decision, predicted_category AS attack_category_predicted, mitre_technique AS mitre_technique_predicted FROM {src}"
oracle("attack_decision", FINAL.format(t="0.5e0", src="tiered"))
oracle("honeypot_override", "SELECT flow_id, is_honeypot, CASE WHEN is_honeypot THEN 'CRITICAL' ELSE severity_label END AS severity_label FROM tiered")
cte("overridden", "SELECT t.* REPLACE (CASE WHEN s.flow_id IS NOT NULL THEN 1e0 ELSE attack_probability END AS attack_probability, CASE WHEN s.flow_id IS NOT NULL THEN 'CRITICAL' ELSE severity_label END AS severity_label) FROM tiered t LEFT JOIN seeds s ON t.flow_id = s.flow_id")
oracle("seed_override", "SELECT flow_id, attack_probability, severity_label FROM overridden")
BPP = "COALESCE(bytes_sent, 0)/GREATEST(packets_sent, 1)"
SMALL = f"NOT COALESCE(is_internal_src, FALSE) AND {BPP} < 500"
oracle("cti_overrides", f"SELECT flow_id, CASE WHEN k IS NOT NULL THEN 1e0 ELSE p END AS attack_probability, CASE WHEN k IS NOT NULL THEN 'CRITICAL' ELSE {FLOW_BINS.format(p='p')} END AS severity, COALESCE(k, 'Anomalous Traffic (ML)') AS attack_type FROM (SELECT flow_id, {FSCORE} AS p, CASE WHEN {SMALL} THEN 'Data Exfiltration (Small Packets)' WHEN {SWIFT_SQL} THEN 'SWIFT SQL Injection Probe' WHEN ja3_hash = '{K.KNOWN_C2_JA3}' THEN 'C2 Beacon (Malicious JA3)' END AS k FROM flows_ja3)")

HASHES = ", ".join(f"'{h}'" for h in K.LIVE_MALICIOUS_JA3)


def live_case(outputs: list[str], score: str = "correlation_score") -> str:
    conditions = [
        f"ja3_hash IN ({HASHES})", SWIFT_SQL, SMALL, f"{score} > 0.86e0 AND dst_port = 853",
        f"{score} > 0.86e0 AND NOT COALESCE(is_internal_src, FALSE)", f"{score} > 0.86e0 AND dst_port IN (3389, 445)", f"{score} > 0.86e0",
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{o}'" for c, o in zip(conditions, outputs)) + " END"


ATTACKS = ["C2 Beacon (Malicious JA3)", "SWIFT SQL Injection Probe", "Data Exfiltration (Small Packets)", "Suspicious Encrypted DNS", "Anomalous External Access", "Anomalous Lateral Movement", "Unknown Anomaly (Correlation Detection)"]
TIERS = ["CRITICAL", "CRITICAL", "CRITICAL", "HIGH", "HIGH", "HIGH", "MEDIUM"]


def live_ctes(name: str, source: str) -> None:
    cte(f"{name}_f", f"SELECT *, {fusion(FSCORE, '((src_port*3) % 100/100e0)', '(src_port % 100/100e0)')} AS correlation_score FROM {source}")
    cte(name, f"SELECT *, {live_case(ATTACKS)} AS attack_name, {live_case(TIERS)} AS live_severity FROM {name}_f")


cte("raw_ja3", "SELECT f.*, COALESCE(m.ja3_hash, 'UNKNOWN') AS ja3_hash FROM netflow f LEFT JOIN ja3mode m ON f.src_ip = m.src_ip AND f.dst_ip = m.dst_ip")
live_ctes("livescored", "flows_ja3")
live_ctes("streamscored", "raw_ja3")
oracle("classify_live_attack", "SELECT flow_id, attack_name, live_severity, ROUND(correlation_score, 6) AS correlation_score FROM livescored")
oracle("stream_score_flows", "SELECT flow_id, attack_name, live_severity, ROUND(correlation_score, 6) AS correlation_score FROM streamscored")
oracle("stream_counters", "SELECT COUNT(*) AS total, COUNT(*) - COUNT(attack_name) AS benign, COUNT(attack_name) AS threats FROM streamscored")
cte("candidates", "SELECT src_ip, attack_name, EPOCH_US(DATE_TRUNC('second', start_time)) AS alert_us, MIN(live_severity) AS severity FROM livescored WHERE attack_name IS NOT NULL GROUP BY 1, 2, 3")
oracle("recent_alerts", "SELECT src_ip, attack_name, severity, alert_us FROM candidates ORDER BY alert_us DESC, src_ip, attack_name LIMIT 50")


def cooldown(source: str) -> str:
    """The emitted alerts, found by stepping from each alert to the first one after its cooldown."""
    return (
        f"SELECT src_ip, attack_name, severity, alert_us FROM (WITH RECURSIVE chain AS ("
        f"SELECT src_ip, attack_name, MIN(alert_us) AS alert_us FROM {source} GROUP BY 1, 2"
        f" UNION ALL SELECT h.src_ip, h.attack_name, MIN(c.alert_us) FROM chain h JOIN {source} c"
        f" ON c.src_ip = h.src_ip AND c.attack_name = h.attack_name AND c.alert_us > h.alert_us + 10000000 GROUP BY 1, 2)"
        f" SELECT chain.*, c.severity FROM chain JOIN {source} c USING (src_ip, attack_name, alert_us))"
    )


oracle("alert_cooldown_batch", cooldown("candidates"))
cte("rawcandidates", "SELECT src_ip, attack_name, EPOCH_US(DATE_TRUNC('second', start_time)) AS alert_us, MIN(live_severity) AS severity FROM streamscored WHERE attack_name IS NOT NULL GROUP BY 1, 2, 3")
cte("streamend", "SELECT MAX(EPOCH_US(DATE_TRUNC('second', start_time))) - 600000000 AS passed_us FROM streamscored")
oracle("stream_alert_cooldown", f"SELECT * FROM ({cooldown('rawcandidates')}) WHERE alert_us <= (SELECT passed_us FROM streamend)")
cte("strongest", "SELECT * FROM (SELECT src_ip AS ip, attack_name AS name, EPOCH_US(DATE_TRUNC('second', start_time)) AS at_us, correlation_score, " + FSCORE + " AS flow_score, (src_port*3) % 100/100e0 AS behavior_score, src_port % 100/100e0 AS packet_score FROM streamscored WHERE attack_name IS NOT NULL) QUALIFY ROW_NUMBER() OVER (PARTITION BY ip, name, at_us ORDER BY correlation_score DESC, flow_score DESC, behavior_score DESC, packet_score DESC) = 1")
oracle("stream_sink_alerts", f"SELECT alert_us, ip, attack_name, severity, ROUND(correlation_score, 2) AS correlation_score, ROUND(flow_score, 2) AS flow_score, ROUND(behavior_score, 2) AS behavior_score, ROUND(packet_score, 2) AS packet_score FROM ({cooldown('rawcandidates')}) c JOIN strongest s ON c.src_ip = s.ip AND c.attack_name = s.name AND c.alert_us = s.at_us WHERE alert_us <= (SELECT passed_us FROM streamend)")
LOOP = "('127.0.0.1', 'localhost', '::1')"
cte("blocked", f"SELECT src_ip, MIN(start_time) AS block_time FROM livescored WHERE attack_name IS NOT NULL AND src_ip NOT IN {LOOP} GROUP BY 1")
cte("rawblocked", f"SELECT src_ip, MIN(start_time) AS block_time FROM streamscored WHERE attack_name IS NOT NULL AND src_ip NOT IN {LOOP} GROUP BY 1")
oracle("blocked_sources", "SELECT src_ip, EPOCH_US(block_time) AS block_us FROM blocked")
oracle("stream_blocklist", "SELECT f.src_ip, COUNT(*) AS n_passed FROM netflow f LEFT JOIN rawblocked b ON f.src_ip = b.src_ip WHERE b.src_ip IS NULL OR f.start_time <= b.block_time GROUP BY 1")
oracle("unblock_ip", "SELECT b.src_ip, EPOCH_US(b.block_time) AS block_us FROM blocked b LEFT JOIN (SELECT f.src_ip, MAX(f.start_time) AS u FROM flows f JOIN flow_labels l USING (flow_id) WHERE NOT l.is_attack AND f.packets_recv = 0 GROUP BY 1) r ON b.src_ip = r.src_ip WHERE r.u IS NULL OR r.u < b.block_time")
oracle("stream_arrival_rate", f"SELECT src_ip, us AS start_us, n AS n_arrivals, CAST(SUM(n) OVER (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 119999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS count_2min FROM (SELECT src_ip, EPOCH_US(start_time) AS us, COUNT(*) AS n FROM netflow WHERE {SWIFT_SQL} GROUP BY 1, 2) QUALIFY us <= (SELECT MAX(EPOCH_US(start_time))//1000*1000 - 600000000 FROM netflow WHERE {SWIFT_SQL})")
oracle("stream_rate_window", f"SELECT src_ip, s AS start_us, s + 120000000 AS end_us, COUNT(*) AS n_queries FROM (SELECT src_ip, (EPOCH_US(start_time)//10000000)*10000000 - k*10000000 AS s FROM netflow, RANGE(0, 12) r(k) WHERE {SWIFT_SQL}) GROUP BY 1, 2 HAVING s + 120000000 <= (SELECT MAX(EPOCH_US(start_time))//1000*1000 - 600000000 FROM netflow WHERE {SWIFT_SQL})")
oracle("stream_source_flows", f"SELECT flow_id, src_ip, dst_ip, EPOCH_US(start_time) AS start_us, CAST(packets_sent AS DOUBLE) AS packets_sent, bytes_sent, dst_port, COALESCE(is_internal_src, FALSE) AS is_internal_src, ja3_hash, CASE WHEN src_port % 7 = 0 THEN 0.05e0 ELSE src_port % 100/100e0 END AS packet_score, CASE WHEN src_port % 7 = 0 THEN 0.05e0 ELSE src_port*3 % 100/100e0 END AS behavior_score FROM flows_ja3 WHERE src_port % 53 <> 0 AND src_port % 59 <> 0 AND bytes_sent IS NOT NULL")

# ── user rules ──
cte("ubase", f"SELECT u.*, LOWER(username) AS lu, LOWER(resource_accessed) AS lr, COALESCE(CAST(SUM(bytes_transferred) OVER w AS BIGINT), 0) AS pb, COUNT(*) OVER w AS pn FROM ueba u WINDOW w AS (PARTITION BY LOWER(username) ORDER BY EPOCH_US(event_time), {slice_of('ueba_id')}, ueba_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
cte("utrain", "SELECT username AS tu, CAST(SUM(bytes_transferred) AS BIGINT) AS tb, COUNT(*) AS tn FROM ueba GROUP BY 1")
cte("uavg", "SELECT b.*, CASE WHEN COALESCE(tn, 0) + pn > 0 THEN (COALESCE(tb, 0) + pb)/(COALESCE(tn, 0) + pn) ELSE 0e0 END AS avg_bytes FROM ubase b LEFT JOIN utrain t ON b.lu = t.tu")
oracle("user_baseline_bytes", "SELECT ueba_id, ROUND(avg_bytes, 4) AS avg_bytes FROM uavg")
WL = ", ".join(f"'{u}'" for u in K.RESOURCE_WHITELIST)
cte("uflags", f"SELECT a.*, is_off_hours AND NOT (STARTS_WITH(lu, 'srv_') OR STARTS_WITH(lu, 'svc_')) AS off, is_off_hours AND NOT (STARTS_WITH(lu, 'srv_') OR STARTS_WITH(lu, 'svc_')) AND ISODOW(event_time) = 6 AND HOUR(event_time) BETWEEN 3 AND 5 AS weekend, bytes_transferred > 100000000 AND avg_bytes < 5000000 AS huge, bytes_transferred > 50000000 AND avg_bytes < 5000000 AS big, CONTAINS(lr, 'swift') AS sw, CONTAINS(lr, 'pumori') AND lu NOT IN ({WL}) AS unauth, COALESCE(h.segment = 'SWIFT', FALSE) AS swh, COALESCE(h.is_honeypot, FALSE) AS hp, h.ip_address AS hip FROM uavg a LEFT JOIN hctx h ON a.hostname = h.hostname")
RULE = (
    "CASE WHEN off THEN 0.08e0 ELSE 0e0 END + CASE WHEN weekend THEN 0.1e0 ELSE 0e0 END"
    " + CASE WHEN peer_group_deviation_score >= 0.8e0 THEN 0.25e0 WHEN peer_group_deviation_score >= 0.65e0 THEN 0.1e0 ELSE 0e0 END"
    " + CASE WHEN huge THEN 0.35e0 WHEN big THEN 0.15e0 ELSE 0e0 END"
    " + CASE WHEN is_new_resource AND sw THEN 0.2e0 WHEN is_new_resource THEN 0.05e0 ELSE 0e0 END"
    " + CASE WHEN failed_attempts_prior_1h >= 10 THEN 0.3e0 WHEN failed_attempts_prior_1h >= 5 THEN 0.1e0 ELSE 0e0 END"
    " + CASE WHEN off AND swh THEN 0.3e0 ELSE 0e0 END + CASE WHEN unauth THEN 0.55e0 ELSE 0e0 END + CASE WHEN hp THEN 0.6e0 ELSE 0e0 END"
)
MARKS = [
    ("off", "off_hours"), ("weekend", "weekend_early_morning"), ("peer_group_deviation_score >= 0.8e0", "high_peer_deviation"),
    ("peer_group_deviation_score >= 0.65e0 AND peer_group_deviation_score < 0.8e0", "elevated_peer_deviation"), ("big", "large_data_transfer"),
    ("is_new_resource AND sw", "new_swift_resource"), ("is_new_resource AND NOT sw", "new_resource"), ("failed_attempts_prior_1h >= 10", "failed_access_spike"),
    ("failed_attempts_prior_1h >= 5 AND failed_attempts_prior_1h < 10", "failed_access_elevated"), ("off AND swh", "swift_off_hours"),
    ("unauth", "unauthorized_pumori"), ("hp", "honeypot_contact"),
]
ML_MARK = ("ml > 0.7e0 AND rule_score < 0.5e0", "ml_anomaly")


def marks(entries) -> str:
    return "CONCAT_WS('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in entries) + ")"


def pairs(entries) -> str:
    quiet = {"weekend_early_morning", "new_resource", "honeypot_contact"}
    shown = [("huge" if n == "large_data_transfer" else c, n) for c, n in entries if n not in quiet]
    return marks([(c, ":".join(K.USER_FLAG_TECHNIQUE[n])) for c, n in shown])


cte("uruled", f"SELECT *, LEAST({RULE}, 1e0) AS rule_score, ((ueba_id*31) % 101)/100e0 AS ml FROM uflags")
oracle("ueba_rules", f"SELECT ueba_id, ROUND(rule_score, 6) AS rule_score, {marks(MARKS)} AS flags, {pairs(MARKS)} AS mitre FROM uruled")
HYBRID = "LEAST(1e0, CASE WHEN ml >= 0.55e0 AND rule_score >= 0.55e0 THEN LEAST(GREATEST(ml, rule_score) + 0.1e0, 1e0) WHEN rule_score < 0.1e0 THEN ml*0.5e0 WHEN rule_score < 0.2e0 THEN ml*0.7e0 WHEN rule_score < 0.35e0 THEN ml*0.85e0 ELSE GREATEST(ml, rule_score) END)"
USER_IP = "CASE WHEN source_ip IS NULL OR TRIM(source_ip) = '' THEN COALESCE(hip, '') ELSE source_ip END"
cte("uresults", f"SELECT CAST(ueba_id AS VARCHAR) AS event_ref, 'ueba' AS source, username||'@'||hostname AS entity, event_time, ROUND({HYBRID}, 4) AS score, ROUND(ml, 4) AS ml_score, ROUND(rule_score, 4) AS rule_score, {marks(MARKS + [ML_MARK])} AS flags, {pairs(MARKS + [ML_MARK])} AS mitre, {USER_IP} AS source_ip, username, hostname FROM uruled")
oracle("hybrid_score", "SELECT event_ref, score, ml_score, rule_score, flags, source_ip FROM uresults")
oracle("score_summary", "SELECT ROUND(AVG(score), 4) AS mean_score, MAX(score) AS max_score, COUNT(*) FILTER (score >= 0.75e0) AS n_flagged, 'batch' AS cut FROM uresults UNION ALL SELECT ROUND(AVG(score), 4), MAX(score), COUNT(*) FILTER (score >= 0.7e0), 'runner' FROM uresults")
cte("squeries", f"SELECT u.*, h.ip_address AS hip, EPOCH_US(event_time) AS us, ROW_NUMBER() OVER (PARTITION BY username ORDER BY EPOCH_US(event_time), {slice_of('ueba_id')}, ueba_id) AS rn FROM ueba u LEFT JOIN hctx h ON u.hostname = h.hostname WHERE event_type = 'DB_QUERY' AND (COALESCE(h.segment = 'SWIFT', FALSE) OR CONTAINS(LOWER(resource_accessed), 'swift'))")
cte("scounted", "SELECT *, rn - MIN(rn) OVER (PARTITION BY username ORDER BY us RANGE BETWEEN 120000000 PRECEDING AND CURRENT ROW) + 1 AS c FROM squeries")


def velocity(limit: int) -> str:
    return f"SELECT {limit} AS limit_, username, ueba_id, us AS event_us, c AS count_in_window, hostname, {USER_IP} AS source_ip FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY username ORDER BY us, c, ueba_id) AS hit FROM scounted WHERE c > {limit}) WHERE hit = 1"


oracle("swift_query_velocity", velocity(80) + " UNION ALL " + velocity(400))
cte("vresults", f"SELECT CAST(ueba_id AS VARCHAR) AS event_ref, 'ueba_velocity' AS source, username||'@'||hostname AS entity, MAKE_TIMESTAMP(event_us) AS event_time, 1e0 AS score, 0e0 AS ml_score, 1e0 AS rule_score, 'swift_query_velocity' AS flags, 'Collection:T1005' AS mitre, source_ip, username, hostname FROM ({velocity(400)})")
oracle("user_profiles", "SELECT username, COUNT(*) AS event_count, CAST(SUM(bytes_transferred) AS BIGINT) AS bytes_total, ROUND(AVG(bytes_transferred), 4) AS bytes_mean, ROUND(AVG(peer_group_deviation_score), 6) AS peer_mean, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT HOUR(event_time))), ',') AS login_hours FROM ueba GROUP BY 1")

# ── Windows rules ──
cte("wlow", f"SELECT e.*, LOWER(subject_username) AS su, LOWER(target_username) AS tu, LOWER(process_name) AS pn, LOWER(parent_process) AS pp, {OFF.format(t='event_time')} AS off, EPOCH_US(event_time) AS us FROM wclean e")
HV = "(CONTAINS({n}, 'admin') OR CONTAINS({n}, 'sql') OR CONTAINS({n}, 'db') OR CONTAINS({n}, 'svc'))"
cte("wfail", f"SELECT *, ROW_NUMBER() OVER (PARTITION BY tu ORDER BY us, {slice_of('event_log_id')}, event_log_id) AS rn FROM wlow WHERE event_id = 4625")
cte("wbrute", "SELECT *, rn - MIN(rn) OVER (PARTITION BY tu ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) + 1 AS n_failures, us - MIN(us) OVER (PARTITION BY tu ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS spread FROM wfail")
cte("walertb", f"SELECT *, CASE WHEN n_failures >= 10 AND spread < 5000000 THEN 0.9e0 WHEN n_failures >= 10 THEN 0.7e0 WHEN off AND {HV.format(n='tu')} THEN 0.8e0 END AS score, CASE WHEN n_failures >= 10 THEN 'brute_force' WHEN off AND {HV.format(n='tu')} THEN 'kerberoasting' END AS flag FROM wbrute")
oracle("brute_force_window", "SELECT event_log_id, n_failures, score, flag FROM walertb")
cte("wshare", f"SELECT *, ROW_NUMBER() OVER (PARTITION BY su ORDER BY us, {slice_of('event_log_id')}, event_log_id) AS share_count FROM wlow WHERE event_id = 5140")
oracle("share_access_running", "SELECT event_log_id, share_count, share_count >= 50 AS alert FROM wshare")
listed = {n: v for n, v in K.LISTED_PROCESS.items() if n == n.lower()}
SVC = "CASE WHEN STARTS_WITH(w.hostname, 'ATM-') THEN {atm} " + " ".join(f"WHEN pn = '{n}' THEN {{p_{i}}}" for i, n in enumerate(listed)) + " ELSE {rest} END"
svc_score = SVC.format(atm="1e0", rest="0.45e0", **{f"p_{i}": f"{v[1]}e0" for i, v in enumerate(listed.values())})
svc_flag = SVC.format(atm="'new_service_atm'", rest="'new_service'", **{f"p_{i}": "'new_service'" for i in range(len(listed))})
PROC = "CASE " + " ".join(f"WHEN pn = '{c}' AND pp = '{p}' THEN {{combo_{i}}}" for i, (c, p) in enumerate(K.PARENT_COMBO)) + " " + " ".join(f"WHEN pn = '{n}' THEN {{p_{i}}}" for i, n in enumerate(listed)) + " END"
proc_score = PROC.format(**{f"combo_{i}": f"{s}e0" for i, s in enumerate(K.PARENT_COMBO.values())}, **{f"p_{i}": f"{v[1]}e0" for i, v in enumerate(listed.values())})
proc_flag = PROC.format(**{f"combo_{i}": "'suspicious_process'" for i in range(len(K.PARENT_COMBO))}, **{f"p_{i}": f"'{v[0]}'" for i, v in enumerate(listed.values())})
ADM = ", ".join(f"'{a}'" for a in K.ADMIN_ACCOUNTS)
LATE = "CASE WHEN off THEN 0.8e0 ELSE 0.5e0 END"
SHELL = "logon_type = 3 AND pn IN ('cmd.exe', 'powershell.exe', 'lsass.exe', 'mimikatz.exe')"
PRIV = f"su NOT IN ({ADM}) AND NOT ENDS_WITH(su, '$')"
cte("wplain", f"""SELECT w.*, CASE event_id WHEN 1102 THEN 1e0 WHEN 7045 THEN {svc_score} WHEN 4688 THEN {proc_score} WHEN 4672 THEN CASE WHEN {PRIV} THEN {LATE} END WHEN 4648 THEN {LATE} WHEN 4740 THEN 0.5e0
 WHEN 4698 THEN CASE WHEN off OR COALESCE(h.segment IN ('CORE_BANKING', 'SWIFT'), FALSE) THEN 0.8e0 ELSE 0.5e0 END WHEN 4720 THEN {LATE} WHEN 4771 THEN CASE WHEN off AND {HV.format(n='tu')} THEN 0.8e0 END
 WHEN 4769 THEN CASE WHEN off AND ({HV.format(n='tu')} OR {HV.format(n='su')}) THEN 0.8e0 END WHEN 4624 THEN CASE WHEN {SHELL} THEN 0.85e0 WHEN off AND logon_type IN (7, 8, 10) THEN 0.5e0 END END AS score,
 CASE event_id WHEN 1102 THEN 'audit_log_cleared' WHEN 7045 THEN {svc_flag} WHEN 4688 THEN {proc_flag} WHEN 4672 THEN 'priv_escalation' WHEN 4648 THEN 'explicit_credential' WHEN 4740 THEN 'account_lockout' WHEN 4698 THEN 'scheduled_task'
 WHEN 4720 THEN 'user_created' WHEN 4771 THEN 'kerberoasting' WHEN 4769 THEN 'kerberoasting' WHEN 4624 THEN CASE WHEN {SHELL} THEN 'pass_the_hash' ELSE 'off_hours_logon' END END AS flag
 FROM wlow w LEFT JOIN hctx h ON w.hostname = h.hostname WHERE event_id NOT IN (4625, 5140)""")
cte("wall", "SELECT event_log_id, event_time, event_id, hostname, source_ip, su, score, flag FROM wplain UNION ALL SELECT event_log_id, event_time, event_id, hostname, source_ip, su, score, flag FROM walertb UNION ALL SELECT event_log_id, event_time, event_id, hostname, source_ip, su, 0.75e0, 'share_access_bulk' FROM wshare WHERE share_count >= 50")
cte("walerts", f"SELECT event_log_id, event_time, event_id, e.hostname, {RESOLVED}, su AS username, score, flag, CASE WHEN event_id = 4625 OR flag IN ('account_lockout', 'kerberoasting') THEN 'BRUTE_FORCE' WHEN flag = 'share_access_bulk' THEN 'RANSOMWARE_STAGING' WHEN flag = 'new_service_atm' THEN 'ATM_JACKPOTTING' WHEN flag IN ('explicit_credential', 'pass_the_hash') THEN 'LATERAL_MOVEMENT' WHEN flag = 'off_hours_logon' THEN NULL ELSE 'INSIDER_THREAT' END AS category FROM wall e LEFT JOIN hctx h ON e.hostname = h.hostname WHERE score IS NOT NULL")
oracle("windows_event_rules", "SELECT event_log_id, event_id, hostname, username, source_ip, score, flag, category FROM walerts")
oracle("windows_scores_back_to_events", "SELECT e.event_log_id, COALESCE(a.score, 0e0) AS score, e.is_anomaly FROM wclean e LEFT JOIN walerts a USING (event_log_id)")
WMITRE = case("flag", {k: ":".join(v) for k, v in K.WINDOWS_FLAG_TECHNIQUE.items()}, "''")
cte("results", f"SELECT * FROM uresults UNION ALL SELECT event_log_id, 'windows', username||'@'||hostname, event_time, score, 0e0, score, flag, {WMITRE}, source_ip, username, hostname FROM walerts UNION ALL SELECT * FROM vresults")
oracle("behavior_detail_union", "SELECT event_ref, source, entity, score, ml_score, rule_score, flags, mitre, source_ip FROM results")
oracle("flag_counts", "SELECT flag, COUNT(*) AS n FROM (SELECT UNNEST(STRING_SPLIT(flags, '|')) AS flag FROM results WHERE flags <> '') GROUP BY 1")


def raised_list(flags: list[str]) -> str:
    return "MAX(CAST(" + " OR ".join(f"LIST_CONTAINS(fl, '{f}')" for f in flags) + " AS INT))"


INDS = ", ".join(f"{raised_list(f)} AS {n}" for n, f in INDICATORS.items())
cte("byaddr", f"SELECT source_ip, ROUND(MAX(score), 4) AS behavior_score, CAST(MAX(score) >= 0.7e0 AND (COUNT(*) FILTER (score >= 0.7e0) >= 2 OR COUNT(*) FILTER (score >= 0.85e0) >= 1) AS INT) AS is_behavior_anomaly, {INDS}, COUNT(*) AS behavior_event_count FROM (SELECT *, STRING_SPLIT(flags, '|') AS fl FROM results) WHERE source_ip IS NOT NULL AND TRIM(source_ip) <> '' AND source_ip <> 'LOCAL' GROUP BY 1")
oracle("behavior_by_ip", "SELECT * FROM byaddr")
oracle("ip_indicator_flags", "SELECT source_ip, " + ", ".join(INDICATORS) + " FROM byaddr")
ACTIVE = "CONCAT_WS(', ', " + ", ".join(f"CASE WHEN {i} = 1 THEN '{i[4:]}' END" for i in INDICATORS) + ")"
oracle("top_anomalous_ips", f"SELECT source_ip, behavior_score, CASE WHEN {ACTIVE} = '' THEN 'ml_anomaly' ELSE {ACTIVE} END AS active_flags FROM byaddr ORDER BY behavior_score DESC, source_ip LIMIT 10")

# ── fusion and response ──
oracle("gated_fusion", "SELECT flow_id, ROUND(threat_raw, 6) AS threat_score FROM fused")
oracle("segment_amplification", "SELECT flow_id, ROUND(threat_amp, 6) AS threat_score FROM amplified")
oracle("ensemble_blend", f"SELECT flow_id, ROUND({clip(FSCORE + '*0.7e0 + packets_recv/10e0*0.3e0')}, 6) AS attack_probability FROM flows")
oracle("co_occurrence_boost", "SELECT flow_id, agents_fired, max_agents_5min, boost_applied, ROUND(threat_score, 6) AS threat_score FROM boosted")
oracle("severity_distribution", "SELECT t.severity_label, COUNT(x.flow_id) AS n, ROUND(COUNT(x.flow_id)/(SELECT COUNT(*) FROM tiered), 6) AS share FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) t(severity_label) LEFT JOIN tiered x ON x.severity_label = t.severity_label GROUP BY 1")
cte("cands", "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY affected_asset ORDER BY attack_probability DESC, flow_id) AS rn FROM tiered WHERE (segment = 'SWIFT' OR predicted_category = 'SWIFT_TAMPERING') AND affected_asset IS NOT NULL) WHERE rn = 1")
CAND = "affected_asset, flow_id, attack_probability, severity_label, segment, mitre_technique"
oracle("top_candidate_per_asset", f"SELECT {CAND} FROM cands")
cte("flagged", "SELECT *, CASE source WHEN 'ueba' THEN 0 WHEN 'windows' THEN 1 ELSE 2 END AS so FROM results WHERE CONTAINS(LOWER(flags), 'swift')")
cte("places", "SELECT hostname AS affected_asset, 0 AS branch, so, event_time, event_ref, 0e0 AS p, '' AS tie FROM flagged UNION ALL SELECT source_ip, 1, so, event_time, event_ref, 0e0, '' FROM flagged WHERE source_ip <> '' UNION ALL SELECT affected_asset, 2, 0, NULL, '', -attack_probability, flow_id FROM cands")
cte("firsts", "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY affected_asset ORDER BY branch, so, event_time NULLS FIRST, event_ref, p, tie) AS rn FROM places WHERE affected_asset IS NOT NULL) WHERE rn = 1 ORDER BY branch, so, event_time NULLS FIRST, event_ref, p, tie, affected_asset LIMIT 500")
oracle("swift_shortlist", "SELECT c.flow_id, f.affected_asset, COALESCE(ROUND(c.attack_probability, 6), 1e0) AS attack_probability, COALESCE(c.severity_label, 'CRITICAL') AS severity_label, COALESCE(c.segment, 'SWIFT') AS segment, c.mitre_technique FROM firsts f LEFT JOIN cands c USING (affected_asset)")
oracle("match_tickets_to_shortlist", "SELECT incident_id, EXISTS (SELECT 1 FROM cands WHERE LIST_CONTAINS(STRING_SPLIT(t.affected_assets, '|'), cands.affected_asset)) AS caught FROM tickets t WHERE CONTAINS(LOWER(attack_pattern), 'swift')")
cte("sweep", "SELECT k/100e0 AS threshold, COUNT(*) FILTER (attack_probability >= k/100e0 AND is_attack) AS tp, COUNT(*) FILTER (attack_probability >= k/100e0 AND NOT is_attack) AS fp, COUNT(*) FILTER (attack_probability < k/100e0 AND NOT is_attack) AS tn, COUNT(*) FILTER (attack_probability < k/100e0 AND is_attack) AS fn FROM evaluated, RANGE(1, 100) r(k) GROUP BY k")
RATES = "CASE WHEN fp + tn > 0 THEN fp/(fp + tn) ELSE 0e0 END AS fpr, CASE WHEN tp + fn > 0 THEN tp/(tp + fn) ELSE 0e0 END AS recall, CASE WHEN tp + fp > 0 THEN tp/(tp + fp) ELSE 0e0 END AS precision"
cte("swept", f"SELECT *, {RATES} FROM sweep")
ROUNDED = "ROUND(fpr, 6) AS fpr, ROUND(recall, 6) AS recall, ROUND(precision, 6) AS precision"
oracle("threshold_sweep", f"SELECT threshold, tp, fp, tn, fn, {ROUNDED}, tp + fp AS n_flagged FROM swept")
oracle("confusion_at_threshold", f"SELECT threshold, tp, fp, tn, fn, {ROUNDED}, tp + fp AS n_flagged FROM swept WHERE threshold = 0.5e0")


def tuned(limit: str) -> str:
    return f"(SELECT COALESCE((SELECT threshold FROM swept WHERE fpr <= {limit} ORDER BY recall DESC, threshold LIMIT 1), (SELECT threshold FROM swept ORDER BY fpr, threshold LIMIT 1), 0.5e0))"


oracle("tune_threshold", f"SELECT {tuned('0.1e0')} AS threshold, 0.1e0 AS max_fpr UNION ALL SELECT {tuned('0.4e0')}, 0.4e0")
oracle("triage_decision", f"SELECT flow_id, attack_probability >= {tuned('0.1e0')} AS predicted_tp, ROUND(attack_probability, 4) AS attack_probability, severity_label FROM overridden UNION ALL SELECT flow_id, TRUE, 1e0, 'CRITICAL' FROM seeds WHERE flow_id NOT IN (SELECT flow_id FROM flows)")
oracle("union_injected_rows", "SELECT flow_id, attack_probability >= 0.5e0 AS predicted_tp, ROUND(attack_probability, 4) AS attack_probability, severity_label FROM tiered UNION ALL SELECT flow_id, TRUE, 1e0, 'CRITICAL' FROM seeds WHERE flow_id NOT IN (SELECT flow_id FROM flows)")

# ── aggregates ──
SOFT_W = "ROUND(win_fail_ratio, 6) AS win_fail_ratio, ROUND(win_priv_ratio, 6) AS win_priv_ratio, ROUND(win_process_ratio, 6) AS win_process_ratio, ROUND(win_off_hours_ratio, 6) AS win_off_hours_ratio"
oracle("windows_ip_features", f"SELECT * REPLACE ({SOFT_W}) FROM winip")
SOFT_Z = ["zeek_mean_duration", "zeek_mean_orig_bytes", "zeek_mean_resp_bytes", "zeek_mean_bytes_ratio", "zeek_mean_orig_pkts", "zeek_fail_ratio", "zeek_encrypted_ratio", "zeek_off_hours_ratio", "zeek_dst_diversity"]
oracle("zeek_ip_features", "SELECT * REPLACE (" + ", ".join(f"ROUND({c}, 4) AS {c}" for c in SOFT_Z) + ") FROM zeekip")
oracle("busy_hours", "SELECT CAST(hour AS INT) AS hour, n FROM busyhours")
cte("jbase", "SELECT ja3_hash, COUNT(*)/(SELECT COUNT(*) FROM zeek WHERE ja3_hash IS NOT NULL AND ja3_hash <> '' AND NOT is_anomaly) AS freq FROM zeek WHERE ja3_hash IS NOT NULL AND ja3_hash <> '' AND NOT is_anomaly GROUP BY 1")
oracle("ja3_baseline_frequency", "SELECT ja3_hash, ROUND(freq, 8) AS frequency FROM jbase")
cte("jflags", f"SELECT z.*, b.freq, LN(1 + COALESCE(b.freq, 0)*10000) AS lf, CAST(z.ja3_hash IS NOT NULL AND z.ja3_hash <> '' AND b.freq IS NULL AS INT) AS never, CAST(z.ja3_hash IS NOT NULL AND z.ja3_hash <> '' AND COALESCE(b.freq, 0) < 0.0001e0 AS INT) AS rare, CAST(COALESCE(z.ja3_hash = '{K.KNOWN_C2_JA3}', FALSE) AS INT) AS c2 FROM zeek z LEFT JOIN jbase b ON z.ja3_hash = b.ja3_hash")
oracle("ja3_row_flags", "SELECT log_id, ROUND(lf, 6) AS ja3_log_frequency, never AS ja3_never_seen_in_normal, rare AS ja3_is_rare, c2 AS ja3_matches_known_c2 FROM jflags")
cte("jsignal", "SELECT id_orig_h AS source_ip, CAST(SUM(never) AS BIGINT) AS ja3_never_seen_conns, CAST(SUM(rare) AS BIGINT) AS ja3_rare_conns, CAST(SUM(c2) AS BIGINT) AS ja3_known_c2_conns, MIN(freq) AS mf FROM jflags GROUP BY 1")
oracle("ja3_ip_signal", "SELECT a.source_ip, COALESCE(ja3_never_seen_conns, 0) AS ja3_never_seen_conns, COALESCE(ja3_rare_conns, 0) AS ja3_rare_conns, COALESCE(ja3_known_c2_conns, 0) AS ja3_known_c2_conns, ROUND(mf, 8) AS ja3_min_frequency, CAST(COALESCE(ja3_known_c2_conns, 0) > 0 AS INT) AS ind_ja3_c2_match FROM addresses a LEFT JOIN jsignal j USING (source_ip)")
oracle("top_ja3_ips", "SELECT source_ip, ja3_known_c2_conns, ja3_rare_conns, ja3_never_seen_conns FROM jsignal WHERE ja3_known_c2_conns > 0 OR ja3_rare_conns > 0 ORDER BY ja3_known_c2_conns DESC, ja3_rare_conns DESC, source_ip LIMIT 20")
oracle("quantile_indicators", "SELECT source_ip, CAST(win_fail_ratio > (SELECT QUANTILE_CONT(win_fail_ratio, 0.9) FROM addresses) AS INT) AS ind_high_fail_ratio, CAST(zeek_mean_bytes_ratio > (SELECT QUANTILE_CONT(zeek_mean_bytes_ratio, 0.9) FROM addresses) AS INT) AS ind_high_upload_ratio, CAST(zeek_unique_dst_ports > (SELECT QUANTILE_CONT(CAST(zeek_unique_dst_ports AS DOUBLE), 0.9) FROM addresses) AS INT) AS ind_high_port_spread FROM addresses")

# ── evaluation ──
cte("percount", "SELECT attack_probability AS threshold, COUNT(*) FILTER (is_attack) AS pos, COUNT(*) FILTER (NOT is_attack) AS neg FROM evaluated GROUP BY 1")
cte("rocraw", "SELECT threshold, pos, neg, CAST(SUM(pos) OVER d AS BIGINT) AS tp, CAST(SUM(neg) OVER d AS BIGINT) AS fp, CAST(SUM(pos) OVER () AS BIGINT) AS np, CAST(SUM(neg) OVER () AS BIGINT) AS nn, ROW_NUMBER() OVER d AS i, LEAD(pos) OVER d AS npos, LEAD(neg) OVER d AS nneg FROM percount WINDOW d AS (ORDER BY threshold DESC)")
cte("roc", "SELECT *, CASE WHEN nn > 0 THEN fp/nn ELSE 0e0 END AS fpr, CASE WHEN np > 0 THEN tp/np ELSE 0e0 END AS tpr, tp/(tp + fp) AS precision, i = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg AS is_corner FROM rocraw")
oracle("roc_points", "SELECT threshold, tp, fp, ROUND(fpr, 6) AS fpr, ROUND(tpr, 6) AS tpr, ROUND(precision, 6) AS precision, is_corner FROM roc")
oracle("auroc", "SELECT ROUND(SUM(pos*((nn - fp) + neg/2e0))/(MAX(np)*CAST(MAX(nn) AS DOUBLE)), 6) AS auroc FROM roc")


def operating_point(rule: str, best: str) -> str:
    tp, fp = "COALESCE(b.tp, 0)", "COALESCE(b.fp, 0)"
    p, r = "COALESCE(b.precision, 0e0)", "COALESCE(b.tpr, 0e0)"
    return (
        f"SELECT '{rule}' AS rule, b.threshold, {tp} AS tp, {fp} AS fp, t.nn - {fp} AS tn, t.np - {tp} AS fn, ROUND(COALESCE(b.fpr, 0e0), 6) AS fpr,"
        f" ROUND({p}, 6) AS precision, ROUND({r}, 6) AS recall, ROUND(CASE WHEN {p} + {r} > 0 THEN 2*{p}*{r}/({p} + {r}) ELSE 0e0 END, 6) AS f1"
        f" FROM (SELECT MAX(nn) AS nn, MAX(np) AS np FROM roc) t LEFT JOIN ({best}) b ON TRUE"
    )


oracle("metrics_at_fpr", operating_point("closest", "SELECT * FROM (SELECT * FROM roc WHERE is_corner ORDER BY ABS(fpr - 0.05e0), threshold DESC LIMIT 1) WHERE ABS(fpr - 0.05e0) < 0.05e0") + " UNION ALL " + operating_point("last_below", "SELECT * FROM roc WHERE is_corner AND fpr <= 0.05e0 ORDER BY threshold LIMIT 1"))
oracle("average_precision", "SELECT ROUND(SUM(pos*precision)/MAX(np), 6) AS average_precision FROM roc")
oracle("best_f1_threshold", "SELECT threshold, ROUND(f1, 6) AS f1, ROUND(precision, 6) AS precision, ROUND(tpr, 6) AS recall FROM (SELECT *, 2*precision*tpr/(precision + tpr + 1e-12) AS f1 FROM roc) ORDER BY 2*precision*tpr/(precision + tpr + 1e-12) DESC, threshold LIMIT 1")
oracle("threshold_at_recall", "SELECT target_recall, threshold, ROUND(precision, 6) AS precision, ROUND(tpr, 6) AS recall FROM (SELECT t.target_recall, r.*, ROW_NUMBER() OVER (PARTITION BY t.target_recall ORDER BY threshold DESC) AS rn FROM roc r JOIN (VALUES (0.7e0), (0.8e0), (0.9e0)) t(target_recall) ON r.tpr >= t.target_recall) WHERE rn = 1")
oracle("attack_rate", "SELECT 'labels' AS scope, COUNT(*) AS n_rows, COUNT(*) FILTER (is_attack) AS n_attacks, ROUND(AVG(CAST(is_attack AS INT)), 6) AS attack_rate FROM flow_labels UNION ALL SELECT 'joined', COUNT(*), COUNT(*) FILTER (is_attack), ROUND(AVG(CAST(is_attack AS INT)), 6) FROM evaluated")
cte("report", "SELECT 'Normal' AS class, tn AS hit, tn + fn AS said, tn + fp AS support FROM sweep WHERE threshold = 0.5e0 UNION ALL SELECT 'Anomaly', tp, tp + fp, tp + fn FROM sweep WHERE threshold = 0.5e0")
cte("reported", "SELECT class, support, CASE WHEN said > 0 THEN hit/said ELSE 0e0 END AS p, CASE WHEN support > 0 THEN hit/support ELSE 0e0 END AS r FROM report")
oracle("classification_report", "SELECT class, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(CASE WHEN p + r > 0 THEN 2*p*r/(p + r) ELSE 0e0 END, 6) AS f1, support FROM reported")
cte("lvec", "SELECT v.* EXCLUDE (is_attack), l.is_attack FROM vectors v JOIN flow_labels l USING (flow_id)")
LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, is_attack FROM lvec" for c in ALL)
cte("lvalues", LONG)
cte("lcounts", "SELECT feature, value, COUNT(*) FILTER (is_attack) AS pos, COUNT(*) FILTER (NOT is_attack) AS neg FROM lvalues GROUP BY 1, 2")
oracle("feature_auroc", "SELECT feature, ROUND(SUM(pos*(below + neg/2e0))/(SUM(pos)*CAST(SUM(neg) AS DOUBLE)), 6) AS auroc FROM (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM lcounts) GROUP BY 1")
oracle("class_means", "SELECT feature, ROUND(AVG(value) FILTER (is_attack), 4) AS attack_mean, ROUND(AVG(value) FILTER (NOT is_attack), 4) AS normal_mean FROM lvalues GROUP BY 1")
EXACT = ["segment_risk", "dst_port_risk", "is_internal_to_ext", "flag_syn_only", "flow_count"]
cte("exactvalues", " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, is_attack FROM lvec" for c in EXACT) + " UNION ALL SELECT 'label_copy', CAST(CAST(is_attack AS INT) AS DOUBLE), is_attack FROM lvec")
oracle("disjoint_features", "SELECT feature, CAST(SUM(a) AS BIGINT) AS attack_values, CAST(SUM(n) AS BIGINT) AS normal_values, CAST(SUM(a*n) AS BIGINT) AS shared_values, SUM(a*n) = 0 AS disjoint FROM (SELECT feature, value, MAX(CAST(is_attack AS INT)) AS a, MAX(CAST(NOT is_attack AS INT)) AS n FROM exactvalues GROUP BY 1, 2) GROUP BY 1")

# ── stored statistics and the composed run ──
oracle("train_stats_artifacts", "SELECT 'rate' AS artifact, CAST(1 AS BIGINT) AS n_rows, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std FROM ratestats UNION ALL SELECT 'source', COUNT(*), ROUND(AVG(flow_count), 6), ROUND(STDDEV_SAMP(flow_count), 6) FROM srcstats UNION ALL SELECT 'baseline', COUNT(DISTINCT ja3_hash), NULL, NULL FROM labelled WHERE flow_label = 'NORMAL'")

# ── formula scores through calibration, split, and the composed run ──
oracle("importance_share", "SELECT SPLIT_PART(feature, '_', 1) AS family, ROUND(SUM(importance), 6) AS share FROM (SELECT feature, ABS(ROUND(AVG(value) FILTER (is_attack), 4) - ROUND(AVG(value) FILTER (NOT is_attack), 4)) AS importance FROM lvalues GROUP BY 1) GROUP BY 1")
cte("rawaddr", "SELECT *, -((win_total_events*57 + zeek_total_conns*23 + win_failed_logons*3) % 211 + 1)/212e0 AS raw FROM addresses")
cte("calibrated", "SELECT *, 1e0 - CASE WHEN (SELECT MAX(raw) > MIN(raw) FROM rawaddr) THEN (raw - (SELECT MIN(raw) FROM rawaddr))/(SELECT MAX(raw) - MIN(raw) FROM rawaddr) ELSE 0e0 END AS threat_score, CAST(raw < (SELECT QUANTILE_CONT(raw, 0.05) FROM rawaddr) AS INT) AS is_anomaly FROM rawaddr")
oracle("packet_calibration", "SELECT source_ip, ROUND(threat_score, 6) AS threat_score, is_anomaly FROM calibrated")
oracle("top_threat_ips", f"SELECT source_ip, ROUND(threat_score, 6) AS threat_score, ind_high_fail_ratio, ind_high_upload_ratio, ind_high_port_spread, win_failed_logons, zeek_total_conns FROM calibrated JOIN ({ORACLES['quantile_indicators'][ORACLES['quantile_indicators'].rindex('SELECT source_ip, CAST(win_fail'):]}) USING (source_ip) WHERE is_anomaly = 1 ORDER BY threat_score DESC, source_ip LIMIT 20")
cte("rawuser", "SELECT ueba_id, -((ueba_id*37) % 997 + 1)/1000e0 AS raw FROM ueba")
cte("rawends", "SELECT QUANTILE_CONT(raw, 0.01) AS low, QUANTILE_CONT(raw, 0.99) AS high FROM rawuser")
oracle("user_calibration", f"SELECT ueba_id, ROUND({clip('(high - raw)/CASE WHEN high - low = 0 THEN 1e0 ELSE high - low END')}, 4) AS ml_score FROM rawuser, rawends")
cte("splitrows", "SELECT flow_id, CAST(is_attack AS INT) AS label, CAST('0x'||SUBSTR(MD5(flow_id||'/42'), 1, 4) AS INT) AS b FROM flow_labels")
cte("splitcuts", "SELECT label, MAX(b) AS cut FROM (SELECT label, b, SUM(n) OVER (PARTITION BY label ORDER BY b) - n AS before, SUM(n) OVER (PARTITION BY label) AS total FROM (SELECT label, b, COUNT(*) AS n FROM splitrows GROUP BY 1, 2)) WHERE before + 0.5 < total*0.2e0 GROUP BY 1")
oracle("stratified_split", "SELECT flow_id, label, COALESCE(b <= cut, FALSE) AS is_test FROM splitrows LEFT JOIN splitcuts USING (label)")
cte("run_bscore", "SELECT source_ip AS src_ip, MAX(score) AS behavior_score FROM results WHERE source_ip IS NOT NULL GROUP BY 1")
RUN = ("joined", "fused", "amplified", "windowed", "boosted", "categorised", "correlated", "enriched", "tiered", "evaluated", "sweep", "swept")
for step in RUN:  # the fusion steps once more, over the behavior agent's own scores
    CTES[f"run_{step}"] = re.sub(rf"\b({'|'.join(RUN)}|bscore)\b", r"run_\1", CTES[step])
oracle("full_run_decisions", FINAL.format(t=tuned("0.1e0").replace("swept", "run_swept"), src="run_tiered"))
