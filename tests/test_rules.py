"""Boundary rows for cleaning, rules, fusion, response and evaluation."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatlens import constants as K
from threatlens.functions import expressions as X
from threatlens.operators import behavior as bh
from threatlens.operators import cleaning as cl
from threatlens.operators import evaluation as ev
from threatlens.operators import flow_features as ff
from threatlens.operators import fusion as fu
from threatlens.operators import killchain as kc
from threatlens.operators import live_rules as lr
from threatlens.operators import response as rs
from threatlens.operators import sessions as ss
from threatlens.operators import user_rules as ur
from threatlens.operators import windows_rules as wr
from threatlens.sources import readers

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_fusion_reproduces_the_captured_alerts(spark):
    rows = [
        (0.95, 0.35, 0.23, 0.66), (0.95, 0.32, 0.14, 0.64), (0.19, 0.97, 0.70, 0.72),
        (0.29, 0.34, 0.93, 0.41), (0.95, 0.05, 0.05, 0.59),
    ]
    df = spark.createDataFrame(rows, "f double, b double, p double, want double")
    for r in df.withColumn("got", F.round(X.gated_fusion("f", "b", "p"), 2)).collect():
        assert r["got"] == r["want"]


def test_severity_ladders(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.6, 0.61, 0.75, 0.9, 1.0, 0.85, 0.5)], "p double")
    assert values(df, X.flow_severity("p")) == [None, "NORMAL", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL", "HIGH", "NORMAL"]
    assert values(df, X.fused_severity("p")) == ["NORMAL", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL", "CRITICAL", "MEDIUM"]
    assert values(df, X.response_severity("p")) == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL", "HIGH", "LOW"]


def test_hybrid_score_branches(spark):
    rows = [(0.6, 0.6, 0.7), (0.95, 0.95, 1.0), (0.8, 0.05, 0.4), (0.8, 0.1, 0.56), (0.8, 0.2, 0.68), (0.2, 0.4, 0.4), (0.1, 0.3, 0.085)]
    df = spark.createDataFrame(rows, "m double, r double, want double")
    for r in df.withColumn("got", X.hybrid_score("m", "r")).collect():
        assert math.isclose(r["got"], r["want"], abs_tol=1e-12)


def test_clean_netflow_handles_bad_numbers_and_times(spark):
    rows = [
        ("a", "1.1.1.1", "2.2.2.2", "2024-01-01 00:00:00", 1.0, float("inf")),
        ("b", "1.1.1.1", "2.2.2.2", "not a time", float("nan"), 5.0),
        ("c", None, "2.2.2.2", "2024-01-01 00:00:00", 1.0, 1.0),
        ("d", "1.1.1.1", None, "2024-01-01 00:00:00", 1.0, float("-inf")),
    ]
    df = spark.createDataFrame(rows, "flow_id string, src_ip string, dst_ip string, start_time string, duration_sec double, bytes_sent double")
    got = {r["flow_id"]: r for r in readers.clean_netflow(df).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["bytes_sent"] is None and got["b"]["start_time"] is None and got["b"]["duration_sec"] is None


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError):
        readers.require_columns(spark.range(1), ["flow_id"], "netflow")


def test_csv_reader_prunes_and_parses(spark, tmp_path):
    path = tmp_path / "hosts.csv"
    path.write_text("hostname,ip_address,segment,criticality,is_honeypot\nh1,10.0.0.1,SWIFT,HIGH,True\n")
    df = readers.read_table(spark, "hosts", str(path), columns=["hostname", "ip_address"])
    assert [tuple(r) for r in df.collect()] == [("h1", "10.0.0.1")]


def test_boolean_spellings(spark):
    df = spark.createDataFrame([("True",), ("true",), ("1",), ("False",), ("0",), ("",), (None,)], "b string")
    assert values(df, X.as_bool("b")) == [True, True, True, False, False, False, False]


def windows(spark, rows):
    schema = (
        "event_log_id string, event_time timestamp, event_id int, hostname string, subject_username string, "
        "target_username string, process_name string, parent_process string, source_ip string, logon_type int"
    )
    return spark.createDataFrame(rows, schema)


def test_windows_duplicates_round_half_to_even(spark):
    rows = [
        ("b", at(10.4), 1102, "h", "u", "", "", "", None, 2), ("a", at(10.0), 1102, "h", "u", "", "", "", None, 2),
        ("c", at(10.5), 1102, "h", "u", "", "", "", None, 2), ("d", at(11.5), 1102, "h", "u", "", "", "", None, 2),
    ]
    kept = cl.dedupe_windows_events(windows(spark, rows))
    # 10.5 rounds down to the even second, 11.5 rounds up to 12.
    assert sorted(values(kept, "event_log_id")) == ["a", "d"]


def hosts(spark, rows=None):
    rows = rows or [
        ("ATM-1", "10.1.0.1", "ATM", None, "False"), ("SWIFT-GW-01", "10.3.0.3", "SWIFT", "HIGH", "False"),
        ("TRAP-1", "10.9.0.1", None, "LOW", "True"), ("WS-KTM-5", "10.0.0.5", "WORKSTATION", "LOW", "0"),
        ("SRV-DC-01", "10.1.0.9", "CORE_BANKING", "HIGH", None), ("SRV-SQL-01", "10.2.0.2", "CORE_BANKING", "HIGH", None),
    ]
    return spark.createDataFrame(rows, "hostname string, ip_address string, segment string, criticality string, is_honeypot string")


def test_windows_rules(spark):
    day = 10 * 3600  # Monday 10:00
    night = 2 * 3600
    rows = [
        ("e1", at(day), 7045, "ATM-1", "U", "", "x", "", None, 2),
        ("e2", at(day), 7045, "S", "U", "", "Mimikatz.exe", "", None, 2),
        ("e3", at(day), 7045, "S", "U", "", "DefenderHelper.exe", "", None, 2),
        ("e4", at(day), 4688, "S", "U", "", "cmd.exe", "WINWORD.exe", "LOCAL", 2),
        ("e5", at(night), 4672, "S", "bob", "", "", "", "1.2.3.4", 2),
        ("e6", at(night), 4672, "S", "PC$", "", "", "", "1.2.3.4", 2),
        ("e7", at(day), 4698, "SWIFT-GW-01", "bob", "", "", "", "", 2),
        ("e8", at(day), 4624, "S", "bob", "", "cmd.exe", "", "", 3),
        ("e9", at(night), 4624, "S", "bob", "", "x", "", "", 7),
        ("f1", None, 4771, "S", "bob", "sql_admin", "", "", "", 7),
        ("f2", at(night), 4769, "S", "db_user", "x", "", "", "", 7),
        ("f3", at(night), 4625, "S", "bob", "svc_x", "", "", "", 7),
    ]
    got = {r["event_log_id"]: r for r in wr.windows_event_rules(windows(spark, rows), hosts(spark)).collect()}
    flat = {k: (v["score"], v["flag"], v["category"]) for k, v in got.items()}
    assert flat == {
        "e1": (1.0, "new_service_atm", "ATM_JACKPOTTING"), "e2": (1.0, "new_service", "INSIDER_THREAT"),
        "e3": (0.45, "new_service", "INSIDER_THREAT"), "e4": (0.85, "suspicious_process", "INSIDER_THREAT"),
        "e5": (0.8, "priv_escalation", "INSIDER_THREAT"), "e7": (0.8, "scheduled_task", "INSIDER_THREAT"),
        "e8": (0.85, "pass_the_hash", "LATERAL_MOVEMENT"), "e9": (0.5, "off_hours_logon", None),
        "f2": (0.8, "kerberoasting", "BRUTE_FORCE"), "f3": (0.8, "kerberoasting", "BRUTE_FORCE"),
    }
    assert got["e1"]["source_ip"] == "10.1.0.1" and got["e7"]["source_ip"] == "10.3.0.3"
    fixed = wr.windows_event_rules(windows(spark, rows), hosts(spark), case_fix=True).where("event_log_id = 'e3'")
    assert values(fixed, "score") == [0.95]


def test_brute_force_fast_and_slow(spark):
    fast = [(f"f{i:02}", at(36000 + i * 0.4), 4625, "S", "x", "fast", "", "", "", 3) for i in range(11)]
    slow = [(f"s{i:02}", at(36000 + i * 29), 4625, "S", "x", "slow", "", "", "", 3) for i in range(12)]
    out = wr.brute_force_window(windows(spark, fast + slow))
    got = {r["event_log_id"]: (r["n_failures"], r["alert"] and r["alert"]["score"]) for r in out.collect()}
    assert got["f08"] == (9, None) and got["f09"] == (10, 0.9) and got["f10"] == (11, 0.9)
    assert got["s09"] == (10, 0.7) and got["s11"] == (11, 0.7)  # the first one left the window


UEBA = (
    "ueba_id long, event_time timestamp, username string, hostname string, source_ip string, event_type string, "
    "resource_accessed string, bytes_transferred string, duration_sec string, failed_attempts_prior_1h string, "
    "peer_group_deviation_score string, is_off_hours string, is_new_resource string"
)


def test_user_rules_and_baseline(spark):
    saturday = 5 * 86400 + 5 * 3600
    rows = [
        (1, at(saturday), "ann", "SWIFT-GW-01", "", "DB_QUERY", "SWIFT_MT", "10", "1", "10", "0.8", "True", "1"),
        (2, at(saturday), "svc_a", "TRAP-1", "", "DB_QUERY", "Pumori", "60000000", "1", "5", "0.65", "True", "False"),
        (3, at(60), "Bob", "X", "1.1.1.1", "DB_QUERY", "f", "200000000", "1", "x", None, "False", "true"),
    ]
    df = spark.createDataFrame(rows, UEBA)
    based = ur.user_baseline_bytes(df)
    means = {r["ueba_id"]: r["avg_bytes"] for r in based.collect()}
    # A mixed-case name has no training history; a lower-case one sees its own training row.
    assert means == {1: 10.0, 2: 60000000.0, 3: 0.0}
    got = {r["ueba_id"]: r for r in ur.ueba_rules(based, hosts(spark)).collect()}
    assert got[1]["flags"] == [
        "off_hours", "weekend_early_morning", "high_peer_deviation", "new_swift_resource", "failed_access_spike", "swift_off_hours",
    ]
    assert got[1]["rule_score"] == 1.0
    assert got[2]["flags"] == ["elevated_peer_deviation", "failed_access_elevated", "unauthorized_pumori", "honeypot_contact"]
    assert got[3]["flags"] == ["large_data_transfer", "new_resource"] and math.isclose(got[3]["rule_score"], 0.40)
    assert [tuple(p) for p in got[3]["mitre"]] == [("Exfiltration", "T1041")]


def test_behavior_by_ip_needs_evidence(spark):
    rows = [("a", 0.7, ["off_hours"]), ("b", 0.7, ["x"]), ("b", 0.72, ["brute_force"]), ("c", 0.85, []), ("LOCAL", 1.0, []), ("", 1.0, [])]
    df = spark.createDataFrame(rows, "source_ip string, score double, flags array<string>")
    got = {r["source_ip"]: r for r in bh.behavior_by_ip(df).collect()}
    assert {k: v["is_behavior_anomaly"] for k, v in got.items()} == {"a": 0, "b": 1, "c": 1}
    assert got["a"]["ind_off_hours"] == 1 and got["b"]["ind_brute_force"] == 1 and got["c"]["ind_off_hours"] == 0


def test_hosts_by_ip_and_enrichment_keep_rows(spark):
    doubled = hosts(spark, [("b", "10.0.0.1", "S", None, "1"), ("a", "10.0.0.1", "S", None, "0"), ("c", "10.0.0.2", "S", None, "1")])
    flows = spark.createDataFrame([("f", "10.0.0.1", "9.9.9.9"), ("g", "8.8.8.8", "10.0.0.2"), ("h", "8.8.8.8", "9.9.9.9")], "flow_id string, src_ip string, dst_ip string")
    got = {r["flow_id"]: (r["affected_asset"], r["is_honeypot"]) for r in rs.enrich_hosts(flows, doubled).collect()}
    assert got == {"f": ("a", False), "g": ("c", True), "h": ("9.9.9.9", False)}


def test_nearest_session_ties_go_backward(spark):
    m = K.MINUTE
    left = spark.createDataFrame([("k", 60 * m), ("k", 200 * m), ("j", 60 * m)], "ip string, l long")
    right = spark.createDataFrame([("k", 50 * m), ("k", 70 * m), ("k", 216 * m), ("k", 184 * m), ("j", 75 * m)], "ip string, r long")
    got = {(r["ip"], r["l"] // m): r["r"] // m for r in ss.nearest_start(left, right, "ip", "l", "r").collect()}
    assert got == {("k", 60): 50, ("j", 60): 75}


def test_category_order_and_overrides(spark):
    schema = "segment string, dst_port int, bytes_sent double, is_internal_src boolean, is_internal_dst boolean, threat_score double"
    rows = [
        ("SWIFT", 853, 1.0, True, True, 0.1), ("SWIFT", 1433, 9e5, True, False, 0.9), ("DMZ", 80, 500001.0, True, False, 0.6),
        ("DMZ", 80, 1.0, True, True, 0.75), ("DMZ", 80, 1.0, None, False, 0.85), ("DMZ", 80, 1.0, True, True, 0.7),
    ]
    df = fu.classify(spark.createDataFrame(rows, schema))
    assert values(df, "predicted_category") == ["C2_BEACON", "SWIFT_TAMPERING", "DATA_EXFIL", "LATERAL_MOVEMENT", "ZERO_DAY", "NORMAL"]
    assert values(df, "mitre_technique") == ["T1071.001", "T1005", "T1041", "T1021.002", "T0000", ""]


def test_signature_overrides_last_match_wins(spark):
    schema = "flow_id string, ja3_hash string, segment string, dst_port int, is_internal_src boolean, bytes_sent double, packets_sent long, attack_probability double, severity string"
    rows = [
        ("a", K.KNOWN_C2_JA3, "SWIFT", 1433, True, 9e9, 1, 0.1, "NORMAL"), ("b", "x", "DMZ", 80, None, 10.0, 1, 0.1, "NORMAL"),
        ("c", "x", "DMZ", 80, True, 10.0, 1, 0.0, None),
    ]
    got = {r["flow_id"]: (r["attack_probability"], r["severity"], r["attack_type"]) for r in lr.cti_overrides(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "a": (1.0, "CRITICAL", lr.PROBE), "b": (1.0, "CRITICAL", lr.SMALL_PACKETS), "c": (0.0, None, "Anomalous Traffic (ML)"),
    }


def test_killchain_with_raw_node_fallback(spark):
    schema = "flow_id string, src_ip string, dst_ip string, start_time timestamp, is_internal_src boolean, is_internal_dst boolean"
    rows = [
        ("f1", "10.0.0.5", "10.1.0.9", at(1), True, True), ("f2", "10.0.0.5", "10.1.0.9", at(5), True, True),
        ("f3", "10.1.0.9", "10.2.0.2", at(2), True, True), ("f4", "10.2.0.2", "GATE", at(3), True, True),
        ("f5", "10.2.0.2", "10.3.0.3", at(3), None, True),
    ]
    flows = spark.createDataFrame(rows, schema)
    chain = ["WS-KTM-", "SRV-DC-01", "SRV-SQL-01", "GATE"]
    got = kc.killchain_paths(flows, hosts(spark), chain).collect()
    assert [(r["kill_chain"], r["chain_flow_ids"]) for r in got] == [("10.0.0.5→10.1.0.9→10.2.0.2→GATE", ["f2", "f3", "f4"])]
    assert kc.killchain_paths(flows, hosts(spark)).count() == 0  # the last hop is not known to be internal


def scored(spark):
    rows = [(f"f{i}", p, a) for i, (p, a) in enumerate([(0.9, True), (0.8, False), (0.8, True), (0.4, False), (0.3, True), (0.1, False), (0.1, False)])]
    return spark.createDataFrame(rows, "flow_id string, attack_probability double, is_attack boolean")


def test_rank_metrics(spark):
    df = scored(spark)
    # pairs won: .9 beats 4; .8 beats 3 and ties 1; .3 beats 2 -> 4 + 3.5 + 2 of 12
    assert math.isclose(ev.auroc(df).first()[0], 9.5 / 12)
    # per distinct score: recall gained times precision
    assert math.isclose(ev.average_precision(df).first()[0], (1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5))
    point = ev.metrics_at_fpr(df, 0.25, "last_below").first()
    assert (point["threshold"], point["tp"], point["fp"], point["tn"], point["fn"]) == (0.8, 2, 1, 3, 1)
    assert ev.best_f1_threshold(df).first()["threshold"] in (0.3, 0.8)
    one_class = df.where("is_attack")
    assert ev.auroc(one_class).first()[0] is None


def test_threshold_sweep_and_tuning(spark):
    df = scored(spark)
    sweep = {round(r["threshold"], 2): r for r in ev.threshold_sweep(df).collect()}
    assert len(sweep) == 99
    for t in (0.1, 0.11, 0.3, 0.8, 0.81, 0.9, 0.99):
        want = ev.confusion_at_threshold(df, t).first()
        assert all(sweep[t][c] == want[c] for c in ("tp", "fp", "tn", "fn", "n_flagged"))
    assert ev.tune_threshold(df, 0.10).first()[0] == 0.81
    assert ev.tune_threshold(df, 0.25).first()[0] == 0.41
    assert ev.tune_threshold(df.limit(0)).first()[0] == 0.50


def test_shortlist_prefers_behavior_assets(spark):
    flows = spark.createDataFrame(
        [("f1", "A", 0.9, "HIGH", "SWIFT", "T", "X"), ("f2", "A", 0.95, "HIGH", "SWIFT", "T", "X"), ("f3", "B", 0.99, "HIGH", "DMZ", "T", "SWIFT_TAMPERING"), ("f4", "C", 1.0, "HIGH", "DMZ", "T", "X")],
        "flow_id string, affected_asset string, attack_probability double, severity_label string, segment string, mitre_technique string, predicted_category string",
    )
    results = spark.createDataFrame(
        [("ueba", at(5), "1", ["swift_off_hours"], "A", "10.0.0.1"), ("ueba", at(1), "2", ["new_swift_resource"], "Z", ""), ("windows", at(0), "3", ["x"], "Q", "1")],
        "source string, event_time timestamp, event_ref string, flags array<string>, hostname string, source_ip string",
    )
    got = [(r["affected_asset"], r["flow_id"], r["attack_probability"]) for r in rs.swift_shortlist(flows, results).collect()]
    assert sorted(got, key=str) == sorted([("Z", None, 1.0), ("A", "f2", 0.95), ("10.0.0.1", None, 1.0), ("B", "f3", 0.99)], key=str)
    assert [r["affected_asset"] for r in rs.swift_shortlist(flows, results, top_n=1).collect()] == ["Z"]
    tickets = spark.createDataFrame([("i1", "SWIFT_x", "Q|B"), ("i2", "swift", "N"), ("i3", "other", "B")], "incident_id string, attack_pattern string, affected_assets string")
    check = rs.recall_check(rs.match_tickets(tickets, rs.swift_shortlist(flows, results))).first()
    assert (check["n_checkable"], check["n_missed"], check["status"]) == (2, 1, "FAIL")


def test_modal_fingerprint_tie_is_smallest(spark):
    flows = spark.createDataFrame([("f", "a", "b"), ("g", "a", "c")], "flow_id string, src_ip string, dst_ip string")
    zeek = spark.createDataFrame([("a", "b", "y"), ("a", "b", "x"), ("a", "b", None), ("a", "c", None)], "id_orig_h string, id_resp_h string, ja3_hash string")
    got = {r["flow_id"]: r["ja3_hash"] for r in ff.join_ja3_mode(flows, zeek).collect()}
    assert got == {"f": "x", "g": "UNKNOWN"}


def test_agent_scores_find_other_names(spark):
    df = spark.createDataFrame(pd.DataFrame({"source_ip": ["a", "a", "b"], "threat_score": [0.1, 0.4, 0.2]}))
    assert {tuple(r) for r in readers.agent_scores(df, "packet_score").collect()} == {("a", 0.4), ("b", 0.2)}
    bare = df.drop("threat_score")
    assert {tuple(r) for r in readers.agent_scores(bare, "packet_score").collect()} == {("a", 0.0), ("b", 0.0)}
    assert readers.agent_scores(None, "packet_score", spark).count() == 0
