"""Fixed values of the detection domain: risk maps, rule thresholds, feature lists, word lists.

These values decide results, so they are stated once here and never derived.
"""

# Indicators and ports.
KNOWN_C2_JA3 = "c7d1e3f2a4b6c8d0"
LIVE_MALICIOUS_JA3 = ["c7d1e3f2a4b6c8d0", "e7d1e3f2a4b6c8d1", "a7d1e3f2a4b6c8d2"]
SWIFT_SQL_PORT = 1433
ENCRYPTED_DNS_PORT = 853
C2_PORTS = [853, 4444]
LATERAL_PORTS = [3389, 445]

# Command-and-control time window, Monday = 0.
C2_WEEKDAY = 5
C2_HOUR_FROM = 3
C2_HOUR_TO = 5

# Kill chain nodes; a trailing dash marks a host name prefix.
KILL_CHAIN = ["WS-KTM-", "SRV-DC-01", "SRV-SQL-01", "SWIFT-GW-01"]
KILL_CHAIN_ID = "COMM-018"
KILL_CHAIN_TACTICS = [
    "TA0001 - Initial Access",
    "TA0008 - Lateral Movement",
    "TA0040 - Impact",
]
KILL_CHAIN_TECHNIQUES = [
    "T1021.002 - SMB/Windows Admin Shares",
    "T1078 - Valid Accounts",
    "T1565.001 - Stored Data Manipulation",
]
KILL_CHAIN_CONFIDENCE = 0.95

# Risk and weight maps.
SEGMENT_RISK = {"SWIFT": 1.0, "CORE_BANKING": 0.8, "ATM": 0.6, "DMZ": 0.4, "WORKSTATION": 0.2}
SEGMENT_RISK_DEFAULT = 0.1
PORT_RISK = {1433: 0.8, 853: 0.9, 3389: 0.7, 445: 0.7, 22: 0.3}
PORT_RISK_DEFAULT = 0.05
SEGMENT_WEIGHT = {
    "SWIFT": 1.25,
    "ATM": 1.20,
    "CORE_BANKING": 1.10,
    "DMZ": 1.00,
    "WORKSTATION": 0.90,
    "INTERNAL": 0.95,
}
EVENT_TYPE_RISK = {
    "FILE_ACCESS": 0.05,
    "DB_QUERY": 0.10,
    "EMAIL_SEND": 0.05,
    "SHARE_ACCESS": 0.10,
    "PRINT": 0.02,
    "REMOTE_LOGIN": 0.15,
    "PRIVILEGE_USE": 0.25,
    "SOFTWARE_INSTALL": 0.30,
    "USB_INSERT": 0.20,
    "LARGE_DOWNLOAD": 0.15,
}
EVENT_TYPE_RISK_DEFAULT = 0.05

# Category to technique.
CATEGORY_TECHNIQUE = {
    "C2_BEACON": "T1071.001",
    "LATERAL_MOVEMENT": "T1021.002",
    "DATA_EXFIL": "T1041",
    "PORT_SCAN": "T1046",
    "BRUTE_FORCE": "T1110",
    "RANSOMWARE_STAGING": "T1486",
    "INSIDER_THREAT": "T1078",
    "SWIFT_TAMPERING": "T1005",
    "ATM_JACKPOTTING": "T1543.003",
    "ZERO_DAY": "T0000",
    "NORMAL": "",
}

# Flag to (tactic, technique).
USER_FLAG_TECHNIQUE = {
    "off_hours": ("Persistence", "T1078"),
    "high_peer_deviation": ("Valid Accounts", "T1078"),
    "elevated_peer_deviation": ("Valid Accounts", "T1078"),
    "large_data_transfer": ("Exfiltration", "T1041"),
    "new_swift_resource": ("Collection", "T1005"),
    "new_resource": ("Discovery", "T1083"),
    "failed_access_spike": ("Credential Access", "T1110"),
    "failed_access_elevated": ("Credential Access", "T1110"),
    "swift_off_hours": ("Lateral Movement", "T1021"),
    "unauthorized_pumori": ("Collection", "T1005"),
    "privilege_abuse": ("Privilege Escalation", "T1078"),
    "ml_anomaly": ("Anomaly", "T0000"),
    "swift_query_velocity": ("Collection", "T1005"),
}
WINDOWS_FLAG_TECHNIQUE = {
    "audit_log_cleared": ("Defense Evasion", "T1562.001"),
    "credential_dump": ("Credential Access", "T1003.001"),
    "new_service_atm": ("Persistence", "T1543.003"),
    "new_service": ("Persistence", "T1543.003"),
    "priv_escalation": ("Privilege Escalation", "T1078"),
    "explicit_credential": ("Lateral Movement", "T1021"),
    "brute_force": ("Credential Access", "T1110"),
    "account_lockout": ("Credential Access", "T1110"),
    "scheduled_task": ("Persistence", "T1053.005"),
    "user_created": ("Persistence", "T1136.001"),
    "kerberoasting": ("Credential Access", "T1558.003"),
    "share_access_bulk": ("Lateral Movement", "T1021.002"),
    "suspicious_process": ("Execution", "T1059"),
    "off_hours_logon": ("Persistence", "T1078"),
    "pass_the_hash": ("Credential Access", "T1550.002"),
}

# Account and process lists.
RESOURCE_WHITELIST = [
    "srv_pumori_app",
    "pumori_batch",
    "admin_db_sync",
    "cbs_service",
    "pumori_reporting",
]
ADMIN_ACCOUNTS = [
    "admin_01",
    "admin_02",
    "admin_03",
    "svc_backup",
    "svc_monitor",
    "svc_antivirus",
    "svc_wsus",
    "svc_sccm",
]
# process -> (flag, score)
LISTED_PROCESS = {
    "lsass.exe": ("credential_dump", 0.95),
    "mimikatz.exe": ("credential_dump", 1.00),
    "procdump.exe": ("credential_dump", 0.90),
    "DefenderHelper.exe": ("new_service", 0.95),
    "WindowsUpdateSvc.exe": ("new_service", 0.95),
    "NetSvc64.exe": ("new_service", 0.95),
    "SysMonitor32.exe": ("new_service", 0.95),
}
# (process, parent) -> score
PARENT_COMBO = {
    ("powershell.exe", "winword.exe"): 0.90,
    ("powershell.exe", "excel.exe"): 0.90,
    ("cmd.exe", "winword.exe"): 0.85,
    ("wscript.exe", "explorer.exe"): 0.80,
}
HASH_LOGON_PROCESS = ["cmd.exe", "powershell.exe", "lsass.exe", "mimikatz.exe"]
HIGH_VALUE_NAME_PARTS = ["admin", "sql", "db", "svc"]

# Model input columns.
ANOMALY_FEATURES = [
    "bytes_per_pkt",
    "pkt_sent_ratio",
    "segment_risk",
    "dst_port_risk",
    "is_internal_to_ext",
    "flag_syn_only",
    "hour_sin",
    "hour_cos",
    "is_c2_time_window",
    "unique_dst_ips",
]
CLASSIFIER_FEATURES = ANOMALY_FEATURES + [
    "is_swift_sql",
    "is_encrypted_dns",
    "swift_direct_internet",
    "is_known_c2_ja3",
    "ja3_unseen_in_normal",
    "dow_sin",
    "dow_cos",
    "flow_count",
    "swift_query_zscore",
    "swift_rate_exceeded",
]
USER_FEATURES = [
    "bytes_transferred",
    "duration_sec",
    "failed_attempts_prior_1h",
    "peer_group_deviation_score",
    "is_off_hours_num",
    "is_new_resource_num",
    "hour_of_day",
    "day_of_week",
    "event_type_risk",
]
PACKET_FEATURES = [
    "win_total_events",
    "win_unique_hosts",
    "win_unique_users",
    "win_failed_logons",
    "win_process_creations",
    "win_privileged_logons",
    "win_service_installs",
    "win_rdp_logons",
    "win_network_logons",
    "win_fail_ratio",
    "win_priv_ratio",
    "win_process_ratio",
    "win_off_hours_ratio",
    "zeek_total_conns",
    "zeek_unique_dst_ips",
    "zeek_unique_dst_ports",
    "zeek_failed_conns",
    "zeek_encrypted_conns",
    "zeek_off_hours_conns",
    "zeek_mean_duration",
    "zeek_mean_orig_bytes",
    "zeek_mean_resp_bytes",
    "zeek_total_orig_bytes",
    "zeek_mean_bytes_ratio",
    "zeek_mean_orig_pkts",
    "zeek_fail_ratio",
    "zeek_encrypted_ratio",
    "zeek_off_hours_ratio",
    "zeek_dst_diversity",
]

# Severity ladders, highest first, as (lower bound, tier).
FUSED_LADDER = [(0.85, "CRITICAL"), (0.70, "HIGH"), (0.50, "MEDIUM")]
RESPONSE_LADDER = [(0.90, "CRITICAL"), (0.75, "HIGH"), (0.60, "MEDIUM")]
RESPONSE_TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# Live alerting.
LIVE_THRESHOLD = 0.86
LIVE_DEFAULT_SCORE = 0.05
ALERT_COOLDOWN_SEC = 10
LOOPBACK = ["127.0.0.1", "localhost", "::1"]
INTERNAL_PREFIXES = ["10.", "192.168.", "172.16."]

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
