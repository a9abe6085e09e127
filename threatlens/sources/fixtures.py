"""Security tables derived from the driver's Parquet tables (see FIXTURES.md).

The texts run unchanged in Spark SQL and in DuckDB: ``{table}`` marks a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

T0 = "TIMESTAMP '2024-01-01 00:00:00'+INTERVAL '1' SECOND*"


def _ip(k: str) -> str:
    return (
        f"('10.'||CAST(({k})%5 AS STRING)||'.'||CAST(CAST(FLOOR(({k})/250) AS INT) AS STRING)"
        f"||'.'||CAST(({k})%250 AS STRING))"
    )


def _host(k: str) -> str:
    return (
        f"CASE WHEN ({k})=1 THEN 'SRV-DC-01' WHEN ({k})=2 THEN 'SRV-SQL-01' WHEN ({k})=3 THEN 'SWIFT-GW-01'"
        f" WHEN ({k})%5=0 THEN 'WS-KTM-'||CAST(({k}) AS STRING) WHEN ({k})%5=1 THEN 'ATM-'||CAST(({k}) AS STRING)"
        f" WHEN ({k})%5=2 THEN 'SRV-CBS-'||CAST(({k}) AS STRING) WHEN ({k})%5=3 THEN 'SWIFT-DB-'||CAST(({k}) AS STRING)"
        f" ELSE 'DMZ-WEB-'||CAST(({k}) AS STRING) END"
    )


def _segment(k: str) -> str:
    return (
        f"CASE WHEN ({k}) IN (1,2) THEN 'CORE_BANKING' WHEN ({k})%5=0 THEN 'WORKSTATION' WHEN ({k})%5=1 THEN 'ATM'"
        f" WHEN ({k})%5=2 THEN 'CORE_BANKING' WHEN ({k})%5=3 THEN 'SWIFT' ELSE 'DMZ' END"
    )


def _port(k: str) -> str:
    return (
        f"CASE ({k})%8 WHEN 0 THEN 853 WHEN 1 THEN 3389 WHEN 2 THEN 445 WHEN 3 THEN 22 WHEN 4 THEN 443"
        f" WHEN 5 THEN 80 WHEN 6 THEN 1433 ELSE 4444 END"
    )


_USER_KEY = "1+user_id%100"

VIEWS = {
    "hosts": f"""SELECT {_host('s_suppkey')} AS hostname, {_ip('s_suppkey')} AS ip_address, {_segment('s_suppkey')} AS segment,
 CASE s_suppkey%4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' END AS criticality, (s_suppkey%9=4) AS is_honeypot FROM {{supplier}}""",
    "netflow": f"""SELECT 'NF-'||CAST(l_orderkey AS STRING)||'-'||CAST(l_linenumber AS STRING) AS flow_id,
 CASE WHEN l_linenumber=7 THEN '185.10.'||CAST(l_partkey%250 AS STRING)||'.'||CAST(l_suppkey%250 AS STRING) ELSE {_ip('l_suppkey')} END AS src_ip,
 CASE WHEN l_partkey%11=10 THEN '45.33.'||CAST(l_suppkey%250 AS STRING)||'.'||CAST(l_partkey%250 AS STRING) ELSE {_ip('1+l_partkey%10')} END AS dst_ip,
 CASE WHEN l_suppkey=3 THEN {T0}(445800+(l_orderkey*41+l_linenumber*13)%100) ELSE {T0}((l_orderkey*41+l_linenumber*13)%604800) END AS start_time,
 l_tax*100 AS duration_sec, CASE WHEN l_orderkey%101=0 THEN NULL ELSE l_extendedprice*10 END AS bytes_sent,
 CAST(l_quantity AS BIGINT) AS packets_sent, CAST(ROUND(l_discount*100) AS BIGINT) AS packets_recv,
 CASE WHEN l_linenumber=7 THEN 'DMZ' ELSE {_segment('l_suppkey')} END AS segment,
 CASE WHEN l_orderkey%97=0 THEN NULL ELSE l_linenumber<>7 END AS is_internal_src, (l_partkey%11<>10) AS is_internal_dst,
 CASE WHEN l_suppkey=3 THEN 1433 ELSE {_port('l_partkey')} END AS dst_port, CAST(1024+l_orderkey%60000 AS INT) AS src_port, 'TCP' AS protocol,
 CASE l_returnflag WHEN 'A' THEN 'S' WHEN 'N' THEN 'PA' ELSE 'SA' END AS tcp_flags FROM {{lineitem}}""",
    "flow_labels": """SELECT DISTINCT 'NF-'||CAST(l_orderkey AS STRING)||'-'||CAST(l_linenumber AS STRING) AS flow_id, ((l_orderkey+l_linenumber)%10=0) AS is_attack FROM {lineitem} WHERE l_orderkey%2=0""",
    "zeek": f"""SELECT 'ZK-'||CAST(o_orderkey AS STRING) AS log_id, {T0}((o_orderkey*47)%604800) AS ts, {_ip('1+o_custkey%100')} AS id_orig_h, {_ip('1+o_orderkey%10')} AS id_resp_h,
 {_port('o_orderkey')} AS id_resp_p, CASE o_orderkey%5 WHEN 0 THEN 'ssl' WHEN 1 THEN 'tls' WHEN 2 THEN 'http' WHEN 3 THEN 'dns' END AS service,
 CASE o_orderstatus WHEN 'F' THEN 'SF' WHEN 'O' THEN 'S0' ELSE 'REJ' END AS conn_state, (o_orderkey%600)/CAST(10 AS DOUBLE) AS duration, CAST(ROUND(o_totalprice) AS BIGINT) AS orig_bytes,
 (o_orderkey%7)*1000 AS resp_bytes, o_orderkey%50 AS orig_pkts,
 CASE WHEN o_custkey%12=0 THEN NULL WHEN o_orderkey%50=0 THEN 'c7d1e3f2a4b6c8d0' WHEN o_orderkey%1999=0 THEN 'never'||CAST(o_orderkey AS STRING) WHEN o_orderkey=4321 THEN 'rare0001' ELSE 'ja3'||CAST(o_custkey%9 AS STRING) END AS ja3_hash,
 (o_orderkey%50=0 OR o_orderkey%1999=0) AS is_anomaly FROM {{orders}}""",
    "windows_events": f"""SELECT 'WE-'||CAST(event_id AS STRING) AS event_log_id,
 CASE WHEN event_id%20=0 THEN {T0}(244800+CAST(FLOOR(event_id/50) AS BIGINT)) ELSE {T0}((event_id*613)%604800) END AS event_time, CASE WHEN event_id%20=0 THEN 4625 ELSE CASE event_id%19 WHEN 0 THEN 1102 WHEN 1 THEN 7045 WHEN 2 THEN 4688 WHEN 3 THEN 4672 WHEN 4 THEN 4648 WHEN 5 THEN 4625 WHEN 6 THEN 4740 WHEN 7 THEN 4698 WHEN 8 THEN 4720 WHEN 9 THEN 4771 WHEN 10 THEN 4769 WHEN 11 THEN 5140 WHEN 12 THEN 5140 ELSE 4624 END END AS event_id,
 {_host(_USER_KEY)} AS hostname,
 CASE user_id%7 WHEN 0 THEN 'admin_01' WHEN 1 THEN 'WS$' WHEN 2 THEN 'svc_backup' ELSE 'User_'||CAST(user_id%20 AS STRING) END AS subject_username,
 CASE WHEN event_id%20=0 THEN 'sql_admin' WHEN user_id%3=0 THEN 'db_ops' ELSE 'user_'||CAST(user_id AS STRING) END AS target_username,
 CASE event_id%6 WHEN 0 THEN 'cmd.exe' WHEN 1 THEN 'powershell.exe' WHEN 2 THEN 'mimikatz.exe' WHEN 3 THEN 'DefenderHelper.exe' WHEN 4 THEN 'wscript.exe' ELSE 'svchost.exe' END AS process_name,
 CASE event_id%5 WHEN 0 THEN 'winword.exe' WHEN 1 THEN 'excel.exe' WHEN 2 THEN 'explorer.exe' ELSE 'services.exe' END AS parent_process,
 CASE event_id%11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE {_ip(_USER_KEY)} END AS source_ip,
 CASE event_id%5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 10 WHEN 3 THEN 7 ELSE 5 END AS logon_type, (event_type='error' AND event_id%4=0) AS is_anomaly FROM {{events}}""",
    "ueba": f"""SELECT event_id AS ueba_id, CASE WHEN event_id%20=1 THEN {T0}(441000+CAST(FLOOR(event_id/100) AS BIGINT)) ELSE {T0}((event_id*727)%604800) END AS event_time,
 CASE WHEN event_id%20=1 THEN 'usr_burst' WHEN user_id%10=0 THEN 'srv_pumori_app' WHEN user_id%10=1 THEN 'svc_backup' WHEN user_id%10=2 THEN 'Pumori_Batch' ELSE 'user_'||CAST(user_id AS STRING) END AS username,
 {_host(_USER_KEY)} AS hostname, CASE WHEN event_id%9=0 THEN '' ELSE {_ip(_USER_KEY)} END AS source_ip,
 CASE WHEN event_id%20=1 THEN 'DB_QUERY' ELSE CASE event_id%10 WHEN 0 THEN 'FILE_ACCESS' WHEN 1 THEN 'DB_QUERY' WHEN 2 THEN 'EMAIL_SEND' WHEN 3 THEN 'SHARE_ACCESS' WHEN 4 THEN 'PRINT' WHEN 5 THEN 'REMOTE_LOGIN' WHEN 6 THEN 'PRIVILEGE_USE' WHEN 7 THEN 'SOFTWARE_INSTALL' WHEN 8 THEN 'USB_INSERT' ELSE 'LARGE_DOWNLOAD' END END AS event_type,
 CASE WHEN event_id%20=1 THEN 'SWIFT_MT103' ELSE CASE event_id%6 WHEN 0 THEN 'swift_mt940' WHEN 1 THEN 'pumori_cbs' ELSE 'share_'||CAST(event_id%6 AS STRING) END END AS resource_accessed,
 CAST(FLOOR(value*value*value) AS BIGINT) AS bytes_transferred, CAST(event_id%900 AS DOUBLE) AS duration_sec, event_id%13 AS failed_attempts_prior_1h,
 ((event_id*37)%100)/CAST(100 AS DOUBLE) AS peer_group_deviation_score, (event_id%3=0) AS is_off_hours, (event_id%4=0) AS is_new_resource, (event_type='error' AND event_id%4=0) AS is_anomaly FROM {{events}}""",
    "tickets": """SELECT 'INC-'||CAST(n_nationkey AS STRING) AS incident_id, CASE n_nationkey%3 WHEN 0 THEN 'SWIFT_Tampering' WHEN 1 THEN 'C2_Beacon' ELSE 'Brute_Force' END AS attack_pattern,
 CASE WHEN n_nationkey%2=0 THEN 'SWIFT-GW-01|SRV-SQL-01' ELSE 'NOHOST-9|ATM-1' END AS affected_assets FROM {nation}""",
}


def base_tables(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))


def view_sql(name: str) -> str:
    """The view text over tables of the same name as the driver's files."""
    return VIEWS[name].format(**{t: t for t in base_tables(name)})


def over(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """The view over given base tables; a streaming base table gives a streaming view."""
    return spark.sql(VIEWS[name], **tables)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in base_tables(name)}
    return over(spark, name, **tables)
