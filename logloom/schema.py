"""Canonical tables: one fixed logical schema per log family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AUDIT_EVENTS = """
event_version string, event_time timestamp, event_source string, event_name string, aws_region string,
source_ip string, user_agent string, error_code string, error_message string, event_id string, event_type string,
read_only boolean, management_event boolean, event_category string, recipient_account_id string,
user_identity struct<type:string, principal_id:string, arn:string, account_id:string, access_key_id:string,
  user_name:string, invoked_by:string,
  session_context:struct<attributes:struct<mfa_authenticated:string, creation_date:string>,
    session_issuer:struct<type:string, arn:string, user_name:string, account_id:string>>>,
resources array<struct<arn:string, account_id:string, type:string>>,
request_parameters string, response_elements string, additional_event_data string
"""

LB_REQUESTS = """
kind string, type string, ts timestamp, lb string, client_ip string, client_port string, target string,
request_time double, target_time double, response_time double, latency double, elb_status string,
target_status string, received_bytes bigint, sent_bytes bigint, method string, url string, protocol string,
host string, path string, user_agent string, ssl_cipher string, ssl_protocol string, target_group_arn string,
trace_id string, domain_name string, cert_arn string, matched_rule_priority string,
request_creation_time timestamp, actions string, redirect_url string, error_reason string, target_list string,
target_status_list string, classification string, classification_reason string, conn_trace_id string,
listener string, tls_handshake_time double, incoming_tls_alert string, tls_key_exchange string,
alpn_frontend string, alpn_backend string
"""

LB_CONNECTIONS = """
ts timestamp, lb string, client_ip string, client_port string, listener string, ssl_protocol string,
ssl_cipher string, tls_handshake_time double, client_cert_subject string, client_cert_validity string,
client_cert_serial string, tls_verify_status string, conn_trace_id string, tls_key_exchange string
"""

WAF_REQUESTS = """
ts timestamp, web_acl string, action string, rule string, rule_type string, rule_group string, source string,
source_id string, client_ip string, country string, method string, host string, uri string, user_agent string,
labels array<string>, count_rules array<string>, rate_rule string, response_code int, oversize boolean,
ja3 string, ja4 string, request_id string, challenge_failed boolean
"""

OBJECT_REQUESTS = """
ts timestamp, bucket string, remote_ip string, requester string, request_id string, operation string, key string,
method string, path string, proto string, status int, error_code string, bytes_sent bigint, object_size bigint,
total_time_ms bigint, turnaround_ms bigint, referer string, user_agent string, sig_version string,
cipher_suite string, auth_type string, host_header string, tls_version string, access_point_arn string,
acl_required boolean, plain_http boolean
"""

FLOWS = """
version int, account_id string, interface_id string, src_addr string, dst_addr string, src_port int, dst_port int,
protocol int, packets bigint, bytes bigint, start timestamp, end timestamp, action string, log_status string,
vpc_id string, subnet_id string, instance_id string, tcp_flags int, type string, pkt_src_addr string,
pkt_dst_addr string, region string, az_id string, pkt_src_aws_service string, pkt_dst_aws_service string,
flow_direction string, traffic_path int, reject_reason string
"""

FINDINGS = """
rule string, severity string, severity_rank int, title string, actor string, account string, region string,
event_id string, detail string, time timestamp, n bigint
"""
FINDING_COLUMNS = [f.split()[0] for f in FINDINGS.replace("\n", " ").split(",")]

METRICS = "name string, type string, labels map<string,string>, value double, at timestamp"

TABLES = {
    "audit_events": AUDIT_EVENTS,
    "lb_requests": LB_REQUESTS,
    "lb_connections": LB_CONNECTIONS,
    "waf_requests": WAF_REQUESTS,
    "object_requests": OBJECT_REQUESTS,
    "flows": FLOWS,
}

# Column that carries the record time of each table.
TIME_COLUMN = {
    "audit_events": "event_time",
    "lb_requests": "ts",
    "lb_connections": "ts",
    "waf_requests": "ts",
    "object_requests": "ts",
    "flows": "start",
}

# Severities from least to most urgent.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SEVERITY_RANK = {name: i for i, name in enumerate(SEVERITIES)}


def parse_severity(text: str) -> str:
    name = text.strip().upper()
    if name not in SEVERITY_RANK:
        raise ValueError(f"unknown severity {text!r} (want low, medium, high, or critical)")
    return name


def struct_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Add the canonical columns a source lacks as typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[
            F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in struct_of(TABLES[table]).fields
        ]
    )
