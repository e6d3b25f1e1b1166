"""Ranked table sets in report order.

One DataFrame per family: ``(table_no, title, key, n, unit, rank, pct_of_max,
tone)``. All tables of a family come from one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.functions.text import printable
from logloom.operators import audit, flows, lb, objects, waf
from logloom.operators.counters import Dim, count_by, top_n, with_shares

# Dimension and title of every table, in report order.
AUDIT_TABLES = (
    ("principal", "Top principals"), ("event_name", "Top event names"), ("service", "Top services"),
    ("error_code", "Top error codes"), ("source_ip", "Top source IPs"), ("account", "By account"),
    ("region", "By region"),
)
LB_TABLES = (
    ("lb", "By load balancer"), ("elb_status", "By ELB status"), ("target_status", "By target status"),
    ("client_ip", "Top client IPs"), ("host", "Top hosts"), ("path", "Top paths"),
    ("user_agent", "Top user agents"), ("target", "Top targets"), ("method", "By method"),
    ("type", "By listener type"), ("action", "By action"), ("tls_protocol", "By TLS protocol"),
    ("tls_cipher", "By TLS cipher"), ("error_reason", "Top error reasons"),
)
CONNECTION_TABLES = (
    ("lb", "Connections by load balancer"), ("listener_tls", "By listener and TLS protocol"),
    ("tls_protocol", "Connections by TLS protocol"), ("tls_cipher", "Connections by TLS cipher"),
    ("key_exchange", "By TLS key exchange"), ("verify_status", "By client cert verify status"),
    ("client_ip", "Top connection client IPs"), ("failed_client_ip", "Top failed handshake client IPs"),
)
WAF_TABLES = (
    ("acl", "Web ACLs"), ("rule", "Terminating rules"), ("rule_group", "Rule groups"),
    ("blocked_client_ip", "Top blocked client IPs"), ("client_ip", "Top client IPs"),
    ("blocked_country", "Blocked countries"), ("country", "Countries"), ("host", "Hosts"),
    ("uri", "URIs, numbers as {n}"), ("method", "Methods"), ("user_agent", "User agents"), ("source", "Sources"),
    ("label", "Labels"), ("count_rule", "COUNT rules"), ("ja4", "JA4 fingerprints"),
    ("response_code", "Response codes"),
)
OBJECT_TABLES = (
    ("operation", "Operations"), ("principal", "Requesters"), ("remote_ip", "Top remote IPs"),
    ("status", "Status codes"), ("error_code", "Error codes"), ("denied_by_ip", "Denied by remote IP"),
    ("bucket", "Source buckets"), ("key", "Top keys"), ("bytes_by_requester", "Bytes sent by requester"),
    ("bytes_by_ip", "Bytes sent by remote IP"), ("tls", "TLS versions"), ("auth_type", "Auth types"),
    ("sig_version", "Signature versions"), ("user_agent", "User agents"),
)
FLOW_TABLES = (
    ("action", "Actions"), ("bytes_by_action", "Bytes by action"), ("service", "Destination ports"),
    ("source", "Top sources"), ("destination", "Top destinations"), ("pair_bytes", "Top pairs by bytes"),
    ("rejects_by_source", "Rejected flows by source"), ("protocol", "Protocols"), ("interface", "Interfaces"),
    ("direction", "Flow directions"),
)


def _tables(df: DataFrame, dims: dict[str, Dim], layout, unit: str, n: int, tone=d.value_tone) -> DataFrame:
    wanted = {name: dims[name] for name, _ in layout}
    return layout_tables(count_by(df, wanted), wanted, layout, unit, n, tone)


def layout_tables(counts: DataFrame, dims: dict[str, Dim], layout, unit: str, n: int, tone=d.value_tone) -> DataFrame:
    """Ranked tables of an already aggregated counter set."""
    ranked = with_shares(top_n(counts, n))
    number = title = units = None
    for i, (name, text) in enumerate(layout, 1):
        test = F.col("dim") == name
        of = "bytes" if dims[name].weight is not None else unit
        number = F.when(test, i) if number is None else number.when(test, i)
        title = F.when(test, text) if title is None else title.when(test, text)
        units = F.when(test, of) if units is None else units.when(test, of)
    return ranked.select(
        number.alias("table_no"), title.alias("title"), printable(F.col("key")).alias("key"), "n",
        units.alias("unit"), "rank", "pct_of_max", tone(F.col("key")).alias("tone"),
    )


def audit_tables(df: DataFrame, n: int = 10) -> DataFrame:
    return _tables(df, audit.dims(), AUDIT_TABLES, "events", n)


def lb_tables(df: DataFrame, n: int = 10) -> DataFrame:
    return _tables(df, lb.dims(), LB_TABLES, "requests", n)


def connection_tables(df: DataFrame, n: int = 10) -> DataFrame:
    return _tables(df, lb.conn_dims(), CONNECTION_TABLES, "connections", n)


def waf_tables(df: DataFrame, n: int = 10) -> DataFrame:
    return _tables(df, waf.dims(), WAF_TABLES, "requests", n)


def object_tables(df: DataFrame, n: int = 10) -> DataFrame:
    return _tables(df, objects.dims(), OBJECT_TABLES, "requests", n)


def flow_tables(df: DataFrame, n: int = 10) -> DataFrame:
    return _tables(flows.only_flows(df), flows.dims(), FLOW_TABLES, "flows", n, d.action_tone)
