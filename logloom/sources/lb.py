"""Load-balancer access logs (application, network, classic) and connection logs.

One scan reads every layout: the field positions depend on the kind that the
file name tells, so a line is tokenized once and each field picked by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.functions import text as x
from logloom.sources import scope as s
from logloom.sources.lines import Parsed, lines_of, parsed, read_lines, salvage_contents, unreadable_of

# 0-based field positions per layout, and the shortest line.
POSITIONS: dict[str, dict[str, int]] = {
    "alb": {
        "type": 0, "time": 1, "lb": 2, "client": 3, "target": 4, "request_time": 5, "target_time": 6,
        "response_time": 7, "elb_status": 8, "target_status": 9, "received_bytes": 10, "sent_bytes": 11, "request": 12,
        "user_agent": 13, "ssl_cipher": 14, "ssl_protocol": 15, "target_group_arn": 16, "trace_id": 17,
        "domain_name": 18, "cert_arn": 19, "matched_rule_priority": 20, "request_creation_time": 21, "actions": 22,
        "redirect_url": 23, "error_reason": 24, "target_list": 25, "target_status_list": 26, "classification": 27,
        "classification_reason": 28, "conn_trace_id": 29,
    },
    "nlb": {
        "type": 0, "time": 2, "lb": 3, "listener": 4, "client": 5, "target": 6, "connection_ms": 7, "handshake_ms": 8,
        "received_bytes": 9, "sent_bytes": 10, "incoming_tls_alert": 11, "cert_arn": 12, "ssl_cipher": 14,
        "ssl_protocol": 15, "tls_key_exchange": 16, "domain_name": 17, "alpn_frontend": 18, "alpn_backend": 19,
        "request_creation_time": 21,
    },
    "classic": {
        "time": 0, "lb": 1, "client": 2, "target": 3, "request_time": 4, "target_time": 5, "response_time": 6,
        "elb_status": 7, "target_status": 8, "received_bytes": 9, "sent_bytes": 10, "request": 11, "user_agent": 12,
        "ssl_cipher": 13, "ssl_protocol": 14,
    },
}
MIN_FIELDS = {"alb": 13, "nlb": 11, "classic": 12}
CONNECTION_POSITIONS = {
    "time": 0, "client_ip": 1, "client_port": 2, "listener": 3, "ssl_protocol": 4, "ssl_cipher": 5,
    "tls_handshake_time": 6, "client_cert_subject": 7, "client_cert_validity": 8, "client_cert_serial": 9,
    "tls_verify_status": 10, "conn_trace_id": 11, "tls_key_exchange": 12, "lb": 13,
}
MIN_CONNECTION_FIELDS = 14


def _by_kind(values: dict[str, int]) -> Column:
    kind, out = F.col("kind"), None
    for name, v in values.items():
        out = F.when(kind == name, v) if out is None else out.when(kind == name, v)
    return out


def _field(name: str) -> Column:
    """The field's token, NULL where the layout has none or logs ``-``."""
    places = {kind: at[name] for kind, at in POSITIONS.items() if name in at}
    return x.known(x.unquoted(F.get(F.col("tokens"), _by_kind(places))))


def _tokenized(lines: DataFrame, kind: Column) -> DataFrame:
    return lines.select("file", "pos", kind.alias("kind"), x.raw_tokens(F.col("line")).alias("tokens"))


def parse_lb(lines: DataFrame) -> Parsed:
    """Access-log lines ``(file, pos, line)`` of any layout to requests."""
    fields = _tokenized(lines, s.lb_kind(F.col("file"))).select(
        "file", "pos", "kind", F.size("tokens").alias("n_tokens"),
        *[_field(name).alias(name) for name in dict.fromkeys(n for at in POSITIONS.values() for n in at)],
    )
    client_ip, client_port = x.host_port(F.col("client"))
    method, url, protocol = x.request_line(F.col("request"))
    split = fields.select(
        "*", method.alias("method"), url.alias("url"), protocol.alias("protocol"), client_ip.alias("client_ip"),
        client_port.alias("client_port"), x.rfc3339(F.col("time")).alias("ts"),
        x.seconds(F.col("request_time")).alias("rt"), x.seconds(F.col("target_time")).alias("tt"),
        x.seconds(F.col("response_time")).alias("st"),
    )
    c = F.col
    latency = F.when(c("kind") == "nlb", x.millis(c("connection_ms"))).otherwise(
        d.total_latency(c("rt"), c("tt"), c("st"))
    )
    derived = {
        "type": F.when(c("kind") == "classic", F.coalesce(x.url_scheme(c("url")), F.lit("tcp"))).otherwise(c("type")),
        "request_time": c("rt"), "target_time": c("tt"), "response_time": c("st"), "latency": latency,
        "received_bytes": F.coalesce(x.whole(c("received_bytes")), F.lit(0)),
        "sent_bytes": F.coalesce(x.whole(c("sent_bytes")), F.lit(0)),
        "host": x.url_host(c("url")), "path": x.url_path(c("url")), "domain_name": F.lower(c("domain_name")),
        "request_creation_time": x.rfc3339(c("request_creation_time")),
        "tls_handshake_time": x.millis(c("handshake_ms")),
    }
    names = (
        "kind type ts lb client_ip client_port target request_time target_time response_time latency elb_status "
        "target_status received_bytes sent_bytes method url protocol host path user_agent ssl_cipher ssl_protocol "
        "target_group_arn trace_id domain_name cert_arn matched_rule_priority request_creation_time actions "
        "redirect_url error_reason target_list target_status_list classification classification_reason "
        "conn_trace_id listener tls_handshake_time incoming_tls_alert tls_key_exchange alpn_frontend alpn_backend"
    ).split()
    record = F.struct(*[derived.get(n, c(n)).alias(n) for n in names])
    error = (
        F.when(c("kind").isNull(), "not a load balancer log")
        .when(c("n_tokens") < _by_kind(MIN_FIELDS), "too few fields")
        .when(c("ts").isNull(), "bad time field")
    )
    return parsed(split.select("file", "pos", error.alias("err"), record.alias("rec")))


def parse_lb_conns(lines: DataFrame) -> Parsed:
    """Connection-log lines ``(file, pos, line)`` to connections."""
    tokens = lines.select("file", "pos", x.raw_tokens(F.col("line")).alias("tokens"))
    fields = tokens.select(
        "file", "pos", F.size("tokens").alias("n_tokens"),
        *[
            x.known(x.unquoted(F.get(F.col("tokens"), F.lit(i)))).alias(name)
            for name, i in CONNECTION_POSITIONS.items()
        ],
    ).withColumn("ts", x.rfc3339(F.col("time")))
    names = (
        "ts lb client_ip client_port listener ssl_protocol ssl_cipher tls_handshake_time client_cert_subject "
        "client_cert_validity client_cert_serial tls_verify_status conn_trace_id tls_key_exchange"
    ).split()
    derived = {"tls_handshake_time": x.seconds(F.col("tls_handshake_time"))}
    record = F.struct(*[derived.get(n, F.col(n)).alias(n) for n in names])
    error = F.when(F.col("n_tokens") < MIN_CONNECTION_FIELDS, "too few fields").when(
        F.col("ts").isNull(), "bad time field"
    )
    return parsed(fields.select("file", "pos", error.alias("err"), record.alias("rec")))


def _read(spark, paths, keep, parse, strict_files: bool) -> Parsed:
    if strict_files:
        return parse(read_lines(spark, paths, keep))
    found = salvage_contents(spark, paths, keep)
    out = parse(lines_of(found))
    return Parsed(out.good, out.bad, unreadable_of(found))


def read_lb(spark: SparkSession, paths, names: Sequence[str] = (), kinds: Sequence[str] = (),
            strict_files: bool = True) -> Parsed:
    """Requests of all layouts, optionally of some balancers or kinds only."""
    return _read(
        spark, paths, lambda p: s.lb_file_filter(p, names, kinds) & ~s.is_conn_file(p), parse_lb, strict_files
    )


def read_lb_conns(spark: SparkSession, paths, names: Sequence[str] = (), strict_files: bool = True) -> Parsed:
    return _read(spark, paths, lambda p: s.lb_file_filter(p, names) & s.is_conn_file(p), parse_lb_conns, strict_files)
