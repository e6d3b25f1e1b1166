"""JSON line encoders, stream labels and line tables.

A line table is ``(kind, labels, at, line)``. NULL fields are left out of the
JSON; zero and false are left out where a log consumer treats them as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators import flows, lb, objects


def rfc3339_text(ts: Column) -> Column:
    """UTC time with only the fraction digits that are needed."""
    fraction = F.regexp_replace(F.date_format(ts, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def labels(**values: Column | str | None) -> Column:
    """Label map without empty values."""
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("key"), (F.lit(v) if isinstance(v, str) else v).cast("string").alias("value"))
            for k, v in values.items()
            if v is not None
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda e: d.yes(e["value"] != "")))


def labels_text(c: Column) -> Column:
    """``k=v,k=v`` in key order: a groupable form of a label map."""
    pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(pairs, ",")


def _when_true(c: Column) -> Column:
    return F.when(c, F.lit(True))


def _when_some(c: Column) -> Column:
    return F.when(c != 0, c)


def _when_any(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _encode(df: DataFrame, kind: str, at: Column, label_map: Column, run_id: str, fields: dict[str, Column]) -> DataFrame:
    body = F.struct(
        F.lit(kind).alias("kind"), F.lit(run_id).alias("run_id"), *[c.alias(name) for name, c in fields.items()]
    )
    return df.select(
        F.lit(kind).alias("kind"), label_map.alias("labels"), at.alias("at"), F.to_json(body).alias("line")
    )


def _cols(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def audit_lines(df: DataFrame, run_id: str, job: str = "logloom", max_bytes: int | None = None) -> DataFrame:
    """Audit events under their own field names.

    With ``max_bytes``, a longer line loses its payloads and is marked; without, every line is whole.
    """
    u = F.col("user_identity")
    context, issuer = u["session_context"], u["session_context"]["session_issuer"]
    identity = F.struct(
        u["type"].alias("type"), u["principal_id"].alias("principalId"), u["arn"].alias("arn"),
        u["account_id"].alias("accountId"), u["access_key_id"].alias("accessKeyId"),
        u["user_name"].alias("userName"), u["invoked_by"].alias("invokedBy"),
        F.when(
            context.isNotNull(),
            F.struct(
                F.struct(
                    context["attributes"]["mfa_authenticated"].alias("mfaAuthenticated"),
                    context["attributes"]["creation_date"].alias("creationDate"),
                ).alias("attributes"),
                F.when(
                    issuer.isNotNull(),
                    F.struct(
                        issuer["type"].alias("type"), issuer["arn"].alias("arn"),
                        issuer["user_name"].alias("userName"), issuer["account_id"].alias("accountId"),
                    ),
                ).alias("sessionIssuer"),
            ),
        ).alias("sessionContext"),
    )
    resources = F.transform(
        "resources",
        lambda r: F.struct(r["arn"].alias("ARN"), r["account_id"].alias("accountId"), r["type"].alias("type")),
    )
    fields = {
        "eventVersion": F.col("event_version"), "eventTime": rfc3339_text(F.col("event_time")),
        "eventSource": F.col("event_source"), "eventName": F.col("event_name"), "awsRegion": F.col("aws_region"),
        "sourceIPAddress": F.col("source_ip"), "userAgent": F.col("user_agent"), "errorCode": F.col("error_code"),
        "errorMessage": F.col("error_message"), "eventID": F.col("event_id"), "eventType": F.col("event_type"),
        "readOnly": F.col("read_only"), "managementEvent": F.col("management_event"),
        "eventCategory": F.col("event_category"), "recipientAccountId": F.col("recipient_account_id"),
        "userIdentity": identity, "resources": resources,
    }
    payload = {
        "requestParameters": F.try_parse_json("request_parameters"),
        "responseElements": F.try_parse_json("response_elements"),
        "additionalEventData": F.try_parse_json("additional_event_data"),
    }
    head = [F.lit("event").alias("kind"), F.lit(run_id).alias("run_id")] + [c.alias(n) for n, c in fields.items()]
    whole = F.to_json(F.struct(*head, *[c.alias(n) for n, c in payload.items()]))
    short = F.to_json(F.struct(*head, F.lit(True).alias("truncated")))
    whole_or_short = F.col("whole") if max_bytes is None else F.when(F.octet_length("whole") > max_bytes, F.col("short")).otherwise(F.col("whole"))
    label_map = labels(job=job, subcommand="cloudtrail", kind="event", account=F.col("recipient_account_id"),
                       region=F.col("aws_region"))
    return (
        df.select(label_map.alias("labels"), F.col("event_time").alias("at"), whole.alias("whole"), short.alias("short"))
        .select(
            F.lit("event").alias("kind"), "labels", "at",
            whole_or_short.alias("line"),
        )
    )


def finding_lines(findings: DataFrame, run_id: str, subcommand: str, job: str = "logloom") -> DataFrame:
    severity = F.lower("severity")
    fields = _cols("rule") | {"severity": severity} | _cols("title", "actor", "account", "region", "event_id", "detail")
    fields["actor"] = F.nullif("actor", F.lit(""))
    fields["event_time"] = rfc3339_text(F.col("time"))
    label_map = labels(job=job, subcommand=subcommand, kind="finding", severity=severity, account=F.col("account"))
    return _encode(findings, "finding", F.col("time"), label_map, run_id, fields)


def lb_lines(df: DataFrame, run_id: str, job: str = "logloom") -> DataFrame:
    """Requests; unmeasured durations are left out."""
    fields = {"event_time": rfc3339_text(F.col("ts")), "lb": F.col("lb"), "lb_type": F.col("kind")}
    fields |= _cols("type", "client_ip", "client_port", "target", "request_time", "target_time", "response_time")
    fields |= {"latency": lb.latency()}
    fields |= _cols("elb_status", "target_status")
    fields |= {n: F.coalesce(n, F.lit(0)) for n in ("received_bytes", "sent_bytes")}
    fields |= _cols(
        "method", "url", "protocol", "host", "path", "user_agent", "ssl_cipher", "ssl_protocol", "target_group_arn",
        "trace_id", "domain_name", "cert_arn", "actions", "redirect_url", "error_reason", "classification",
        "classification_reason", "conn_trace_id", "listener", "tls_handshake_time", "incoming_tls_alert",
        "tls_key_exchange", "alpn_frontend", "alpn_backend",
    )
    label_map = labels(job=job, subcommand="elb", kind="request", lb=F.col("lb"))
    return _encode(df, "request", F.col("ts"), label_map, run_id, fields)


def conn_lines(df: DataFrame, run_id: str, job: str = "logloom") -> DataFrame:
    fields = {"event_time": rfc3339_text(F.col("ts")), "lb": F.col("lb"), "lb_type": F.lit("alb")}
    fields |= _cols("client_ip", "client_port")
    fields |= {"received_bytes": F.lit(0), "sent_bytes": F.lit(0)}
    fields |= _cols(
        "ssl_cipher", "ssl_protocol", "conn_trace_id", "tls_verify_status", "client_cert_subject",
        "client_cert_validity", "client_cert_serial", "listener", "tls_handshake_time", "tls_key_exchange",
    )
    label_map = labels(job=job, subcommand="elb", kind="conn", lb=F.col("lb"))
    return _encode(df, "conn", F.col("ts"), label_map, run_id, fields)


def waf_lines(df: DataFrame, run_id: str, job: str = "logloom") -> DataFrame:
    fields = {"event_time": rfc3339_text(F.col("ts"))}
    fields |= _cols("web_acl", "action", "rule", "rule_type", "rule_group", "source", "source_id", "client_ip",
                    "country", "method", "host", "uri", "user_agent")
    fields |= {
        "labels": _when_any(F.col("labels")), "count_rules": _when_any(F.col("count_rules")),
        "rate_rule": F.col("rate_rule"), "response_code": _when_some(F.col("response_code")),
        "oversize": _when_true(F.col("oversize")),
    }
    fields |= _cols("ja3", "ja4", "request_id")
    fields["challenge_failed"] = _when_true(F.col("challenge_failed"))
    label_map = labels(job=job, subcommand="waf", kind="request", acl=F.col("web_acl"), action=F.col("action"))
    return _encode(df, "request", F.col("ts"), label_map, run_id, fields)


def object_lines(df: DataFrame, run_id: str, job: str = "logloom") -> DataFrame:
    fields = {"event_time": rfc3339_text(F.col("ts"))} | _cols("bucket", "remote_ip")
    fields |= {"requester": objects.principal()}
    fields |= _cols("request_id", "operation", "key", "method", "path", "proto")
    fields |= {
        "status": _when_some(F.col("status")), "error_code": F.col("error_code"),
        "bytes_sent": F.coalesce("bytes_sent", F.lit(0)), "object_size": _when_some(F.col("object_size")),
        "total_time_ms": F.col("total_time_ms"), "turnaround_time_ms": F.col("turnaround_ms"),
    }
    fields |= _cols("referer", "user_agent", "sig_version", "cipher_suite", "auth_type", "host_header", "tls_version",
                    "access_point_arn")
    fields |= {"acl_required": _when_true(F.col("acl_required")), "plain_http": _when_true(F.col("plain_http"))}
    label_map = labels(job=job, subcommand="s3", kind="request", bucket=F.col("bucket"),
                       status_class=d.object_status_class(objects.status()))
    return _encode(df, "request", F.col("ts"), label_map, run_id, fields)


def flow_lines(df: DataFrame, run_id: str, job: str = "logloom") -> DataFrame:
    """Flows with both the logged and the effective endpoints; ports stay, because 0 is a real ICMP value."""
    fields = {
        "event_time": rfc3339_text(F.col("start")), "end_time": rfc3339_text(F.col("end")),
    }
    fields |= _cols("action", "log_status", "version", "account_id", "interface_id", "vpc_id", "subnet_id", "instance_id")
    fields |= {"source": flows.source(), "destination": flows.destination()}
    fields |= _cols("src_addr", "dst_addr", "src_port", "dst_port")
    fields |= {"protocol": d.protocol_name(F.col("protocol"))}
    fields |= {n: F.coalesce(n, F.lit(0)) for n in ("packets", "bytes")}
    fields |= _cols("tcp_flags", "type", "pkt_src_addr", "pkt_dst_addr", "region", "az_id", "pkt_src_aws_service",
                    "pkt_dst_aws_service", "flow_direction", "traffic_path", "reject_reason")
    label_map = labels(job=job, subcommand="vpc", kind="flow", action=F.col("action"), vpc=F.col("vpc_id"))
    return _encode(df, "flow", F.col("start"), label_map, run_id, fields)


def by_event_time(lines: DataFrame) -> DataFrame:
    """Order lines by record time within their label stream.

    Range partitioning on (stream, time) splits a stream that holds most of the
    lines over several consecutive files instead of sending it to one task.
    """
    return (
        lines.withColumn("stream", labels_text(F.col("labels")))
        .repartitionByRange("stream", "at")
        .sortWithinPartitions("stream", "at", "line")
    )


def write_jsonl(lines: DataFrame, path: str, findings: DataFrame | None = None) -> None:
    """JSON Lines folders per kind: every match, uncapped, and the findings in their own ``kind=finding`` folder.

    ``path`` belongs to one run or batch: a repetition replaces what it wrote before, so no line is there twice.
    """
    out = lines.select("kind", "line")
    if findings is not None:
        out = out.unionByName(findings.select("kind", "line"))
    out.write.mode("overwrite").partitionBy("kind").text(path)


def fan_out(lines: DataFrame, *writers) -> None:
    """Several outputs of one result, computed once."""
    kept = lines.persist()
    try:
        for write in writers:
            write(kept)
    finally:
        kept.unpersist()
