"""Audit-event queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators import audit
from logloom.operators import counters as c
from logloom.operators import filters, health, lines, metrics, reports, rules
from logloom.plans import sqlparts as q
from logloom.plans.registry import Query

A = "audit_events"
ACTOR = "coalesce(arn, invoked_by, user_name, 'unknown')"
SERVICE = "replace(event_source, '.amazonaws.com', '')"
READS = "event_name LIKE 'List%' OR event_name LIKE 'Describe%'"
WRITE = f"coalesce(NOT read_only, NOT ({READS}))"

DIMS = {
    "principal": (ACTOR, "TRUE"), "event_name": ("event_name", "TRUE"), "service": (SERVICE, "TRUE"), "account": ("recipient_account_id", "TRUE"),
    "region": ("aws_region", "TRUE"), "error_code": ("error_code", "TRUE"), "source_ip": ("source_ip", "TRUE"),
}
TOTALS = f"SELECT count(*) AS events, count(*) FILTER ({WRITE}) AS writes, count(error_code) AS errors, min(event_time) AS first, max(event_time) AS last FROM audit_events"
HOURS = "SELECT h AS hour, count(x.event_time) AS n FROM range(0, 24) r(h) LEFT JOIN audit_events x ON hour(x.event_time) = h GROUP BY 1"


def _rule(rule: str, severity: str, title: str, detail: str, where: str) -> str:
    rank = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}[severity]
    return (
        f"SELECT '{rule}' AS rule, '{severity}' AS severity, CAST({rank} AS BIGINT) AS severity_rank, '{title}' AS title, {ACTOR} AS actor, recipient_account_id AS account, "
        f"aws_region AS region, event_id, {detail} AS detail, event_time AS time, CAST(1 AS BIGINT) AS n FROM audit_events WHERE {where}"
    )


LOGIN = "event_name = 'ConsoleLogin' AND json_extract_string(response_elements, '$.ConsoleLogin')"
RULES = {
    "root-usage": _rule(
        "root-usage", "CRITICAL", "Root account activity", "'Root account used for ' || event_name || ' in ' || aws_region",
        "identity_type = 'Root' AND invoked_by IS NULL",
    ),
    "console-no-mfa": _rule(
        "console-no-mfa", "HIGH", "Console login without MFA", "'ConsoleLogin succeeded without MFA from ' || source_ip",
        f"{LOGIN} = 'Success' AND json_extract_string(additional_event_data, '$.MFAUsed') = 'No'",
    ),
    "console-login-failed": _rule(
        "console-login-failed", "MEDIUM", "Failed console login", "'Failed console login from ' || source_ip", f"{LOGIN} = 'Failure'"
    ),
    "access-denied": _rule(
        "access-denied", "LOW", "Authorization failure", f"error_code || ' denied on ' || event_name || ' (' || {SERVICE} || ')'",
        "error_code IN ('AccessDenied', 'AccessDeniedException', 'UnauthorizedOperation', 'Client.UnauthorizedOperation')",
    ),
    "iam-mutation": _rule(
        "iam-mutation", "MEDIUM", "IAM configuration changed", "event_name || ' in ' || aws_region",
        "event_source = 'iam.amazonaws.com' AND event_name = 'CreateAccessKey'",
    ),
    "access-key-created": _rule(
        "access-key-created", "HIGH", "Access key created", "'Long-lived access key created for the calling identity'",
        "event_source = 'iam.amazonaws.com' AND event_name = 'CreateAccessKey'",
    ),
    "cloudtrail-tamper": _rule(
        "cloudtrail-tamper", "CRITICAL", "CloudTrail configuration changed", "event_name || ' on trail'",
        "event_source = 'cloudtrail.amazonaws.com' AND event_name = 'StopLogging'",
    ),
    "s3-exposure": _rule(
        "s3-exposure", "HIGH", "S3 bucket exposure setting changed", "event_name || ' on bucket ' || json_extract_string(request_parameters, '$.bucketName')",
        "event_source = 's3.amazonaws.com' AND event_name = 'PutBucketPolicy'",
    ),
    "sg-open-ingress": _rule(
        "sg-open-ingress", "HIGH", "Security group opened to the internet", "'AuthorizeSecurityGroupIngress with 0.0.0.0/0'",
        "event_source = 'ec2.amazonaws.com' AND event_name = 'AuthorizeSecurityGroupIngress' AND (contains(request_parameters, '0.0.0.0/0') OR contains(request_parameters, '::/0'))",
    ),
    "kms-destruction": _rule(
        "kms-destruction", "HIGH", "KMS key availability reduced", "event_name || ' on key'", "event_source = 'kms.amazonaws.com' AND event_name = 'DisableKey'"
    ),
}
ALL_SQL = " UNION ALL ".join(RULES.values())
CAPPED = f"SELECT * FROM ({ALL_SQL}) ORDER BY severity_rank DESC, time, event_id, rule LIMIT 300"
SINCE, UNTIL = datetime(1995, 1, 1), datetime(1997, 1, 1)


def _custom():
    return [
        rules.Rule(
            "denied-write", "HIGH", "Denied write", audit.is_write() & F.col("error_code").isNotNull(),
            F.concat(F.col("event_name"), F.lit(" failed: "), F.col("error_code")),
        )
    ]


def _capped(t):
    return rules.cap_audit(rules.audit_findings(t.audit_events), 300)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for i, dim in enumerate(DIMS, 2):
        out[f"agg_ct_{i:02d}"] = Query(lambda t, x=dim: c.counter(t.audit_events, audit.dims()[x]), q.counter(A, *DIMS[dim]))
    for i, rule in enumerate(RULES, 1):
        out[f"rul_ct_{i:02d}"] = Query(
            lambda t, r=rule: rules.audit_findings(t.audit_events, [x for x in rules.audit_rules() if x.id == r]), RULES[rule]
        )
    out |= {
        "agg_ct_01": Query(lambda t: audit.totals(t.audit_events), TOTALS),
        "agg_ct_counters": Query(lambda t: audit.counters(t.audit_events), q.counters(A, DIMS)),
        "agg_ct_09": Query(lambda t: audit.hour_of_day(t.audit_events), HOURS),
        "agg_ct_10_principals": Query(lambda t: audit.distinct_principals(t.audit_events), f"SELECT count(DISTINCT {ACTOR}) AS principals FROM audit_events"),
        "agg_ct_10_source_ips": Query(lambda t: audit.distinct_source_ips(t.audit_events), "SELECT count(DISTINCT source_ip) AS source_ips FROM audit_events"),
        "prj_01": Query(
            lambda t: t.audit_events.groupBy(audit.actor().alias("actor")).count(), f"SELECT {ACTOR} AS actor, count(*) AS count FROM audit_events GROUP BY 1"
        ),
        "prj_02_03": Query(
            lambda t: t.audit_events.groupBy(audit.service().alias("service"), "event_name", "read_only", audit.is_write().alias("is_write")).count(),
            f"SELECT {SERVICE} AS service, event_name, read_only, {WRITE} AS is_write, count(*) AS count FROM audit_events GROUP BY 1, 2, 3, 4",
        ),
        "prj_04": Query(
            lambda t: t.audit_events.groupBy(
                d.json_text(F.col("request_parameters"), "bucketName").alias("bucket"), d.json_text(F.col("request_parameters"), "missing").alias("missing"),
                d.json_text(F.col("response_elements"), "ConsoleLogin").alias("login"),
            ).count(),
            "SELECT json_extract_string(request_parameters, '$.bucketName') AS bucket, CAST(NULL AS VARCHAR) AS missing, json_extract_string(response_elements, '$.ConsoleLogin') AS login, "
            "count(*) AS count FROM audit_events GROUP BY 1, 2, 3",
        ),
        "prj_04_number": Query(
            lambda t: t.read("events").agg(
                F.count(d.json_text(F.col("props"), "k")).alias("texts"), F.count(F.get_json_object("props", "$.k")).alias("present")
            ),
            "SELECT count(*) FILTER (json_type(props, '$.k') = 'VARCHAR') AS texts, count(json_extract(props, '$.k')) AS present FROM events",
        ),
        "flt_01_03": Query(
            lambda t: filters.AuditFilter(principal="USER/U1", source_ip="113.1").apply(t.audit_events).groupBy(audit.actor().alias("actor"), "source_ip").count(),
            f"SELECT {ACTOR} AS actor, source_ip, count(*) AS count FROM audit_events WHERE contains(lower({ACTOR}), 'user/u1') AND contains(source_ip, '113.1') GROUP BY 1, 2",
        ),
        "flt_02": Query(
            lambda t: filters.AuditFilter(resource="B3").apply(t.audit_events).groupBy("event_name").count(),
            "SELECT event_name, count(*) AS count FROM audit_events WHERE contains(lower(request_parameters), 'b3') OR coalesce(contains(lower(resource_arn), 'b3'), false) GROUP BY 1",
        ),
        "flt_04_05": Query(
            lambda t: filters.AuditFilter(events=["consolelogin", "PUTBUCKETPOLICY"], sources=["SIGNIN", "s3.amazonaws.com"]).apply(t.audit_events)
            .groupBy("event_source", "event_name").count(),
            "SELECT event_source, event_name, count(*) AS count FROM audit_events WHERE event_name IN ('ConsoleLogin', 'PutBucketPolicy') AND event_source IN ('signin.amazonaws.com', 's3.amazonaws.com') GROUP BY 1, 2",
        ),
        "flt_06_07": Query(
            lambda t: filters.AuditFilter(errors_only=True, writes_only=True, since=SINCE, until=UNTIL).apply(t.audit_events).groupBy("event_name", "error_code").count(),
            f"SELECT event_name, error_code, count(*) AS count FROM audit_events WHERE error_code IS NOT NULL AND {WRITE} AND event_time >= TIMESTAMP '1995-01-01' AND event_time < TIMESTAMP '1997-01-01' GROUP BY 1, 2",
        ),
        "rul_ct_all": Query(lambda t: rules.audit_findings(t.audit_events), ALL_SQL),
        "set_02": Query(
            lambda t: rules.audit_findings(t.audit_events).groupBy("rule", "severity").count(),
            f"SELECT rule, severity, count(*) AS count FROM ({ALL_SQL}) GROUP BY 1, 2",
        ),
        "udx_01": Query(
            lambda t: rules.audit_findings(t.audit_events, _custom()),
            _rule("denied-write", "HIGH", "Denied write", "event_name || ' failed: ' || error_code", f"{WRITE} AND error_code IS NOT NULL"),
        ),
        "rnk_05": Query(_capped, CAPPED),
        "rnk_05_counts": Query(
            lambda t: rules.severity_counts(rules.audit_findings(t.audit_events)), q.severity_counts(ALL_SQL)
        ),
        "rnk_05_dropped": Query(
            lambda t: rules.dropped_by(rules.audit_findings(t.audit_events), _capped(t)),
            f"SELECT (SELECT count(*) FROM ({ALL_SQL})) - (SELECT count(*) FROM ({CAPPED})) AS dropped FROM audit_events LIMIT 1",
        ),
        "rnk_02_audit": Query(
            lambda t: health.audit_matches(t.audit_events, 200),
            f"SELECT event_time, recipient_account_id AS account, aws_region AS region, event_name, {ACTOR} AS actor, source_ip, error_code, event_id FROM audit_events ORDER BY event_time, event_id LIMIT 200",
        ),
        "rnk_11_audit": Query(
            lambda t: reports.audit_tables(t.audit_events), q.tables(q.counters(A, DIMS), reports.AUDIT_TABLES, "events", set(), 10, q.VALUE_TONE)
        ),
        "hlt_06_audit": Query(
            lambda t: health.audit_summary(t.audit_events),
            "UNPIVOT (SELECT CAST(events AS VARCHAR) AS events, CAST(writes AS VARCHAR) AS writes, CAST(errors AS VARCHAR) AS errors, "
            f"CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last FROM ({TOTALS})) ON COLUMNS(*) INTO NAME metric VALUE value",
        ),
        "met_08_audit": Query(
            lambda t: c.count_by(t.audit_events, audit.extra_dims()),
            q.counters(A, {"user_agent": ("user_agent", "TRUE"), "identity_type": ("identity_type", "TRUE")}),
        ),
        "snk_01": Query(
            lambda t: lines.audit_lines(t.audit_events, "run", max_bytes=128 << 10).select(
                "at",
                F.from_json(
                    "line", "eventID string, eventName string, userIdentity struct<type:string, arn:string>, requestParameters struct<bucketName:string, cidr:string>, truncated boolean"
                ).alias("j"),
                lines.labels_text(F.col("labels")).alias("labels"),
            ).select(
                "at", F.col("j.eventID").alias("event_id"), F.col("j.eventName").alias("event_name"), F.col("j.userIdentity.type").alias("identity_type"),
                F.col("j.userIdentity.arn").alias("arn"), F.col("j.requestParameters.bucketName").alias("bucket"), F.col("j.truncated").alias("truncated"), "labels",
            ),
            "SELECT event_time AS at, event_id, event_name, identity_type, arn, json_extract_string(request_parameters, '$.bucketName') AS bucket, CAST(NULL AS BOOLEAN) AS truncated, "
            "'account=' || recipient_account_id || ',job=logloom,kind=event,region=' || aws_region || ',subcommand=cloudtrail' AS labels FROM audit_events",
        ),
        "snk_13_audit": Query(
            lambda t: metrics.audit_gauges(t.audit_events, _capped(t), rules.audit_findings(t.audit_events)).select(
                "name", "type", lines.labels_text(F.col("labels")).alias("labels"), "value"
            ),
            f"SELECT 'logloom_findings' AS name, 'gauge' AS type, 'severity=' || lower(severity) AS labels, CAST(n AS DOUBLE) AS value FROM ({q.severity_counts(CAPPED)}) "
            f"UNION ALL SELECT 'logloom_findings_dropped', 'gauge', '', (SELECT count(*) FROM ({ALL_SQL})) - (SELECT count(*) FROM ({CAPPED})) "
            f"UNION ALL SELECT 'logloom_cloudtrail_write_events', 'gauge', '', count(*) FROM audit_events WHERE {WRITE} "
            "UNION ALL SELECT 'logloom_cloudtrail_error_events', 'gauge', '', count(error_code) FROM audit_events",
        ),
    }
    return out
