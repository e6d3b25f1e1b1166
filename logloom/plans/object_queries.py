"""Object-access queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators import counters as c
from logloom.operators import filters, health, lines, metrics, objects, reports, rules
from logloom.plans import sqlparts as q
from logloom.plans.registry import Query

DENIED, DELETES, EGRESS = 10, 5, 1 << 20
O = "object_requests"
WHO = "coalesce(requester, 'anonymous')"
OKAY = "status BETWEEN 200 AND 299"
IS_DENIED = "(status = 403 OR coalesce(error_code = 'AccessDenied', false))"
WRITES = (
    "operation IN ('REST.PUT.OBJECT', 'REST.POST.OBJECT', 'REST.COPY.OBJECT', 'REST.POST.UPLOADS', 'REST.PUT.PART', 'REST.COPY.PART', 'REST.POST.UPLOAD')"
)
DELETE = "operation IN ('REST.DELETE.OBJECT', 'BATCH.DELETE.OBJECT')"
MULTI = "operation = 'REST.POST.MULTI_OBJECT_DELETE'"
READS = "operation IN ('REST.GET.OBJECT', 'REST.HEAD.OBJECT', 'REST.GET.BUCKET', 'REST.GET.BUCKETVERSIONS', 'REST.COPY.OBJECT_GET')"
CHANGES = (
    "operation IN ('REST.PUT.BUCKETPOLICY', 'REST.DELETE.BUCKETPOLICY', 'REST.PUT.ACL', 'REST.PUT.PUBLIC_ACCESS_BLOCK', 'REST.DELETE.PUBLIC_ACCESS_BLOCK')"
)
ANON_WRITE = f"{OKAY} AND requester IS NULL AND ({WRITES} OR {DELETE} OR {MULTI})"
ANON_READ = f"{OKAY} AND requester IS NULL AND {READS}"
WEAK = "tls_version IN ('TLSv1', 'TLSv1.0', 'TLSv1.1')"
FIRST = "(SELECT min(ts) FROM object_requests)"
CLASS = "CASE WHEN status BETWEEN 200 AND 599 THEN (status // 100) || 'xx' ELSE 'other' END"

DIMS = {
    "operation": ("operation", "TRUE"), "status": ("status", "status > 0"), "error_code": ("error_code", "TRUE"), "bucket": ("bucket", "TRUE"),
    "tls": ("tls_version", "TRUE"), "auth_type": ("auth_type", "TRUE"), "sig_version": ("sig_version", "TRUE"), "principal": (WHO, "TRUE"),
    "remote_ip": ("remote_ip", "TRUE"), "key": ("bucket || '/' || key", "TRUE"), "user_agent": ("user_agent", "TRUE"),
    "bytes_by_ip": ("remote_ip", "TRUE", "bytes_sent"), "bytes_by_requester": ("requester", "TRUE", "bytes_sent"),
    "denied_by_ip": ("remote_ip", IS_DENIED), "denied_by_requester": ("requester", f"{IS_DENIED} AND requester IS NOT NULL"),
    "deletes_by_principal": (WHO, f"{OKAY} AND {DELETE}"), "weak_tls": (WHO, WEAK), "plain_http": (WHO, "plain_http"), "sigv2": (WHO, "sig_version = 'SigV2'"),
}
TOTALS = (
    "SELECT count(*) AS requests, CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent, count(*) FILTER (status >= 400 OR error_code IS NOT NULL) AS errors, "
    f"count(*) FILTER (requester IS NULL) AS anonymous, count(*) FILTER ({IS_DENIED}) AS denied, min(ts) AS first, max(ts) AS last FROM object_requests"
)


def _top3(where: str, col: str) -> str:
    return (
        f"SELECT bucket, string_agg(k || ' (' || n || ')', ', ' ORDER BY n DESC, k) FILTER (place <= 3) AS top FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, k) AS place FROM "
        f"(SELECT bucket, {col} AS k, count(*) AS n FROM object_requests WHERE {where} AND {col} IS NOT NULL GROUP BY 1, 2)) GROUP BY 1"
    )


def _anonymous(rule: str, severity: str, title: str, phrase: str, where: str) -> str:
    return q.finding(
        rule, severity, title, "a.bucket",
        f"n || '{phrase}' || coalesce(o.top, '-') || ') from ' || coalesce(i.top, '-') || '; keys ' || coalesce(k.top, '-')", "first", "n",
        f"FROM (SELECT bucket, count(*) AS n, min(ts) AS first FROM object_requests WHERE {where} GROUP BY 1) a LEFT JOIN ({_top3(where, 'operation')}) o USING (bucket) "
        f"LEFT JOIN ({_top3(where, 'remote_ip')}) i USING (bucket) LEFT JOIN ({_top3(where, 'key')}) k USING (bucket)",
    )


def _simple(rule: str, severity: str, title: str, dim: str, detail: str, having: str = "TRUE") -> str:
    return q.finding(rule, severity, title, "key", detail, FIRST, "n", f"FROM ({q.counter(O, *DIMS[dim])}) WHERE {having}")


RULES = {
    "s3-anonymous-write": _anonymous(
        "s3-anonymous-write", "CRITICAL", "Anonymous write or delete succeeded", " anonymous write or delete requests succeeded (", ANON_WRITE
    ),
    "s3-anonymous-read": _anonymous("s3-anonymous-read", "HIGH", "Anonymous read succeeded", " anonymous reads succeeded (", ANON_READ),
    "s3-access-denied-burst": " UNION ALL ".join(
        _simple("s3-access-denied-burst", "HIGH", "Burst of denied requests", dim, f"n || ' denied requests (403 or AccessDenied) from this {who}'", f"n >= {DENIED}")
        for dim, who in (("denied_by_ip", "IP"), ("denied_by_requester", "requester"))
    ),
    "s3-mass-delete": _simple("s3-mass-delete", "HIGH", "Mass object deletion", "deletes_by_principal", "n || ' objects deleted'", f"n >= {DELETES}"),
    "s3-access-change": q.finding(
        "s3-access-change", "MEDIUM", "Bucket access configuration changed", WHO,
        "operation || ' on ' || bucket || coalesce('/' || key, '') || ' from ' || remote_ip", "ts", "1",
        f"FROM (SELECT * FROM object_requests WHERE {OKAY} AND {CHANGES} ORDER BY ts, bucket, operation, key NULLS FIRST, {WHO}, remote_ip)",
    ),
    "s3-large-egress": " UNION ALL ".join(
        _simple("s3-large-egress", "MEDIUM", "Large data egress", dim, f"printf('%.1f GiB', n / 1073741824.0) || ' sent to this {who}'", f"n >= {EGRESS}")
        for dim, who in (("bytes_by_requester", "requester"), ("bytes_by_ip", "IP"))
    ),
    "s3-weak-tls": _simple("s3-weak-tls", "LOW", "TLS below 1.2", "weak_tls", "n || ' requests used TLS below 1.2'"),
    "s3-plain-http": _simple("s3-plain-http", "LOW", "Requests over plain HTTP", "plain_http", "n || ' REST requests used plain HTTP'"),
    "s3-sigv2": _simple("s3-sigv2", "LOW", "Signature Version 2 requests", "sigv2", "n || ' requests were signed with Signature Version 2'"),
}
ALL_SQL = " UNION ALL ".join(RULES.values())
LIMITS = {"denied_threshold": DENIED, "delete_threshold": DELETES, "egress_bytes": EGRESS}


def findings(t):
    return rules.object_findings(t.object_requests, **LIMITS)


def _operation_classes(t):
    op = F.col("operation")
    return t.object_requests.groupBy(
        "operation", d.object_write(op).alias("w"), d.object_delete(op).alias("x"), d.object_multi_delete(op).alias("m"),
        d.object_read(op).alias("r"), d.object_access_change(op).alias("c"),
    ).count()


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}

    def one(dim):
        return lambda t: c.counter(t.object_requests, objects.dims()[dim])

    names = {
        "agg_ob_02": "operation", "agg_ob_03": "status", "agg_ob_04": "error_code", "agg_ob_05": "bucket", "agg_ob_06": "tls",
        "agg_ob_07": "auth_type", "agg_ob_08": "sig_version", "agg_ob_09": "principal", "agg_ob_10": "remote_ip", "agg_ob_11": "key",
        "agg_ob_12": "user_agent", "agg_ob_13_ip": "bytes_by_ip", "agg_ob_13_requester": "bytes_by_requester", "agg_ob_14_ip": "denied_by_ip",
        "agg_ob_14_requester": "denied_by_requester", "agg_ob_15": "deletes_by_principal", "agg_ob_19_weak_tls": "weak_tls",
        "agg_ob_19_plain_http": "plain_http", "agg_ob_19_sigv2": "sigv2",
    }
    for name, dim in names.items():
        out[name] = Query(one(dim), q.counter(O, *DIMS[dim]))
    for i, rule in enumerate(RULES, 1):
        out[f"rul_ob_0{i}"] = Query(
            lambda t, r=rule: rules.object_findings(t.object_requests, **LIMITS, rules=[r]), RULES[rule]
        )

    out |= {
        "agg_ob_01": Query(lambda t: objects.totals(t.object_requests), TOTALS),
        "agg_ob_counters": Query(lambda t: objects.counters(t.object_requests), q.counters(O, DIMS)),
        "agg_ob_16": Query(
            lambda t: objects.anonymous(t.object_requests, objects.anon_write()),
            f"SELECT bucket, count(*) AS n, min(ts) AS first FROM object_requests WHERE {ANON_WRITE} GROUP BY 1",
        ),
        "agg_ob_17": Query(
            lambda t: objects.anonymous(t.object_requests, objects.anon_read()),
            f"SELECT bucket, count(*) AS n, min(ts) AS first FROM object_requests WHERE {ANON_READ} GROUP BY 1",
        ),
        "agg_ob_18": Query(
            lambda t: objects.access_changes(t.object_requests, 20),
            f"SELECT ts, bucket, operation, key, {WHO} AS principal, remote_ip FROM object_requests WHERE {OKAY} AND {CHANGES} "
            "ORDER BY ts, bucket, operation, key NULLS FIRST, principal, remote_ip LIMIT 20",
        ),
        "agg_ob_20": Query(
            lambda t: objects.hour_by_class(t.object_requests),
            f"SELECT date_trunc('hour', ts) AS hour, {CLASS} AS status_class, count(*) AS n FROM object_requests GROUP BY 1, 2",
        ),
        "agg_ob_21_buckets": Query(lambda t: objects.distinct_buckets(t.object_requests), "SELECT count(DISTINCT bucket) AS buckets FROM object_requests"),
        "agg_ob_21_requesters": Query(
            lambda t: objects.distinct_requesters(t.object_requests), f"SELECT count(DISTINCT {WHO}) AS requesters FROM object_requests"
        ),
        "prj_17": Query(
            lambda t: t.object_requests.groupBy("status", d.object_status_class(objects.status()).alias("status_class")).count(),
            f"SELECT status, {CLASS} AS status_class, count(*) AS count FROM object_requests GROUP BY 1, 2",
        ),
        "prj_30_31": Query(
            lambda t: t.object_requests.groupBy(
                objects.principal().alias("principal"), objects.success().alias("success"),
                d.object_error(objects.status(), F.col("error_code")).alias("is_error"), objects.denied().alias("denied"),
            ).count(),
            f"SELECT {WHO} AS principal, {OKAY} AS success, status >= 400 OR error_code IS NOT NULL AS is_error, {IS_DENIED} AS denied, count(*) AS count FROM object_requests GROUP BY 1, 2, 3, 4",
        ),
        "prj_32": Query(
            _operation_classes,
            f"SELECT operation, {WRITES} AS w, {DELETE} AS x, {MULTI} AS m, {READS} AS r, {CHANGES} AS c, count(*) AS count FROM object_requests GROUP BY ALL",
        ),
        "prj_33_34": Query(
            lambda t: t.object_requests.groupBy(
                d.tls_version(F.upper("tls_version")).alias("tls"), d.object_weak_tls(F.col("tls_version")).alias("weak"),
                d.object_sigv2(F.col("sig_version")).alias("sigv2"),
                d.plain_http(F.coalesce("tls_version", F.lit("-")), F.col("operation")).alias("plain"), "plain_http",
            ).count(),
            f"SELECT replace(upper(tls_version), 'TLSV', 'TLSv') AS tls, coalesce({WEAK}, false) AS weak, sig_version = 'SigV2' AS sigv2, "
            "tls_version IS NULL AND operation LIKE 'REST.%' AS plain, plain_http, count(*) AS count FROM object_requests GROUP BY 1, 2, 3, 4, 5",
        ),
        "flt_15_16": Query(
            lambda t: filters.ObjectFilter(
                operations=["put", " delete ", ""], buckets=["BKT-1", "bkt-3"], requester="Anonymous", client_ip="192.0", key_prefix="k/1", statuses=["2xx", "500"]
            ).apply(t.object_requests).groupBy("operation", "bucket", "status").count(),
            "SELECT operation, bucket, status, count(*) AS count FROM object_requests WHERE (contains(lower(operation), 'put') OR contains(lower(operation), 'delete')) "
            f"AND (contains(bucket, 'bkt-1') OR contains(bucket, 'bkt-3')) AND contains({WHO}, 'anonymous') AND contains(remote_ip, '192.0') AND key LIKE 'k/1%' AND ({OKAY} OR status = 500) GROUP BY 1, 2, 3",
        ),
        "flt_15_errors": Query(
            lambda t: filters.ObjectFilter(errors_only=True, statuses=["other", "4xx"]).apply(t.object_requests).groupBy("status").count(),
            f"SELECT status, count(*) AS count FROM object_requests WHERE (status >= 400 OR error_code IS NOT NULL) AND {CLASS} IN ('other', '4xx') GROUP BY 1",
        ),
        "rul_ob_all": Query(findings, ALL_SQL),
        "rnk_06_objects": Query(lambda t: rules.cap_aggregate(findings(t), 20), q.capped(ALL_SQL, 20)),
        "rnk_11_objects": Query(
            lambda t: reports.object_tables(t.object_requests),
            q.tables(q.counters(O, DIMS), reports.OBJECT_TABLES, "requests", {"bytes_by_ip", "bytes_by_requester"}, 10, q.VALUE_TONE),
        ),
        "hlt_06_objects": Query(
            lambda t: health.object_summary(t.object_requests),
            "UNPIVOT (SELECT CAST(requests AS VARCHAR) AS requests, CAST(errors AS VARCHAR) AS errors, CAST(denied AS VARCHAR) AS denied, CAST(anonymous AS VARCHAR) AS anonymous, "
            f"CAST(bytes_sent AS VARCHAR) AS bytes_sent FROM ({TOTALS})) ON COLUMNS(*) INTO NAME metric VALUE value",
        ),
        "hlt_07_objects": Query(
            lambda t: health.object_matches(t.object_requests, 100),
            f"SELECT ts, bucket, operation, key, status, error_code, {WHO} AS requester, remote_ip, bytes_sent, tls_version, user_agent FROM object_requests "
            "ORDER BY ts, bucket, operation, key NULLS FIRST, status, error_code NULLS FIRST, requester, remote_ip, bytes_sent LIMIT 100",
        ),
        "snk_05": Query(
            lambda t: lines.object_lines(t.object_requests, "run").select(
                "at", F.from_json("line", "bucket string, requester string, operation string, key string, status int, bytes_sent bigint, plain_http boolean").alias("j"),
                lines.labels_text(F.col("labels")).alias("labels"),
            ).select("at", "j.*", "labels"),
            f"SELECT ts AS at, bucket, {WHO} AS requester, operation, key, nullif(status, 0) AS status, bytes_sent, CASE WHEN plain_http THEN true END AS plain_http, "
            f"'bucket=' || bucket || ',job=logloom,kind=request,status_class=' || {CLASS} || ',subcommand=s3' AS labels FROM object_requests",
        ),
        "snk_13_objects": Query(
            lambda t: metrics.object_gauges(t.object_requests, rules.cap_aggregate(findings(t), 500)).select(
                "name", "type", lines.labels_text(F.col("labels")).alias("labels"), "value"
            ),
            "SELECT 'logloom_s3_requests' AS name, 'gauge' AS type, 'status_class=' || s.c AS labels, CAST(count(r.bucket) AS DOUBLE) AS value FROM (VALUES ('2xx'), ('3xx'), ('4xx'), ('5xx'), ('other')) s(c) "
            f"LEFT JOIN (SELECT bucket, {CLASS} AS k FROM object_requests) r ON r.k = s.c GROUP BY s.c "
            "UNION ALL SELECT 'logloom_s3_bytes_sent', 'gauge', '', sum(bytes_sent) FROM object_requests "
            f"UNION ALL SELECT 'logloom_s3_findings', 'gauge', 'severity=' || lower(severity), n FROM ({q.severity_counts(q.capped(ALL_SQL, 500))})",
        ),
    }
    return out
