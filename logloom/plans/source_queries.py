"""Reader queries: derived tables are rendered as raw log text and parsed back."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from logloom.functions import text as x
from logloom.operators.filters import AuditFilter
from logloom.plans import render
from logloom.plans.fixtures import DERIVED
from logloom.plans.registry import Query
from logloom.session import shared_dir
from logloom.sources import audit, flows, lb, lines, objects, scope, waf

def _with_id(t, table: str, key: str, **more: str):
    """A derived table together with the key of its source row."""
    source, columns = DERIVED[table]
    extra = {key: key} | more
    return t.read(source).select(*[F.expr(e).alias(n) for n, e in {**columns, **{f"_{k}": v for k, v in extra.items()}}.items()])


def lb_text(t):
    return render.lb_lines(_with_id(t, "lb_requests", "event_id"), "_event_id")


def flow_folders(t) -> str:
    """All flows as columnar files in Hive-style day folders of their delivery: every seventh comes a day late."""
    delivered = F.expr("CASE WHEN src_port % 7 = 0 THEN start + INTERVAL 1 DAY ELSE start END")
    stored = t.flows.select(
        F.col("src_addr").alias("srcaddr"), F.col("dst_addr").alias("dstaddr"), F.col("src_port").alias("srcport"), F.col("dst_port").alias("dstport"),
        "protocol", "packets", "bytes", F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "action", F.col("log_status").alias("log-status"),
        F.lit("111122223333").alias("aws-account-id"), F.lit(scope.FLOWS).alias("aws-service"), F.lit("us-east-1").alias("aws-region"),
        *[F.date_format(delivered, f).alias(n) for n, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))],
    )
    root = f"{shared_dir(t.spark)}/flows-{uuid.uuid4().hex}"
    folders = ("aws-account-id", "aws-service", "aws-region", "year", "month", "day")
    stored.repartition("year", "month", "day").write.partitionBy(*folders).parquet(f"{root}/AWSLogs")
    return root


def late_flows(t, since: datetime, until: datetime):
    """Flows of a window, from its delivery days and the one after them only, trimmed by record time."""
    root, day = flow_folders(t), scope.Scope(accounts=("111122223333",), regions=("us-east-1",), start=since.date(), end=since.date())
    folders = scope.hive_glob(root, scope.window_scope(day, since, until))
    log = flows.read_flow_tables(t.spark, folders, base_path=f"{root}/AWSLogs", since=since, until=until)
    return log.good.groupBy("src_addr").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("start").alias("first"), F.max("start").alias("last"))


def flat_objects(t, start: date, end: date):
    """Object records of some days in the flat layout: names that start with a prefix and the day."""
    root = f"{shared_dir(t.spark)}/objects-{uuid.uuid4().hex}"
    day = F.to_date(F.regexp_extract("line", r"\[(\d\d/\w{3}/\d{4})", 1), "dd/MMM/yyyy")
    text = object_text(t).select(F.date_format(day, "yyyy-MM-dd-'00'").alias("access"), F.col("line").alias("value"))
    text.repartition("access").write.partitionBy("access").text(root)
    days = scope.flat_glob(root, "access=", scope.Scope(accounts=("111122223333",), regions=("us-east-1",), start=start, end=end))
    return objects.parse_objects(lines.read_lines(t.spark, days)).good.select("ts", "bucket", "key", "operation", "status", "requester", "bytes_sent")


def conn_text(t):
    return render.conn_lines(_with_id(t, "lb_connections", "event_id"), "_event_id")


def waf_text(t):
    df = _with_id(t, "waf_requests", "event_id")
    return render.waf_lines(df.withColumn("count_rules", F.filter(F.split("count_rules_csv", ","), lambda r: r != "")), "_event_id")


def object_text(t):
    return render.object_lines(_with_id(t, "object_requests", "o_orderkey"), "_o_orderkey")


def flow_text(t):
    df = _with_id(t, "flows", "l_orderkey", pos="l_orderkey * 8 + l_linenumber", file="CAST(floor(l_orderkey / 1000) AS BIGINT)")
    return render.flow_rows(df, "_pos", "_file")


def audit_text(t):
    df = t.audit_events.withColumn("_file", F.floor(F.expr("CAST(substring(event_id, 3) AS BIGINT)") / 100).cast("bigint"))
    return render.audit_files(df, "_file")


ALB_COLUMNS = (
    "kind, type, ts, lb, client_ip, client_port, target, request_time, target_time, response_time, latency, elb_status, target_status, "
    "received_bytes, sent_bytes, method, url, protocol, host, path, user_agent, ssl_cipher, ssl_protocol, target_group_arn, trace_id, domain_name, "
    "matched_rule_priority, actions, error_reason, target_list, conn_trace_id"
).split(", ")
_LAT = "round(request_time + target_time + response_time + 1e-9, 6)"
ALB_SQL = (
    f"SELECT kind, type, ts, lb, client_ip, '4321' AS client_port, target, round(request_time, 6) AS request_time, round(target_time, 6) AS target_time, response_time, {_LAT} AS latency, "
    "elb_status, target_status, received_bytes, sent_bytes, method, type || '://' || host || ':443' || path || '?q=1' AS url, 'HTTP/1.1' AS protocol, host, path, user_agent, ssl_cipher, ssl_protocol, "
    "target_group_arn, 'Root=1-a\"b' AS trace_id, domain_name, '0' AS matched_rule_priority, actions, error_reason, target AS target_list, 'TID_1' AS conn_trace_id FROM lb_requests WHERE kind = 'alb'"
)
CLASSIC_COLUMNS = "kind type ts lb client_ip target target_time latency elb_status target_status sent_bytes method host path user_agent ssl_protocol".split()
NLB_COLUMNS = "kind type ts lb listener client_ip target latency tls_handshake_time received_bytes sent_bytes ssl_cipher ssl_protocol domain_name elb_status".split()

WAF_BAD = f"event_id % 100 IN ({render.NOT_JSON}, {render.NO_ACTION})"

FLOW_FILE = "CAST(floor(l_orderkey / 1000) AS BIGINT)"
FLOW_POS = "(l_orderkey * 8 + l_linenumber)"


def _keyed(table: str, key: str) -> str:
    """A derived table with its source key, as SQL."""
    source, columns = DERIVED[table]
    return "(SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + f", {key} FROM {source})"


WAF_ROWS = _keyed("waf_requests", "event_id")
OBJECT_ROWS = _keyed("object_requests", "o_orderkey")
AUDIT_ROWS = _keyed("audit_events", "CAST(floor(o_orderkey / 100) AS BIGINT) AS file_no")
FLOW_ROWS = _keyed("flows", f"{FLOW_POS} AS pos, {FLOW_FILE} AS file_no")
FLOW_GOOD = f"{FLOW_ROWS} WHERE file_no % 16 <> 0 AND pos % 100 <> 5"
FLOW_SQL = (
    "SELECT '1_vpcflowlogs_us-east-1_fl-' || file_no || '.log.gz' AS file, interface_id, src_addr, dst_addr, src_port, dst_port, protocol, packets, bytes, start, action, log_status, tcp_flags, vpc_id, "
    f"pkt_src_addr, flow_direction, CASE WHEN file_no % 2 = 0 THEN 2 END AS version FROM {FLOW_GOOD}"
)
FLOW_COLUMNS = (
    "file interface_id src_addr dst_addr src_port dst_port protocol packets bytes start action log_status tcp_flags vpc_id pkt_src_addr flow_direction version"
).split()
FLOW_BAD_SQL = (
    "SELECT '1_vpcflowlogs_us-east-1_fl-' || file_no || '.log.gz' AS file, count(*) AS bad, CASE WHEN file_no % 2 = 0 THEN 'bad srcport field' ELSE 'more fields than the header' END AS first_error "
    f"FROM {FLOW_ROWS} WHERE file_no % 16 <> 0 AND pos % 100 = 5 GROUP BY file_no"
)
PATHS = (
    "CASE o_orderkey % 8 WHEN 0 THEN 'a/1_CloudTrail_us-east-1_' || o_orderkey || '.json.gz' WHEN 1 THEN 'a/CloudTrail-Digest/1_CloudTrail_' || o_orderkey || '.json.gz' "
    "WHEN 2 THEN 'b/1_elasticloadbalancing_us-east-1_app.Web-' || o_custkey % 3 || '.0a_x.log.gz' WHEN 3 THEN 'b/conn_log_1_elasticloadbalancing_us-east-1_app.w.0a_x.log.gz' "
    "WHEN 4 THEN 'b/1_elasticloadbalancing_us-east-1_net.edge.0a_x.log' WHEN 5 THEN 'c/2024-01-02-03-04-05-AB' || o_orderkey WHEN 6 THEN 'd/1_vpcflowlogs_us-east-1_fl.log.gz' ELSE 'e/README.txt' END"
)


def _file_flags(t):
    p = F.col("path")
    seg = scope.lb_kind(p)
    return t.read("orders").select(F.expr(PATHS).alias("path")).groupBy("path").count().select(
        "path", "count", scope.is_audit_file(p).alias("is_audit"), scope.is_lb_file(p).alias("is_lb"), seg.alias("kind"),
        scope.lb_name(p).alias("name"), scope.is_conn_file(p).alias("is_conn"), scope.is_waf_file(p).alias("is_gz"),
        scope.is_object_file(p).alias("is_object"), scope.is_flow_file(p).alias("is_flow"),
        scope.lb_file_filter(p, ["WEB-1", "edge"], ["alb", "nlb"]).alias("picked"),
    ).withColumn("picked", F.coalesce("picked", F.lit(False)))


FLAGS_SQL = (
    "SELECT path, count, path LIKE '%\\_CloudTrail\\_%.json.gz' ESCAPE '\\' AND NOT contains(path, '/CloudTrail-Digest/') AS is_audit, contains(path, '_elasticloadbalancing_') AS is_lb, "
    "CASE WHEN contains(path, '_app.') THEN 'alb' WHEN contains(path, '_net.') THEN 'nlb' END AS kind, nullif(regexp_extract(path, '_(app|net)\\.([^.]*)', 2), '') AS name, "
    "contains(path, '/conn_log_') AS is_conn, path LIKE '%.gz' AS is_gz, regexp_matches(path, '2024-01-02-03-04-05-AB') AS is_object, contains(path, '_vpcflowlogs_') AS is_flow, "
    f"contains(path, 'app.Web-1') OR contains(path, 'net.edge') AS picked FROM (SELECT {PATHS} AS path, count(*) AS count FROM orders GROUP BY 1)"
)


def _scope_rows(t):
    """Scope folders of the days that have orders in one month."""
    days = t.read("orders").where("o_orderdate >= '1995-03-01' AND o_orderdate < '1995-03-08'").select(F.to_date("o_orderdate").alias("day")).distinct()
    s = scope.Scope(["111122223333"], ["us-east-1", "eu-central-1"], date(1995, 3, 1), date(1995, 3, 7), base_prefix="/base/")
    paths = t.spark.createDataFrame([(p,) for p in scope.scan_paths("s3://logs", s, scope.AUDIT)], "path string")
    day = F.to_date(F.regexp_extract("path", r"(\d{4}/\d{2}/\d{2})$", 1), "yyyy/MM/dd")
    return paths.withColumn("day", day).join(days, "day").select("path")


def queries() -> dict[str, Query]:
    return {
        "src_01": Query(
            _scope_rows,
            "SELECT 's3://logs/base/AWSLogs/111122223333/CloudTrail/' || r || '/' || strftime(d, '%Y/%m/%d') AS path FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders "
            "WHERE o_orderdate >= '1995-03-01' AND o_orderdate < '1995-03-08'), (VALUES ('us-east-1'), ('eu-central-1')) x(r)",
        ),
        "src_03": Query(
            lambda t: scope.discover(waf_text(t), scope.ACL_LEVEL, ["ACL-1", "zzz"]), "SELECT DISTINCT web_acl AS name FROM waf_requests WHERE contains(web_acl, 'acl-1')"
        ),
        "src_03_buckets": Query(
            lambda t: scope.discover(object_text(t), scope.BUCKET_LEVEL), "SELECT DISTINCT bucket AS name FROM object_requests"
        ),
        "src_05_11": Query(_file_flags, FLAGS_SQL),
        "src_12": Query(
            lambda t: audit.parse_audit(audit_text(t)).good.select(
                "event_time", "event_source", "event_name", "aws_region", "source_ip", "error_code", "event_id", "read_only", "recipient_account_id",
                F.col("user_identity.type").alias("identity_type"), F.col("user_identity.arn").alias("arn"), F.col("user_identity.user_name").alias("user_name"),
                F.col("user_identity.invoked_by").alias("invoked_by"), F.element_at(F.coalesce("resources", F.array(F.struct(F.lit(None).cast("string").alias("arn"), F.lit(None).cast("string").alias("account_id"), F.lit(None).cast("string").alias("type")))), 1)["arn"].alias("resource_arn"),
                "request_parameters", "response_elements", "additional_event_data",
            ),
            "SELECT date_trunc('second', event_time) AS event_time, event_source, event_name, aws_region, source_ip, error_code, event_id, read_only, recipient_account_id, identity_type, arn, user_name, invoked_by, resource_arn, "
            f"request_parameters, response_elements, additional_event_data FROM {AUDIT_ROWS} WHERE file_no % 10 <> 3",
        ),
        "src_23": Query(
            lambda t: audit.parse_audit(audit_text(t)).unreadable,
            "SELECT DISTINCT 'AWSLogs/1/CloudTrail/us-east-1/2024/01/01/1_CloudTrail_us-east-1_' || file_no || '.json.gz' AS file, 'malformed envelope' AS err "
            f"FROM {AUDIT_ROWS} WHERE file_no % 10 = 3",
        ),
        "src_13": Query(lambda t: lb.parse_lb(lb_text(t)).good.where("kind = 'alb'").select(*ALB_COLUMNS), ALB_SQL),
        "src_14": Query(
            lambda t: lb.parse_lb_conns(conn_text(t)).good.select(
                "ts", "lb", "client_ip", "client_port", "listener", "ssl_protocol", "ssl_cipher", "tls_handshake_time", "client_cert_subject", "tls_verify_status", "conn_trace_id", "tls_key_exchange"
            ),
            "SELECT ts, lb, client_ip, '50000' AS client_port, listener, ssl_protocol, ssl_cipher, round(tls_handshake_time, 6) AS tls_handshake_time, CAST(NULL AS VARCHAR) AS client_cert_subject, "
            "tls_verify_status, 'TID_9' AS conn_trace_id, tls_key_exchange FROM lb_connections",
        ),
        "src_15": Query(
            lambda t: lb.parse_lb(lb_text(t)).good.where("kind = 'nlb'").select(*NLB_COLUMNS),
            "SELECT kind, 'tls' AS type, ts, lb, 'listener-1' AS listener, client_ip, target, round(received_bytes / 1000, 6) AS latency, CAST(0.002 AS DOUBLE) AS tls_handshake_time, received_bytes, sent_bytes, ssl_cipher, ssl_protocol, "
            "domain_name, CAST(NULL AS VARCHAR) AS elb_status FROM lb_requests WHERE kind = 'nlb'",
        ),
        "src_16": Query(
            lambda t: lb.parse_lb(lb_text(t)).good.where("kind = 'classic'").select(*CLASSIC_COLUMNS),
            f"SELECT kind, type, ts, lb, client_ip, target, round(target_time, 6) AS target_time, {_LAT} AS latency, elb_status, target_status, sent_bytes, method, host, path, user_agent, ssl_protocol "
            "FROM lb_requests WHERE kind = 'classic'",
        ),
        "src_17": Query(
            lambda t: lb.parse_lb(lb_text(t)).good.groupBy("kind", "type").agg(F.count("*").alias("n"), F.sum("sent_bytes").alias("sent")),
            "SELECT kind, type, count(*) AS n, CAST(sum(sent_bytes) AS BIGINT) AS sent FROM lb_requests GROUP BY 1, 2",
        ),
        "src_18": Query(
            lambda t: waf.parse_waf(waf_text(t)).good.select(
                "ts", "web_acl", "action", "rule", "rule_type", "rule_group", "source", "client_ip", "country", "method", "host", "uri", "user_agent",
                F.array_join("labels", ",").alias("labels"), F.array_join("count_rules", ",").alias("count_rules"), "rate_rule", "response_code", "oversize", "ja4", "challenge_failed",
            ),
            "SELECT date_trunc('millisecond', ts) AS ts, web_acl, action, coalesce(rate_rule, rule) AS rule, CASE WHEN rate_rule IS NOT NULL THEN 'RATE_BASED' WHEN rule_group IS NOT NULL THEN 'MANAGED_RULE_GROUP' ELSE 'REGULAR' END AS rule_type, "
            "CASE WHEN rate_rule IS NULL THEN rule_group END AS rule_group, source, client_ip, country, method, host, uri, user_agent, array_to_string(labels, ',') AS labels, count_rules_csv AS count_rules, rate_rule, "
            f"response_code, oversize, ja4, challenge_failed FROM {WAF_ROWS} WHERE NOT ({WAF_BAD})",
        ),
        "src_22": Query(
            lambda t: waf.parse_waf(waf_text(t)).bad_report(),
            "SELECT 'AWSLogs/1/WAFLogs/us-east-1/' || web_acl || '/2024/01/01/00/00/x.log.gz' AS file, count(*) AS bad, arg_min(CASE WHEN event_id % 100 = 7 THEN 'not a JSON record' ELSE 'missing timestamp or action' END, event_id) AS first_error "
            f"FROM {WAF_ROWS} WHERE {WAF_BAD} GROUP BY web_acl",
        ),
        "src_19": Query(
            lambda t: objects.parse_objects(object_text(t)).good.select(
                "ts", "bucket", "remote_ip", "requester", "operation", "key", "method", "path", "proto", "status", "error_code", "bytes_sent", "total_time_ms", "turnaround_ms", "referer", "user_agent",
                "sig_version", "auth_type", "tls_version", "acl_required", "plain_http",
            ),
            "SELECT date_trunc('second', ts) AS ts, bucket, remote_ip, requester, operation, key, 'GET' AS method, '/' || coalesce(key, '-') AS path, 'HTTP/1.1' AS proto, status, error_code, bytes_sent, 12 AS total_time_ms, CAST(NULL AS BIGINT) AS turnaround_ms, "
            "'https://x.example/p' AS referer, user_agent, sig_version, auth_type, tls_version, true AS acl_required, tls_version IS NULL AND operation LIKE 'REST.%' AS plain_http "
            f"FROM {OBJECT_ROWS} WHERE o_orderkey % 50 <> 3",
        ),
        "src_19_bad": Query(
            lambda t: objects.parse_objects(object_text(t)).bad.groupBy("err").count(),
            f"SELECT 'unterminated field' AS err, count(*) AS count FROM {OBJECT_ROWS} WHERE o_orderkey % 50 = 3",
        ),
        "src_20": Query(lambda t: flows.parse_flow_files(render.flow_files(flow_text(t))).good.select(*FLOW_COLUMNS), FLOW_SQL),
        "jon_01": Query(lambda t: flows.parse_flow_lines(render.flow_lines(flow_text(t))).good.select(*FLOW_COLUMNS), FLOW_SQL),
        "src_20_bad": Query(lambda t: flows.parse_flow_files(render.flow_files(flow_text(t))).bad_report(), FLOW_BAD_SQL),
        "src_20_unreadable": Query(
            lambda t: flows.parse_flow_files(render.flow_files(flow_text(t))).unreadable,
            f"SELECT DISTINCT '1_vpcflowlogs_us-east-1_fl-' || file_no || '.log.gz' AS file, 'header: missing, the first line is a record' AS err FROM {FLOW_ROWS} WHERE file_no % 16 = 0",
        ),
        "src_21": Query(
            lambda t: lines.clean(
                t.read("events").select(
                    F.lit("f").alias("file"), F.col("event_id").alias("pos"),
                    F.expr("CASE event_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN event_type || '\\r' ELSE event_type END").alias("line"),
                )
            ).groupBy("line").count(),
            "SELECT event_type AS line, count(*) AS count FROM events WHERE event_id % 3 <> 0 GROUP BY 1",
        ),
        "src_25": Query(
            lambda t: flows.normalize_columns(
                t.flows.select(
                    F.col("src_addr").alias("srcaddr"), F.concat(F.lit("::ffff:"), "dst_addr").alias("dstaddr"), F.col("dst_port").alias("dstport"), F.col("bytes"),
                    F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), F.lit("us-east-1").alias("aws-region"), F.col("action"), F.col("pkt_src_addr").alias("pkt_srcaddr"),
                )
            ).select("src_addr", "dst_addr", "dst_port", "bytes", "start", "region", "action", "pkt_src_addr"),
            "SELECT src_addr, dst_addr, dst_port, bytes, start, 'us-east-1' AS region, action, pkt_src_addr FROM flows",
        ),
        "src_25_window": Query(
            lambda t: flows.read_flow_tables(t.spark, flow_folders(t), since=datetime(1996, 3, 1, 6), until=datetime(1996, 9, 1)).good.groupBy(
                "account_id", "region", "action", "log_status", "protocol").agg(
                F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("dst_port").alias("port"), F.min("start").alias("first"), F.max("start").alias("last")),
            "SELECT '111122223333' AS account_id, 'us-east-1' AS region, action, log_status, protocol, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, max(dst_port) AS port, "
            "min(start) AS first, max(start) AS last FROM flows WHERE start >= TIMESTAMP '1996-03-01 06:00:00' AND start < TIMESTAMP '1996-09-01' GROUP BY ALL",
        ),
        "src_26": Query(
            lambda t: waf.parse_waf(waf_text(t)).good.select(F.to_json(F.struct("*")).alias("j"))
            .unionByName(objects.parse_objects(object_text(t)).good.select(F.to_json(F.struct("*")).alias("j")))
            .agg(F.count("*").alias("records"), F.count_if(F.contains("j", F.lit("SECRET"))).alias("leaks")),
            f"SELECT (SELECT count(*) FROM {WAF_ROWS} WHERE NOT ({WAF_BAD})) + (SELECT count(*) FROM {OBJECT_ROWS} WHERE o_orderkey % 50 <> 3) AS records, 0 AS leaks FROM events LIMIT 1",
        ),
        "src_28": Query(
            lambda t: lines.scan_stats(lb.parse_lb(lb_text(t)).good, F.col("elb_status") == "200"),
            "SELECT count(DISTINCT kind) AS objects, count(*) AS records_read, count(*) FILTER (elb_status = '200' AND kind <> 'nlb') AS records_matched FROM lb_requests",
        ),
        "jon_03": Query(
            lambda t: lines.unseen(
                flow_text(t).select("file").distinct(), flow_text(t).where("file LIKE '%0.log.gz'").select("file").distinct()
            ),
            f"SELECT DISTINCT '1_vpcflowlogs_us-east-1_fl-' || file_no || '.log.gz' AS file FROM {FLOW_ROWS} WHERE file_no % 10 <> 0",
        ),
        "set_05": Query(
            lambda t: lines.unseen(object_text(t).select("file").distinct(), object_text(t).where("file LIKE '%bkt-1%'").select("file").distinct()),
            "SELECT DISTINCT 'logs/111122223333/us-east-1/' || bucket || '/2024/01/01/2024-01-01-00-00-00-ABCDEF' AS file FROM object_requests WHERE bucket <> 'bkt-1'",
        ),
        "src_02": Query(
            lambda t: AuditFilter(since=datetime(1995, 1, 1, 6), until=datetime(1995, 6, 1)).apply(audit.parse_audit(audit_text(t)).good).select("event_id", "event_time"),
            f"SELECT event_id, date_trunc('second', event_time) AS event_time FROM {AUDIT_ROWS} WHERE file_no % 10 <> 3 AND event_time >= TIMESTAMP '1995-01-01 06:00:00' AND event_time < TIMESTAMP '1995-06-01'",
        ),
        "src_02_delivery": Query(
            lambda t: late_flows(t, datetime(1996, 3, 1, 6), datetime(1996, 4, 20)),
            "SELECT src_addr, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(start) AS first, max(start) AS last FROM flows "
            "WHERE start >= TIMESTAMP '1996-03-01 06:00:00' AND start < TIMESTAMP '1996-04-20' GROUP BY 1",
        ),
        "src_04": Query(
            lambda t: flat_objects(t, date(1995, 2, 1), date(1995, 4, 30)),
            "SELECT date_trunc('second', ts) AS ts, bucket, key, operation, status, requester, bytes_sent "
            f"FROM {OBJECT_ROWS} WHERE o_orderkey % 50 <> 3 AND ts >= TIMESTAMP '1995-02-01' AND ts < TIMESTAMP '1995-05-01'",
        ),
        "prj_21_28": Query(
            lambda t: waf.parse_waf(waf_text(t)).good.groupBy(
                "web_acl", "rule", "rule_group", F.array_join("labels", ",").alias("labels"), F.array_join("count_rules", ",").alias("count_rules"), "rate_rule", "challenge_failed",
                "host", "user_agent",
            ).count(),
            "SELECT web_acl, coalesce(rate_rule, rule) AS rule, CASE WHEN rate_rule IS NULL THEN rule_group END AS rule_group, array_to_string(labels, ',') AS labels, count_rules_csv AS count_rules, rate_rule, "
            f"challenge_failed, host, user_agent, count(*) AS count FROM {WAF_ROWS} WHERE NOT ({WAF_BAD}) GROUP BY ALL",
        ),
        "fnc_01_02": Query(
            lambda t: t.read("events").select(
                "event_id", F.concat(F.lit('a "'), "event_type", F.lit(' \\"q\\" " [x y] '), "props").alias("line")
            ).select("event_id", F.array_join(x.quoted_tokens(F.col("line")), "|").alias("quoted"), F.array_join(x.bracketed_tokens(F.col("line")), "|").alias("bracketed"), x.unterminated(F.col("line")).alias("open")),
            "SELECT event_id, 'a|' || event_type || ' \"q\" |[x|y]|' || replace(props, ' ', '|') AS quoted, 'a|' || event_type || ' \"q\" |x y|' || replace(props, ' ', '|') AS bracketed, false AS open FROM events",
        ),
        "fnc_03": Query(
            lambda t: t.read("part").select("p_partkey", F.size(x.space_tokens(F.concat(F.lit("  "), "p_type", F.lit("   end ")))).alias("n")),
            "SELECT p_partkey, len([w for w in string_split(p_type || ' end', ' ') if w <> '']) AS n FROM part",
        ),
        "fnc_04_05_06": Query(
            lambda t: t.read("events").select(
                "event_id", x.rfc3339(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")).alias("zoned"), x.rfc3339(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("plain"),
                x.rfc3339(F.date_format("ts", "yyyy-MM-dd")).alias("bad"), x.clf_time(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss' -0100'")).alias("clf"),
                x.epoch_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("millis"), x.epoch_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("seconds"),
            ),
            "SELECT event_id, ts - INTERVAL 2 HOUR AS zoned, date_trunc('second', ts) AS plain, CAST(NULL AS TIMESTAMP) AS bad, date_trunc('second', ts) + INTERVAL 1 HOUR AS clf, "
            "date_trunc('millisecond', ts) AS millis, date_trunc('second', ts) AS seconds FROM events",
        ),
        "fnc_07_08": Query(
            lambda t: t.read("events").select(F.expr("CASE event_id % 4 WHEN 0 THEN '-1' WHEN 1 THEN 'x' ELSE CAST(value AS STRING) END").alias("v"), F.expr("CAST(event_id * 97 - 100 AS STRING)").alias("p"), "event_id")
            .select("event_id", x.seconds(F.col("v")).alias("secs"), x.millis(F.col("v")).alias("ms"), x.whole(F.col("p")).alias("n"), x.port(F.col("p")).alias("port")),
            "SELECT event_id, CASE WHEN event_id % 4 > 1 THEN round(value, 6) END AS secs, CASE WHEN event_id % 4 > 1 THEN round(value / 1000, 6) END AS ms, event_id * 97 - 100 AS n, "
            "CASE WHEN event_id * 97 - 100 BETWEEN 0 AND 65535 THEN event_id * 97 - 100 END AS port FROM events",
        ),
    }
