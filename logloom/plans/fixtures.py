"""Log tables derived from the given tables.

Every record comes from one source row by expressions that Spark and DuckDB
both understand, so a query and its SQL twin see the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.schema import conform

DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "flows": ("lineitem", {
        "src_addr": "CASE WHEN l_suppkey % 4 = 0 THEN '10.0.1.' || (l_suppkey % 100 + 1) ELSE '198.51.100.' || (l_suppkey % 100 + 1) END",
        "dst_addr": "CASE WHEN l_partkey % 5 = 0 THEN '203.0.113.' || (l_partkey % 100 + 1) ELSE '10.0.' || (l_partkey % 4) || '.' || (l_partkey % 200 + 1) END",
        "src_port": "CAST(1024 + (l_orderkey * 7) % 60000 AS INT)",
        "dst_port": "CAST(CASE l_partkey % 10 WHEN 0 THEN 22 WHEN 1 THEN 3306 WHEN 2 THEN 23 WHEN 3 THEN 443 ELSE (l_orderkey * l_linenumber) % 1000 END AS INT)",
        "protocol": "CASE WHEN l_linenumber = 7 THEN 17 WHEN l_linenumber = 6 AND l_partkey % 2 = 0 THEN 1 ELSE 6 END",
        "packets": "CAST(floor(l_quantity) AS BIGINT)",
        "bytes": "CAST(floor(l_extendedprice) AS BIGINT)",
        "start": "l_shipdate",
        "action": "CASE WHEN l_returnflag = 'R' THEN 'REJECT' ELSE 'ACCEPT' END",
        "log_status": "CASE WHEN l_orderkey % 500 = 0 THEN 'NODATA' WHEN l_orderkey % 500 = 1 THEN 'SKIPDATA' ELSE 'OK' END",
        "tcp_flags": "CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 2 ELSE 18 END",
        "interface_id": "'eni-' || (l_suppkey % 16)",
        "vpc_id": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 'vpc-' || (l_suppkey % 3) END",
        "pkt_src_addr": "CASE WHEN l_orderkey % 17 = 0 THEN '192.0.2.' || (l_suppkey % 50 + 1) ELSE NULL END",
        "flow_direction": "CASE l_linenumber % 3 WHEN 0 THEN 'egress' WHEN 1 THEN 'ingress' ELSE NULL END",
    }),
    "lb_requests": ("events", {
        "ts": "ts",
        "kind": "CASE user_id % 5 WHEN 0 THEN 'nlb' WHEN 1 THEN 'classic' ELSE 'alb' END",
        "type": "CASE user_id % 5 WHEN 0 THEN 'tls' WHEN 1 THEN 'http' ELSE 'https' END",
        "lb": "'app/web-' || (user_id % 3) || '/abc'",
        "client_ip": "'203.0.113.' || (user_id % 200 + 1)",
        "target": "CASE WHEN event_type = 'signup' THEN NULL ELSE '10.0.20.' || (user_id % 7 + 1) || ':80' END",
        "request_time": "CASE WHEN event_type = 'signup' THEN NULL ELSE 0.001e0 END",
        "target_time": "CASE WHEN event_type = 'signup' OR (event_type = 'error' AND event_id % 3 = 0) THEN NULL ELSE value / 100 END",
        "response_time": "CASE WHEN event_type = 'signup' THEN NULL ELSE 0.0e0 END",
        "elb_status": "CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN '502' WHEN 1 THEN '500' ELSE '404' END WHEN event_type = 'signup' THEN '301' ELSE '200' END",
        "target_status": "CASE WHEN event_type = 'signup' OR (event_type = 'error' AND event_id % 3 = 0) THEN NULL WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 1 THEN '500' ELSE '404' END ELSE '200' END",
        "received_bytes": "CAST(floor(value * 10) AS BIGINT)",
        "sent_bytes": "CAST(floor(value * 1000) AS BIGINT)",
        "method": "CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END",
        "host": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'h' || (user_id % 4) || '.example.com' END",
        "domain_name": "'sni' || (user_id % 2) || '.example.com'",
        "path": "'/tiles/' || (event_id % 20) || '/a' || (user_id % 3) || '/' || (user_id % 10) || '.pbf'",
        "user_agent": "CASE user_id % 3 WHEN 0 THEN 'curl/8' WHEN 1 THEN NULL ELSE 'Mozilla/5.0' END",
        "ssl_protocol": "CASE user_id % 6 WHEN 0 THEN 'TLSv1' WHEN 1 THEN NULL WHEN 2 THEN 'TLSv1.2' ELSE 'TLSv1.3' END",
        "ssl_cipher": "CASE user_id % 6 WHEN 1 THEN NULL WHEN 0 THEN 'AES128-SHA' ELSE 'ECDHE-RSA-AES128-GCM-SHA256' END",
        "target_group_arn": "CASE WHEN event_type = 'signup' THEN NULL ELSE 'arn:aws:elasticloadbalancing:us-east-1:1:targetgroup/tg' || (user_id % 4) || '/x' END",
        "error_reason": "CASE WHEN event_type = 'error' AND event_id % 3 = 1 AND user_id % 2 = 0 THEN 'TargetConnectionError' ELSE NULL END",
        "actions": "CASE event_type WHEN 'signup' THEN 'redirect' ELSE 'forward' END",
    }),
    "lb_connections": ("events", {
        "ts": "ts",
        "lb": "'app/web-' || (user_id % 3) || '/abc'",
        "client_ip": "'203.0.113.' || (user_id % 200 + 1)",
        "listener": "CASE WHEN user_id % 4 = 0 THEN '80' ELSE '443' END",
        "ssl_protocol": "CASE WHEN user_id % 4 = 0 OR event_type = 'error' THEN NULL WHEN user_id % 6 = 1 THEN 'TLSv1.1' ELSE 'TLSv1.3' END",
        "ssl_cipher": "CASE WHEN user_id % 4 = 0 OR event_type = 'error' THEN NULL ELSE 'cipher-' || (user_id % 3) END",
        "tls_handshake_time": "CASE WHEN user_id % 4 = 0 OR event_type = 'error' THEN NULL ELSE value / 1000 END",
        "tls_key_exchange": "CASE WHEN user_id % 4 = 0 OR event_type = 'error' THEN NULL ELSE 'secp256r1' END",
        "tls_verify_status": "CASE WHEN user_id % 9 = 0 THEN 'Failed:ClientCertExpired' WHEN user_id % 9 = 1 THEN 'Success' ELSE NULL END",
    }),
    "waf_requests": ("events", {
        "ts": "ts",
        "web_acl": "'acl-' || (user_id % 2)",
        "action": "CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'CAPTCHA' ELSE 'CHALLENGE' END ELSE CASE WHEN user_id % 10 = 3 THEN 'BLOCK' ELSE 'ALLOW' END END",
        "rule": "CASE event_type WHEN 'error' THEN 'AWSManagedRulesSQLiRuleSet/SQLi_BODY' WHEN 'signup' THEN 'bot-captcha' ELSE 'Default_Action' END",
        "rule_group": "CASE event_type WHEN 'error' THEN 'AWSManagedRulesSQLiRuleSet' ELSE NULL END",
        "source": "CASE user_id % 3 WHEN 0 THEN 'ALB' WHEN 1 THEN 'CF' ELSE NULL END",
        "client_ip": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE '198.51.100.' || user_id END",
        "country": "CASE user_id % 4 WHEN 0 THEN 'NL' WHEN 1 THEN 'US' WHEN 2 THEN 'BR' ELSE NULL END",
        "host": "'h' || (user_id % 4) || '.example.com'",
        "uri": "'/item/' || (event_id % 30)",
        "method": "CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END",
        "user_agent": "CASE user_id % 3 WHEN 0 THEN 'curl/8' WHEN 1 THEN NULL ELSE 'Mozilla/5.0' END",
        "ja4": "CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'ja4-' || (user_id % 7) END",
        "labels": "split(CASE WHEN user_id % 8 = 0 THEN 'awswaf:managed:aws:core-rule-set:X,custom:l' || (event_id % 3) ELSE 'custom:l' || (event_id % 3) END, ',')",
        "count_rules_csv": "CASE WHEN event_id % 6 = 0 THEN 'AWSManagedRulesCommonRuleSet/SizeRestrictions_BODY,geo-watch' WHEN event_id % 6 = 1 THEN 'geo-watch' ELSE '' END",
        "rate_rule": "CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'rate-' || (user_id % 2) ELSE NULL END",
        "response_code": "CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 405 ELSE 0 END",
        "oversize": "event_id % 50 = 0",
        "challenge_failed": "event_type = 'signup' AND user_id % 3 = 0",
    }),
    "object_requests": ("orders", {
        "ts": "o_orderdate",
        "bucket": "'bkt-' || (o_custkey % 5)",
        "remote_ip": "'192.0.2.' || (o_custkey % 120 + 1)",
        "requester": "CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 'arn:aws:iam::1:user/u' || (o_custkey % 40) END",
        "operation": "CASE o_orderpriority WHEN '1-URGENT' THEN 'REST.PUT.OBJECT' WHEN '2-HIGH' THEN 'BATCH.DELETE.OBJECT' WHEN '3-MEDIUM' THEN 'REST.GET.OBJECT' WHEN '5-LOW' THEN 'REST.HEAD.OBJECT' ELSE CASE WHEN o_orderkey % 20 = 0 THEN 'REST.PUT.BUCKETPOLICY' WHEN o_orderkey % 20 = 1 THEN 'REST.POST.MULTI_OBJECT_DELETE' ELSE 'WEBSITE.GET.OBJECT' END END",
        "key": "CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE 'k/' || (o_orderkey % 300) END",
        "status": "CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 403 ELSE CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 7 = 1 THEN 500 ELSE 204 END END",
        "error_code": "CASE WHEN o_orderstatus = 'O' THEN 'AccessDenied' ELSE NULL END",
        "bytes_sent": "CASE WHEN o_orderkey % 9 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) END",
        "tls_version": "CASE o_custkey % 7 WHEN 0 THEN 'TLSv1.1' WHEN 1 THEN NULL ELSE 'TLSv1.2' END",
        "plain_http": "o_custkey % 7 = 1 AND o_orderpriority <> '4-NOT SPECIFIED'",
        "sig_version": "CASE WHEN o_custkey % 11 = 0 THEN 'SigV2' ELSE 'SigV4' END",
        "auth_type": "CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 'AuthHeader' END",
        "user_agent": "'ua-' || (o_custkey % 9)",
    }),
    "audit_events": ("orders", {
        "event_time": "o_orderdate",
        "event_id": "'e-' || o_orderkey",
        "event_source": "CASE o_orderkey % 7 WHEN 0 THEN 'iam' WHEN 1 THEN 's3' WHEN 2 THEN 'ec2' WHEN 3 THEN 'kms' WHEN 4 THEN 'cloudtrail' ELSE 'signin' END || '.amazonaws.com'",
        "event_name": "CASE o_orderkey % 7 WHEN 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'CreateAccessKey' ELSE 'ListUsers' END WHEN 1 THEN 'PutBucketPolicy' WHEN 2 THEN 'AuthorizeSecurityGroupIngress' WHEN 3 THEN 'DisableKey' WHEN 4 THEN CASE WHEN o_custkey % 9 = 0 THEN 'StopLogging' ELSE 'DescribeTrails' END ELSE 'ConsoleLogin' END",
        "read_only": "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 4 = 1 END",
        "identity_type": "CASE WHEN o_custkey % 50 = 0 THEN 'Root' ELSE 'IAMUser' END",
        "invoked_by": "CASE WHEN o_custkey % 100 = 0 THEN 'support.amazonaws.com' ELSE NULL END",
        "arn": "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 'arn:aws:iam::1:user/u' || (o_custkey % 60) END",
        "user_name": "CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE 'u' || (o_custkey % 60) END",
        "source_ip": "'203.0.113.' || (o_custkey % 90)",
        "user_agent": "'agent-' || (o_custkey % 12)",
        "recipient_account_id": "CAST(111122223333 + o_custkey % 3 AS STRING)",
        "aws_region": "CASE o_custkey % 2 WHEN 0 THEN 'us-east-1' ELSE 'eu-central-1' END",
        "error_code": "CASE o_orderpriority WHEN '1-URGENT' THEN 'AccessDenied' WHEN '5-LOW' THEN 'ThrottlingException' ELSE NULL END",
        "resource_arn": "CASE WHEN o_orderkey % 7 = 1 THEN 'arn:aws:s3:::b' || (o_custkey % 5) ELSE NULL END",
        "request_parameters": "'{\"bucketName\":\"b' || (o_custkey % 5) || '\",\"cidr\":\"' || CASE WHEN o_custkey % 3 = 0 THEN '0.0.0.0/0' ELSE '10.0.0.0/8' END || '\"}'",
        "response_elements": "'{\"ConsoleLogin\":\"' || CASE WHEN o_custkey % 2 = 0 THEN 'Success' ELSE 'Failure' END || '\"}'",
        "additional_event_data": "'{\"MFAUsed\":\"' || CASE WHEN o_custkey % 5 = 0 THEN 'No' ELSE 'Yes' END || '\"}'",
    }),
}


def sql_of(table: str) -> str:
    """The derived table as a SELECT over its source table."""
    source, columns = DERIVED[table]
    return "SELECT " + ", ".join(f'{expr} AS "{name}"' for name, expr in columns.items()) + f" FROM {source}"


def with_tables(sql: str) -> str:
    """Prefix a query with the derived tables it names."""
    used = [t for t in DERIVED if t in sql]
    ctes = ", ".join(f"{t} AS ({sql_of(t)})" for t in used)
    if not ctes:
        return sql
    body = sql.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


class Tables:
    """The given tables and the log tables derived from them, in canonical form."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def raw(self, table: str) -> DataFrame:
        source, columns = DERIVED[table]
        return self.read(source).select(*[F.expr(e).alias(n) for n, e in columns.items()])

    @cached_property
    def flows(self) -> DataFrame:
        return conform(self.raw("flows"), "flows")

    @cached_property
    def lb_requests(self) -> DataFrame:
        df = self.raw("lb_requests")
        latency = d.total_latency(F.col("request_time"), F.col("target_time"), F.col("response_time"))
        return conform(df.withColumn("latency", latency), "lb_requests")

    @cached_property
    def lb_connections(self) -> DataFrame:
        return conform(self.raw("lb_connections"), "lb_connections")

    @cached_property
    def waf_requests(self) -> DataFrame:
        names = F.filter(F.split("count_rules_csv", ","), lambda r: r != "")
        return conform(self.raw("waf_requests").withColumn("count_rules", names), "waf_requests")

    @cached_property
    def object_requests(self) -> DataFrame:
        return conform(self.raw("object_requests"), "object_requests")

    @cached_property
    def audit_events(self) -> DataFrame:
        df = self.raw("audit_events")
        text = F.lit(None).cast("string")
        identity = F.struct(
            F.col("identity_type").alias("type"), text.alias("principal_id"), "arn", text.alias("account_id"),
            text.alias("access_key_id"), "user_name", "invoked_by",
            F.lit(None).cast(
                "struct<attributes:struct<mfa_authenticated:string,creation_date:string>,"
                "session_issuer:struct<type:string,arn:string,user_name:string,account_id:string>>"
            ).alias("session_context"),
        )
        resource = F.struct(F.col("resource_arn").alias("arn"), text.alias("account_id"), text.alias("type"))
        resources = F.when(F.col("resource_arn").isNotNull(), F.array(resource))
        return conform(df.withColumn("user_identity", identity).withColumn("resources", resources), "audit_events")
