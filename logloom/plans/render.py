"""Derived tables rendered as raw log text, the input of the reader queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_JSON, NO_ACTION = 7, 8


def _dash(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-"))


def _quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), _dash(c), F.lit('"'))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("-1"))


def _stamp(ts: str, zone: str = "Z") -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(zone))


def _line(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


LB_HEAD = "AWSLogs/111122223333/elasticloadbalancing/us-east-1/2024/01/01/111122223333_elasticloadbalancing_us-east-1_"
LB_TAIL = "_20240101T0000Z_192.0.2.1_4k2a9x1b.log.gz"


def lb_lines(df: DataFrame, pos: str) -> DataFrame:
    """Access-log lines of three layouts; the file name tells which."""
    dash = F.lit("-")
    segment = F.when(F.col("kind") == "alb", "app.web.0123").when(F.col("kind") == "nlb", "net.edge.4567").otherwise("old")
    request = F.concat(
        F.lit('"'), "method", F.lit(" "), "type", F.lit("://"), F.col("host"), F.lit(":443"), "path",
        F.lit('?q=1 HTTP/1.1"'),
    )
    client = F.concat("client_ip", F.lit(":4321"))
    durations = [_number("request_time"), _number("target_time"), _number("response_time")]
    sizes = [_dash("received_bytes"), _dash("sent_bytes")]
    status = [_dash("elb_status"), _dash("target_status")]
    alb = _line(
        F.col("type"), _stamp("ts"), F.col("lb"), client, _dash("target"), *durations, *status, *sizes, request,
        _quoted("user_agent"), _dash("ssl_cipher"), _dash("ssl_protocol"), _dash("target_group_arn"), F.lit('"Root=1-a\\"b"'),
        _quoted(F.upper("domain_name")), F.lit('"-"'), F.lit("0"), _stamp("ts"), _quoted("actions"), F.lit('"-"'),
        _quoted("error_reason"), _quoted("target"), _quoted("target_status"), F.lit('"-"'), F.lit('"-"'), F.lit("TID_1"),
        F.lit('"later" field'),
    )
    nlb = _line(
        F.lit("tls 2.0"), _stamp("ts", ""), F.col("lb"), F.lit("listener-1"), client, _dash("target"),
        F.col("received_bytes").cast("string"), F.lit("2"), *sizes, dash, dash, dash, _dash("ssl_cipher"),
        _dash("ssl_protocol"), dash, _dash("domain_name"), dash, dash, dash, _stamp("ts", ""),
    )
    classic = _line(
        _stamp("ts"), F.col("lb"), client, _dash("target"), *durations, *status, *sizes, request, _quoted("user_agent"),
        _dash("ssl_cipher"), _dash("ssl_protocol"),
    )
    line = F.when(F.col("kind") == "alb", alb).when(F.col("kind") == "nlb", nlb).otherwise(classic)
    return df.select(F.concat(F.lit(LB_HEAD), segment, F.lit(LB_TAIL)).alias("file"), F.col(pos).alias("pos"), line.alias("line"))


def conn_lines(df: DataFrame, pos: str) -> DataFrame:
    line = _line(
        _stamp("ts"), F.col("client_ip"), F.lit("50000"), F.col("listener"), _dash("ssl_protocol"), _dash("ssl_cipher"),
        _dash("tls_handshake_time"), F.lit('"-"'), F.lit("-"), F.lit("-"), _dash("tls_verify_status"), F.lit("TID_9"),
        _dash("tls_key_exchange"), F.col("lb"), F.lit("192.0.2.57"),
    )
    name = LB_HEAD.replace("/111122223333_", "/conn_log_111122223333_") + "app.web.0123" + LB_TAIL
    return df.select(F.lit(name).alias("file"), F.col(pos).alias("pos"), line.alias("line"))


def waf_lines(df: DataFrame, pos: str) -> DataFrame:
    """JSON lines; some are broken or lack an action. Cookies and arguments must not survive parsing."""
    rule = "struct<ruleId:string,action:string>"
    group_type = f"struct<ruleGroupId:string,terminatingRule:{rule},nonTerminatingMatchingRules:array<{rule}>,excludedRules:array<struct<ruleId:string>>>"
    rate = F.col("rate_rule").isNotNull()
    grouped = F.col("rule_group").isNotNull() & ~rate
    common = F.array_contains("count_rules", "AWSManagedRulesCommonRuleSet/SizeRestrictions_BODY")

    def group(name: str, terminating: Column, counted: Column) -> Column:
        return F.struct(
            F.lit("AWS#" + name).alias("ruleGroupId"), terminating.cast(rule).alias("terminatingRule"),
            counted.cast(f"array<{rule}>").alias("nonTerminatingMatchingRules"),
            F.lit(None).cast("array<struct<ruleId:string>>").alias("excludedRules"),
        ).cast(group_type)

    def hit(name: str, action: str) -> Column:
        return F.struct(F.lit(name).alias("ruleId"), F.lit(action).alias("action"))

    none = F.lit(None)
    groups = F.array_compact(
        F.array(
            F.when(common, group("AWSManagedRulesCommonRuleSet", none, F.array(hit("SizeRestrictions_BODY", "COUNT")))),
            F.when(grouped, group("AWSManagedRulesSQLiRuleSet", hit("SQLi_BODY", "BLOCK"), none)),
        )
    )
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    action = F.when(F.col(pos) % 100 == NO_ACTION, F.lit(None)).otherwise(F.col("action"))
    doc = F.struct(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("arn:aws:wafv2:us-east-1:1:regional/webacl/"), "web_acl", F.lit("/id")).alias("webaclId"),
        F.when(rate, F.col("rate_rule")).when(grouped, "AWS-AWSManagedRulesSQLiRuleSet").otherwise(F.col("rule")).alias("terminatingRuleId"),
        F.when(rate, "RATE_BASED").when(grouped, "MANAGED_RULE_GROUP").otherwise("REGULAR").alias("terminatingRuleType"),
        action.alias("action"), F.col("source").alias("httpSourceName"), groups.alias("ruleGroupList"),
        F.when(F.array_contains("count_rules", "geo-watch"), F.array(hit("geo-watch", "Count"), hit("soft", "CAPTCHA"))).alias("nonTerminatingMatchingRules"),
        F.col("response_code").alias("responseCodeSent"),
        F.struct(
            F.col("client_ip").alias("clientIp"), "country",
            F.array(header("HOST", F.col("host")), header("User-Agent", F.col("user_agent")), header("Cookie", F.lit("SECRET"))).alias("headers"),
            "uri", F.lit("token=SECRET").alias("args"), F.col("method").alias("httpMethod"),
        ).alias("httpRequest"),
        F.transform("labels", lambda v: F.struct(v.alias("name"))).alias("labels"),
        F.when(F.col("challenge_failed"), F.struct(F.lit(405).alias("responseCode"), F.lit("TOKEN_MISSING").alias("failureReason"))).alias("captchaResponse"),
        F.when(F.col("oversize"), F.array(F.lit("REQUEST_BODY"))).alias("oversizeFields"), F.col("ja4").alias("ja4Fingerprint"),
    )
    line = F.when(F.col(pos) % 100 == NOT_JSON, F.lit("{not json")).otherwise(F.to_json(doc))
    file = F.concat(F.lit("AWSLogs/1/WAFLogs/us-east-1/"), "web_acl", F.lit("/2024/01/01/00/00/x.log.gz"))
    return df.select(file.alias("file"), F.col(pos).alias("pos"), line.alias("line"))


def object_lines(df: DataFrame, pos: str) -> DataFrame:
    """Object-access lines; one in fifty is cut inside its quoted request."""
    tls = F.when(F.col("tls_version").isNull(), "-").otherwise(F.upper("tls_version"))
    uri = F.concat(F.lit('"GET /'), _dash("key"), F.lit('?X-Amz-Signature=SECRET HTTP/1.1"'))
    line = _line(
        F.lit("owner"), F.col("bucket"), F.concat(F.lit("["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000]")),
        F.col("remote_ip"), _dash("requester"), F.lit("REQ1"), F.col("operation"), _dash("key"), uri,
        F.when(F.col("status") == 0, "-").otherwise(F.col("status").cast("string")), _dash("error_code"),
        F.col("bytes_sent").cast("string"), F.lit("-"), F.lit("12"), F.lit("-"), F.lit('"https://x.example/p?s=SECRET"'),
        _quoted("user_agent"), F.lit("-"), F.lit("hostid="), F.col("sig_version"), F.lit("-"), _dash("auth_type"),
        F.lit("b.example"), tls, F.lit("-"), F.lit("Yes"), F.lit('"future field"'),
    )
    cut = F.substring_index(line, " HTTP/1.1", 1)
    name = F.concat(F.lit("logs/111122223333/us-east-1/"), "bucket", F.lit("/2024/01/01/2024-01-01-00-00-00-ABCDEF"))
    return df.select(name.alias("file"), F.col(pos).alias("pos"), F.when(F.col(pos) % 50 == 3, cut).otherwise(line).alias("line"))


FLOW_HEADER = "version interface-id srcaddr dstaddr srcport dstport protocol packets bytes start end action log-status vpc-id tcp-flags pkt-srcaddr flow-direction sublocation-type"
FLOW_HEADER_2 = "${vpc-id} ${bytes} ${packets} ${action} ${log-status} ${start} ${end} ${srcaddr} ${dstaddr} ${srcport} ${dstport} ${protocol} ${tcp-flags} ${pkt-srcaddr} ${interface-id} ${flow-direction}"


def flow_rows(df: DataFrame, pos: str, file_no: str) -> DataFrame:
    """Flow lines of two layouts by file; files divisible by 16 have no header, some lines are damaged."""
    at = F.unix_seconds(F.col("start").cast("timestamp")).cast("string")
    one = _line(
        F.lit("2"), F.col("interface_id"), F.col("src_addr"), F.col("dst_addr"),
        F.when(F.col(pos) % 100 == 5, "70000").otherwise(F.col("src_port").cast("string")), _dash("dst_port"), _dash("protocol"),
        _dash("packets"), _dash("bytes"), at, at, _dash("action"), _dash("log_status"), _dash("vpc_id"), _dash("tcp_flags"),
        _dash("pkt_src_addr"), _dash("flow_direction"), F.lit("-"),
    )
    two = _line(
        _dash("vpc_id"), _dash("bytes"), _dash("packets"), _dash("action"), _dash("log_status"), at, at, F.col("src_addr"),
        F.col("dst_addr"), _dash("src_port"), _dash("dst_port"), _dash("protocol"), _dash("tcp_flags"), _dash("pkt_src_addr"),
        F.col("interface_id"), _dash("flow_direction"), F.when(F.col(pos) % 100 == 5, "extra"),
    )
    even = F.col(file_no) % 2 == 0
    file = F.concat(F.lit("1_vpcflowlogs_us-east-1_fl-"), F.col(file_no).cast("string"), F.lit(".log.gz"))
    header = F.when(F.col(file_no) % 16 == 0, F.lit(None)).when(even, FLOW_HEADER).otherwise(FLOW_HEADER_2)
    return df.select(file.alias("file"), F.col(pos).alias("pos"), header.alias("header"), F.when(even, one).otherwise(two).alias("line"))


def flow_files(rows: DataFrame) -> DataFrame:
    """Whole files of a thousand orders each."""
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    body = F.array_join(F.transform(lines, lambda e: e["line"]), "\r\n")
    return rows.groupBy("file").agg(F.first("header").alias("header"), body.alias("body")).select(
        "file", F.concat_ws("\n", "header", "body").alias("content")
    )


def flow_lines(rows: DataFrame) -> DataFrame:
    """The same files line by line as a scan gives them: a file's lines in one task, header first."""
    heads = rows.where(F.col("header").isNotNull()).select("file", F.lit(-1).cast("bigint").alias("pos"), F.col("header").alias("line"))
    return rows.select("file", "pos", "line").unionByName(heads.distinct()).repartition("file").sortWithinPartitions("file", "pos")


def audit_files(df: DataFrame, file_no: str) -> DataFrame:
    """Envelopes of a hundred orders each; every tenth file is cut short."""
    u = F.col("user_identity")
    record = F.struct(
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.col("event_source").alias("eventSource"),
        F.col("event_name").alias("eventName"), F.col("aws_region").alias("awsRegion"), F.col("source_ip").alias("sourceIPAddress"),
        F.col("error_code").alias("errorCode"), F.col("event_id").alias("eventID"), F.col("read_only").alias("readOnly"),
        F.col("recipient_account_id").alias("recipientAccountId"),
        F.struct(u["type"].alias("type"), u["arn"].alias("arn"), u["user_name"].alias("userName"), u["invoked_by"].alias("invokedBy")).alias("userIdentity"),
        F.transform("resources", lambda r: F.struct(r["arn"].alias("ARN"))).alias("resources"),
        F.try_parse_json("request_parameters").alias("requestParameters"), F.try_parse_json("response_elements").alias("responseElements"),
        F.try_parse_json("additional_event_data").alias("additionalEventData"),
    )
    file = F.concat(F.lit("AWSLogs/1/CloudTrail/us-east-1/2024/01/01/1_CloudTrail_us-east-1_"), F.col(file_no).cast("string"), F.lit(".json.gz"))
    records = df.select(file.alias("file"), F.to_json(record).alias("record"), F.col(file_no).alias("n"))
    joined = F.concat(F.lit('{"Records":['), F.array_join(F.collect_list("record"), ","), F.lit("]}"))
    whole = records.groupBy("file", "n").agg(joined.alias("content"))
    cut = F.expr("substring(content, 1, length(content) - 40)")
    return whole.select("file", F.when(F.col("n") % 10 == 3, cut).otherwise(F.col("content")).alias("content"))
