"""Web-firewall logs: one JSON object per line.

The schema names only what is kept. Headers other than Host and User-Agent,
the query string and any body are never selected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.functions import text as x
from logloom.sources import scope as s
from logloom.sources.lines import Parsed, lines_of, parsed, read_lines, salvage_contents, unreadable_of

_RULE = "struct<ruleId:string, action:string>"
RECORD = f"""
timestamp bigint, webaclId string, terminatingRuleId string, terminatingRuleType string, action string,
httpSourceName string, httpSourceId string,
ruleGroupList array<struct<ruleGroupId:string, terminatingRule:{_RULE},
nonTerminatingMatchingRules:array<{_RULE}>, excludedRules:array<struct<ruleId:string>>>>,
nonTerminatingMatchingRules array<{_RULE}>, responseCodeSent int,
httpRequest struct<clientIp:string, country:string, headers:array<struct<name:string, value:string>>, uri:string,
httpMethod:string, requestId:string>,
labels array<struct<name:string>>,
captchaResponse struct<responseCode:int, failureReason:string>,
challengeResponse struct<responseCode:int, failureReason:string>,
oversizeFields array<string>, ja3Fingerprint string, ja4Fingerprint string, _broken string
"""


def parse_waf(lines: DataFrame) -> Parsed:
    """JSON lines ``(file, pos, line)`` to web-firewall requests."""
    doc = F.from_json("line", RECORD, {"columnNameOfCorruptRecord": "_broken"})
    rows = lines.select("file", "pos", doc.alias("j"))
    rows = rows.withColumn(
        "at", d.terminating_group_index(F.col("j.ruleGroupList"), F.col("j.terminatingRuleType"))
    )
    j, at = F.col("j"), F.col("at")
    groups, request, kind = j["ruleGroupList"], j["httpRequest"], j["terminatingRuleType"]
    record = F.struct(
        x.epoch_millis(j["timestamp"]).alias("ts"),
        d.acl_name(j["webaclId"]).alias("web_acl"),
        x.present(j["action"]).alias("action"),
        d.effective_rule(groups, at, j["terminatingRuleId"]).alias("rule"),
        x.present(kind).alias("rule_type"),
        d.effective_group(groups, at).alias("rule_group"),
        x.present(j["httpSourceName"]).alias("source"),
        x.present(j["httpSourceId"]).alias("source_id"),
        x.present(request["clientIp"]).alias("client_ip"),
        x.present(request["country"]).alias("country"),
        x.present(request["httpMethod"]).alias("method"),
        d.header_value(request["headers"], "host").alias("host"),
        x.present(request["uri"]).alias("uri"),
        d.header_value(request["headers"], "user-agent").alias("user_agent"),
        d.label_names(j["labels"]).alias("labels"),
        d.count_rules(groups, at, j["nonTerminatingMatchingRules"]).alias("count_rules"),
        d.rate_rule(kind, j["terminatingRuleId"]).alias("rate_rule"),
        F.coalesce(j["responseCodeSent"], F.lit(0)).alias("response_code"),
        d.yes(F.size(j["oversizeFields"]) > 0).alias("oversize"),
        x.present(j["ja3Fingerprint"]).alias("ja3"),
        x.present(j["ja4Fingerprint"]).alias("ja4"),
        x.present(request["requestId"]).alias("request_id"),
        d.challenge_failed(j["captchaResponse"], j["challengeResponse"]).alias("challenge_failed"),
    )
    error = F.when(j["_broken"].isNotNull() | j.isNull(), "not a JSON record").when(
        (F.coalesce(j["timestamp"], F.lit(0)) == 0) | x.present(j["action"]).isNull(), "missing timestamp or action"
    )
    return parsed(rows.select("file", "pos", error.alias("err"), record.alias("rec")))


def read_waf(spark: SparkSession, paths, acls: Sequence[str] = (), strict_files: bool = True) -> Parsed:
    """Requests of the web ACLs whose folder name contains any given text."""

    def keep(path):
        return s.is_waf_file(path) & s.contains_any(s.path_part(path, s.ACL_LEVEL), acls)

    if strict_files:
        return parse_waf(read_lines(spark, paths, keep))
    found = salvage_contents(spark, paths, keep)
    out = parse_waf(lines_of(found))
    return Parsed(out.good, out.bad, unreadable_of(found))
