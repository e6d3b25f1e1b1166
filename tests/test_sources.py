"""Readers over real files: layouts, damaged lines, unreadable files, names that are not logs."""

from __future__ import annotations

import gzip
import json
from datetime import date, datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logloom.sources import audit, flows, lb, objects, scope, waf

ALB = "AWSLogs/1/elasticloadbalancing/us-east-1/2026/09/23/1_elasticloadbalancing_us-east-1_app.shop.0a1b_20260923T0715Z_192.0.2.60_x1.log.gz"
NLB = ALB.replace("app.shop.0a1b", "net.edge.9f9f")
CLASSIC = ALB.replace("app.shop.0a1b", "legacy-lb").removesuffix(".gz")

GOOD = (
    'https 2026-09-23T08:21:03.117204Z app/shop/0a1b 203.0.113.5:40211 10.0.20.37:80 0.002 0.006 0.000 200 200 201 5120 '
    '"GET https://Tiles.Example.com:443/data/7.json?k=1 HTTP/1.1" "agent \\"quoted\\" (x)" ECDHE TLSv1.2 '
    'arn:aws:elasticloadbalancing:us-east-1:1:targetgroup/tg/1 "Root=1" "tiles.example.com" "cert" 2 2026-09-23T08:21:03.112000Z '
    '"forward" "-" "-" "10.0.20.37:80" "200" "-" "-" TID_1 "future"'
)
NO_TARGET = 'http 2026-09-23T08:24:10Z app/shop/0a1b 203.0.113.9:51907 - -1 -1 -1 400 - 0 310 "- http://shop.example.com:80- -" "-" - - - "-"'


def test_lb_layouts_are_read_in_one_scan(spark, write, tmp_path):
    write(ALB, f"{GOOD}\r\n\n{NO_TARGET}\nshort line\n{GOOD.replace('2026-09-23T08:21:03.117204Z', 'yesterday')}\n")
    write(NLB, "tls 2.0 2018-12-20T02:59:40 net/edge/c6 lst 72.21.218.154:51341 172.16.0.185:443 5 2 98 246 - arn:cert - ECDHE tlsv12 - Edge.example.com - - - 2018-12-20T02:59:30\n")
    write(CLASSIC, '2015-05-13T23:39:43.945958Z legacy-lb 192.168.131.39:2817 10.0.0.1:80 0.000073 0.001048 0.000057 200 200 0 29 "GET http://www.example.com:80/ HTTP/1.1" "curl/7" - -\n')
    write("AWSLogs/1/elasticloadbalancing/us-east-1/2026/09/23/ELBAccessLogTestFile", "hello\n")
    p = lb.read_lb(spark, str(tmp_path))
    got = {(r["kind"], r["elb_status"]): r for r in rows(p.good)}
    alb = got["alb", "200"]
    assert alb["ts"] == datetime(2026, 9, 23, 8, 21, 3, 117204)
    assert (alb["client_ip"], alb["client_port"], alb["target"]) == ("203.0.113.5", "40211", "10.0.20.37:80")
    assert (alb["method"], alb["host"], alb["path"], alb["protocol"]) == ("GET", "tiles.example.com", "/data/7.json", "HTTP/1.1")
    assert alb["user_agent"] == 'agent "quoted" (x)' and alb["redirect_url"] is None and alb["conn_trace_id"] == "TID_1"
    assert alb["latency"] == pytest.approx(0.008)
    bad = got["alb", "400"]
    assert bad["method"] is None and bad["host"] == "shop.example.com" and bad["latency"] is None and bad["target"] is None
    nlb = got["nlb", None]
    assert (nlb["type"], nlb["listener"], nlb["latency"], nlb["tls_handshake_time"]) == ("tls", "lst", 0.005, 0.002)
    assert nlb["domain_name"] == "edge.example.com" and nlb["request_time"] is None
    classic = got["classic", "200"]
    assert (classic["type"], classic["lb"], classic["path"]) == ("http", "legacy-lb", "/")
    report = rows(p.bad_report())
    assert [(r["bad"], r["first_error"]) for r in report] == [(2, "too few fields")]
    assert rows(lb.read_lb(spark, str(tmp_path), kinds=["nlb"]).good.select("kind")) == [{"kind": "nlb"}]
    assert lb.read_lb(spark, str(tmp_path), names=["SHOP"]).good.count() == 2


def test_lb_connections(spark, write, tmp_path):
    name = ALB.replace("/1_elastic", "/conn_log_1_elastic")
    write(
        name,
        '2026-09-23T09:40:52.204417Z 198.18.71.40 38114 443 TLSv1.2 ECDHE 0.219 "-" - - Success TID_9 secp256r1 app/shop/1 192.0.2.57\n'
        '2026-09-23T09:44:36Z 198.51.100.7 50000 443 - - - "-" - - - TID_a - app/shop/1\n',
    )
    p = lb.read_lb_conns(spark, str(tmp_path))
    a, b = sorted(rows(p.good), key=lambda r: r["client_ip"])
    assert (a["tls_handshake_time"], a["tls_verify_status"], a["tls_key_exchange"]) == (0.219, "Success", "secp256r1")
    assert (b["ssl_protocol"], b["tls_handshake_time"]) == (None, None)
    assert lb.read_lb(spark, str(tmp_path)).good.count() == 0


def test_waf_rules_and_redaction(spark, write, tmp_path):
    def rec(**kw):
        base = {
            "timestamp": 1789900000123, "webaclId": "arn:aws:wafv2:us-east-1:1:regional/webacl/prod/abcd", "terminatingRuleId": "Default_Action",
            "terminatingRuleType": "REGULAR", "action": "ALLOW",
            "httpRequest": {"clientIp": "203.0.113.9", "uri": "/login", "args": "token=SECRET", "headers": [{"name": "hOST", "value": "a.example"}, {"name": "Cookie", "value": "SECRET"}]},
        }
        return json.dumps(base | kw)

    def group(name, term=None, counted=(), excluded=()):
        return {
            "ruleGroupId": name, "terminatingRule": {"ruleId": term, "action": "BLOCK"} if term else None,
            "nonTerminatingMatchingRules": [{"ruleId": c, "action": "COUNT"} for c in counted], "excludedRules": [{"ruleId": e} for e in excluded] or None,
        }

    text = "\n".join([
        rec(action="BLOCK", terminatingRuleId="AWS-x", terminatingRuleType="MANAGED_RULE_GROUP", ruleGroupList=[group("AWS#Common", "Size"), group("AWS#SQLi", "Body")]),
        rec(ruleGroupList=[group("arn:aws:wafv2:1:regional/rulegroup/mine/77", "Would", ["C1"], ["E1"])], nonTerminatingMatchingRules=[{"ruleId": "geo", "action": "Count"}, {"ruleId": "soft", "action": "CAPTCHA"}, {"ruleId": "geo", "action": "COUNT"}], oversizeFields=["REQUEST_BODY"]),
        rec(action="BLOCK", terminatingRuleId="rate-1", terminatingRuleType="RATE_BASED"),
        rec(action="CAPTCHA", captchaResponse={"responseCode": 405, "failureReason": ""}),
        "{not json", rec(timestamp=0), "  ",
    ])
    write("AWSLogs/1/WAFLogs/us-east-1/prod/2026/09/20/10/00/x.log.gz", text)
    write("AWSLogs/1/WAFLogs/us-east-1/other/2026/09/20/10/00/x.log.gz", rec())
    p = waf.read_waf(spark, str(tmp_path), acls=["PRO"])
    got = p.good.collect()
    assert [(r["rule"], r["rule_group"], r["count_rules"]) for r in got[:2]] == [
        ("SQLi/Body", "SQLi", ["Common/Size"]), ("Default_Action", None, ["mine/Would", "mine/C1", "mine/E1", "geo"]),
    ]
    assert got[1]["oversize"] and not got[0]["oversize"] and got[2]["rate_rule"] == "rate-1" and got[3]["challenge_failed"]
    assert {r["host"] for r in got} == {"a.example"} and {r["web_acl"] for r in got} == {"prod"}
    assert "SECRET" not in str(got)
    assert sorted(r["err"] for r in p.bad.collect()) == ["missing timestamp or action", "not a JSON record"]
    files = waf.read_waf(spark, str(tmp_path)).good
    assert [r["name"] for r in scope.discover(files, scope.ACL_LEVEL).collect()] == ["other", "prod"]


def test_object_lines(spark, write, tmp_path):
    head = "owner data [06/Feb/2019:00:00:38 +0000] 192.0.2.3"
    write(
        "logs/2019-02-06-00-00-38-ABC",
        f'{head} arn:u R1 REST.GET.OBJECT k/1 "GET /k/1?X-Amz-Signature=SECRET HTTP/1.1" 200 - 113 - 7 - "https://r.example/p?s=SECRET#f" "ua" - h= SigV4 C AuthHeader b.s3 TLSV1.2 - Yes more "later on"\n'
        f'{head} - R2 REST.PUT.OBJECT k/2 "PUT /k/2 HTTP/1.1" 200 - - 10 3 2 "-" "curl" - h= - - - b.s3 - - -\n'
        f'{head} - R3 REST.GET.OBJECT a "GET /a HTTP/1.1" 403 AccessDenied 10 10 3 2 "-" "Wget" -\n'
        f'{head} - R4 BATCH.DELETE.OBJECT a - 204 -\n'
        f'{head} - R5 REST.GET.OBJECT a "GET /a\n'
        f'owner data [yesterday] 192.0.2.3 - R6 REST.GET.OBJECT a "x" 200\n',
    )
    write("logs/README", "not a log\n")
    p = objects.read_objects(spark, str(tmp_path))
    got = {r["request_id"]: r for r in rows(p.good)}
    one = got["R1"]
    assert (one["ts"], one["method"], one["path"], one["proto"]) == (datetime(2019, 2, 6, 0, 0, 38), "GET", "/k/1", "HTTP/1.1")
    assert (one["tls_version"], one["acl_required"], one["plain_http"], one["referer"]) == ("TLSv1.2", True, False, "https://r.example/p")
    assert (one["total_time_ms"], one["turnaround_ms"], one["object_size"]) == (7, None, 0)
    assert got["R2"]["plain_http"] and got["R2"]["bytes_sent"] == 0 and got["R2"]["requester"] is None
    assert not got["R3"]["plain_http"] and got["R3"]["status"] == 403
    assert got["R4"]["method"] is None and got["R4"]["status"] == 204
    assert "SECRET" not in str(got)
    assert rows(p.bad_report().select("bad", "first_error")) == [{"bad": 2, "first_error": "unterminated field"}]


FLOW_V2 = "version account-id interface-id srcaddr dstaddr srcport dstport protocol packets bytes start end action log-status"


@pytest.mark.parametrize("strict_files", [True, False])
def test_flow_files_follow_their_own_header(spark, write, tmp_path, strict_files):
    write(
        "x/1_vpcflowlogs_us-east-1_a.log.gz",
        f"{FLOW_V2}\n2 1 eni-a 198.51.100.7 10.0.1.10 51544 443 6 12 5120 1789898400 1789898460 ACCEPT OK\n\n"
        "2 1 eni-b - - - - - - - 1789898400 1789898460 - NODATA\n"
        "2 1 eni-a 198.51.100.7 10.0.1.10 70000 443 6 12 5120 1789898400 1789898460 ACCEPT OK\n"
        "2 1 eni-a 198.51.100.7 10.0.1.300 70000 443 6 12 5120 1789898400 1789898460 ACCEPT OK\n"
        "2 1 eni-a 198.51.100.7\n",
    )
    write(
        "x/1_vpcflowlogs_us-east-1_b.log.gz",
        "${pkt-srcaddr} ${srcaddr} ${dstaddr} ${start} ${bytes} ${unknown-field} ${traffic-path}\n2001:DB8::99 ::ffff:10.1.2.3 fd00:0::5 1789898400 7 zzz 8\n",
    )
    write("x/1_vpcflowlogs_us-east-1_c.log.gz", "2 1 eni-a 198.51.100.7\n")
    write("x/1_vpcflowlogs_us-east-1_d.log.gz", "version srcaddr\n2 10.0.0.1\n")
    p = flows.read_flows(spark, str(tmp_path), strict_files=strict_files)
    got = {(r["interface_id"], r["log_status"]): r for r in rows(p.good)}
    a = got["eni-a", "OK"]
    assert (a["src_port"], a["protocol"], a["bytes"], a["start"]) == (51544, 6, 5120, datetime(2026, 9, 20, 10, 0))
    nodata = got["eni-b", "NODATA"]
    assert (nodata["src_addr"], nodata["dst_port"], nodata["bytes"]) == (None, None, 0)
    b = got[None, None]
    assert (b["pkt_src_addr"], b["src_addr"], b["dst_addr"], b["traffic_path"]) == ("2001:db8::99", "10.1.2.3", "fd00::5", 8)
    errors = sorted(r["err"] for r in p.bad.collect())
    assert errors == ["bad dstaddr field", "bad srcport field", "fewer fields than the header"]
    assert sorted(r["err"] for r in p.unreadable.collect()) == ["header: missing, the first line is a record", "header: no start field"]


def test_flow_file_of_many_blocks(spark, write, tmp_path):
    # Several Arrow batches of one file, then small files of other layouts, one of them a header only.
    body = "".join(f"2 1 eni-a 198.51.100.7 10.0.1.10 {k % 60000} 443 6 12 {k} 1789898400 1789898460 ACCEPT OK\r\n" for k in range(25_000))
    write("x/1_vpcflowlogs_us-east-1_a.log.gz", f"{FLOW_V2}\r\n{body}2\r\n")
    write("x/1_vpcflowlogs_us-east-1_b.log.gz", "start bytes\n1789898400 7\n")
    write("x/1_vpcflowlogs_us-east-1_c.log.gz", f"\n{FLOW_V2}\n")
    write("x/1_vpcflowlogs_us-east-1_d.log.gz", "bytes start\n9 1789898400\n")
    write("x/1_vpcflowlogs_us-east-1_e.log.gz", "version\n" + "2\n" * 12_000)
    write("x/1_vpcflowlogs_us-east-1_f.log.gz", "")
    p = flows.read_flows(spark, str(tmp_path))
    got = {r["bytes"]: r for r in p.good.collect()}
    assert p.good.count() == 25_002 and sum(got) == sum(range(25_000)) and got[24_999]["interface_id"] == "eni-a"
    assert [r["bytes"] for r in p.good.where("interface_id IS NULL").orderBy("bytes").collect()] == [7, 9]
    assert [(r["pos"], r["err"]) for r in p.bad.collect()] == [(25_000, "fewer fields than the header")]
    assert [(r["file"][-8:], r["err"]) for r in p.unreadable.collect()] == [("e.log.gz", "header: no start field")]


def test_flow_tables_with_hive_columns(spark, tmp_path):
    df = spark.createDataFrame([("198.51.100.7", "::ffff:10.0.0.1", 443, 5, 1789898400, "ACCEPT")], "srcaddr string, dstaddr string, dstport int, bytes bigint, start bigint, action string")
    base = str(tmp_path / "h")
    df.write.parquet(f"{base}/aws-account-id=1/aws-region=us-east-1")
    r = flows.read_flow_tables(spark, [base], base).good.first()
    assert (r["dst_addr"], r["region"], r["bytes"], r["account_id"]) == ("10.0.0.1", "us-east-1", 5, "1")


def test_flow_tables_read_only_their_window(spark, tmp_path):
    base, t0 = str(tmp_path / "h"), 1789898400  # 2026-09-20 10:00
    made = [(str(k), k, t0 + k * 6 * 3600, 70000 if k == 4 else 443, f"{d:%Y}", f"{d:%m}", f"{d:%d}")
            for k in range(12) for d in [datetime(2026, 9, 20, 10) + timedelta(hours=6 * k + 24 * (k % 2))]]
    df = spark.createDataFrame(made, "`interface-id` string, bytes int, start bigint, dstport int, year string, month string, day string")
    df.write.partitionBy("year", "month", "day").parquet(base)
    since, until = datetime(2026, 9, 20, 16, 0, 0, 1), datetime(2026, 9, 22, 4, tzinfo=timezone.utc)
    good = flows.read_flow_tables(spark, base, since=since, until=until).good
    # Late deliveries are found in the folder of the next day; the bounds are half open.
    assert sorted(int(r["interface_id"]) for r in good.collect()) == [2, 3, 4, 5, 6]
    assert {r["interface_id"]: r["dst_port"] for r in good.collect()}["4"] is None
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(start,1789920001)" in plan and "LessThan(start,1790049600)" in plan and "make_date(" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    as_text = df.select("bytes", F.col("start").cast("string"))
    assert as_text.where(flows.stored_window(as_text, since, until)).count() == 5
    as_time = df.select(F.timestamp_seconds("start").alias("start"))
    assert as_time.where(flows.stored_window(as_time, since, None)).count() == 10
    assert flows.normalize_columns(as_time).where("start IS NULL").count() == 0
    assert df.where(flows.stored_window(df.drop("start"), since, None)).count() == 0


def test_audit_envelopes_and_corrupt_files(spark, write, tmp_path):
    rec = {
        "eventTime": "2026-09-17T02:14:09Z", "eventSource": "iam.amazonaws.com", "eventName": "CreateAccessKey", "errorCode": "", "eventID": "e1",
        "userIdentity": {"type": "Root", "arn": "arn:root", "sessionContext": {"attributes": {"mfaAuthenticated": "false"}}},
        "resources": [{"ARN": "arn:x"}], "requestParameters": {"userName": "bob", "n": 1},
    }
    day = "AWSLogs/1/CloudTrail/us-east-1/2026/09/17/1_CloudTrail_us-east-1_"
    write(day + "a.json.gz", json.dumps({"Records": [rec, {"eventName": "ListUsers"}]}, indent=1))
    write(day + "b.json.gz", '{"Records":[{"eventName":')
    whole = gzip.compress(json.dumps({"Records": [rec]}).encode())
    write(day + "c.json.gz", whole[: len(whole) // 2])
    write(day.replace("CloudTrail/us", "CloudTrail-Digest/us") + "d.json.gz", "{}")
    p = audit.read_audit(spark, str(tmp_path), strict_files=False)
    got = {r["event_name"]: r for r in rows(p.good)}
    r = got["CreateAccessKey"]
    assert (r["event_time"], r["error_code"], r["user_identity"]["session_context"]["attributes"]["mfa_authenticated"]) == (datetime(2026, 9, 17, 2, 14, 9), None, "false")
    assert json.loads(r["request_parameters"]) == {"userName": "bob", "n": 1} and r["resources"][0]["arn"] == "arn:x"
    assert got["ListUsers"]["event_time"] is None
    assert sorted(x["err"] for x in p.unreadable.collect()) == ["corrupt gzip data", "malformed envelope"]


def test_scope_paths_and_globs(spark, write, tmp_path):
    s = scope.Scope(["111", "222"], ["us-east-1"], date(2026, 2, 28), date(2026, 3, 1), base_prefix="/base/", org_id="o-1")
    assert scope.scan_paths("s3://b", s, scope.AUDIT) == [
        f"s3://b/base/AWSLogs/o-1/{a}/CloudTrail/us-east-1/{d}" for a in ("111", "222") for d in ("2026/02/28", "2026/03/01")
    ]
    assert s.widened().days()[-1] == date(2026, 3, 2)
    assert scope.scan_glob("s3://b", scope.Scope([], ["r"], s.start, s.end), scope.AUDIT) is None
    write("base/AWSLogs/o-1/111/CloudTrail/us-east-1/2026/03/01/1_CloudTrail_x.json.gz", '{"Records":[{"eventName":"A"}]}')
    write("base/AWSLogs/o-1/111/CloudTrail/us-east-1/2026/03/05/1_CloudTrail_x.json.gz", '{"Records":[{"eventName":"B"}]}')
    p = audit.read_audit(spark, scope.scan_glob(str(tmp_path), s, scope.AUDIT))
    assert [r["event_name"] for r in p.good.collect()] == ["A"]
    none = scope.Scope(["999"], ["us-east-1"], s.start, s.end)
    assert audit.read_audit(spark, scope.scan_glob(str(tmp_path), none, scope.AUDIT)).good.count() == 0
    assert scope.flat_glob("s3://b", "logs/pre-", s) == "s3://b/logs/pre-{2026-02-28,2026-03-01}-*"
    assert "aws-region=us-east-1" in scope.hive_glob("s3://b", s)


def test_file_pruning_reaches_the_scan(spark, write, tmp_path):
    for i in range(4):
        write(NLB.replace("x1", f"x{i}"), "tls 2.0\n")
    write(ALB, GOOD)
    df = lb.read_lb(spark, str(tmp_path), kinds=["alb"]).good
    assert df.count() == 1
    assert rows(df.select(scope.lb_name(F.col("file")).alias("n"))) == [{"n": "shop"}]


def test_large_quoted_field_does_not_overflow(spark):
    from logloom.functions import text as x

    line = 'a "' + "y\\\"" * 200_000 + '" b'
    df = spark.createDataFrame([(line,)], "line string")
    r = df.select(F.size(x.raw_tokens(F.col("line"))).alias("n"), F.length(F.get(x.quoted_tokens(F.col("line")), F.lit(1))).alias("len")).first()
    assert (r["n"], r["len"]) == (3, 400_000)
