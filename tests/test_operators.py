"""Filters, addresses, rules at their thresholds, caps, partition invariance and plan shapes."""

from __future__ import annotations

import ipaddress
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logloom.functions import net
from logloom.functions.text import binary_size
from logloom.operators import counters as c
from logloom.operators import filters, flows, health, history, lb, lines, rules, series, waf
from logloom.plans.fixtures import Tables
from logloom.schema import TABLES, conform, parse_severity, struct_of
from logloom.session import configure

SF = "/root/testdata/sf0.001"
T = datetime(2026, 9, 20, 10)


@pytest.fixture(scope="module")
def t(spark):
    return Tables(configure(spark), SF)


def table(spark, name, *records):
    schema = struct_of(TABLES[name])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in records], schema)


def flow(**kw):
    base = dict(src_addr="198.51.100.7", dst_addr="10.0.0.5", src_port=50000, dst_port=22, protocol=6, packets=1, bytes=40, start=T, action="REJECT", log_status="OK", tcp_flags=2)
    return base | kw


def test_addresses(spark):
    cases = {
        "10.0.0.1": ("10.0.0.1", True, False), "100.127.1.1": ("100.127.1.1", True, False), "100.128.1.1": ("100.128.1.1", False, True),
        "172.31.0.1": ("172.31.0.1", True, False), "172.32.0.1": ("172.32.0.1", False, True), "203.0.113.9": ("203.0.113.9", False, True),
        "224.0.0.1": ("224.0.0.1", False, False), "0.0.0.0": ("0.0.0.0", False, False), "256.1.1.1": (None, False, False), "01.2.3.4": (None, False, False),
        "::1": ("::1", True, False), "::": ("::", False, False), "FD00:0:0::5": ("fd00::5", True, False), "fe80::1": ("fe80::1", True, False),
        "ff02::1": ("ff02::1", False, False), "::ffff:10.1.2.3": ("10.1.2.3", True, False), "2001:db8:0:0:1:0:0:1": ("2001:db8::1:0:0:1", False, True),
        "1:2:3:4:5:6:7:8:9": (None, False, False), "1::2::3": (None, False, False), ":::": (None, False, False), "eni-1": (None, False, False),
    }
    df = spark.createDataFrame([(a,) for a in cases], "a string").withColumn("t", net.addr_text(F.col("a")))
    got = {r["a"]: (r["t"], r["p"], r["q"]) for r in df.select("a", "t", net.is_private(F.col("t")).alias("p"), net.is_public(F.col("t")).alias("q")).collect()}
    assert got == cases


def test_prefixes_match_their_family_only_and_long_lists_agree(spark):
    df = spark.createDataFrame([(a,) for a in ("10.1.2.3", "10.2.0.1", "2001:db8::9", "fd00::1", None)], "a string")
    hit = lambda ps: {r["a"] for r in df.where(net.in_prefixes(F.col("a"), ps)).collect()}
    assert hit(["10.1.9.9/16"]) == {"10.1.2.3"} and hit(["::/0"]) == {"2001:db8::9", "fd00::1"} and hit(["0.0.0.0/0"]) == {"10.1.2.3", "10.2.0.1"}
    assert hit(["10.2.0.1", "2001:db8::/32"]) == {"10.2.0.1", "2001:db8::9"}
    many = ["10.1.2.0/24", "8.0.0.0/7", "2001:db8::/32", *[f"192.0.2.{i}" for i in range(60)]]
    assert {r["a"] for r in net.where_any_in(df, ["a"], many).collect()} == {"10.1.2.3", "2001:db8::9"}
    with pytest.raises(ValueError):
        net.parse_prefixes(["10.0.0.0/33"])


@pytest.mark.parametrize("broadcast_up_to", [100_000, 10])
def test_long_prefix_lists_inside_one_network_keep_each_row_once(spark, monkeypatch, broadcast_up_to):
    monkeypatch.setattr(net, "MAX_BROADCAST_PREFIXES", broadcast_up_to)
    listed = [f"10.{i // 128}.{2 * (i % 128)}.0/{25 - i % 3}" for i in range(3000)] + ["2001:db8::/33", "::ffff:9.9.9.9"]
    rows = [(f"10.{i % 40}.{i % 250}.{i}", f"10.{i % 30}.{i % 7}.{200 - i % 99}") for i in range(250)] * 2
    rows += [("2001:db8:1::1", None), ("2001:db8:ffff::1", "1.1.1.1"), (None, "9.9.9.9"), (None, None), ("eni-1", "eni-2")]
    nets = [ipaddress.ip_network(x, strict=False) for x in listed if "ffff" not in x] + [ipaddress.ip_network("9.9.9.9")]

    def inside(text):
        return text is not None and text[:1] != "e" and any(ipaddress.ip_address(text) in n for n in nets)

    df = spark.createDataFrame(rows, "a string, b string")
    got = sorted(map(str, net.where_any_in(df, ["a", "b"], listed).collect()))
    assert got == sorted(str(r) for r in df.collect() if inside(r["a"]) or inside(r["b"]))


def test_parameters_are_checked():
    assert filters.parse_ports(["22", "8000-8100"]) == [(22, 22), (8000, 8100)] and filters.parse_protocols(["TCP", "47"]) == [6, 47]
    assert filters.parse_size("1.5GiB") == 3 << 29 and parse_severity(" high ") == "HIGH"
    for bad in (lambda: filters.parse_ports(["9-1"]), lambda: filters.parse_ports(["70000"]), lambda: filters.parse_protocols(["256"]), lambda: parse_severity("urgent"), lambda: filters.parse_size("x")):
        with pytest.raises(ValueError):
            bad()
    assert filters.AuditFilter(events=["x"]).narrowing and not filters.AuditFilter(writes_only=True).narrowing


def test_scan_and_sweep_thresholds(spark):
    below = [flow(dst_port=p) for p in range(100, 124)]
    at = [flow(src_addr="198.51.100.8", dst_port=p) for p in range(100, 125)]
    ignored = [flow(src_addr="198.51.100.9", dst_port=p, tcp_flags=18) for p in range(100, 140)]
    swept = [flow(src_addr="10.0.0.9", dst_addr=f"10.0.1.{i}", action="ACCEPT") for i in range(50)]
    df = table(spark, "flows", *below, *at, *ignored, *swept)
    got = {(r["rule"], r["actor"]): r for r in rules.flow_findings(df).collect()}
    assert set(got) == {("vpc-port-scan", "198.51.100.8"), ("vpc-host-sweep", "10.0.0.9")}
    scan = got["vpc-port-scan", "198.51.100.8"]
    assert scan["n"] == 25 and scan["time"] == T
    assert scan["detail"] == "rejected connection attempts to 25 or more distinct ports (sample: 100, 101, 102, 103, 104, 105, 106, 107, 108, 109); 25 rejected flows"


def test_exposed_service_lists_its_busiest_sources(spark):
    hits = [flow(src_addr=f"198.51.100.{i}", action="ACCEPT", flow_direction=None, bytes=1024) for i in range(1, 8) for _ in range(i)]
    quiet = [flow(action="ACCEPT", flow_direction="egress"), flow(action="ACCEPT", src_port=22)]
    r = rules.flow_findings(table(spark, "flows", *hits, *quiet), rules=["vpc-sensitive-port-exposed"]).collect()
    assert len(r) == 1 and r[0]["actor"] == "10.0.0.5:22/tcp"
    assert r[0]["detail"] == (
        "28 accepted flows, 28.0 KiB, from 7 public sources; top: 198.51.100.7 (7), 198.51.100.6 (6), 198.51.100.5 (5), 198.51.100.4 (4), 198.51.100.3 (3)"
    )


def test_cap_keeps_every_critical_finding(spark, t):
    found = rules.waf_findings(t.waf_requests, block_threshold=5)
    critical = found.where("severity = 'CRITICAL'").count()
    kept = rules.cap_aggregate(found, 3)
    assert kept.count() == critical > 3
    assert rules.dropped_by(found, kept).first()["dropped"] == found.count() - critical
    assert [r["verdict"] for r in (rules.gate(found, "critical").first(), rules.gate(found.where("false"), "low").first(), rules.gate(found, "low", 1).first())] == [1, 0, 2]


def test_results_do_not_depend_on_partitioning(spark, t):
    def results(n):
        f, w = t.flows.repartition(n), t.waf_requests.repartition(n)
        return (
            rows(rules.flow_findings(f, egress_bytes=1 << 20)), rows(rules.waf_findings(w, block_threshold=5)), rows(c.top_n(flows.counters(f), 5)),
            rows(lb.target_groups(t.lb_requests.repartition(n)).drop("target_time_sum")), rows(waf.client_stats(w)),
        )

    one = results(1)
    assert results(2) == one and results(17) == one


def test_top_n_is_cut_before_the_shuffle(spark, t):
    plan = c.top_n(flows.counters(t.flows), 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "partial_sum" in plan


def test_time_filter_and_columns_reach_the_scan(spark, t):
    df = filters.FlowFilter(since=datetime(1994, 1, 1), actions=["reject"]).apply(t.flows).groupBy("interface_id").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_no_python_and_no_cross_join_in_rules(spark, t):
    for df in (rules.flow_findings(t.flows), rules.waf_findings(t.waf_requests), rules.object_findings(t.object_requests), rules.audit_findings(t.audit_events), series.rebucket(t.lb_requests)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_fold_tail_and_empty_inputs(spark, t):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "key string, n bigint")
    assert {r["key"]: r["n"] for r in c.fold_tail(counts, 2).collect()} == {"a": 5, "b": 3, "(other)": 4}
    assert {r["key"] for r in c.fold_tail(counts, 4).collect()} == {"a", "b", "c", "d"}
    empty = t.lb_requests.where("false")
    assert series.rebucket(empty).count() == 0 and health.gauges(empty).count() == 0
    assert flows.totals(t.flows.where("false")).first()["reject_rate"] == 0
    assert lb.latency_stat(empty).first()["avg"] == 0 and lb.hour_of_day(empty).count() == 24


def test_custom_rule_replaces_the_list(spark, t):
    rule = rules.Rule("any", "LOW", "Any", F.col("event_id").isNotNull(), F.col("event_name"))
    assert rules.audit_findings(t.audit_events, [rule]).select("rule").distinct().collect()[0]["rule"] == "any"


def test_event_line_over_the_limit_drops_its_payloads(spark, t):
    big = t.audit_events.limit(2).withColumn("request_parameters", F.concat(F.lit('{"k":"'), F.repeat(F.lit("x"), 128 << 10), F.lit('"}')))
    got = lines.audit_lines(big, "r", max_bytes=128 << 10).select("line").collect()
    whole = lines.audit_lines(big, "r").select("line").collect()
    assert all("requestParameters" in r["line"] and len(r["line"]) > 128 << 10 for r in whole)
    assert all('"truncated":true' in r["line"] and "requestParameters" not in r["line"] and len(r["line"]) < 2000 for r in got)


def test_jsonl_and_fan_out(spark, t, tmp_path):
    found = lines.finding_lines(rules.waf_findings(t.waf_requests, block_threshold=5), "r", "waf")
    out, copy = str(tmp_path / "jsonl"), str(tmp_path / "copy")
    lines.fan_out(
        lines.waf_lines(t.waf_requests, "r"),
        lambda df: lines.write_jsonl(df, out, found), lambda df: lines.by_event_time(df).select("stream", "line").write.parquet(copy),
    )
    back = spark.read.json(out)
    assert back.where("kind = 'request'").count() == t.waf_requests.count() == spark.read.parquet(copy).count()
    assert back.where("kind = 'finding'").count() == found.count()


def test_counter_reset_counts_from_zero(spark):
    df = spark.createDataFrame([("c", {"k": "v"}, v, datetime(2026, 1, 1, 0, m)) for m, v in ((0, 5.0), (10, 9.0), (20, 2.0), (50, 2.0))], "name string, labels map<string,string>, value double, at timestamp")
    assert [r["increase"] for r in history.increase(df, 1800).orderBy("at").collect()] == [0.0, 4.0, 6.0, 0.0]


def test_byte_text(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 1 << 20, 5 << 30, 3 << 40, 1 << 50)], "n bigint")
    assert [r[0] for r in df.select(binary_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 MiB", "5.0 GiB", "3.0 TiB", "1.0 PiB"]


def test_conform_adds_typed_nulls(spark):
    df = conform(spark.createDataFrame([("a",)], "action string"), "flows")
    assert df.schema["dst_port"].dataType.simpleString() == "int" and len(df.columns) == 28


def test_buckets_and_their_grid_fold_the_log_once(spark, tmp_path):
    path = str(tmp_path / "lb")
    spark.range(5000).select(
        (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97)).alias("ts"), F.lit("200").alias("elb_status"), F.lit("200").alias("target_status"),
        F.lit("t").alias("target"), F.lit(None).cast("string").alias("error_reason"), *[F.lit(0.5).alias(c) for c in ("request_time", "target_time", "response_time", "latency")],
    ).write.parquet(path)

    def records_read():
        gateway = spark.sparkContext._gateway
        none = gateway.jvm.java.util.ArrayList()
        stages = spark._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()) if "collect" in stages.apply(i).name())

    before = records_read()
    got = series.rebucket(spark.read.parquet(path)).collect()
    assert sum(r["requests"] for r in got) == 5000 and {r["step_minutes"] for r in got} == {60}
    assert records_read() - before == 5001  # and the one row that the buckets are unfolded from
    before = records_read()
    assert len(series.requests_chart(series.rebucket(spark.read.parquet(path))).collect()) == 2 * len(got)
    assert records_read() - before == 5001
    assert series.rebucket(spark.read.parquet(path).where("ts IS NULL")).count() == 0


def test_mapped_addresses_take_the_short_way(spark, monkeypatch):
    """The usual text of an IPv4-mapped address is unwrapped without its 32 digits; other spellings give the same."""
    mapped = ["::ffff:10.0.0.1", "::FFFF:203.0.113.255", "::ffff:0.0.0.0"]
    other = ["::ffff:0a00:1", "0:0:0:0:0:ffff:10.0.0.1", "::ffff:10.0.0.1%eth0", "::ffff:10.0.0.256", "::ffff:010.0.0.1", "::ffff:10.0.0.1\n", "::ffff:10.0.0.1x", "x::ffff:10.0.0.1", "::1", "", None]
    df = spark.createDataFrame([(a,) for a in mapped + other], "a string")
    short = df.select("a", net.addr_text(F.col("a")).alias("t"), net.addr_key(F.col("a")).alias("k")).collect()
    plain = net._MAPPED
    monkeypatch.setattr(net, "_MAPPED", "(?!)")
    assert short == df.select("a", net.addr_text(F.col("a")).alias("t"), net.addr_key(F.col("a")).alias("k")).collect()
    assert [(r["t"], r["k"]) for r in short[:3]] == [("10.0.0.1", "40A000001"), ("203.0.113.255", "4CB0071FF"), ("0.0.0.0", "400000000")]
    monkeypatch.setattr(net, "_MAPPED", plain)
    monkeypatch.setattr(net, "_v6_digits", lambda c: F.raise_error(F.lit("the long way")).cast("string"))
    got = df.where(F.col("a").isin(mapped)).select("a", net.addr_text(F.col("a")).alias("t"), net.addr_key(F.col("a")).alias("k")).collect()
    assert sorted(got) == sorted(short[:3])
