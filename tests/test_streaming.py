"""The rolling scanner: ticks, failures, retries, window report, retention."""

from __future__ import annotations

import gzip
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from logloom.operators import rules
from logloom.sources import lines
from logloom.streaming import families, ticks

NOW = datetime(2026, 9, 20, 12, 0, tzinfo=timezone.utc)
T0 = int(NOW.timestamp()) - 3600
HEADER = "version interface-id srcaddr dstaddr srcport dstport protocol packets bytes start end action log-status"


def flow(src, port, t=T0, action="REJECT", sport=50000):
    return f"2 eni-1 {src} 10.0.0.5 {sport} {port} 6 1 40 {t} {t + 60} {action} OK"


def flow_file(*lines):
    return "\n".join([HEADER, *lines]) + "\n"


@pytest.fixture
def scanner(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def options(**kw):
        base = dict(
            source=str(tmp_path / "in"), tables=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), once=True, clock=lambda: NOW
        )
        return ticks.Options(**(base | kw))

    def run(o, family=families.FLOWS):
        q = ticks.start(spark, family, o)
        q.awaitTermination(120)

    return options, run


def name(i):
    return f"in/AWSLogs/1_vpcflowlogs_us-east-1_fl-{i}.log.gz"


def test_two_ticks_read_each_file_once_and_the_report_crosses_thresholds(spark, scanner, write):
    options, run = scanner
    o = options(thresholds={"scan_ports": 6})
    write(name(1), flow_file(*[flow("198.51.100.7", p) for p in range(1, 5)]))
    run(o)
    write(name(2), flow_file(*[flow("198.51.100.7", p) for p in range(3, 7)]))
    write("in/README.txt", "not a log")
    run(o)
    run(o)
    rows = {r["batch_id"]: r for r in ticks.ticks(spark, o).collect()}
    # The last tick found no new file.
    assert [(r["result"], r["objects"], r["records_matched"]) for _, r in sorted(rows.items())] == [("ok", 1, 4), ("ok", 1, 4), ("ok", 0, 0)]
    per_tick = ticks.read_table(spark, o, "findings")
    assert per_tick.count() == 0
    found = ticks.report(spark, families.FLOWS, o)["findings"].collect()
    assert [(f["rule"], f["actor"]) for f in found] == [("vpc-port-scan", "198.51.100.7")]
    assert "sample: 1, 2, 3, 4, 5, 6)" in found[0]["detail"] and "8 rejected flows" in found[0]["detail"]
    counters = ticks.report(spark, families.FLOWS, o)["counters"]
    assert counters.where("dim = 'action' and key = 'REJECT'").first()["n"] == 8


def test_records_outside_the_window_are_left_out(spark, scanner, write):
    options, run = scanner
    old = int((NOW - timedelta(hours=30)).timestamp())
    write(name(1), flow_file(flow("198.51.100.7", 1, t=old), flow("198.51.100.7", 2)))
    o = options()
    run(o)
    r = ticks.ticks(spark, o).first()
    assert (r["records_read"], r["records_matched"]) == (2, 1)


def test_failed_delivery_commits_nothing_and_is_repeated(spark, scanner, write):
    options, run = scanner
    write(name(1), flow_file(flow("198.51.100.7", 1)))

    def broken(frames, batch_id):
        raise RuntimeError("sink down")

    with pytest.raises(StreamingQueryException):
        run(options(after_write=broken))
    o = options()
    assert ticks.committed(spark, o) == []
    assert [r["result"] for r in ticks.failed_ticks(spark, o).collect()] == ["failed"]
    run(o)
    # The failed tick is repeated first, then the new run has its own, quiet one.
    assert [(r["batch_id"], r["objects"]) for r in ticks.ticks(spark, o).orderBy("batch_id").collect()] == [(0, 1), (1, 0)]
    assert ticks.read_table(spark, o, "lines").count() == 1
    m = ticks.tick_history(spark, families.FLOWS, o)
    newest = m.where("name = 'logloom_scans_total'").select(F.col("labels.result").alias("r"), "value", "at").groupBy("r").agg(F.max("value").alias("v"))
    assert {r["r"]: r["v"] for r in newest.collect()} == {"ok": 2.0, "partial": 0.0, "failed": 1.0}


def test_corrupt_file_is_reported_retried_and_read_later(spark, scanner, write):
    options, run = scanner
    good = gzip.compress(flow_file(flow("198.51.100.9", 22)).encode())
    path = write(name(1), good[: len(good) // 2])
    write(name(2), flow_file(flow("198.51.100.7", 1), "2 eni-1 damaged"))
    o = options()
    run(o)
    r = ticks.ticks(spark, o).first()
    assert (r["result"], r["errors"], r["objects"], r["records_read"]) == ("partial", 1, 1, 1)
    bad = ticks.read_table(spark, o, "bad/records").first()
    assert (bad["bad"], bad["first_error"]) == (1, "bad srcaddr field")
    with open(path, "wb") as f:
        f.write(good)
    write(name(3), flow_file(flow("198.51.100.7", 2)))
    run(o)
    second = ticks.ticks(spark, o).where("batch_id = 1").first()
    assert (second["result"], second["records_read"]) == ("ok", 2)
    assert ticks.read_table(spark, o, "retry").where("batch_id = 1").count() == 0


def test_prune_forgets_ticks_before_the_lookback(spark, scanner, write):
    options, run = scanner
    write(name(1), flow_file(flow("198.51.100.7", 1)))
    run(options(clock=lambda: NOW))
    write(name(2), flow_file(flow("198.51.100.7", 2, t=T0 + 26 * 3600)))
    later = options(clock=lambda: NOW + timedelta(hours=26))
    run(later)
    # The second tick has pruned the first one.
    assert ticks.prune(spark, later) == []
    assert ticks.committed(spark, later) == [1]
    assert ticks.report(spark, families.FLOWS, later)["totals"].first()["flows"] == 1
    assert ticks.read_table(spark, later, "lines").count() == 2
    assert values(spark, later, "vpc_flows_total", action="REJECT") == [2.0]
    assert values(spark, later, "seen_keys") == [2.0]
    # Seen files are forgotten 48 hours later, but a tick that is the newest one stays.
    much_later = options(clock=lambda: NOW + timedelta(hours=80))
    ticks.prune(spark, much_later)
    assert ticks.committed(spark, much_later) == [1]
    assert [r["batch_id"] for r in ticks.read_table(spark, much_later, "seen").select("batch_id").distinct().collect()] == [1]
    run(much_later)
    # The newest tick with files stays too, outside the window.
    assert ticks.committed(spark, much_later) == [1, 2] and ticks.report(spark, families.FLOWS, much_later)["totals"].first()["flows"] == 0
    assert values(spark, much_later, "vpc_flows_total", action="REJECT") == [2.0, 2.0]


def values(spark, o, name, **labels):
    """A series' values in order of time."""
    rows = ticks.tick_history(spark, families.FLOWS, o).where(F.col("name") == "logloom_" + name).collect()
    return [r["value"] for r in sorted(rows, key=lambda r: r["at"]) if labels.items() <= r["labels"].items()]


def test_quiet_folder_has_ticks(spark, scanner, write):
    options, run = scanner
    for k in range(3):
        run(options(clock=lambda k=k: NOW + timedelta(minutes=15 * k)))
    o = options()
    rows = ticks.ticks(spark, o).orderBy("batch_id").collect()
    assert [(r["result"], r["objects"]) for r in rows] == [("ok", 0)] * 3
    assert values(spark, o, "last_success_timestamp_seconds") == [(NOW + timedelta(minutes=15 * k)).timestamp() for k in range(3)]
    assert values(spark, o, "scans_total", result="ok") == [1.0, 2.0, 3.0]


def test_interval_gives_ticks_without_files(spark, scanner, write):
    options, _ = scanner
    o = options(once=False, interval="1 second")
    write(name(1), flow_file(flow("198.51.100.7", 1)))
    q = ticks.start(spark, families.FLOWS, o)
    try:
        for _ in range(120):
            if len(ticks.committed(spark, o)) >= 3:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    rows = ticks.ticks(spark, o).orderBy("batch_id").collect()
    assert len(rows) >= 3 and [r["objects"] for r in rows[:3]] == [1, 0, 0]


def test_unreadable_files_wait_and_heal(spark, scanner, write):
    options, run = scanner
    good = gzip.compress(flow_file(flow("198.51.100.9", 22)).encode())
    path = write(name(1), good[:30])
    gone = write(name(2), good[:30])
    tried = []
    for k in range(3):
        o = options(clock=lambda k=k: NOW + timedelta(minutes=15 * k))
        run(o)
        tried += [r["attempts"] for r in ticks.read_table(spark, o, "retry").where(F.col("batch_id") == k).collect()]
        assert ticks.ticks(spark, o).where(F.col("batch_id") == k).first()["result"] == "partial"
    # The second try comes at once, the third after one interval; the next one would come after three.
    assert tried == [1, 1, 2, 2, 3, 3]
    with open(path, "wb") as f:
        f.write(good)
    os.remove(gone)
    o = options(clock=lambda: NOW + timedelta(minutes=31))
    run(o)
    assert ticks.ticks(spark, o).orderBy(F.desc("batch_id")).first()["result"] == "ok"
    assert ticks.read_table(spark, o, "retry").where("batch_id = 3").count() == 0
    assert values(spark, o, "vpc_flows_total", action="REJECT")[-1] == 1.0 and max(values(spark, o, "scan_errors_total")) == 6.0


def test_only_damaged_files_are_decoded_in_python(spark, scanner, write, monkeypatch):
    options, run = scanner
    decoded, decode = [], ticks.src.decode_contents

    def noted(raw):
        decoded.append([r["path"].rpartition("/")[2] for r in raw.select("path").collect()])
        return decode(raw)

    monkeypatch.setattr(ticks.src, "decode_contents", noted)
    o = options()
    write(name("a+b%20c d"), flow_file(flow("198.51.100.7", 1)))
    run(o)
    assert decoded == []
    # Plain text under a name that promises gzip: Spark's reader can't, the second reader can, within the tick.
    plain = write(name(2), flow_file(flow("198.51.100.8", 2), flow("198.51.100.8", 3)).encode())
    run(o)
    assert decoded == [[os.path.basename(plain)]]
    got = [(r["result"], r["objects"], r["records_read"]) for r in ticks.ticks(spark, o).orderBy("batch_id").collect()]
    assert got == [("ok", 1, 1), ("ok", 1, 2)]
    # A file that one of the two sources delivers a batch late is neither read twice nor taken for a damaged one.
    old = {r["file"] for r in ticks.read_table(spark, o, "seen").collect()}
    late = [(f, c) for f in old for c in ("text", None)] + [("new", "text"), ("new", None), ("cut", None)]
    kept = []
    fresh, damaged = ticks._arrived(spark.createDataFrame(late, "file string, content string"), o, 2, kept)
    assert ([r["file"] for r in fresh.collect()], [r["file"] for r in damaged.collect()], len(old)) == (["new"], ["cut"], 2)
    for k in kept:
        k.unpersist()


def test_ledger_meets_the_listing(spark, scanner):
    """Files whose pause is over or that have changed are due, the longest waiting first; files that are gone leave the ledger."""
    options, _ = scanner
    at = lambda minutes: NOW + timedelta(minutes=minutes)
    ledger = [(f"f{k}", "e", 1, NOW, at(k), NOW) for k in range(6)] + [("gone", "e", 1, NOW, NOW, NOW), ("changed", "e", 9, NOW, at(900), NOW)]
    there = [(f"f{k}", NOW) for k in range(6)] + [("changed", at(1)), ("new", NOW)]
    waiting, listed = spark.createDataFrame(ledger, ticks.RETRY_SCHEMA), spark.createDataFrame(there, "file string, modified timestamp")
    for now, bound, want, rest in ((2, 1000, {"f0", "f1", "f2", "changed"}, {"f3", "f4", "f5"}), (4, 2, {"f0", "f1"}, {"f2", "f3", "f4", "f5", "changed"})):
        due, later = ticks._due(waiting, listed, options(retry_files=bound), at(now))
        assert ({r["file"] for r in due.collect()}, {r["file"] for r in later.collect()}) == (want, rest)


def test_files_passed_over_as_too_old_are_on_record(spark, scanner, write):
    options, run = scanner
    write(name(1), flow_file(flow("198.51.100.7", 1)))
    run(options())
    old = write(name(2), flow_file(flow("198.51.100.7", 2)))
    os.utime(old, (T0 - 10**6, T0 - 10**6))
    for _ in range(2):
        run(options())
    o = options()
    assert [r["file"].rsplit("/", 1)[1] for r in ticks.read_table(spark, o, "skipped").collect()] == [name(2).rsplit("/", 1)[1]]
    assert values(spark, o, "records_read_total")[-1] == 1.0


def test_lines_lie_in_order_of_event_time(spark, scanner, write):
    options, run = scanner
    write(name(1), flow_file(*[flow("198.51.100.7", p, t=T0 + (p * 37) % 100) for p in range(1, 60)]))
    o = options(thresholds={"scan_ports": 20})
    run(o)
    for part in (r[0] for r in ticks.read_table(spark, o, "lines").select(F.input_file_name()).distinct().collect()):
        rows = [(",".join(f"{k}={v}" for k, v in sorted(r["labels"].items())), r["at"]) for r in spark.read.parquet(part).collect()]
        assert rows == sorted(rows)
    kinds = {r["kind"]: r["count"] for r in ticks.read_table(spark, o, "lines").groupBy("kind").count().collect()}
    assert kinds == {"flow": 59, "finding": 1}


def test_every_family_runs_a_tick(spark, scanner, write, tmp_path):
    options, run = scanner
    iso = NOW - timedelta(hours=1)
    alb = f'https {iso:%Y-%m-%dT%H:%M:%S}.5Z app/web/1 203.0.113.1:5000 10.0.0.1:80 0.1 0.2 0.1 502 - 10 20 "GET https://a.example:443/x/12?q HTTP/1.1" "ua" - TLSv1 - "-" "-" "-" 0 - "forward" "-" "-"'
    conn = f'{iso:%Y-%m-%dT%H:%M:%S}Z 203.0.113.1 5000 443 - - - "-" - - - TID - app/web/1'
    lb = "in/111_elasticloadbalancing_us-east-1_app.web.1_x.log.gz"
    write(lb, alb + "\n")
    write(lb.replace("in/", "in/conn_log_"), conn + "\n")
    o = options()
    run(o, families.LOAD_BALANCER)
    merged = ticks.report(spark, families.LOAD_BALANCER, o)
    assert merged["totals"].first()["errors_5xx"] == 1 and merged["conn_totals"].first()["handshake_failed"] == 1
    assert merged["timeline"].first()["conn_errors"] == 1
    assert "findings" not in merged


def test_merged_rules_equal_rules_over_all_records(spark):
    """Summaries of parts judged together give the findings of one scan."""
    from logloom.plans.fixtures import Tables
    from logloom.session import configure

    t = Tables(configure(spark), "/root/testdata/sf0.001")
    for family, table, ts, th in (
        (families.WAF, t.waf_requests, "ts", {"block_threshold": 5}),
        (families.OBJECTS, t.object_requests, "ts", {"denied_threshold": 10, "delete_threshold": 5, "egress_bytes": 1 << 20}),
        (families.FLOWS, t.flows, "start", {"egress_bytes": 1 << 20}),
    ):
        parts = [family.summarise({"records": table.where(F.day(ts) % 2 == i)}) for i in (0, 1)]
        merged = {n: m(parts[0][n].unionByName(parts[1][n])) for n, m in family.merge.items()}
        got = sorted(map(tuple, family.judge(merged, th).collect()), key=repr)
        want = sorted(map(tuple, family.findings({"records": table}, th).collect()), key=repr)
        assert got == want and got


def waf_line(k):
    return '{"timestamp":%d,"action":"ALLOW","webaclId":"arn:aws:wafv2:us-east-1:1:regional/webacl/a/id","httpRequest":{"clientIp":"192.0.2.%d"}}' % (T0 * 1000 + k, k % 200)


def test_line_files_heal_and_damaged_ones_give_no_line(spark, scanner, write):
    options, run = scanner
    text = "\n".join(waf_line(k) for k in range(5000))
    good = gzip.compress(text.encode())
    cut = write("in/cut.gz", good[: len(good) * 3 // 4])
    write("in/whole.gz", text)
    write("in/a+b%20c [d] {e}.gz", waf_line(1) + "\r\n\n{not json\n")
    write("in/plain.gz", (waf_line(2) + "\n").encode())  # no gzip under its name
    write("in/two.gz", gzip.compress(waf_line(3).encode()[:40]) + gzip.compress(waf_line(3).encode()[40:] + b"\n" + waf_line(4).encode()))
    o = options()
    run(o, families.WAF)
    first = ticks.ticks(spark, o).first()
    assert (first["result"], first["errors"], first["objects"], first["records_read"]) == ("partial", 1, 4, 5004)
    assert [(r["bad"], "d%5D" in r["file"] or "[d]" in r["file"]) for r in ticks.read_table(spark, o, "bad/records").collect()] == [(1, True)]
    with open(cut, "wb") as f:
        f.write(good)
    run(o, families.WAF)
    second = ticks.ticks(spark, o).orderBy(F.desc("batch_id")).first()
    assert (second["result"], second["errors"], second["objects"], second["records_read"]) == ("ok", 0, 1, 5000)


@pytest.mark.parametrize("family", [families.WAF, families.OBJECTS], ids=lambda f: f.name)
def test_files_longer_than_a_row_can_hold_are_read(spark, scanner, write, family):
    """2.2 GB of text under a name that Spark decompresses by, and under one it does not."""
    options, run = scanner
    at = NOW - timedelta(hours=1)
    line = waf_line(1) if family is families.WAF else f'o bkt [{at:%d/%b/%Y:%H:%M:%S} +0000] 192.0.2.3 - R1 REST.GET.OBJECT a "GET /a HTTP/1.1" 200 - 1 - 1 - "-" "ua" -'
    blank = gzip.compress((b" " * (1 << 20) + b"\n") * 64, 1) * 33
    write("in/long.gz" if family is families.WAF else "in/2026-09-20-11-00-00-ABC", gzip.compress(f"{line}\n".encode()) + blank + gzip.compress(line.encode()))
    o = options()
    run(o, family)
    tick = ticks.ticks(spark, o).first()
    assert (tick["result"], tick["objects"], tick["records_read"], tick["records_matched"]) == ("ok", 1, 2, 2)


def test_damaged_files_are_found_without_rows_that_hold_files(spark, write, monkeypatch):
    good = gzip.compress("\n".join(waf_line(k) for k in range(2000)).encode())
    for k in range(5):
        write(f"in/whole-{k}.gz", good)
    for k in (1, 3):
        write(f"in/cut-{k}.gz", good[: len(good) * k // 4])
    folder = os.path.dirname(write("in/stored", good))  # gzip data under a name that Spark does not decompress by
    paths = sorted(r["path"] for r in spark.read.format("binaryFile").load(folder).select("path").collect())
    mixed = paths[::2] + paths[1::2]
    monkeypatch.setattr(lines, "count_lines", lambda raw: pytest.fail("a row holds a file"))
    assert lines.whole_files(spark, mixed) == [p for p in mixed if "whole" in p] and len(mixed) == 8
    assert lines.whole_files(spark, paths[:2]) == []


def test_stored_files_are_decoded_without_rows_that_hold_files(spark, write):
    """Parts of many splits come together in order, the last line feed of the stored bytes among them; contents are never read as one row."""
    text = "".join(f"{k * 7919 % 100003}\n" for k in range(40000))
    names = {"in/stored": gzip.compress(text.encode()), "in/two": gzip.compress(b"a\nb") * 2, "in/plain.gz": text.encode()[:-1],
             "in/feeds.gz": b"\n\n", "in/cut": gzip.compress(text.encode())[:-9], "in/cut.gz": gzip.compress(text.encode())[:-1], "in/one.gz": b"\x1f"}
    wrong = gzip.compress(b"x" * 10)[:-4] + b"\n\n\n\n"  # a wrong length at the end
    folder = {os.path.dirname(write(name, data)) for name, data in names.items()}.pop()
    write("in/long.gz", wrong)
    raw = spark.read.format("binaryFile").load(folder).select("path", F.raise_error(F.lit("a row holds a file")).cast("binary").alias("content"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        found = {r["file"]: (r["n"], r["err"]) for r in lines.count_lines(raw).collect()}
        bad = (0, "corrupt gzip data")
        assert {p.rpartition("/")[2]: v for p, v in found.items()} == {
            "stored": (40000, None), "two": (3, None), "plain.gz": (40000, None), "feeds.gz": (2, None), "cut": bad, "cut.gz": bad,
            "one.gz": (1, None), "long.gz": bad}
        read = lines.decode_lines(spark, [p for p, (_, err) in found.items() if err is None]).orderBy("file", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    of = lambda name: [r["line"] for r in read if r["file"].endswith("/" + name)]
    assert ([x for x in of("stored") if x], of("plain.gz")) == (text.split("\n")[:-1], text.split("\n")[:-1])
    assert (of("two"), [x for x in of("feeds.gz") if x]) == (["a", "ba", "b"], [])
