"""Rolling-scanner queries: derived tables as log files, read in several ticks."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators import history, lines, metrics
from logloom.plans import object_queries as ob
from logloom.plans import render
from logloom.plans import source_queries as s
from logloom.plans import sqlparts as q
from logloom.plans import waf_queries as w
from logloom.plans.registry import Query
from logloom.session import shared_dir
from logloom.streaming import families, ticks

# The derived records lie in January 2024.
NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
LOOKBACK = timedelta(days=32)

READ = f"(SELECT * REPLACE (date_trunc('millisecond', ts) AS ts) FROM {s.WAF_ROWS} WHERE NOT ({s.WAF_BAD}))"


#: Orders, and so object requests, lie between 1995 and 2001.
OBJECT_NOW, OBJECT_LOOKBACK = datetime(2010, 1, 1, tzinfo=timezone.utc), timedelta(days=9125)


def _waf_scan(t) -> ticks.Options:
    """Write the rendered log as files, scan them two at a time, and return where the results lie."""
    o = _options(t, max_files=2, thresholds={"block_threshold": w.T})
    s.waf_text(t).repartition(4).select("line").write.option("compression", "gzip").text(o.source)
    ticks.start(t.spark, families.WAF, o).awaitTermination()
    return o


def _options(t, **more) -> ticks.Options:
    root = f"{shared_dir(t.spark)}/scan-{uuid.uuid4().hex}"
    base = {"source": f"{root}/in", "tables": f"{root}/out", "checkpoint": f"{root}/checkpoint", "lookback": LOOKBACK, "once": True, "clock": lambda: NOW}
    return ticks.Options(**(base | more))


def _hadoop(t, path: str):
    p = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(t.spark._jsc.hadoopConfiguration()), p


def _deliver(t, rows: DataFrame, path: str) -> None:
    """One delivered file of a name that a reader knows: written by Spark, then moved there."""
    parts = f"{path}.parts-{uuid.uuid4().hex}".replace("/in/", "/parts/")
    rows.select("line").coalesce(1).write.option("compression", "gzip").text(parts)
    fs, folder = _hadoop(t, parts)
    fs.mkdirs(_hadoop(t, path)[1].getParent())
    for found in fs.listStatus(folder):
        if found.getPath().getName().startswith("part-"):
            fs.rename(found.getPath(), _hadoop(t, path)[1])


def _tick(t, family: families.Family, o: ticks.Options) -> None:
    ticks.start(t.spark, family, o).awaitTermination()


def _half(t, k: int) -> DataFrame:
    return s.waf_text(t).where(F.col("pos") % 2 == k)


def _waf_halves(t, **more) -> ticks.Options:
    """Records of even and of odd numbers, each in a tick of its own."""
    o = _options(t, max_files=1, thresholds={"block_threshold": w.T}, **more)
    for k in (0, 1):
        _deliver(t, _half(t, k), f"{o.source}/half-{k}.gz")
    _tick(t, families.WAF, o)
    return o


def _lb_scan(t) -> ticks.Options:
    """Application-balancer requests and connections, half of each in a tick."""
    o = _options(t, max_files=2)
    requests, connections = s.lb_text(t).where(F.contains("file", F.lit("_app.web."))), s.conn_text(t)
    tail = render.LB_TAIL.replace(".log.gz", "")
    for k in (0, 1):
        _deliver(t, requests.where(F.col("pos") % 2 == k), f"{o.source}/{render.LB_HEAD}app.web.0123{tail}{k}.log.gz")
        _deliver(t, connections.where(F.col("pos") % 2 == k), f"{o.source}/{render.LB_HEAD.replace('/111122223333_', '/conn_log_111122223333_')}app.web.0123{tail}{k}.log.gz")
    _tick(t, families.LOAD_BALANCER, o)
    return o


def _object_scan(t) -> ticks.Options:
    """Object requests in two ticks, 15 minutes apart."""
    o = _options(t, max_files=1, lookback=OBJECT_LOOKBACK, clock=lambda: OBJECT_NOW)
    for k in (0, 1):
        _deliver(t, s.object_text(t).where(F.col("pos") % 2 == k), f"{o.source}/logs/111122223333/us-east-1/bkt/2024/01/01/2024-01-01-00-0{k}-00-ABCDEF")
        _tick(t, families.OBJECTS, replace(o, clock=lambda k=k: OBJECT_NOW + timedelta(minutes=15 * k)))
    return o


def _once(scan: Callable) -> Callable:
    """Queries on one finished scan share it: it is made once per session and input."""
    made: dict[tuple, ticks.Options] = {}

    def shared(t) -> ticks.Options:
        key = (t.spark.sparkContext.applicationId, t.sf_dir)
        if key not in made:
            made[key] = scan(t)
        return made[key]

    return shared


scanned, lb_scan, object_scan, waf_halves = _once(_waf_scan), _once(_lb_scan), _once(_object_scan), _once(_waf_halves)


def _snapshot(t, family: families.Family, o: ticks.Options, *names: str) -> DataFrame:
    """The newest value of each series of the scanner's metric history."""
    m = ticks.tick_history(t.spark, family, o).where(F.col("name").isin(*[metrics.PREFIX + n for n in names]))
    return m.withColumn("labels", lines.labels_text(F.col("labels"))).groupBy("name", "labels").agg(F.max("value").alias("value"))


def _quiet(t) -> DataFrame:
    """Two more ticks on a folder without new files."""
    o = _options(t)
    _deliver(t, _half(t, 0), f"{o.source}/half.gz")
    for k in range(3):
        _tick(t, families.WAF, replace(o, clock=lambda k=k: NOW + timedelta(minutes=15 * k)))
    success = ticks.tick_history(t.spark, families.WAF, o).where(F.col("name") == metrics.PREFIX + "last_success_timestamp_seconds")
    quiet = ticks.ticks(t.spark, o).agg(F.count_if(F.expr("objects = 0 AND result = 'ok'")).alias("quiet"), F.sum("records_read").alias("records"))
    return quiet.join(success.agg((F.max("value") - F.min("value")).alias("moved_seconds")))


def _sink_down(_frames, _batch) -> None:
    raise ConnectionError("the sink does not answer")


def _repeated(t) -> DataFrame:
    """A tick whose delivery fails commits nothing and is repeated under its number."""
    o = _options(t)
    _deliver(t, _half(t, 0), f"{o.source}/half.gz")
    try:
        _tick(t, families.WAF, replace(o, after_write=_sink_down))
    except StreamingQueryException:
        pass
    before = ticks.ticks(t.spark, o).count()
    _tick(t, families.WAF, o)
    done = ticks.ticks(t.spark, o).agg(F.sum("objects").alias("objects"), F.sum("records_matched").alias("matched"))
    failed = ticks.failed_ticks(t.spark, o).agg(F.count("*").alias("failed"))
    written = ticks.read_table(t.spark, o, "lines").agg(F.count_if(F.expr("kind = 'request'")).alias("lines"))
    return done.join(failed).join(written).withColumn("committed_before", F.lit(before))


def _retained(t) -> DataFrame:
    """A tick after the lookback: the first tick's state is gone, its lines and the running totals are there."""
    o = _options(t)
    for k in (0, 1):
        _deliver(t, _half(t, k), f"{o.source}/half-{k}.gz")
        _tick(t, families.WAF, replace(o, clock=lambda k=k: NOW + k * (LOOKBACK + timedelta(days=1))))
    left = ticks.ticks(t.spark, o).agg(F.count("*").alias("ticks"), F.sum("records_read").alias("read_in_window"))
    total = _snapshot(t, families.WAF, o, "records_read_total").select(F.col("value").cast("bigint").alias("read_total"))
    written = ticks.read_table(t.spark, o, "lines").agg(F.count_if(F.expr("kind = 'request'")).alias("lines"))
    return left.join(total).join(written)


def _healed(t) -> DataFrame:
    """A file that is cut on its first try and whole on its second, beside one that is whole."""
    o = _options(t)
    _deliver(t, s.waf_text(t).where("pos >= 200"), f"{o.source}/whole.gz")
    # A few lines, the bytes of one small file.
    data = gzip.compress("\n".join(r["line"] for r in s.waf_text(t).where("pos < 200").select("line").collect()).encode())
    for content in (data[: len(data) // 2], data):
        fs, path = _hadoop(t, f"{o.source}/cut.gz")
        out = fs.create(path, True)
        out.write(bytearray(content))
        out.close()
        _tick(t, families.WAF, o)
    rows = ticks.ticks(t.spark, o).select("result", "objects", "errors", "records_read")
    return rows.withColumn("waiting", F.lit(ticks.pending_files(t.spark, o, 1 << 40).count()))


def _inversions(t) -> DataFrame:
    """Lines that lie before an earlier one of their stream and file."""
    rows = ticks.read_table(t.spark, waf_halves(t), "lines").where("kind = 'request'").select(
        "at", lines.labels_text(F.col("labels")).alias("stream"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("k"))
    before = F.lag("at").over(Window.partitionBy("file", "stream").orderBy("k"))
    return rows.withColumn("before", before).agg(F.count("*").alias("lines"), F.count_if(F.col("at") < F.col("before")).alias("inversions"))


def _ticks(t):
    o = scanned(t)
    return ticks.ticks(t.spark, o).agg(
        F.sum("objects").alias("objects"), F.sum("records_read").alias("records_read"), F.sum("records_matched").alias("records_matched"),
        F.sum("errors").alias("errors"), F.count_if(F.col("result") == "ok").alias("ok"), F.count("*").alias("n"),
    ).withColumn("all_ok", F.col("ok") == F.col("n")).drop("ok", "n")


def _history(t):
    m = ticks.tick_history(t.spark, families.WAF, scanned(t))
    return m.groupBy("name", lines.labels_text(F.col("labels")).alias("labels")).agg(F.max("value").alias("value")).where(
        F.col("name").isin(*[metrics.PREFIX + n for n in ("objects_scanned_total", "records_read_total", "records_matched_total", "scan_errors_total")])
    )


OBJECT_READ = f"(SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM {s.OBJECT_ROWS} WHERE o_orderkey % 50 <> 3)"
OBJECT_DIMS = {k: v for k, v in ob.DIMS.items() if k in ("operation", "status", "error_code", "bucket")}
_LATENCY = "round(request_time + target_time + response_time + 1e-9, 6)"
LB_REPORT = (
    f"WITH r AS (SELECT *, {_LATENCY} AS v FROM lb_requests WHERE kind = 'alb'), "
    "h AS (SELECT target, bool_or(coalesce(target_status LIKE '5%', false)) AS bad FROM r WHERE target IS NOT NULL GROUP BY target) "
    "SELECT count(*) AS requests, count(v) AS latency_count, round(avg(v) + 1e-9, 6) AS latency_avg, round(max(v) + 1e-9, 6) AS latency_max, "
    "count(target_time) AS target_time_count, round(max(target_time) + 1e-9, 6) AS target_time_max, "
    "(SELECT count(*) FROM h WHERE bad) AS bad, (SELECT count(*) FROM h) AS seen FROM r"
)


def _lb_report(t) -> DataFrame:
    """One row of a merged balancer report: totals, latency and target health over both ticks."""
    m = ticks.report(t.spark, families.LOAD_BALANCER, lb_scan(t))
    latency = m["latency"].select("latency_count", "latency_avg", "latency_max", "target_time_count", "target_time_max")
    return m["totals"].select("requests").join(latency).join(m["target_health"])


def queries() -> dict[str, Query]:
    counters = q.counters("waf_read", {k: v for k, v in w.DIMS.items() if k in ("action", "acl", "country", "client_ip", "label", "count_rule")})
    counters = counters.replace("waf_requests", "waf_read")
    return {
        "str_01_02_03": Query(
            _ticks, f"SELECT 4 AS objects, count(*) AS records_read, count(*) AS records_matched, 0 AS errors, true AS all_ok FROM {READ}"
        ),
        "str_05": Query(
            _history,
            "SELECT 'logloom_' || k AS name, 'subcommand=waf' AS labels, CAST(v AS DOUBLE) AS value FROM (SELECT unnest(['objects_scanned_total', 'records_read_total', 'records_matched_total', 'scan_errors_total']) AS k, "
            f"unnest([4, n, n, 0]) AS v FROM (SELECT count(*) AS n FROM {READ}))",
        ),
        "str_06": Query(
            lambda t: ticks.report(t.spark, families.WAF, replace(scanned(t), cap=500))["findings"],
            f"WITH waf_read AS {READ} " + q.capped(w.ALL_SQL.replace("waf_requests", "waf_read"), 500),
        ),
        "str_06_counters": Query(
            lambda t: ticks.report(t.spark, families.WAF, scanned(t))["counters"].where(
                F.col("dim").isin("action", "acl", "country", "client_ip", "label", "count_rule")
            ),
            f"WITH waf_read AS {READ} {counters}",
        ),
        "str_11": Query(
            lambda t: ticks.read_table(t.spark, scanned(t), "bad/records").agg(F.sum("bad").alias("bad")),
            f"SELECT count(*) AS bad FROM {s.WAF_ROWS} WHERE {s.WAF_BAD}",
        ),
        "str_02": Query(_quiet, f"SELECT 2 AS quiet, count(*) AS records, CAST(1800 AS DOUBLE) AS moved_seconds FROM {READ} WHERE event_id % 2 = 0"),
        "str_04": Query(
            _repeated,
            f"SELECT 1 AS objects, count(*) AS matched, 1 AS failed, count(*) AS lines, 0 AS committed_before FROM {READ} WHERE event_id % 2 = 0",
        ),
        "str_07": Query(
            lambda t: ticks.read_table(t.spark, waf_halves(t), "findings").drop("batch_id"),
            " UNION ALL ".join(f"SELECT * FROM (WITH waf_read AS (SELECT * FROM {READ} WHERE event_id % 2 = {k}) {w.ALL_SQL.replace('waf_requests', 'waf_read')})" for k in (0, 1)),
        ),
        "str_08": Query(
            _retained,
            f"SELECT 1 AS ticks, count(*) FILTER (event_id % 2 = 1) AS read_in_window, count(*) AS read_total, count(*) FILTER (event_id % 2 = 0) AS lines FROM {READ}",
        ),
        "str_09": Query(
            _healed,
            f"SELECT 'partial' AS result, 1 AS objects, 1 AS errors, count(*) FILTER (event_id >= 200) AS records_read, 0 AS waiting FROM {READ} "
            f"UNION ALL SELECT 'ok', 1, 0, count(*) FILTER (event_id < 200), 0 FROM {READ}",
        ),
        "str_10": Query(_inversions, f"SELECT count(*) AS lines, 0 AS inversions FROM {READ}"),
        "str_06_lb": Query(_lb_report, LB_REPORT),
        "str_06_connections": Query(
            lambda t: ticks.report(t.spark, families.LOAD_BALANCER, lb_scan(t))["handshake"],
            "SELECT count(tls_handshake_time) AS handshake_count, round(sum(tls_handshake_time) + 1e-9, 6) AS handshake_sum, round(min(tls_handshake_time) + 1e-9, 6) AS handshake_min, "
            "round(max(tls_handshake_time) + 1e-9, 6) AS handshake_max, round(avg(tls_handshake_time) + 1e-9, 6) AS handshake_avg FROM lb_connections",
        ),
        "str_06_objects": Query(
            lambda t: ticks.report(t.spark, families.OBJECTS, object_scan(t))["counters"].where(F.col("dim").isin(*OBJECT_DIMS)),
            f"WITH object_read AS {OBJECT_READ} " + q.counters("object_read", OBJECT_DIMS),
        ),
        "str_06_matches": Query(
            lambda t: ticks.report(t.spark, families.OBJECTS, replace(object_scan(t), max_events=100))["matches_records"].select("ts"),
            f"SELECT ts FROM {OBJECT_READ} ORDER BY ts LIMIT 100",
        ),
        "str_06_scan": Query(
            lambda t: ticks.report(t.spark, families.OBJECTS, object_scan(t))["scan"].drop("duration"),
            f"SELECT 2 AS objects, count(*) AS records_read, count(*) AS records_matched, 0 AS errors FROM {OBJECT_READ}",
        ),
        "snk_14_waf": Query(
            lambda t: _snapshot(t, families.WAF, waf_halves(t), "waf_requests_total", "waf_findings_total"),
            f"SELECT 'logloom_waf_requests_total' AS name, 'action=' || a.action || ',subcommand=waf' AS labels, CAST(count(f.action) AS DOUBLE) AS value FROM "
            f"(VALUES ('ALLOW'), ('BLOCK'), ('COUNT'), ('CAPTCHA'), ('CHALLENGE')) a(action) LEFT JOIN {READ} f USING (action) GROUP BY a.action "
            "UNION ALL SELECT 'logloom_waf_findings_total', 'severity=' || lower(s.severity) || ',subcommand=waf', CAST(count(f.severity) AS DOUBLE) FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) s(severity) LEFT JOIN ("
            + " UNION ALL ".join(f"SELECT severity FROM (WITH waf_read AS (SELECT * FROM {READ} WHERE event_id % 2 = {k}) {w.ALL_SQL.replace('waf_requests', 'waf_read')})" for k in (0, 1))
            + ") f ON f.severity = s.severity GROUP BY s.severity",
        ),
        "snk_14_lb": Query(
            lambda t: _snapshot(t, families.LOAD_BALANCER, lb_scan(t), "elb_requests_total", "elb_received_bytes_total", "elb_sent_bytes_total",
                                "elb_latency_seconds_count", "elb_conns_total", "elb_conns_tls_total", "elb_tls_handshake_seconds_count"),
            "WITH r AS (SELECT * FROM lb_requests WHERE kind = 'alb') "
            "SELECT 'logloom_elb_requests_total' AS name, 'status_class=' || s.c || ',subcommand=elb' AS labels, CAST(count(r.elb_status) AS DOUBLE) AS value FROM (VALUES ('2xx'), ('3xx'), ('4xx'), ('5xx'), ('other')) s(c) "
            "LEFT JOIN r ON s.c = CASE WHEN regexp_matches(r.elb_status, '^[2-5]..$') THEN substr(r.elb_status, 1, 1) || 'xx' ELSE 'other' END GROUP BY s.c "
            + "".join(f"UNION ALL SELECT 'logloom_elb_{n}', 'subcommand=elb', CAST({v} AS DOUBLE) FROM {f} " for n, v, f in (
                ("received_bytes_total", "sum(received_bytes)", "r"), ("sent_bytes_total", "sum(sent_bytes)", "r"),
                ("latency_seconds_count", "count(request_time + target_time + response_time)", "r"), ("conns_total", "count(*)", "lb_connections"),
                ("conns_tls_total", "count(ssl_protocol)", "lb_connections"), ("tls_handshake_seconds_count", "count(tls_handshake_time)", "lb_connections"),
            )),
        ),
        "snk_14_objects": Query(
            lambda t: _snapshot(t, families.OBJECTS, object_scan(t), "s3_requests_total", "s3_bytes_sent_total"),
            f"SELECT 'logloom_s3_requests_total' AS name, 'status_class=' || s.c || ',subcommand=s3' AS labels, CAST(count(r.bucket) AS DOUBLE) AS value FROM (VALUES ('2xx'), ('3xx'), ('4xx'), ('5xx'), ('other')) s(c) "
            f"LEFT JOIN (SELECT bucket, {ob.CLASS} AS k FROM {OBJECT_READ}) r ON r.k = s.c GROUP BY s.c "
            f"UNION ALL SELECT 'logloom_s3_bytes_sent_total', 'subcommand=s3', CAST(sum(bytes_sent) AS DOUBLE) FROM {OBJECT_READ}",
        ),
        "met_02_ticks": Query(
            lambda t: history.increased(history.select(ticks.tick_history(t.spark, families.OBJECTS, object_scan(t)), f"{metrics.PREFIX}records_read_total"), 3600).select("increase"),
            f"SELECT CAST(count(*) AS DOUBLE) AS increase FROM {OBJECT_READ} WHERE o_orderkey % 2 = 1",
        ),
        "snk_08": Query(_written, f"SELECT 'request' AS kind, count(*) AS n FROM waf_requests UNION ALL SELECT 'finding', count(*) FROM ({w.ALL_SQL})"),
    }


def _written(t):
    """Lines and findings written as JSON Lines and read back."""
    path = f"{shared_dir(t.spark)}/jsonl-{uuid.uuid4().hex}"
    found = lines.finding_lines(w.findings(t), "run", "waf")
    lines.fan_out(lines.waf_lines(t.waf_requests, "run"), lambda df: lines.write_jsonl(df, path, found))
    return t.spark.read.text(path).groupBy("kind").agg(F.count("*").alias("n"))
