"""Metric-history, tick-counter and line queries. One hour of derived records is one tick."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators import history as h
from logloom.operators import lines, metrics
from logloom.plans.registry import Query

H = 3600
W, HOLD = 6 * H, 3 * H


def _hour(c: str):
    return F.date_trunc("hour", c)


def waf_history(t):
    """Cumulative web-firewall requests per hour, action and scanner."""
    deltas = metrics.dense_ticks(
        t.waf_requests, _hour("ts"), F.col("action"), "waf_requests_total", "action", metrics.WAF_ACTIONS, pod=F.col("web_acl")
    )
    return metrics.cumulative(deltas)


def lb_history(t):
    """Cumulative load-balancer requests per hour, status class and scanner."""
    deltas = metrics.dense_ticks(
        t.lb_requests, _hour("ts"), d.metric_status_class(F.col("elb_status")), "elb_requests_total", "status_class",
        metrics.STATUS_CLASSES, pod=F.col("lb"),
    )
    return metrics.cumulative(deltas)


def latency_history(t):
    """Cumulative latency sum and count per hour and scanner."""
    v = F.col("latency")
    ticks = t.lb_requests.groupBy(_hour("ts").alias("at"), F.col("lb").alias("pod")).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.count(v).cast("double").alias("c")
    )
    rows = F.array(
        F.struct(F.lit("latency_sum").alias("name"), F.col("s").alias("value")),
        F.struct(F.lit("latency_count").alias("name"), F.col("c").alias("value")),
    )
    return metrics.cumulative(ticks.select("at", F.create_map(F.lit("pod"), F.col("pod")).alias("labels"), F.inline(rows)))


def ticks(t):
    """Tick table: one scan per hour and web ACL, with a result that depends on its size."""
    n = F.count("*")
    return t.waf_requests.groupBy(F.col("web_acl").alias("subcommand"), _hour("ts").alias("at")).agg(
        F.when(n % 4 == 0, "failed").when(n % 4 == 1, "partial").otherwise("ok").alias("result"),
        F.countDistinct("host").alias("objects"), n.alias("records_read"), F.count_if(F.col("action") == "BLOCK").alias("records_matched"),
        F.when(n % 4 == 1, 1).otherwise(0).alias("errors"), (n / 10).alias("duration"), F.lit(3600.0).alias("interval"),
        F.lit(86400.0).alias("lookback"), n.alias("seen"),
    )


def tick_metrics(t):
    """Tick counters with the running scanners' ``up`` series."""
    m = metrics.tick_counters(ticks(t))
    up = ticks(t).select(
        F.lit("up").alias("name"), F.lit("gauge").alias("type"), F.create_map(F.lit("subcommand"), F.col("subcommand")).alias("labels"),
        F.lit(1.0).alias("value"), "at",
    )
    return m.unionByName(up)


P = metrics.PREFIX


def _dense(table: str, key: str, label_values, pod: str, label: str, name: str) -> str:
    values = ", ".join(f"('{v}')" for v in label_values)
    return (
        f"SELECT '{P}{name}' AS name, x.v AS {label}, k.pod, k.at, sum(count(r.at)) OVER (PARTITION BY x.v, k.pod ORDER BY k.at) AS value FROM "
        f"(SELECT DISTINCT date_trunc('hour', ts) AS at, {pod} AS pod FROM {table}) k CROSS JOIN (VALUES {values}) x(v) "
        f"LEFT JOIN (SELECT date_trunc('hour', ts) AS at, {pod} AS pod, {key} AS v FROM {table}) r ON r.at = k.at AND r.pod = k.pod AND r.v = x.v GROUP BY x.v, k.pod, k.at"
    )


WAF_HIST = _dense("waf_requests", "action", metrics.WAF_ACTIONS, "web_acl", "action", "waf_requests_total")
CLASS = "CASE WHEN regexp_matches(elb_status, '^[2-5]..$') THEN substr(elb_status, 1, 1) || 'xx' ELSE 'other' END"
LB_HIST = _dense("lb_requests", CLASS, metrics.STATUS_CLASSES, "lb", "status_class", "elb_requests_total")


def _increase(hist: str, keys: str, seconds: int = W) -> str:
    return (
        f"SELECT *, sum(delta) OVER (PARTITION BY {keys} ORDER BY at RANGE BETWEEN INTERVAL {seconds - 1} SECOND PRECEDING AND CURRENT ROW) AS increase FROM "
        f"(SELECT *, coalesce(CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END, 0) AS delta FROM ({hist}) WINDOW w AS (PARTITION BY {keys} ORDER BY at))"
    )


def _held(rows: str, cond: str, keys: str, hold: int = HOLD) -> str:
    return (
        f"SELECT * FROM (SELECT *, min(at) FILTER (c) OVER (PARTITION BY {keys}, breaks) AS began FROM "
        f"(SELECT *, count(*) FILTER (NOT c) OVER (PARTITION BY {keys} ORDER BY at) AS breaks FROM (SELECT *, coalesce({cond}, false) AS c FROM ({rows})))) "
        f"WHERE c AND epoch(at) - epoch(began) >= {hold}"
    )


LAT_HIST = (
    "SELECT lb AS pod, at, sum(s) OVER w AS s, sum(c) OVER w AS c FROM (SELECT lb, date_trunc('hour', ts) AS at, coalesce(sum(request_time + target_time + response_time), 0) AS s, "
    "count(request_time + target_time + response_time) AS c FROM lb_requests GROUP BY 1, 2) WINDOW w AS (PARTITION BY lb ORDER BY at)"
)
TICKS = (
    "SELECT web_acl AS subcommand, date_trunc('hour', ts) AS at, CASE count(*) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'ok' END AS result, count(DISTINCT host) AS objects, count(*) AS n, "
    "count(*) FILTER (action = 'BLOCK') AS matched, CASE WHEN count(*) % 4 = 1 THEN 1 ELSE 0 END AS errors FROM waf_requests GROUP BY 1, 2"
)
RUN = (
    "SELECT subcommand, at, "
    + ", ".join(f"count(*) FILTER (result = '{r}') OVER w AS {r}" for r in metrics.SCAN_RESULTS)
    + ", "
    + ", ".join(
        f"CAST(sum(CASE WHEN result <> 'failed' THEN {c} ELSE 0 END) OVER w AS DOUBLE) AS {a}"
        for c, a in (("objects", "objects"), ("n", "records"), ("matched", "matched"), ("errors", "errors"))
    )
    + f", n / 10 AS duration, n AS seen, max(CASE WHEN result = 'ok' THEN epoch(at) END) OVER w AS success FROM ({TICKS}) WINDOW w AS (PARTITION BY subcommand ORDER BY at)"
)


def _tick_rows() -> str:
    rows = [(f"scans_total", "counter", r, f"'result={r},subcommand=' || subcommand") for r in metrics.SCAN_RESULTS]
    plain = "'subcommand=' || subcommand"
    rows += [
        ("objects_scanned_total", "counter", "objects", plain), ("records_read_total", "counter", "records", plain),
        ("records_matched_total", "counter", "matched", plain), ("scan_errors_total", "counter", "errors", plain),
        ("last_scan_timestamp_seconds", "gauge", "epoch(at)", plain), ("scan_duration_seconds", "gauge", "duration", plain),
        ("last_success_timestamp_seconds", "gauge", "success", plain), ("seen_keys", "gauge", "seen", plain),
        ("lookback_seconds", "gauge", "86400", plain), ("interval_seconds", "gauge", "3600", plain),
    ]
    parts = [
        f"SELECT '{P}{n}' AS name, '{k}' AS type, {lab} AS labels, CAST({v} AS DOUBLE) AS value, at FROM run" for n, k, v, lab in rows
    ]
    return f"WITH run AS ({RUN}) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


def _flat(df, *labels: str):
    """Label values as columns."""
    return df.select("name", *[F.try_element_at("labels", F.lit(k)).alias(k) for k in labels], "at", *[c for c in df.columns if c not in ("name", "labels", "at", "type")])


def queries() -> dict[str, Query]:
    # "at" is a keyword in newer SQL dialects.
    return {n: Query(q.run, re.sub(r"(?<![\w\"'])at(?![\w\"'(])", '"at"', q.sql)) for n, q in _queries().items()}


def _queries() -> dict[str, Query]:
    total, success, interval = f"{P}elb_requests_total", f"{P}last_success_timestamp_seconds", f"{P}interval_seconds"
    return {
        "snk_14": Query(
            lambda t: metrics.tick_counters(ticks(t)).select("name", "type", lines.labels_text(F.col("labels")).alias("labels"), "value", "at"), _tick_rows()
        ),
        "snk_14_family": Query(lambda t: _flat(waf_history(t), "action", "pod"), f"SELECT name, action, pod, at, CAST(value AS DOUBLE) AS value FROM ({WAF_HIST})"),
        "met_01": Query(
            lambda t: _flat(h.increased(h.select(waf_history(t), f"{P}waf_requests_total", action="BLOCK"), W), "action", "pod"),
            f"SELECT name, action, pod, at, CAST(value AS DOUBLE) AS value, CAST(increase AS DOUBLE) AS increase FROM ({_increase(WAF_HIST, 'action, pod')}) WHERE increase > 0 AND action = 'BLOCK'",
        ),
        "met_01_reset": Query(
            lambda t: _flat(h.increase(waf_history(t).withColumn("value", F.col("value") % 7), W), "action", "pod"),
            "SELECT name, action, pod, at, CAST(value AS DOUBLE) AS value, CAST(increase AS DOUBLE) AS increase FROM "
            f"({_increase(f'SELECT * REPLACE (value % 7 AS value) FROM ({WAF_HIST})', 'action, pod')})",
        ),
        "met_02": Query(
            lambda t: h.ratio_above(lb_history(t), total, {"status_class": "5xx"}, ["pod"], W, 0.05, HOLD),
            f"WITH i AS ({_increase(LB_HIST, 'status_class, pod')}), r AS (SELECT pod, at, sum(increase) FILTER (status_class = '5xx') / nullif(sum(increase), 0) AS ratio FROM i GROUP BY 1, 2) "
            f"SELECT pod, at, round(ratio + 1e-9, 6) AS ratio FROM ({_held('SELECT * FROM r', 'ratio > 0.05', 'pod')})",
        ),
        "met_03": Query(
            lambda t: h.stale(tick_metrics(t), success, interval, ["subcommand"], 3, HOLD),
            f"SELECT subcommand, at, CAST(age AS DOUBLE) AS age FROM ({_held(f'SELECT subcommand, at, epoch(at) - success AS age FROM ({RUN}) WHERE success IS NOT NULL', 'age > 3 * 3600', 'subcommand')})",
        ),
        "met_04": Query(
            lambda t: h.never_succeeded(
                tick_metrics(t).where(~((F.col("name") == success) & (F.hour("at") < 20))), "up", success, ["subcommand"], HOLD
            ),
            f"SELECT subcommand, at FROM ({_held(f'SELECT subcommand, at FROM ({RUN}) WHERE success IS NULL OR hour(at) < 20', 'true', 'subcommand')})",
        ),
        "met_05": Query(
            lambda t: h.positive(h.select(waf_history(t), f"{P}waf_requests_total")),
            f"SELECT name, 'action=' || action || ',pod=' || pod AS series, CAST(max(value) AS DOUBLE) AS value, max(at) AS at FROM ({WAF_HIST}) GROUP BY 1, 2 HAVING max(value) > 0",
        ),
        "met_05_overdue": Query(
            lambda t: h.overdue(tick_metrics(t), success, F.lit(1706745600), 26 * H),
            f"SELECT '{success}' AS name, 'subcommand=' || subcommand AS series, CAST(max(success) AS DOUBLE) AS value, max(at) AS at FROM ({RUN}) WHERE success IS NOT NULL GROUP BY 2 HAVING 1706745600 - max(success) > 26 * 3600",
        ),
        "met_05_absent": Query(
            lambda t: h.absent(tick_metrics(t), "no_such_metric").withColumn("name", F.lit("no_such_metric")).union(
                h.absent(tick_metrics(t), success).withColumn("name", F.lit(success))
            ),
            f"SELECT 'no_such_metric' AS name, true AS absent UNION ALL SELECT '{success}', true WHERE NOT EXISTS (SELECT 1 FROM ({RUN}) WHERE success IS NOT NULL)",
        ),
        "met_06_sum_by": Query(
            lambda t: h.by_labels(h.rate(lb_history(t), W), "rate", ["status_class"]),
            f"SELECT status_class, at, round(sum(increase) / {W} + 1e-9, 6) AS rate FROM ({_increase(LB_HIST, 'status_class, pod')}) GROUP BY 1, 2",
        ),
        "met_06_max_by": Query(
            lambda t: h.by_labels(h.select(tick_metrics(t), f"{P}scan_duration_seconds"), "value", ["subcommand"], F.max),
            f"SELECT subcommand, at, CAST(duration AS DOUBLE) AS value FROM ({RUN})",
        ),
        "met_06_mean": Query(
            lambda t: h.mean_of(latency_history(t), "latency_sum", "latency_count", ["pod"], W),
            "WITH d AS (SELECT pod, at, coalesce(s - lag(s) OVER w, 0) AS ds, coalesce(c - lag(c) OVER w, 0) AS dc FROM (" + LAT_HIST + ") WINDOW w AS (PARTITION BY pod ORDER BY at)), "
            f"i AS (SELECT pod, at, sum(ds) OVER f AS s, sum(dc) OVER f AS c FROM d WINDOW f AS (PARTITION BY pod ORDER BY at RANGE BETWEEN INTERVAL {W - 1} SECOND PRECEDING AND CURRENT ROW)) "
            "SELECT pod, at, CASE WHEN c > 0 THEN round(s / c + 1e-9, 6) END AS mean FROM i",
        ),
        "met_06_either": Query(
            lambda t: _flat(
                h.either(h.select(waf_history(t), f"{P}waf_requests_total", action="BLOCK"), waf_history(t).where(F.col("value") > 3)), "action", "pod"
            ),
            f"SELECT name, action, pod, at, CAST(value AS DOUBLE) AS value FROM ({WAF_HIST}) WHERE action = 'BLOCK' OR value > 3",
        ),
        "jon_05": Query(
            lambda t: h.never_succeeded(tick_metrics(t).where(~((F.col("name") == success) & (F.hour("at") < 12))), "up", success, ["subcommand"], 0),
            f"SELECT subcommand, at FROM ({RUN}) WHERE success IS NULL OR hour(at) < 12",
        ),
        "jon_06": Query(
            lambda t: h.stale(tick_metrics(t), success, interval, ["subcommand"], 0.5, 0),
            f"SELECT subcommand, at, CAST(epoch(at) - success AS DOUBLE) AS age FROM ({RUN}) WHERE epoch(at) - success > 1800",
        ),
        "met_07": Query(
            lambda t: h.query_lines(
                lines.lb_lines(t.lb_requests, "run"), {"job": "logloom", "subcommand": "elb", "kind": "request"},
                ["elb_status", "client_ip", "method", "path"], "%s %s %s %s", matches={"elb_status": "5.."},
            ),
            "SELECT ts AS at, elb_status || ' ' || client_ip || ' ' || method || ' ' || path AS text FROM lb_requests WHERE elb_status LIKE '5__'",
        ),
        "met_07_equals": Query(
            lambda t: h.query_lines(
                lines.object_lines(t.object_requests, "run"), {"subcommand": "s3", "status_class": "4xx"}, ["remote_ip", "requester", "operation", "key"],
                "%s %s %s %s", equals={"status": "403"},
            ),
            "SELECT ts AS at, remote_ip || ' ' || coalesce(requester, 'anonymous') || ' ' || operation || ' ' || coalesce(key, '') AS text FROM object_requests WHERE status = 403",
        ),
        "snk_07": Query(
            lambda t: lines.lb_lines(t.lb_requests, "run").unionByName(lines.object_lines(t.object_requests, "run"))
            .groupBy(lines.labels_text(F.col("labels")).alias("stream")).count(),
            "SELECT 'job=logloom,kind=request,lb=' || lb || ',subcommand=elb' AS stream, count(*) AS count FROM lb_requests GROUP BY 1 UNION ALL "
            "SELECT 'bucket=' || bucket || ',job=logloom,kind=request,status_class=' || CASE WHEN status BETWEEN 200 AND 599 THEN (status // 100) || 'xx' ELSE 'other' END || ',subcommand=s3', count(*) FROM object_requests GROUP BY 1",
        ),
        "snk_09": Query(
            lambda t: lines.by_event_time(lines.lb_lines(t.lb_requests, "run")).select("stream", "at", "kind"),
            "SELECT 'job=logloom,kind=request,lb=' || lb || ',subcommand=elb' AS stream, ts AS at, 'request' AS kind FROM lb_requests",
        ),
        "snk_11": Query(
            lambda t: lines.lb_lines(t.lb_requests, "20240101T000000Z-ab").groupBy(F.get_json_object("line", "$.run_id").alias("run_id")).count(),
            "SELECT '20240101T000000Z-ab' AS run_id, count(*) AS count FROM lb_requests",
        ),
    }
