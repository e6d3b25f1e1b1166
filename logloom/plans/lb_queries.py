"""Load-balancer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.functions import text
from logloom.operators import counters as c
from logloom.operators import filters, health, lb, lines, metrics, reports, series
from logloom.plans import sqlparts as q
from logloom.plans.registry import Query

R, K = "lb_requests", "lb_connections"
HOST = "coalesce(host, domain_name)"
PATH = q.normalized("path")
LATENCY = "(request_time + target_time + response_time)"
CONN_ERROR = "(coalesce(error_reason LIKE 'TargetConnection%', false) OR (elb_status = '502' AND target IS NOT NULL AND target_status IS NULL))"
FAILED = "(listener = '443' AND ssl_protocol IS NULL)"
WEAK = "ssl_protocol IN ('SSLv3', 'TLSv1', 'TLSv1.1')"

DIMS = {
    "lb": ("lb",), "type": ("type",), "elb_status": ("elb_status",), "target_status": ("target_status",),
    "host": (HOST,), "path": (PATH,), "client_ip": ("client_ip",), "user_agent": ("user_agent",),
    "target": ("target",), "method": ("method",), "tls_protocol": ("ssl_protocol",), "tls_cipher": ("ssl_cipher",),
    "error_reason": ("error_reason",), "action": ("actions",),
}
DIMS = {k: (*v, "TRUE") for k, v in DIMS.items()}
CONN_DIMS = {
    "lb": ("lb", "TRUE"), "listener": ("listener", "TRUE"),
    "listener_tls": ("listener || ' ' || coalesce(ssl_protocol, 'no TLS')", "TRUE"), "tls_protocol": ("ssl_protocol", "TRUE"),
    "tls_cipher": ("ssl_cipher", "TRUE"), "key_exchange": ("tls_key_exchange", "TRUE"),
    "verify_status": ("tls_verify_status", "TRUE"), "client_ip": ("client_ip", "TRUE"), "failed_client_ip": ("client_ip", FAILED),
}


def _digit(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, '^[1-5]..$') THEN CAST(substr({col}, 1, 1) AS BIGINT) ELSE 0 END"


def _classes(prefix: str, col: str, picks=range(6)) -> str:
    return ", ".join(
        f"count(*) FILTER ({_digit(col)} = {i}) AS {prefix}_{f'{i}xx' if i else 'none'}" for i in picks
    )


def _measured(v: str, p: str) -> str:
    return (
        f"count({v}) AS {p}_count, round(coalesce(sum({v}), 0), 6) AS {p}_sum, round(min({v}), 6) AS {p}_min, round(max({v}), 6) AS {p}_max"
    )


TIMELINE_BODY = (
    f"count(*) AS requests, {_classes('elb', 'elb_status')}, {_classes('target', 'target_status')}, "
    f"count(*) FILTER ({CONN_ERROR}) AS conn_errors, {_measured('target_time', 'target_time')}, {_measured(LATENCY, 'latency')}"
)
GROUPS = (
    f"SELECT target_group_arn, count(*) AS requests, {_classes('target', 'target_status')}, "
    f"count(*) FILTER ({_digit('elb_status')} = 5) AS elb_5xx, count(*) FILTER ({CONN_ERROR}) AS conn_errors, "
    f"{_measured('target_time', 'target_time')}, count(DISTINCT target) AS targets FROM lb_requests WHERE target_group_arn IS NOT NULL GROUP BY 1"
)
PATHS = (
    f"SELECT path, count(*) AS count, avg(v) AS avg, min(v) AS min, max(v) AS max FROM (SELECT {PATH} AS path, {LATENCY} AS v FROM lb_requests) "
    "WHERE v IS NOT NULL GROUP BY 1"
)
GRID = (
    "WITH span AS (SELECT CAST(floor(epoch(min(ts)) / 60) AS BIGINT) AS lo, CAST(floor(epoch(max(ts)) / 60) AS BIGINT) AS hi FROM lb_requests), "
    "st AS (SELECT lo, hi, (SELECT min(s) FROM (VALUES (1), (5), (15), (60), (360), (1440)) x(s) WHERE s = 1440 OR hi // s - lo // s + 1 <= 288) AS s FROM span), "
    "dense AS (SELECT s, unnest(range(lo // s, hi // s + 1)) * s AS m FROM st), "
    "b AS (SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) // st.s * st.s AS m, lb_requests.* FROM lb_requests, st), "
    f"agg AS (SELECT m, count(*) AS requests, {_classes('elb', 'elb_status')}, {_classes('target', 'target_status')}, count(*) FILTER ({CONN_ERROR}) AS conn_errors, "
    f"count(target_time) AS target_time_count, count({LATENCY}) AS latency_count, avg(target_time) AS target_time_avg, avg({LATENCY}) AS latency_avg, max({LATENCY}) AS latency_max FROM b GROUP BY m), "
    "buckets AS (SELECT make_timestamp(CAST(dense.m * 60000000 AS BIGINT)) AS bucket, CAST(dense.s AS BIGINT) AS step_minutes, "
    + ", ".join(
        f"coalesce({x}, 0) AS {x}" for x in (*lb.TIMELINE_SUMS, "target_time_count", "latency_count")
    )
    + ", round(target_time_avg + 1e-9, 6) AS target_time_avg, round(latency_avg + 1e-9, 6) AS latency_avg, round(latency_max, 6) AS latency_max FROM dense LEFT JOIN agg USING (m)) "
)


def _points(chart: str, entries) -> str:
    return " UNION ALL ".join(
        f"SELECT '{chart}' AS chart, bucket, '{name}' AS series, '{kind}' AS kind, '{tone}' AS tone, CAST({v} AS DOUBLE) AS value FROM buckets"
        for name, kind, tone, v in entries
    )


def _nonzero(points: str) -> str:
    return (
        "SELECT chart, bucket, series, kind, tone, value FROM (SELECT *, max(coalesce(value, 0) <> 0) OVER (PARTITION BY series) AS a "
        f"FROM ({points})) WHERE a OR kind <> 'class'"
    )


def _class_entries(p: str, rest: str):
    return [(rest, "class", "muted", f"{p}_none + {p}_1xx")] + [
        (n, "class", t, f"{p}_{n}") for n, t in (("2xx", "ok"), ("3xx", "info"), ("4xx", "warn"), ("5xx", "crit"))
    ]


REQUESTS_CHART = _points("requests", [("Requests", "bar", "accent", "requests"), ("Target response time (avg)", "line", "warn", "target_time_avg")])
ELB_CHART = _nonzero(_points("elb_status", _class_entries("elb", "Other")))
TARGET_CHART = _nonzero(
    _points("target_status", _class_entries("target", "No target response") + [("Target connection errors", "line", "crit", "conn_errors")])
)
LATENCY_CHART = _points("latency", [
    ("Latency (avg)", "line", "accent", "latency_avg"), ("Latency (max)", "line", "crit", "latency_max"),
    ("Target response time (avg)", "line", "warn", "target_time_avg"), ("Guide warn", "guide", "warn", "0.5"), ("Guide crit", "guide", "crit", "1.0"),
])
CHARTS = f"SELECT * FROM ({REQUESTS_CHART} UNION ALL {ELB_CHART} UNION ALL {TARGET_CHART} UNION ALL {LATENCY_CHART})"


def _tone(v: str, warn, crit) -> str:
    return f"CASE WHEN {v} >= {crit} THEN 'crit' WHEN {v} >= {warn} THEN 'warn' ELSE 'ok' END"


GAUGES = (
    f"WITH g AS (SELECT count(*) AS n, avg(target_time) AS tt, count(*) FILTER (elb_status LIKE '5%') / count(*) AS r5, count(*) FILTER ({CONN_ERROR}) AS ce, "
    f"count(DISTINCT CASE WHEN {_digit('target_status')} = 5 THEN target END) AS bad, count(DISTINCT target) AS seen FROM lb_requests) "
    f"SELECT 'target_response_time' AS gauge, round(tt, 6) AS value, round(tt / 2, 6) AS fraction, {_tone('tt', 0.5, 1.0)} AS tone FROM g "
    f"UNION ALL SELECT 'rate_5xx', round(r5, 6), round(r5 / 0.1, 6), {_tone('r5', 0.01, 0.05)} FROM g "
    f"UNION ALL SELECT 'target_connection_errors', ce, round(ce / n / 0.05, 6), {_tone('ce / n', 0.000001, 0.01)} FROM g "
    "UNION ALL SELECT 'targets_5xx', bad, round(bad / seen, 6), CASE WHEN bad = 0 THEN 'ok' WHEN bad = seen THEN 'crit' ELSE 'warn' END FROM g"
)
RING_DIMS = {
    "ELB status": (f"substr(elb_status, 1, 1) || 'xx'", "TRUE"), "Load balancer": ("lb", "TRUE"), "Method": ("method", "TRUE"),
    "Listener type": ("type", "TRUE"),
}


def _match_columns(t: str = "lb_requests") -> str:
    return (
        f"ts, lb, client_ip, target, elb_status, target_status, {LATENCY} AS latency, received_bytes, sent_bytes, method, {HOST} AS host, path, user_agent, "
        f"ssl_protocol, ssl_cipher, actions AS action, error_reason FROM {t}"
    )


def _hours(table: str) -> str:
    return (
        f"SELECT h AS hour, count(x.ts) AS n FROM range(0, 24) r(h) LEFT JOIN {table} x ON hour(x.ts) = h GROUP BY 1"
    )


def _summary(columns: str, body: str) -> str:
    return f"UNPIVOT (SELECT {columns} FROM ({body})) ON COLUMNS(*) INTO NAME metric VALUE value"


LB_TOTALS = (
    "SELECT count(*) AS requests, CAST(sum(received_bytes) AS BIGINT) AS received_bytes, CAST(sum(sent_bytes) AS BIGINT) AS sent_bytes, "
    "count(*) FILTER (elb_status LIKE '4%') AS errors_4xx, count(*) FILTER (elb_status LIKE '5%') AS errors_5xx, min(ts) AS first, max(ts) AS last FROM lb_requests"
)
CONN_TOTALS = (
    f"SELECT count(*) AS connections, count(ssl_protocol) AS tls, count(*) FILTER ({FAILED}) AS handshake_failed, min(ts) AS first, max(ts) AS last FROM lb_connections"
)


def _stat(v: str, table: str) -> str:
    return (
        f"SELECT count({v}) AS count, round(coalesce(sum({v}), 0), 6) AS sum, round(coalesce(max({v}), 0), 6) AS max, round(coalesce(avg({v}), 0) + 1e-9, 6) AS avg FROM {table}"
    )


def _b(df):
    return series.rebucket(df)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for i, dim in enumerate(DIMS, 3):
        out[f"agg_lb_{i:02d}"] = Query(
            lambda t, x=dim: c.counter(t.lb_requests, lb.dims()[x]), q.counter(R, *DIMS[dim])
        )
    for i, dim in enumerate(CONN_DIMS, 3):
        out[f"agg_cn_{i:02d}"] = Query(
            lambda t, x=dim: c.counter(t.lb_connections, lb.conn_dims()[x]), q.counter(K, *CONN_DIMS[dim])
        )
    out |= {
        "agg_lb_01": Query(lambda t: lb.totals(t.lb_requests), LB_TOTALS),
        "agg_lb_02": Query(lambda t: lb.latency_stat(t.lb_requests), _stat(LATENCY, R)),
        "agg_lb_counters": Query(lambda t: lb.counters(t.lb_requests), q.counters(R, DIMS)),
        "agg_lb_17": Query(lambda t: lb.hour_of_day(t.lb_requests), _hours(R)),
        "agg_lb_18": Query(
            lambda t: lb.target_time_stat(t.lb_requests),
            f"SELECT {_measured('target_time', 'target_time')}, round(avg(target_time) + 1e-9, 6) AS target_time_avg FROM lb_requests",
        ),
        "agg_lb_19": Query(lambda t: lb.conn_errors(t.lb_requests), f"SELECT count(*) FILTER ({CONN_ERROR}) AS conn_errors FROM lb_requests"),
        "agg_lb_20": Query(
            lambda t: lb.targets_5xx(t.lb_requests),
            f"SELECT count(DISTINCT CASE WHEN {_digit('target_status')} = 5 THEN target END) AS bad, count(DISTINCT target) AS seen FROM lb_requests",
        ),
        "agg_lb_21": Query(
            lambda t: lb.minute_timeline(t.lb_requests),
            f"SELECT date_trunc('minute', ts) AS minute, {TIMELINE_BODY} FROM lb_requests GROUP BY 1",
        ),
        "agg_gn_03": Query(
            lambda t: lb.merge_timeline(lb.minute_timeline(t.lb_requests), d.hour_of(F.col("minute")), "hour"),
            f"SELECT date_trunc('hour', ts) AS hour, {TIMELINE_BODY} FROM lb_requests GROUP BY 1",
        ),
        "agg_lb_22": Query(lambda t: lb.target_groups(t.lb_requests), GROUPS),
        "agg_lb_23": Query(
            lambda t: lb.path_latency(t.lb_requests),
            f"SELECT path, {_measured('v', 'latency')} FROM (SELECT {PATH} AS path, {LATENCY} AS v FROM lb_requests) WHERE v IS NOT NULL GROUP BY 1",
        ),
        "agg_lb_24": Query(lambda t: lb.distinct_clients(t.lb_requests), "SELECT count(DISTINCT client_ip) AS client_ips FROM lb_requests"),
        "agg_lb_25": Query(lambda t: lb.weak_tls(t.lb_requests), f"SELECT count(*) FILTER ({WEAK}) AS weak_tls FROM lb_requests"),
        "agg_cn_01": Query(lambda t: lb.conn_totals(t.lb_connections), CONN_TOTALS),
        "agg_cn_02": Query(lambda t: lb.handshake_stat(t.lb_connections), _stat("tls_handshake_time", K)),
        "agg_cn_counters": Query(lambda t: lb.conn_counters(t.lb_connections), q.counters(K, CONN_DIMS)),
        "agg_cn_12": Query(
            lambda t: lb.conn_distinct(t.lb_connections),
            f"SELECT count(DISTINCT client_ip) AS client_ips, count(*) FILTER ({WEAK}) AS weak_tls FROM lb_connections",
        ),
        "prj_05": Query(
            lambda t: t.lb_requests.groupBy(lb.host().alias("host")).count(),
            f"SELECT {HOST} AS host, count(*) AS count FROM lb_requests GROUP BY 1",
        ),
        "prj_06": Query(
            lambda t: t.lb_requests.groupBy("elb_status", "error_reason", lb.conn_error().alias("conn_error")).count(),
            f"SELECT elb_status, error_reason, coalesce({CONN_ERROR}, false) AS conn_error, count(*) AS count FROM lb_requests GROUP BY 1, 2, 3",
        ),
        "prj_07": Query(
            lambda t: t.lb_connections.groupBy("listener", "ssl_protocol", lb.failed().alias("failed")).count(),
            f"SELECT listener, ssl_protocol, {FAILED} AS failed, count(*) AS count FROM lb_connections GROUP BY 1, 2, 3",
        ),
        "prj_08": Query(
            lambda t: t.lb_requests.groupBy("target").count().select(
                "target", "count", text.host_port(F.col("target"))[0].alias("host"), text.host_port(F.col("target"))[1].alias("port"),
                text.host_port(F.concat(F.lit("[fd00::1]:"), F.col("count").cast("string")))[0].alias("v6"),
            ),
            "SELECT target, count(*) AS count, split_part(target, ':', 1) AS host, split_part(target, ':', 2) AS port, 'fd00::1' AS v6 FROM lb_requests GROUP BY 1",
        ),
        "prj_09": Query(
            lambda t: t.lb_requests.select(
                F.concat_ws(" ", "method", "path", F.lit("HTTP/1.1")).alias("request"), "method", "path"
            ).groupBy("request").count().select(
                "count", *[p.alias(n) for p, n in zip(text.request_line(F.col("request")), ("method", "url", "protocol"))]
            ),
            "SELECT count(*) AS count, method, path AS url, 'HTTP/1.1' AS protocol FROM lb_requests GROUP BY method, path",
        ),
        "prj_10_12": Query(
            lambda t: t.read("pages").select(
                "page_id", text.url_host(F.col("url")).alias("host"), text.url_path(F.col("url")).alias("path"),
                text.url_scheme(F.col("url")).alias("scheme"),
            ),
            "SELECT page_id, nullif(lower(regexp_replace(split_part(rest, '/', 1), ':[^:]*$', '')), '') AS host, "
            "nullif(regexp_replace(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END, '[?#].*', ''), '') AS path, "
            "CASE WHEN strpos(url, '://') > 1 THEN lower(split_part(url, '://', 1)) END AS scheme FROM "
            "(SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE url END AS rest FROM pages)",
        ),
        "prj_11": Query(
            lambda t: t.lb_requests.groupBy("elb_status").agg(
                F.count(lb.latency()).alias("measured"), F.sum(lb.latency()).alias("total")
            ),
            f"SELECT elb_status, count({LATENCY}) AS measured, round(sum({LATENCY}), 6) AS total FROM lb_requests GROUP BY 1",
        ),
        "prj_13": Query(
            lambda t: t.lb_requests.groupBy("path", lb.path().alias("normalized")).count(),
            f"SELECT path, {PATH} AS normalized, count(*) AS count FROM lb_requests GROUP BY 1, 2",
        ),
        "prj_14_15_16": Query(
            lambda t: t.lb_requests.groupBy("target_status").count().select(
                "target_status", "count", d.status_digit(F.col("target_status")).alias("digit"),
                d.metric_status_class(F.col("target_status")).alias("metric_class"), d.ring_status_class(F.col("target_status")).alias("ring_class"),
            ),
            f"SELECT target_status, count(*) AS count, {_digit('target_status')} AS digit, "
            "CASE WHEN regexp_matches(target_status, '^[2-5]..$') THEN substr(target_status, 1, 1) || 'xx' ELSE 'other' END AS metric_class, "
            "CASE WHEN regexp_matches(target_status, '^[1-5]..$') THEN substr(target_status, 1, 1) || 'xx' ELSE 'other' END AS ring_class FROM lb_requests GROUP BY 1",
        ),
        "prj_18": Query(
            lambda t: t.lb_requests.groupBy(d.target_group_name(F.col("target_group_arn")).alias("name")).count(),
            "SELECT regexp_replace(target_group_arn, '^.*:targetgroup/', '') AS name, count(*) AS count FROM lb_requests GROUP BY 1",
        ),
        "prj_19": Query(
            lambda t: t.lb_requests.groupBy(
                d.minute_of(F.col("ts")).alias("minute"), d.hour_of(F.col("ts")).alias("hour"), F.hour("ts").alias("hour_of_day")
            ).count(),
            "SELECT date_trunc('minute', ts) AS minute, date_trunc('hour', ts) AS hour, hour(ts) AS hour_of_day, count(*) AS count FROM lb_requests GROUP BY 1, 2, 3",
        ),
        "prj_20": Query(
            lambda t: t.lb_connections.groupBy(d.listener_tls(F.col("listener"), F.col("ssl_protocol")).alias("listener_tls")).count(),
            "SELECT listener || ' ' || coalesce(ssl_protocol, 'no TLS') AS listener_tls, count(*) AS count FROM lb_connections GROUP BY 1",
        ),
        "prj_41": Query(
            lambda t: t.lb_requests.groupBy("ssl_protocol", d.yes(F.col("ssl_protocol").isin(*d.LB_WEAK_TLS)).alias("weak")).count(),
            f"SELECT ssl_protocol, coalesce({WEAK}, false) AS weak, count(*) AS count FROM lb_requests GROUP BY 1, 2",
        ),
        "prj_42": Query(
            lambda t: lb.conn_counters(t.lb_connections).unionByName(lb.counters(t.lb_requests))
            .select("dim", "key", "n", d.value_tone(F.col("key")).alias("tone")),
            f"SELECT dim, key, n, {q.VALUE_TONE} AS tone FROM ({q.counters(K, CONN_DIMS)} UNION ALL {q.counters(R, DIMS)})",
        ),
        "prj_44": Query(
            lambda t: lb.path_latency(t.lb_requests).select(
                "path", d.threshold_tone(c.mean("latency"), series.LATENCY_WARN, series.LATENCY_CRIT).alias("tone")
            ),
            f"SELECT path, {_tone('avg', 0.5, 1.0)} AS tone FROM ({PATHS})",
        ),
        "flt_08_09": Query(
            lambda t: filters.LbFilter(
                client_ip="113.1", target="10.0.20.", host="EXAMPLE.com", path="/TILES/1", user_agent="mozilla"
            ).apply(t.lb_requests).groupBy("client_ip", "host", "path").count(),
            f"SELECT client_ip, host, path, count(*) AS count FROM lb_requests WHERE contains(client_ip, '113.1') AND contains(target, '10.0.20.') "
            f"AND contains(lower({HOST}), 'example.com') AND contains(lower(path), '/tiles/1') AND contains(lower(user_agent), 'mozilla') GROUP BY 1, 2, 3",
        ),
        "flt_10_11_12": Query(
            lambda t: filters.LbFilter(methods=["get"], statuses=["50x", "404", "2"], slower_than=0.3).apply(t.lb_requests)
            .groupBy("method", "elb_status").count(),
            f"SELECT method, elb_status, count(*) AS count FROM lb_requests WHERE method = 'GET' AND (elb_status LIKE '50%' OR elb_status = '404' OR elb_status LIKE '2%') "
            f"AND {LATENCY} >= 0.3 GROUP BY 1, 2",
        ),
        "flt_13": Query(
            lambda t: t.lb_connections.agg(
                F.count_if(filters.LbFilter(client_ip=".7").for_connections(t.lb_connections)).alias("by_client"),
                F.count_if(filters.LbFilter(statuses=["5xx"]).for_connections(t.lb_connections)).alias("by_status"),
            ),
            "SELECT count(*) FILTER (contains(client_ip, '.7')) AS by_client, 0 AS by_status FROM lb_connections",
        ),
        "tsr_01": Query(lambda t: _b(t.lb_requests), GRID + "SELECT * FROM buckets"),
        "tsr_02": Query(lambda t: series.requests_chart(_b(t.lb_requests)), GRID + REQUESTS_CHART),
        "tsr_03": Query(lambda t: series.elb_status_chart(_b(t.lb_requests)), GRID + ELB_CHART),
        "tsr_04": Query(lambda t: series.target_status_chart(_b(t.lb_requests)), GRID + TARGET_CHART),
        "tsr_05": Query(lambda t: series.latency_chart(_b(t.lb_requests)), GRID + LATENCY_CHART),
        "tsr_06": Query(
            lambda t: series.legend(series.charts(t.lb_requests)).withColumn("avg", F.round("avg", 4)),
            GRID + "SELECT chart, series, min(value) AS min, max(value) AS max, round(avg(value), 4) AS avg, "
            f"arg_max(value, bucket) FILTER (value IS NOT NULL) AS last FROM ({CHARTS}) WHERE kind <> 'guide' GROUP BY 1, 2",
        ),
        "tsr_08": Query(
            lambda t: series.busiest_hour(lb.hour_of_day(t.lb_requests)),
            f"SELECT hour, n FROM ({_hours(R)}) ORDER BY n DESC, hour LIMIT 1",
        ),
        "hlt_01": Query(lambda t: health.gauges(t.lb_requests), GAUGES),
        "hlt_02": Query(
            lambda t: health.group_table(t.lb_requests, 3),
            "SELECT regexp_replace(target_group_arn, '^.*:targetgroup/', '') AS name, target_group_arn AS arn, requests, target_2xx AS t2xx, target_4xx AS t4xx, target_5xx AS t5xx, "
            f"elb_5xx, conn_errors, targets, round(target_time_sum / target_time_count + 1e-9, 6) AS avg, target_time_max AS max, {_tone('(elb_5xx + conn_errors) / requests', 0.01, 0.05)} AS tone "
            f"FROM ({GROUPS}) ORDER BY requests DESC, target_group_arn LIMIT 3",
        ),
        "rnk_03": Query(
            lambda t: c.top_n(lb.target_groups(t.lb_requests).select(F.col("target_group_arn").alias("key"), F.col("requests").alias("n")), 3),
            f"SELECT target_group_arn AS key, requests AS n, row_number() OVER (ORDER BY requests DESC, target_group_arn) AS rank FROM ({GROUPS}) QUALIFY rank <= 3",
        ),
        "rnk_04": Query(
            lambda t: health.slowest_paths(t.lb_requests, 10),
            f"SELECT path, count, round(avg + 1e-9, 6) AS avg, round(min, 6) AS min, round(max, 6) AS max FROM ({PATHS}) ORDER BY {'avg'} DESC, path LIMIT 10",
        ),
        "hlt_03": Query(
            lambda t: health.path_table(t.lb_requests, 10),
            "SELECT path, count, round(avg + 1e-9, 6) AS avg, round(min, 6) AS min, round(max, 6) AS max, CAST(floor(avg / m * 100) AS BIGINT) AS avg_pct, CAST(floor(max / m * 100) AS BIGINT) AS max_pct, "
            f"{_tone('avg', 0.5, 1.0)} AS avg_tone, {_tone('max', 0.5, 1.0)} AS max_tone FROM (SELECT *, max(max) OVER () AS m FROM (SELECT * FROM ({PATHS}) ORDER BY avg DESC, path LIMIT 10))",
        ),
        "hlt_04": Query(
            lambda t: health.rings(t.lb_requests),
            f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, key) AS place FROM ({q.counters(R, RING_DIMS)})), "
            "f AS (SELECT dim, CASE WHEN place <= 5 THEN key ELSE 'Other' END AS key, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1, 2) "
            "SELECT *, round(n * 100 / sum(n) OVER (PARTITION BY dim), 6) AS pct FROM f",
        ),
        "rnk_09": Query(
            lambda t: health.ring(c.counter(t.lb_requests, lb.dims()["client_ip"])),
            f"WITH k AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS place FROM ({q.counter(R, 'client_ip')})), "
            "f AS (SELECT CASE WHEN place <= 5 THEN key ELSE 'Other' END AS key, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1) "
            "SELECT *, round(n * 100 / sum(n) OVER (), 6) AS pct FROM f",
        ),
        "rnk_10": Query(
            lambda t: health.failing(t.lb_requests, 200, 20),
            "WITH m AS (SELECT ts, lb, client_ip, elb_status, method, path, user_agent FROM lb_requests ORDER BY ts, lb, client_ip, elb_status, method, path, user_agent NULLS FIRST LIMIT 200), "
            "l AS (SELECT *, CASE WHEN elb_status LIKE '5__' THEN 'error' WHEN elb_status LIKE '4__' THEN 'warning' END AS level FROM m) "
            "SELECT *, row_number() OVER (PARTITION BY level ORDER BY ts, lb, client_ip, elb_status, method, path, user_agent NULLS FIRST) AS place, count(*) OVER (PARTITION BY level) AS total "
            "FROM l WHERE level IS NOT NULL QUALIFY place <= 20",
        ),
        "rnk_11_lb": Query(
            lambda t: reports.lb_tables(t.lb_requests), q.tables(q.counters(R, DIMS), reports.LB_TABLES, "requests", set(), 10, q.VALUE_TONE)
        ),
        "rnk_11_connections": Query(
            lambda t: reports.connection_tables(t.lb_connections),
            q.tables(q.counters(K, CONN_DIMS), reports.CONNECTION_TABLES, "connections", set(), 10, q.VALUE_TONE),
        ),
        "hlt_06_lb": Query(
            lambda t: health.lb_summary(t.lb_requests),
            _summary(
                "CAST(requests AS VARCHAR) AS requests, CAST(received_bytes AS VARCHAR) AS received_bytes, CAST(sent_bytes AS VARCHAR) AS sent_bytes, CAST(errors_4xx AS VARCHAR) AS errors_4xx, "
                "CAST(errors_5xx AS VARCHAR) AS errors_5xx, CAST(latency_avg AS VARCHAR) AS latency_avg, CAST(latency_max AS VARCHAR) AS latency_max, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last",
                f"SELECT t.*, round(avg, 6) AS latency_avg, round(max, 6) AS latency_max FROM ({LB_TOTALS}) t, ({_stat(LATENCY, R)}) s",
            ),
        ),
        "hlt_06_connections": Query(
            lambda t: health.conn_summary(t.lb_connections),
            _summary(
                "CAST(connections AS VARCHAR) AS connections, CAST(tls AS VARCHAR) AS tls, CAST(handshake_failed AS VARCHAR) AS handshake_failed, CAST(avg AS VARCHAR) AS handshake_avg, "
                "CAST(max AS VARCHAR) AS handshake_max, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last",
                f"SELECT t.*, s.avg, s.max FROM ({CONN_TOTALS}) t, ({_stat('tls_handshake_time', K)}) s",
            ),
        ),
        "hlt_07_lb": Query(
            lambda t: health.lb_matches(t.lb_requests, 100),
            f"SELECT * REPLACE (round(latency, 6) AS latency) FROM (SELECT {_match_columns()} ORDER BY ts, lb, client_ip, target NULLS FIRST, elb_status LIMIT 100)",
        ),
        "hlt_07_connections": Query(
            lambda t: health.conn_matches(t.lb_connections, 100),
            f"SELECT ts, lb, client_ip, listener, CASE WHEN {FAILED} THEN 'FAILED' ELSE ssl_protocol END AS tls, ssl_cipher, tls_key_exchange AS key_exchange, round(tls_handshake_time, 6) AS handshake, "
            "tls_verify_status AS verify, CAST(NULL AS VARCHAR) AS conn_trace_id FROM lb_connections ORDER BY ts, lb, client_ip, listener, tls NULLS FIRST LIMIT 100",
        ),
        "set_01": Query(
            lambda t: t.lb_requests.where("kind = 'alb'").unionByName(t.lb_requests.where("kind = 'nlb'"))
            .unionByName(t.lb_requests.where("kind = 'classic'")).groupBy("kind").count(),
            "SELECT kind, count(*) AS count FROM lb_requests GROUP BY 1",
        ),
        "snk_03": Query(
            lambda t: _decoded(
                lines.lb_lines(t.lb_requests, "run"),
                "event_time string, lb string, lb_type string, latency double, target_time double, elb_status string, sent_bytes bigint, host string",
            ),
            f"SELECT ts AS at, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts = date_trunc('second', ts) THEN '' ELSE rtrim(strftime(ts, '.%f'), '0') END || 'Z' AS event_time, lb, kind AS lb_type, round({LATENCY}, 6) AS latency, "
            "round(target_time, 6) AS target_time, elb_status, sent_bytes, host, 'job=logloom,kind=request,lb=' || lb || ',subcommand=elb' AS labels FROM lb_requests",
        ),
        "snk_03_connections": Query(
            lambda t: _decoded(
                lines.conn_lines(t.lb_connections, "run"),
                "kind string, lb string, listener string, ssl_protocol string, tls_handshake_time double, tls_verify_status string, sent_bytes bigint",
            ),
            "SELECT ts AS at, 'conn' AS kind, lb, listener, ssl_protocol, round(tls_handshake_time, 6) AS tls_handshake_time, tls_verify_status, 0 AS sent_bytes, "
            "'job=logloom,kind=conn,lb=' || lb || ',subcommand=elb' AS labels FROM lb_connections",
        ),
        "snk_13_lb": Query(
            lambda t: _gauges(metrics.lb_gauges(t.lb_requests, t.lb_connections)),
            "SELECT 'logloom_elb_requests' AS name, 'gauge' AS type, 'status_class=' || s.c AS labels, CAST(count(r.elb_status) AS DOUBLE) AS value FROM (VALUES ('2xx'), ('3xx'), ('4xx'), ('5xx'), ('other')) s(c) "
            "LEFT JOIN lb_requests r ON s.c = CASE WHEN regexp_matches(r.elb_status, '^[2-5]..$') THEN substr(r.elb_status, 1, 1) || 'xx' ELSE 'other' END GROUP BY s.c "
            "UNION ALL SELECT 'logloom_elb_received_bytes', 'gauge', '', sum(received_bytes) FROM lb_requests UNION ALL SELECT 'logloom_elb_sent_bytes', 'gauge', '', sum(sent_bytes) FROM lb_requests "
            f"UNION ALL SELECT 'logloom_elb_latency_avg_seconds', 'gauge', '', round(avg({LATENCY}), 6) FROM lb_requests UNION ALL SELECT 'logloom_elb_latency_max_seconds', 'gauge', '', round(max({LATENCY}), 6) FROM lb_requests "
            f"UNION ALL SELECT 'logloom_elb_conns', 'gauge', '', count(*) FROM lb_connections UNION ALL SELECT 'logloom_elb_conns_tls', 'gauge', '', count(ssl_protocol) FROM lb_connections "
            f"UNION ALL SELECT 'logloom_elb_tls_handshake_failed', 'gauge', '', count(*) FROM lb_connections WHERE {FAILED} "
            "UNION ALL SELECT 'logloom_elb_tls_handshake_avg_seconds', 'gauge', '', round(avg(tls_handshake_time), 6) FROM lb_connections "
            "UNION ALL SELECT 'logloom_elb_tls_handshake_max_seconds', 'gauge', '', round(max(tls_handshake_time), 6) FROM lb_connections",
        ),
    }
    return out


def _decoded(encoded, schema: str):
    """Emitted lines read back from their JSON."""
    return encoded.select("at", F.from_json("line", schema).alias("j"), lines.labels_text(F.col("labels")).alias("labels")).select(
        "at", "j.*", "labels"
    )


def _gauges(m):
    return m.select("name", "type", lines.labels_text(F.col("labels")).alias("labels"), "value")
