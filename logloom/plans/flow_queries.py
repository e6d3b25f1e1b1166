"""Network-flow queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.functions import net
from logloom.functions.text import binary_size
from logloom.operators import counters as c
from logloom.operators import filters, flows, health, lines, metrics, reports, rules, series
from logloom.plans import sqlparts as q
from logloom.plans.registry import Query

MIB = 1 << 20

SRC = "coalesce(pkt_src_addr, src_addr)"
DST = "dst_addr"
OK = "(log_status IS NULL OR log_status = 'OK')"
PROTO = "CASE protocol WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 58 THEN 'icmpv6' ELSE CAST(protocol AS VARCHAR) END"
SERVICE = f"CASE WHEN protocol IN (1, 58) THEN {PROTO} ELSE dst_port || '/' || {PROTO} END"
STARTED = "(protocol IN (1, 58) OR src_port > dst_port)"
TCPUDP = "protocol IN (6, 17)"


def _private(a: str) -> str:
    return f"({a} LIKE '10.%')"


def _public(a: str) -> str:
    return f"({a} IS NOT NULL AND {a} NOT LIKE '10.%')"


SCAN = (
    f"{OK} AND action = 'REJECT' AND {TCPUDP} AND dst_port IS NOT NULL AND {_public(SRC)} "
    "AND (protocol <> 6 OR tcp_flags IS NULL OR (tcp_flags & 18) = 2)"
)
SWEEP = f"{OK} AND {_private(DST)} AND {STARTED}"
SENSITIVE = "dst_port IN (22, 3389, 3306, 5432, 1433, 6379, 9200, 27017, 2375, 11211)"
EXPOSED = (
    f"{OK} AND action = 'ACCEPT' AND {_public(SRC)} AND {_private(DST)} AND {TCPUDP} AND {STARTED} "
    f"AND coalesce(flow_direction, '') <> 'egress' AND {SENSITIVE}"
)
EXPOSED_KEY = f"{DST} || ':' || dst_port || '/' || {PROTO}"
EGRESS = f"{OK} AND action = 'ACCEPT' AND {_private(SRC)} AND {_public(DST)} AND {STARTED} AND bytes > 0"
LEGACY = f"{OK} AND action = 'ACCEPT' AND {TCPUDP} AND dst_port IN (21, 23, 445)"
FIRST = f"(SELECT min(start) FROM flows WHERE {OK})"

DIMS = {
    "action": ("action", OK), "protocol": (PROTO, OK), "service": (SERVICE, OK), "interface": ("interface_id", OK),
    "direction": ("flow_direction", OK), "bytes_by_action": ("action", OK, "bytes"), "source": (SRC, OK),
    "destination": (DST, OK), "pair_bytes": (f"{SRC} || ' -> ' || {DST}", OK, "bytes"),
    "rejects_by_source": (SRC, f"{OK} AND action = 'REJECT'"),
}

TOTALS = (
    f"SELECT count(*) FILTER ({OK}) AS flows, CAST(coalesce(sum(bytes) FILTER ({OK}), 0) AS BIGINT) AS bytes, "
    f"CAST(coalesce(sum(packets) FILTER ({OK}), 0) AS BIGINT) AS packets, count(*) FILTER (log_status = 'NODATA') AS nodata, "
    f"count(*) FILTER (log_status = 'SKIPDATA') AS skipdata, min(start) FILTER ({OK}) AS first, max(start) FILTER ({OK}) AS last, "
    f"count(*) FILTER ({OK} AND action = 'ACCEPT') AS accepted, count(*) FILTER ({OK} AND action = 'REJECT') AS rejected, "
    f"round(count(*) FILTER ({OK} AND action = 'REJECT') / count(*) FILTER ({OK}), 6) AS reject_rate FROM flows"
)

SCAN_SQL = q.finding(
    "vpc-port-scan", "HIGH", "Port scan from a public address", "source",
    "'rejected connection attempts to 25 or more distinct ports (sample: ' || sample || '); ' || rejects || ' rejected flows'",
    FIRST, "25",
    "FROM (SELECT s.source, s.sample, r.rejects FROM (SELECT source, count(*) AS n, "
    "array_to_string(list_sort(list(dst_port))[1:10], ', ') AS sample "
    f"FROM (SELECT DISTINCT {SRC} AS source, dst_port FROM flows WHERE {SCAN}) GROUP BY source HAVING count(*) >= 25) s "
    f"JOIN (SELECT {SRC} AS source, count(*) AS rejects FROM flows WHERE {OK} AND action = 'REJECT' GROUP BY 1) r USING (source))",
)
EXPOSED_SQL = q.finding(
    "vpc-sensitive-port-exposed", "HIGH", "Sensitive port reachable from the internet", "k",
    f"flows || ' accepted flows, ' || {q.size('bytes')} || ', from ' || sources || ' public sources; top: ' || top",
    "first", "flows",
    "FROM (SELECT k, CAST(sum(n) AS BIGINT) AS flows, CAST(sum(b) AS BIGINT) AS bytes, min(f) AS first, count(*) AS sources, "
    "string_agg(src || ' (' || n || ')', ', ' ORDER BY n DESC, src) FILTER (place <= 5) AS top FROM "
    "(SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, src) AS place FROM "
    f"(SELECT {EXPOSED_KEY} AS k, {SRC} AS src, count(*) AS n, sum(bytes) AS b, min(start) AS f FROM flows WHERE {EXPOSED} GROUP BY 1, 2)) GROUP BY k)",
)
SWEEP_SQL = q.finding(
    "vpc-host-sweep", "MEDIUM", "Host sweep", "source", "'started flows to 50 or more distinct private addresses'",
    FIRST, "50",
    f"FROM (SELECT {SRC} AS source, count(DISTINCT {DST}) AS n FROM flows WHERE {SWEEP} GROUP BY 1) WHERE n >= 50",
)
EGRESS_SQL = q.finding(
    "vpc-large-egress", "MEDIUM", "Large egress to public addresses", "source",
    f"'sent ' || {q.size('b')} || ' in accepted flows it started to public addresses (threshold 1.0 MiB)'",
    FIRST, "b",
    f"FROM (SELECT {SRC} AS source, CAST(sum(bytes) AS BIGINT) AS b FROM flows WHERE {EGRESS} GROUP BY 1) WHERE b >= {MIB}",
)
LEGACY_ROWS = (
    f"SELECT CASE WHEN {_public(SRC)} THEN {DST} ELSE {SRC} END AS host, CASE WHEN {_public(SRC)} THEN 'in' ELSE 'out' END AS direction, "
    f"{SERVICE} AS service, count(*) AS n FROM flows WHERE {LEGACY} AND (({_public(SRC)} AND {_private(DST)}) OR ({_private(SRC)} AND {_public(DST)})) GROUP BY 1, 2, 3"
)
LEGACY_SQL = q.finding(
    "vpc-legacy-protocol", "LOW", "Legacy protocol in use", "host",
    "n || ' accepted flows on ' || service || CASE direction WHEN 'in' THEN ' inbound from' ELSE ' outbound to' END || ' public addresses'",
    FIRST, "n", f"FROM ({LEGACY_ROWS})",
)
RULES = {
    "vpc-port-scan": SCAN_SQL, "vpc-sensitive-port-exposed": EXPOSED_SQL, "vpc-host-sweep": SWEEP_SQL,
    "vpc-large-egress": EGRESS_SQL, "vpc-legacy-protocol": LEGACY_SQL,
}
ALL_SQL = " UNION ALL ".join(RULES.values())

BIG = 50
SINCE, UNTIL = datetime(1994, 1, 1), datetime(1996, 7, 1)
MANY_CIDRS = tuple(f"10.0.{(i - 1) % 4}.{i}" for i in range(1, 121)) + ("192.0.2.0/28", "198.51.100.0/29", "2001:db8::/32")


def findings(t):
    return rules.flow_findings(t.flows, egress_bytes=MIB)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}

    def one(dim: str):
        return lambda t: c.counter(flows.only_flows(t.flows), flows.dims()[dim])

    for name, dim in {
        "agg_fl_02": "action", "agg_fl_03": "protocol", "agg_fl_04": "service", "agg_fl_05": "interface",
        "agg_fl_06": "direction", "agg_fl_07": "bytes_by_action", "agg_fl_08": "source", "agg_fl_09": "destination",
        "agg_fl_10": "pair_bytes", "agg_fl_11": "rejects_by_source",
    }.items():
        out[name] = Query(one(dim), q.counter("flows", *DIMS[dim]))
    for i, rule in enumerate(RULES, 1):
        out[f"rul_fl_0{i}"] = Query(
            lambda t, r=rule: rules.flow_findings(t.flows, egress_bytes=MIB, rules=[r]), RULES[rule]
        )
    out |= {
        "agg_fl_01": Query(lambda t: flows.totals(t.flows), TOTALS),
        "agg_fl_counters": Query(lambda t: flows.counters(t.flows), q.counters("flows", DIMS)),
        "agg_fl_12": Query(
            lambda t: flows.hour_by_action(t.flows),
            f"SELECT date_trunc('hour', start) AS hour, action, count(*) AS n FROM flows WHERE {OK} GROUP BY 1, 2",
        ),
        "agg_fl_13": Query(
            lambda t: flows.scanned_ports(t.flows),
            f"SELECT {SRC} AS source, count(DISTINCT dst_port) AS n FROM flows WHERE {SCAN} GROUP BY 1",
        ),
        "agg_fl_14": Query(
            lambda t: flows.swept_hosts(t.flows),
            f"SELECT {SRC} AS source, count(DISTINCT {DST}) AS n FROM flows WHERE {SWEEP} GROUP BY 1",
        ),
        "agg_fl_15": Query(
            lambda t: flows.exposed_services(t.flows),
            f"SELECT {EXPOSED_KEY} AS service, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes, min(start) AS first, "
            f"count(DISTINCT {SRC}) AS sources FROM flows WHERE {EXPOSED} GROUP BY 1",
        ),
        "agg_fl_16": Query(
            lambda t: flows.egress_bytes(t.flows),
            f"SELECT {SRC} AS source, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows WHERE {EGRESS} GROUP BY 1",
        ),
        "agg_fl_17": Query(lambda t: flows.legacy_flows(t.flows), LEGACY_ROWS),
        "agg_fl_18": Query(
            lambda t: flows.distinct_interfaces(t.flows),
            f"SELECT count(DISTINCT interface_id) AS interfaces FROM flows WHERE {OK}",
        ),
        "agg_fl_19": Query(
            lambda t: flows.truncated(t.flows), "SELECT count(*) < 0 AS truncated FROM flows"
        ),
        "agg_gn_01": Query(
            lambda t: c.fold_tail(c.counter(flows.only_flows(t.flows), flows.dims()["service"]), BIG),
            f"WITH k AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS place FROM ({q.counter('flows', *DIMS['service'])})) "
            f"SELECT CASE WHEN place <= {BIG} THEN key ELSE '(other)' END AS key, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1",
        ),
        "agg_gn_02": Query(
            lambda t: c.reaches(flows.only_flows(t.flows), F.col("src_addr"), F.col("dst_addr"), 100),
            f"SELECT src_addr AS key, count(DISTINCT dst_addr) AS n FROM flows WHERE {OK} GROUP BY 1 HAVING count(DISTINCT dst_addr) >= 100",
        ),
        "agg_gn_04": Query(
            lambda t: c.merge_counts(
                *[
                    flows.counters(t.flows.where(cond))
                    for cond in (F.col("start") < F.lit(SINCE), F.col("start") >= F.lit(SINCE))
                ]
            ),
            q.counters("flows", DIMS),
        ),
        "agg_gn_05": Query(
            lambda t: c.with_shares(c.top_n(c.counter(flows.only_flows(t.flows), flows.dims()["service"]), 20)),
            f"SELECT key, n, rank, round(n / sum(n) OVER (), 6) AS share, "
            "CAST(greatest(1, floor(n * 100 / max(n) OVER ())) AS BIGINT) AS pct_of_max FROM "
            f"(SELECT *, row_number() OVER (ORDER BY n DESC, key) AS rank FROM ({q.counter('flows', *DIMS['service'])})) WHERE rank <= 20",
        ),
        "prj_35": Query(
            lambda t: t.flows.groupBy(flows.source().alias("source"), flows.destination().alias("destination")).count(),
            f"SELECT {SRC} AS source, {DST} AS destination, count(*) AS count FROM flows GROUP BY 1, 2",
        ),
        "prj_36_37": Query(
            lambda t: t.flows.groupBy(
                d.protocol_name(F.col("protocol")).alias("protocol_name"), flows.service().alias("service")
            ).count(),
            f"SELECT {PROTO} AS protocol_name, {SERVICE} AS service, count(*) AS count FROM flows GROUP BY 1, 2",
        ),
        "prj_38": Query(
            lambda t: t.flows.groupBy(
                "src_addr", "dst_addr",
                net.is_private(F.col("src_addr")).alias("src_private"), net.is_public(F.col("src_addr")).alias("src_public"),
                net.is_private(F.col("dst_addr")).alias("dst_private"), net.is_public(F.col("dst_addr")).alias("dst_public"),
            ).count(),
            f"SELECT src_addr, dst_addr, {_private('src_addr')} AS src_private, {_public('src_addr')} AS src_public, "
            f"{_private('dst_addr')} AS dst_private, {_public('dst_addr')} AS dst_public, count(*) AS count FROM flows GROUP BY ALL",
        ),
        "prj_39": Query(
            lambda t: t.flows.groupBy("protocol", flows.started().alias("started")).count(),
            f"SELECT protocol, {STARTED} AS started, count(*) AS count FROM flows GROUP BY 1, 2",
        ),
        "prj_40": Query(
            lambda t: t.flows.groupBy(
                "protocol", "tcp_flags", d.conn_attempt(F.col("protocol"), F.col("tcp_flags")).alias("attempt")
            ).count(),
            "SELECT protocol, tcp_flags, protocol <> 6 OR tcp_flags IS NULL OR (tcp_flags & 18) = 2 AS attempt, count(*) AS count FROM flows GROUP BY 1, 2, 3",
        ),
        "fnc_09": Query(
            lambda t: t.flows.groupBy("src_addr").agg(F.sum("bytes").alias("bytes")).select(
                "src_addr", binary_size(F.col("bytes")).alias("text")
            ),
            f"SELECT src_addr, {q.size('b')} AS text FROM (SELECT src_addr, CAST(sum(bytes) AS BIGINT) AS b FROM flows GROUP BY 1)",
        ),
        "fnc_14": Query(
            lambda t: t.flows.groupBy("dst_addr").count().select(
                "dst_addr", "count", net.addr_key(F.col("dst_addr")).alias("addr_key"),
                net.addr_text(F.col("dst_addr")).alias("addr_text"),
                net.addr_text(F.concat(F.lit("::FFFF:"), F.col("dst_addr"))).alias("unmapped"),
                net.in_prefixes(F.col("dst_addr"), ["10.0.2.7/23", "203.0.113.64/26"]).alias("inside"),
            ),
            "SELECT dst_addr, count, '4' || upper(lpad(to_hex((a * 16777216 + b * 65536 + c * 256 + d)), 8, '0')) AS addr_key, dst_addr AS addr_text, "
            "dst_addr AS unmapped, (a = 10 AND b = 0 AND c IN (2, 3)) OR (a = 203 AND b = 0 AND c = 113 AND d BETWEEN 64 AND 127) AS inside FROM "
            "(SELECT dst_addr, count(*) AS count, CAST(split_part(dst_addr, '.', 1) AS BIGINT) AS a, CAST(split_part(dst_addr, '.', 2) AS BIGINT) AS b, "
            "CAST(split_part(dst_addr, '.', 3) AS BIGINT) AS c, CAST(split_part(dst_addr, '.', 4) AS BIGINT) AS d FROM flows GROUP BY dst_addr)",
        ),
        "fnc_15": Query(
            lambda t: t.flows.groupBy("dst_addr", "dst_port").count().select(
                net.endpoint(F.col("dst_addr"), F.col("dst_port")).alias("v4"),
                net.endpoint(F.concat(F.lit("fd00::"), F.col("dst_port").cast("string")), F.col("dst_port")).alias("v6"),
                "count",
            ),
            "SELECT dst_addr || ':' || dst_port AS v4, '[fd00::' || dst_port || ']:' || dst_port AS v6, count FROM "
            "(SELECT dst_addr, dst_port, count(*) AS count FROM flows GROUP BY 1, 2)",
        ),
        "flt_07": Query(
            lambda t: filters.FlowFilter(since=SINCE, until=UNTIL).apply(t.flows).groupBy("action").count(),
            "SELECT action, count(*) AS count FROM flows WHERE start >= TIMESTAMP '1994-01-01' AND start < TIMESTAMP '1996-07-01' GROUP BY 1",
        ),
        "flt_17": Query(
            lambda t: filters.FlowFilter(actions=["reject"], interfaces=["ENI-3", "eni-5"], vpcs=["vpc-1", "vpc-2"])
            .apply(t.flows).groupBy("interface_id", "vpc_id").count(),
            "SELECT interface_id, vpc_id, count(*) AS count FROM flows WHERE action = 'REJECT' AND interface_id IN ('eni-3', 'eni-5') AND vpc_id IN ('vpc-1', 'vpc-2') GROUP BY 1, 2",
        ),
        "flt_18": Query(
            lambda t: filters.FlowFilter(src_cidrs=["192.0.2.0/28", "10.0.0.0/8"], dst_cidrs=["10.0.1.9/23"])
            .apply(t.flows).groupBy("src_addr", "pkt_src_addr", "dst_addr").count(),
            "SELECT src_addr, pkt_src_addr, dst_addr, count(*) AS count FROM flows WHERE (src_addr LIKE '10.%' OR "
            "(pkt_src_addr IS NOT NULL AND CAST(split_part(pkt_src_addr, '.', 4) AS INT) < 16)) AND (dst_addr LIKE '10.0.0.%' OR dst_addr LIKE '10.0.1.%') GROUP BY 1, 2, 3",
        ),
        "jon_02": Query(
            lambda t: filters.FlowFilter(src_cidrs=MANY_CIDRS, dst_cidrs=MANY_CIDRS).apply(t.flows)
            .groupBy("src_addr", "pkt_src_addr", "dst_addr").count(),
            "WITH listed AS (SELECT '10.0.' || ((i - 1) % 4) || '.' || i AS a FROM range(1, 121) r(i)), hit AS (SELECT * FROM flows WHERE "
            "(src_addr IN (SELECT a FROM listed) OR (src_addr LIKE '198.51.100.%' AND CAST(split_part(src_addr, '.', 4) AS INT) < 8) OR (pkt_src_addr IS NOT NULL AND CAST(split_part(pkt_src_addr, '.', 4) AS INT) < 16)) "
            "AND dst_addr IN (SELECT a FROM listed)) SELECT src_addr, pkt_src_addr, dst_addr, count(*) AS count FROM hit GROUP BY 1, 2, 3",
        ),
        "flt_19": Query(
            lambda t: filters.FlowFilter(ports=["22", "440-450"]).apply(t.flows).groupBy("dst_port").count(),
            "SELECT dst_port, count(*) AS count FROM flows WHERE dst_port = 22 OR dst_port BETWEEN 440 AND 450 OR src_port = 22 OR src_port BETWEEN 440 AND 450 GROUP BY 1",
        ),
        "flt_20": Query(
            lambda t: filters.FlowFilter(protocols=["udp", "1"]).apply(t.flows).groupBy("protocol").count(),
            "SELECT protocol, count(*) AS count FROM flows WHERE protocol IN (17, 1) GROUP BY 1",
        ),
        "flt_23": Query(
            lambda t: filters.emitted_flows(flows.only_flows(t.flows)).groupBy("action").count(),
            f"SELECT action, count(*) AS count FROM flows WHERE {OK} AND (action <> 'ACCEPT' OR action IS NULL) GROUP BY 1",
        ),
        "src_24": Query(
            lambda t: flows.status_rows(filters.FlowFilter(since=SINCE, until=UNTIL).in_window(t.flows)),
            "SELECT count(*) FILTER (log_status = 'NODATA') AS nodata, count(*) FILTER (log_status = 'SKIPDATA') AS skipdata FROM flows "
            "WHERE start >= TIMESTAMP '1994-01-01' AND start < TIMESTAMP '1996-07-01'",
        ),
        "rnk_01": Query(
            lambda t: c.top_n(flows.counters(t.flows), 10), q.top(q.counters("flows", DIMS), 10)
        ),
        "rnk_02": Query(
            lambda t: health.flow_matches(t.flows, 200),
            f"SELECT start, interface_id, action, {SRC} AS source, src_port, {DST} AS destination, dst_port, {PROTO} AS protocol, packets, bytes, "
            f"flow_direction AS direction, vpc_id FROM flows WHERE {OK} ORDER BY start, interface_id NULLS FIRST, action NULLS FIRST, source, src_port, destination, dst_port, "
            "protocol, packets, bytes, direction NULLS FIRST, vpc_id NULLS FIRST LIMIT 200",
        ),
        "rnk_06": Query(lambda t: rules.cap_aggregate(findings(t), 60), q.capped(ALL_SQL, 60)),
        "rnk_06_dropped": Query(
            lambda t: rules.dropped_by(findings(t), rules.cap_aggregate(findings(t), 60)),
            f"SELECT (SELECT count(*) FROM ({ALL_SQL})) - (SELECT count(*) FROM ({q.capped(ALL_SQL, 60)})) AS dropped FROM flows LIMIT 1",
        ),
        "rnk_11_flows": Query(
            lambda t: reports.flow_tables(t.flows),
            q.tables(q.counters("flows", DIMS), reports.FLOW_TABLES, "flows", {"bytes_by_action", "pair_bytes"}, 10, q.ACTION_TONE),
        ),
        "jon_04": Query(
            lambda t: rules.flow_facts(flows.only_flows(t.flows), ["vpc-port-scan"]).groupBy("actor").agg(
                F.sum("n").alias("rejects"), F.count("item").alias("ports")
            ),
            f"SELECT {SRC} AS actor, count(*) AS rejects, count(DISTINCT CASE WHEN {SCAN} THEN dst_port END) AS ports FROM flows WHERE {OK} AND action = 'REJECT' GROUP BY 1",
        ),
        "rnk_07": Query(
            lambda t: rules.leading_items(
                rules.flow_facts(flows.only_flows(t.flows), ["vpc-sensitive-port-exposed"]), ["actor"], rules.by_count(), 5, rules.counted_item()
            ),
            "SELECT k AS actor, string_agg(src || ' (' || n || ')', ', ' ORDER BY n DESC, src) FILTER (place <= 5) AS leaders FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, src) AS place FROM "
            f"(SELECT {EXPOSED_KEY} AS k, {SRC} AS src, count(*) AS n FROM flows WHERE {EXPOSED} GROUP BY 1, 2)) GROUP BY 1",
        ),
        "rnk_08": Query(
            lambda t: rules.leading_items(
                rules.flow_facts(flows.only_flows(t.flows), ["vpc-port-scan"]).where("item is not null"), ["actor"],
                [F.col("item").try_cast("int").asc()], 10, F.col("item"),
            ),
            "SELECT source AS actor, array_to_string(list_sort(list(dst_port))[1:10], ', ') AS leaders FROM "
            f"(SELECT DISTINCT {SRC} AS source, dst_port FROM flows WHERE {SCAN}) GROUP BY 1",
        ),
        "rul_fl_all": Query(findings, ALL_SQL),
        "rul_gn_01": Query(
            lambda t: rules.gate(findings(t), "critical"),
            f"SELECT CAST(CASE WHEN max(severity_rank) >= 3 THEN 1 ELSE 0 END AS BIGINT) AS verdict FROM ({ALL_SQL})",
        ),
        "rul_gn_02": Query(lambda t: rules.severity_counts(findings(t)), q.severity_counts(ALL_SQL)),
        "rul_gn_02_max": Query(
            lambda t: rules.max_severity(findings(t)),
            f"SELECT arg_max(severity, severity_rank) AS severity, count(*) > 0 AS \"any\" FROM ({ALL_SQL})",
        ),
        "fnc_16": Query(
            lambda t: findings(t).groupBy("severity", "severity_rank", d.severity_tone(F.col("severity")).alias("tone")).count(),
            "SELECT severity, severity_rank, CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'crit' WHEN severity = 'MEDIUM' THEN 'warn' ELSE 'info' END AS tone, "
            f"count(*) AS count FROM ({ALL_SQL}) GROUP BY 1, 2, 3",
        ),
        "tsr_07_flows": Query(
            lambda t: series.hourly_breakdown(flows.hour_by_action(t.flows), "action"),
            "SELECT hour, CAST(sum(n) AS BIGINT) AS n, string_agg(action || ' ' || n, ', ' ORDER BY n DESC, action) AS breakdown FROM "
            f"(SELECT date_trunc('hour', start) AS hour, action, count(*) AS n FROM flows WHERE {OK} GROUP BY 1, 2) GROUP BY 1",
        ),
        "hlt_05": Query(
            lambda t: health.flow_notes(t.flows),
            "SELECT 'skipdata' AS note, n, n || ' rows are marked SKIPDATA: flows of those intervals were lost before logging, real traffic is above these totals.' AS text "
            "FROM (SELECT count(*) AS n FROM flows WHERE log_status = 'SKIPDATA') WHERE n > 0",
        ),
        "hlt_06_flows": Query(
            lambda t: health.flow_summary(t.flows),
            f"WITH r AS ({TOTALS}) UNPIVOT (SELECT CAST(flows AS VARCHAR) AS flows, CAST(bytes AS VARCHAR) AS bytes, CAST(packets AS VARCHAR) AS packets, "
            "CAST(nodata AS VARCHAR) AS nodata, CAST(skipdata AS VARCHAR) AS skipdata, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, "
            "strftime(last, '%Y-%m-%d %H:%M:%S') AS last, CAST(accepted AS VARCHAR) AS accepted, CAST(rejected AS VARCHAR) AS rejected, "
            "CAST(reject_rate AS VARCHAR) AS reject_rate FROM r) ON COLUMNS(*) INTO NAME metric VALUE value",
        ),
        "snk_06": Query(
            lambda t: decoded_flow_lines(t),
            f"SELECT start AS at, strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS event_time, {SRC} AS source, {DST} AS destination, src_port, dst_port, "
            f"{PROTO} AS protocol, packets, bytes, action, 'action=' || action || ',job=logloom,kind=flow,subcommand=vpc' || coalesce(',vpc=' || vpc_id, '') AS labels "
            f"FROM flows WHERE {OK} AND action <> 'ACCEPT'",
        ),
        "snk_13_flows": Query(
            lambda t: gauge_rows(metrics.flow_gauges(t.flows, rules.cap_aggregate(findings(t), 500))),
            "SELECT 'logloom_vpc_flows' AS name, 'gauge' AS type, 'action=' || a.action AS labels, CAST(count(f.action) AS DOUBLE) AS value "
            f"FROM (VALUES ('ACCEPT'), ('REJECT')) a(action) LEFT JOIN (SELECT action FROM flows WHERE {OK}) f USING (action) GROUP BY a.action "
            f"UNION ALL SELECT 'logloom_vpc_bytes', 'gauge', '', CAST(sum(bytes) AS DOUBLE) FROM flows WHERE {OK} "
            f"UNION ALL SELECT 'logloom_vpc_packets', 'gauge', '', CAST(sum(packets) AS DOUBLE) FROM flows WHERE {OK} "
            f"UNION ALL SELECT 'logloom_vpc_findings', 'gauge', 'severity=' || lower(severity), CAST(n AS DOUBLE) FROM ({q.severity_counts(q.capped(ALL_SQL, 500))})",
        ),
    }
    return out


def gauge_rows(m):
    """Metric rows with labels as text."""
    return m.select("name", "type", lines.labels_text(F.col("labels")).alias("labels"), "value")


def decoded_flow_lines(t):
    """Emitted flow lines read back from their JSON."""
    out = lines.flow_lines(filters.emitted_flows(flows.only_flows(t.flows)), run_id="run")
    schema = (
        "event_time string, source string, destination string, src_port int, dst_port int, protocol string, "
        "packets bigint, bytes bigint, action string"
    )
    return out.select("at", F.from_json("line", schema).alias("j"), lines.labels_text(F.col("labels")).alias("labels")).select(
        "at", "j.*", "labels"
    )
