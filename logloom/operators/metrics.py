"""Metric tables: ``(name, type, labels, value)`` rows of one scan, and counters across ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators import audit, flows, lb, objects
from logloom.operators.lines import labels_text
from logloom.schema import SEVERITIES

PREFIX = "logloom_"

# Label values that are always present.
STATUS_CLASSES = ("2xx", "3xx", "4xx", "5xx", "other")
WAF_ACTIONS = ("ALLOW", "BLOCK", "COUNT", "CAPTCHA", "CHALLENGE")
FLOW_ACTIONS = ("ACCEPT", "REJECT")
SCAN_RESULTS = ("ok", "partial", "failed")

# One metric of a one-row aggregate: name, label, label value, aggregated column.
Metric = tuple[str, str | None, str | None, str]


def _rows(one: DataFrame, metrics: Sequence[Metric], kind: str = "gauge") -> DataFrame:
    none = F.lit(None).cast("string")
    entries = F.array(
        *[
            F.struct(
                F.lit(PREFIX + name).alias("name"), F.lit(kind).alias("type"),
                (none if label is None else F.lit(label)).alias("label"),
                (none if value is None else F.lit(value)).alias("label_value"),
                F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("value"),
            )
            for name, label, value, column in metrics
        ]
    )
    return one.select(F.inline(entries)).select(
        "name", "type",
        F.when(F.col("label").isNotNull(), F.create_map("label", "label_value"))
        .otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        .alias("labels"),
        "value",
    )


def _class_counts(c: Column, values: Sequence[str]) -> list[Column]:
    return [F.count_if(c == v).alias(f"c_{v.lower()}") for v in values]


def _labelled(name: str, label: str, values: Sequence[str]) -> list[Metric]:
    return [(name, label, v, f"c_{v.lower()}") for v in values]


def _severity_metrics(findings: DataFrame, name: str, kind: str = "gauge") -> DataFrame:
    one = findings.agg(*_class_counts(F.col("severity"), SEVERITIES))
    return _rows(one, [(name, "severity", s.lower(), f"c_{s.lower()}") for s in SEVERITIES], kind)


def audit_gauges(df: DataFrame, kept: DataFrame, hits: DataFrame) -> DataFrame:
    """``kept`` are the capped findings, ``hits`` all of them."""
    one = df.agg(F.count_if(audit.is_write()).alias("writes"), F.count("error_code").alias("errors"))
    signed = hits.agg(F.count("*").alias("c")).unionByName(kept.agg((-F.count("*")).alias("c")))
    dropped = signed.agg(F.sum("c").alias("dropped"))
    return (
        _severity_metrics(kept, "findings")
        .unionByName(_rows(dropped, [("findings_dropped", None, None, "dropped")]))
        .unionByName(_rows(one, [
            ("cloudtrail_write_events", None, None, "writes"), ("cloudtrail_error_events", None, None, "errors"),
        ]))
    )


def lb_gauges(requests: DataFrame, connections: DataFrame) -> DataFrame:
    v, h = lb.latency(), F.col("tls_handshake_time")
    has_status = F.when(F.col("elb_status").isNotNull(), d.metric_status_class(F.col("elb_status")))
    req = requests.agg(
        *_class_counts(has_status, STATUS_CLASSES), F.sum("received_bytes").alias("received"),
        F.sum("sent_bytes").alias("sent"), F.avg(v).alias("lat_avg"), F.max(v).alias("lat_max"),
    )
    con = connections.agg(
        F.count("*").alias("conns"), F.count("ssl_protocol").alias("tls"), F.count_if(lb.failed()).alias("failed"),
        F.avg(h).alias("hs_avg"), F.max(h).alias("hs_max"),
    )
    return _rows(req, [
        *_labelled("elb_requests", "status_class", STATUS_CLASSES),
        ("elb_received_bytes", None, None, "received"), ("elb_sent_bytes", None, None, "sent"),
        ("elb_latency_avg_seconds", None, None, "lat_avg"), ("elb_latency_max_seconds", None, None, "lat_max"),
    ]).unionByName(_rows(con, [
        ("elb_conns", None, None, "conns"), ("elb_conns_tls", None, None, "tls"),
        ("elb_tls_handshake_failed", None, None, "failed"),
        ("elb_tls_handshake_avg_seconds", None, None, "hs_avg"),
        ("elb_tls_handshake_max_seconds", None, None, "hs_max"),
    ]))


def waf_gauges(df: DataFrame, kept: DataFrame, acls: DataFrame) -> DataFrame:
    one = df.agg(*_class_counts(F.col("action"), WAF_ACTIONS))
    return (
        _rows(one, _labelled("waf_requests", "action", WAF_ACTIONS))
        .unionByName(_severity_metrics(kept, "waf_findings"))
        .unionByName(_rows(acls.agg(F.count("*").alias("acls")), [("waf_web_acls", None, None, "acls")]))
    )


def object_gauges(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Requests without a status count as ``other``."""
    status_class = d.metric_status_class(objects.status().cast("string"))
    one = df.agg(*_class_counts(status_class, STATUS_CLASSES), F.sum("bytes_sent").alias("sent"))
    return _rows(one, [
        *_labelled("s3_requests", "status_class", STATUS_CLASSES), ("s3_bytes_sent", None, None, "sent"),
    ]).unionByName(_severity_metrics(kept, "s3_findings"))


def flow_gauges(df: DataFrame, kept: DataFrame) -> DataFrame:
    one = flows.only_flows(df).agg(
        *_class_counts(F.col("action"), FLOW_ACTIONS), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets")
    )
    return _rows(one, [
        *_labelled("vpc_flows", "action", FLOW_ACTIONS), ("vpc_bytes", None, None, "bytes"),
        ("vpc_packets", None, None, "packets"),
    ]).unionByName(_severity_metrics(kept, "vpc_findings"))


def common_gauges(scan: DataFrame, finished: float, elapsed: float, errors: int, sinks_ok: bool = True) -> DataFrame:
    """Gauges every run reports; ``scan`` is a one-row scan accounting."""
    one = (
        scan.withColumn("errors", F.lit(errors)).withColumn("elapsed", F.lit(elapsed)).withColumn("at", F.lit(finished))
    )
    metrics: list[Metric] = [
        ("objects_scanned", None, None, "objects"), ("records_read", None, None, "records_read"),
        ("records_matched", None, None, "records_matched"), ("scan_errors", None, None, "errors"),
        ("scan_duration_seconds", None, None, "elapsed"), ("last_run_timestamp_seconds", None, None, "at"),
    ]
    if errors == 0 and sinks_ok:
        metrics.append(("last_success_timestamp_seconds", None, None, "at"))
    return _rows(one, metrics)


# Counters of one tick: what the tick adds to each series, every label value present. A scanner sums them up.


def audit_counters(df: DataFrame, hits: DataFrame) -> DataFrame:
    one = df.agg(F.count_if(audit.is_write()).alias("writes"), F.count("error_code").alias("errors"))
    return _severity_metrics(hits, "findings_total", "counter").unionByName(_rows(one, [
        ("cloudtrail_write_events_total", None, None, "writes"), ("cloudtrail_error_events_total", None, None, "errors"),
    ], "counter"))


def lb_counters(requests: DataFrame, connections: DataFrame) -> DataFrame:
    v, h = lb.latency(), F.col("tls_handshake_time")
    has_status = F.when(F.col("elb_status").isNotNull(), d.metric_status_class(F.col("elb_status")))
    req = requests.agg(
        *_class_counts(has_status, STATUS_CLASSES), F.sum("received_bytes").alias("received"), F.sum("sent_bytes").alias("sent"),
        F.sum(v).alias("seconds"), F.count(v).alias("measured"),
    )
    con = connections.agg(
        F.count("*").alias("conns"), F.count("ssl_protocol").alias("tls"), F.count_if(lb.failed()).alias("failed"),
        F.sum(h).alias("seconds"), F.count(h).alias("measured"),
    )
    return _rows(req, [
        *_labelled("elb_requests_total", "status_class", STATUS_CLASSES),
        ("elb_received_bytes_total", None, None, "received"), ("elb_sent_bytes_total", None, None, "sent"),
        ("elb_latency_seconds_sum", None, None, "seconds"), ("elb_latency_seconds_count", None, None, "measured"),
    ], "counter").unionByName(_rows(con, [
        ("elb_conns_total", None, None, "conns"), ("elb_conns_tls_total", None, None, "tls"),
        ("elb_tls_handshake_failed_total", None, None, "failed"),
        ("elb_tls_handshake_seconds_sum", None, None, "seconds"), ("elb_tls_handshake_seconds_count", None, None, "measured"),
    ], "counter"))


def waf_counters(df: DataFrame, kept: DataFrame) -> DataFrame:
    one = df.agg(*_class_counts(F.col("action"), WAF_ACTIONS))
    return _rows(one, _labelled("waf_requests_total", "action", WAF_ACTIONS), "counter").unionByName(
        _severity_metrics(kept, "waf_findings_total", "counter"))


def object_counters(df: DataFrame, kept: DataFrame) -> DataFrame:
    status_class = d.metric_status_class(objects.status().cast("string"))
    one = df.agg(*_class_counts(status_class, STATUS_CLASSES), F.sum("bytes_sent").alias("sent"))
    return _rows(one, [
        *_labelled("s3_requests_total", "status_class", STATUS_CLASSES), ("s3_bytes_sent_total", None, None, "sent"),
    ], "counter").unionByName(_severity_metrics(kept, "s3_findings_total", "counter"))


def flow_counters(df: DataFrame, kept: DataFrame) -> DataFrame:
    one = flows.only_flows(df).agg(
        *_class_counts(F.col("action"), FLOW_ACTIONS), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets")
    )
    return _rows(one, [
        *_labelled("vpc_flows_total", "action", FLOW_ACTIONS), ("vpc_bytes_total", None, None, "bytes"),
        ("vpc_packets_total", None, None, "packets"),
    ], "counter").unionByName(_severity_metrics(kept, "vpc_findings_total", "counter"))


def scan_counters(tick: DataFrame, failed: int) -> DataFrame:
    """What one committed tick, a row of the tick table, and the ``failed`` attempts before it add to the common series."""
    one = tick.select(
        *[(F.col("result") == r).cast("int").alias(f"c_{r}") if r != "failed" else F.lit(failed).alias("c_failed") for r in SCAN_RESULTS],
        "objects", "records_read", "records_matched", "errors",
    )
    return _rows(one, [
        *_labelled("scans_total", "result", SCAN_RESULTS), ("objects_scanned_total", None, None, "objects"),
        ("records_read_total", None, None, "records_read"), ("records_matched_total", None, None, "records_matched"),
        ("scan_errors_total", None, None, "errors"),
    ], "counter")


def scan_gauges(tick: DataFrame, seen: int, lookback: float, interval: float) -> DataFrame:
    """Where a tick, a row of the tick table, leaves the gauges. ``last_success`` is there after a tick without errors only."""
    one = tick.select(
        (F.unix_micros("at") / 1e6).alias("finished"), "duration", "result", F.lit(seen).alias("seen"), F.lit(lookback).alias("lookback"),
        F.lit(interval).alias("interval"),
    )
    always = [
        ("last_scan_timestamp_seconds", None, None, "finished"), ("scan_duration_seconds", None, None, "duration"),
        ("seen_keys", None, None, "seen"), ("lookback_seconds", None, None, "lookback"), ("interval_seconds", None, None, "interval"),
    ]
    return _rows(one, always).unionByName(_rows(one.where("result = 'ok'"), [("last_success_timestamp_seconds", None, None, "finished")]))


def for_subcommand(metrics: DataFrame, name: str) -> DataFrame:
    """The series of one family."""
    return metrics.withColumn("labels", F.map_concat(F.create_map(F.lit("subcommand"), F.lit(name)), "labels"))


def carried_on(before: DataFrame, more: DataFrame) -> DataFrame:
    """A snapshot of all series and what a tick adds -> the next snapshot: counters add up, gauges take the new value or stay."""
    both = before.withColumn("new", F.lit(0)).unionByName(more.withColumn("new", F.lit(1)))
    return (
        both.withColumn("series", labels_text(F.col("labels"))).groupBy("name", "type", "series")
        .agg(F.max_by("labels", "new").alias("labels"), F.sum("value").alias("total"), F.max_by("value", "new").alias("newest"))
        .select("name", "type", "labels", F.when(F.col("type") == "counter", F.col("total")).otherwise(F.col("newest")).alias("value"))
    )


def stamped(metrics: DataFrame, at: Column) -> DataFrame:
    return metrics.withColumn("at", at)


def cumulative(deltas: DataFrame) -> DataFrame:
    """Running totals of per-tick increments: one window per series, ordered by tick.

    ``deltas`` is ``(name, labels, value, at)`` with one row per series and
    tick, zero where nothing happened (see :func:`dense_ticks`).
    """
    w = Window.partitionBy("name", "series").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        deltas.withColumn("series", labels_text(F.col("labels")))
        .withColumn("value", F.sum("value").over(w))
        .drop("series")
    )


def dense_ticks(df: DataFrame, at: Column, key: Column, name: str, label: str, values: Sequence[str],
                **extra: Column) -> DataFrame:
    """Per-tick counts of every label value, zero-filled: each tick is one row of conditional counts."""
    per_tick = df.groupBy(at.alias("at"), *[c.alias(n) for n, c in extra.items()]).agg(*_class_counts(key, values))
    more = [part for n in extra for part in (F.lit(n), F.col(n))]
    entries = F.array(
        *[
            F.struct(
                F.create_map(F.lit(label), F.lit(v), *more).alias("labels"),
                F.col(f"c_{v.lower()}").cast("double").alias("value"),
            )
            for v in values
        ]
    )
    return per_tick.select(F.lit(PREFIX + name).alias("name"), "at", F.inline(entries))


def tick_counters(ticks: DataFrame) -> DataFrame:
    """Common counters and gauges after each tick of the tick table, in one long metric table.

    ``ticks`` is ``(at, result, objects, records_read, records_matched, errors,
    duration, interval, lookback, seen)``; the window runs over ticks, not records.
    """
    w = Window.partitionBy("subcommand").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    committed = F.col("result") != "failed"
    running = ticks.select(
        "subcommand", "at",
        *[F.sum((F.col("result") == r).cast("int")).over(w).alias(f"scans_{r}") for r in SCAN_RESULTS],
        *[
            F.sum(F.when(committed, F.col(c)).otherwise(0)).over(w).alias(c)
            for c in ("objects", "records_read", "records_matched", "errors")
        ],
        F.col("duration"), F.col("interval"), F.col("lookback"), F.col("seen"),
        F.unix_micros(F.col("at").cast("timestamp")).alias("micros"),
        F.max(F.when(F.col("result") == "ok", F.unix_micros(F.col("at").cast("timestamp")))).over(w).alias("ok_micros"),
    )

    def row(name: str, kind: str, value: Column, extra: tuple[str, str] | None = None) -> Column:
        pairs = [F.lit("subcommand"), F.col("subcommand")]
        if extra:
            pairs += [F.lit(extra[0]), F.lit(extra[1])]
        return F.struct(
            F.lit(PREFIX + name).alias("name"), F.lit(kind).alias("type"), F.create_map(*pairs).alias("labels"),
            value.cast("double").alias("value"),
        )

    entries = F.array(
        *[row("scans_total", "counter", F.col(f"scans_{r}"), ("result", r)) for r in SCAN_RESULTS],
        row("objects_scanned_total", "counter", F.col("objects")),
        row("records_read_total", "counter", F.col("records_read")),
        row("records_matched_total", "counter", F.col("records_matched")),
        row("scan_errors_total", "counter", F.col("errors")),
        row("last_scan_timestamp_seconds", "gauge", F.col("micros") / 1e6),
        row("scan_duration_seconds", "gauge", F.col("duration")),
        row("last_success_timestamp_seconds", "gauge", F.col("ok_micros") / 1e6),
        row("seen_keys", "gauge", F.col("seen")),
        row("lookback_seconds", "gauge", F.col("lookback")),
        row("interval_seconds", "gauge", F.col("interval")),
    )
    return running.select("at", F.inline(entries)).where(F.col("value").isNotNull()).select(
        "name", "type", "labels", "value", "at"
    )
