"""What one tick computes for each log family, and how the summaries of several ticks merge."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators import audit, flows, lb, lines, metrics, objects, rules, waf
from logloom.operators.counters import mean, measured, merge_counts, remeasured
from logloom.operators.filters import AuditFilter, FlowFilter, LbFilter, ObjectFilter, WafFilter, emitted_flows
from logloom.sources import audit as audit_source
from logloom.sources import flows as flow_source
from logloom.sources import lb as lb_source
from logloom.sources import objects as object_source
from logloom.sources import scope
from logloom.sources import waf as waf_source
from logloom.sources.lines import Parsed

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Family:
    """One log family of the rolling scanner. ``thresholds`` are passed to its rules.

    ``summarise`` gives partial states that ``merge`` folds over ticks and ``finish`` turns into what a report shows;
    ``counters`` gives what a tick adds to the family's metric series.
    """

    name: str
    keep: Callable[[Column], Column]
    whole_files: bool
    parse: Callable[[DataFrame], dict[str, Parsed]]
    select: Callable[[DataFrame, str, dict], DataFrame]
    encode: Callable[[Frames, str], DataFrame]
    summarise: Callable[[Frames], Frames]
    merge: Mapping[str, Callable[[DataFrame], DataFrame]]
    findings: Callable[[Frames, dict], DataFrame | None]
    judge: Callable[[Frames, dict], DataFrame | None]
    counters: Callable[[Frames, DataFrame | None], DataFrame]
    finish: Callable[[Frames], Frames] = lambda merged: {}
    time: str = "ts"
    records: Sequence[str] = ("records",)
    thresholds: dict = field(default_factory=dict)


def _sum_by(*keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(*keys).agg(F.sum("n").alias("n"))


def _merge_facts(df: DataFrame) -> DataFrame:
    return df.groupBy("tag", "actor", "extra", "item").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("first").alias("first")
    )


def _distinct(*keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*keys).distinct()


def merge_totals(df: DataFrame) -> DataFrame:
    """Totals of several ticks: counts add up, the time span widens; rates are left to the reader."""
    out = []
    for f in df.schema.fields:
        if f.name == "first":
            out.append(F.min("first").alias("first"))
        elif f.name in ("last", "max"):
            out.append(F.max(f.name).alias(f.name))
        elif f.name not in ("batch_id", "at"):
            out.append(F.coalesce(F.sum(f.name), F.lit(0)).alias(f.name))
    return df.agg(*out)


def _counters(df: DataFrame) -> DataFrame:
    return merge_counts(df.select("dim", "key", "n"))


def _filtered(cls):
    return lambda df, _name, criteria: cls(**criteria).apply(df)


# Flows ----------------------------------------------------------------------


def _flow_select(df: DataFrame, _name: str, criteria: dict) -> DataFrame:
    """Flows that match; status rows only have to lie in the window."""
    f = FlowFilter(**criteria)
    status = f.in_window(df.where(~flows.is_flow()))
    return f.apply(flows.only_flows(df)).unionByName(status)


def _flow_summary(frames: Frames) -> Frames:
    df = frames["records"]
    only = flows.only_flows(df)
    return {
        "totals": flows.totals(df).drop("reject_rate"), "counters": flows.counters(df),
        "hours": flows.hour_by_action(df), "facts": rules.flow_facts(only), "interfaces": only.select("interface_id").distinct(),
    }


FLOWS = Family(
    name="vpc", keep=flow_source.is_text_flow, whole_files=True,
    parse=lambda df: {"records": flow_source.parse_flow_files(df)},
    select=_flow_select,
    encode=lambda fr, run: lines.flow_lines(emitted_flows(flows.only_flows(fr["records"])), run),
    summarise=_flow_summary,
    merge={"totals": merge_totals, "counters": _counters, "hours": _sum_by("hour", "action"), "facts": _merge_facts, "interfaces": _distinct("interface_id")},
    findings=lambda fr, th: rules.flow_findings(fr["records"], **th),
    judge=lambda m, th: rules.flow_rules(m["facts"], m["totals"].select("first"), **th),
    counters=lambda fr, found: metrics.flow_counters(fr["records"], found),
    finish=lambda m: {"reject_rate": m["counters"].where("dim = 'action'").agg(
        F.coalesce(F.sum(F.when(F.col("key") == "REJECT", F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("reject_rate"))},
    time="start",
)

# Web firewall ---------------------------------------------------------------


def _merge_clients(df: DataFrame) -> DataFrame:
    sums = ("blocks", "allows", "rate_limited", "challenge_fails", "exploits")
    return df.groupBy("client").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min_by("exploit_uri", F.when(F.col("exploit_first").isNotNull(), F.struct("exploit_first", "exploit_uri"))).alias("exploit_uri"),
        F.min("exploit_first").alias("exploit_first"),
    )


def _waf_summary(frames: Frames) -> Frames:
    df = frames["records"]
    return {
        "totals": waf.totals(df).drop("block_rate"), "counters": waf.counters(df), "hours": waf.hour_by_action(df),
        "clients": waf.client_stats(df), "facts": rules.waf_facts(df), "acls": df.select("web_acl").distinct(),
        "sources": waf.action_by_source(df),
    }


WAF = Family(
    name="waf", keep=scope.is_waf_file, whole_files=False,
    parse=lambda df: {"records": waf_source.parse_waf(df)},
    select=_filtered(WafFilter),
    encode=lambda fr, run: lines.waf_lines(fr["records"], run),
    summarise=_waf_summary,
    merge={
        "totals": merge_totals, "counters": _counters, "hours": _sum_by("hour", "action"), "clients": _merge_clients,
        "facts": _merge_facts, "acls": _distinct("web_acl"), "sources": _sum_by("source", "action"),
    },
    findings=lambda fr, th: rules.waf_findings(fr["records"], **th),
    judge=lambda m, th: rules.waf_rules(m["clients"], m["facts"], m["totals"].select("first"), **th),
    counters=lambda fr, found: metrics.waf_counters(fr["records"], found),
    finish=lambda m: {"block_rate": m["totals"].select(F.coalesce(F.col("blocked") / F.nullif("requests", F.lit(0)), F.lit(0.0)).alias("block_rate"))},
)

# Object access --------------------------------------------------------------


def _object_summary(frames: Frames) -> Frames:
    df = frames["records"]
    return {
        "totals": objects.totals(df), "counters": objects.counters(df), "hours": objects.hour_by_class(df),
        "facts": rules.object_facts(df), "changes": objects.access_changes(df), "buckets": df.select("bucket").distinct(),
        "requesters": df.select(objects.principal().alias("requester")).distinct(),
    }


def _merge_changes(df: DataFrame) -> DataFrame:
    order = ("ts", "bucket", "operation", "key", "principal", "remote_ip")
    return df.select(*order)


OBJECTS = Family(
    name="s3", keep=scope.is_object_file, whole_files=False,
    parse=lambda df: {"records": object_source.parse_objects(df)},
    select=_filtered(ObjectFilter),
    encode=lambda fr, run: lines.object_lines(fr["records"], run),
    summarise=_object_summary,
    merge={
        "totals": merge_totals, "counters": _counters, "hours": _sum_by("hour", "status_class"), "facts": _merge_facts,
        "changes": _merge_changes, "buckets": _distinct("bucket"), "requesters": _distinct("requester"),
    },
    findings=lambda fr, th: rules.object_findings(fr["records"], **th),
    judge=lambda m, th: rules.object_rules(m["facts"], m["changes"], m["totals"].select("first"), **th),
    counters=lambda fr, found: metrics.object_counters(fr["records"], found),
)

# Load balancer --------------------------------------------------------------


def _lb_select(df: DataFrame, name: str, criteria: dict) -> DataFrame:
    f = LbFilter(**criteria)
    return df.where(f.for_connections(df)) if name == "connections" else f.apply(df)


def _lb_summary(frames: Frames) -> Frames:
    req, con = frames["requests"], frames["connections"]
    return {
        "totals": lb.totals(req), "counters": lb.counters(req), "timeline": lb.minute_timeline(req),
        "groups": lb.target_groups(req).drop("targets"), "paths": lb.path_latency(req),
        "latency": req.agg(*measured(lb.latency(), "latency"), *measured(F.col("target_time"), "target_time"), F.count_if(lb.conn_error()).alias("conn_errors")),
        "hours": req.where(F.col("ts").isNotNull()).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")),
        "targets": req.where(F.col("target").isNotNull()).groupBy("target").agg(F.max(d.status_digit(F.col("target_status")) == 5).alias("bad")),
        "members": req.where(F.col("target_group_arn").isNotNull()).select("target_group_arn", "target").distinct(),
        "conn_totals": lb.conn_totals(con), "conn_counters": lb.conn_counters(con),
        "handshake": con.agg(*measured(F.col("tls_handshake_time"), "handshake")),
        "conn_clients": con.select("client_ip").distinct(),
    }


def _merge_groups(df: DataFrame) -> DataFrame:
    sums = ["requests", *[c for c in lb.TIMELINE_SUMS if c.startswith("target_")], "elb_5xx", "conn_errors"]
    return df.groupBy("target_group_arn").agg(*[F.sum(c).alias(c) for c in sums], *remeasured("target_time"))


def _lb_finish(m: Frames) -> Frames:
    """Statistics of the whole window: averages and target health come from sums and sets, never from averages of ticks."""
    of_group = m["members"].groupBy("target_group_arn").agg(F.count("target").alias("targets"))
    return {
        "latency": m["latency"].withColumn("latency_avg", mean("latency")).withColumn("target_time_avg", mean("target_time")),
        "handshake": m["handshake"].withColumn("handshake_avg", mean("handshake")),
        "target_health": m["targets"].agg(F.count_if("bad").alias("bad"), F.count("*").alias("seen")),
        "groups": m["groups"].join(of_group, "target_group_arn", "left"),
    }


LOAD_BALANCER = Family(
    name="elb", keep=scope.is_lb_file, whole_files=False,
    parse=lambda df: {
        "requests": lb_source.parse_lb(df.where(~scope.is_conn_file(F.col("file")))),
        "connections": lb_source.parse_lb_conns(df.where(scope.is_conn_file(F.col("file")))),
    },
    select=_lb_select,
    encode=lambda fr, run: lines.lb_lines(fr["requests"], run).unionByName(lines.conn_lines(fr["connections"], run)),
    summarise=_lb_summary,
    merge={
        "totals": merge_totals, "counters": _counters,
        "timeline": lambda df: lb.merge_timeline(df, F.col("minute"), "minute"), "groups": _merge_groups,
        "paths": lambda df: df.groupBy("path").agg(*remeasured("latency")),
        "conn_totals": merge_totals, "conn_counters": _counters,
        "latency": lambda df: df.agg(*remeasured("latency"), *remeasured("target_time"), F.coalesce(F.sum("conn_errors"), F.lit(0)).alias("conn_errors")),
        "hours": _sum_by("hour"), "targets": lambda df: df.groupBy("target").agg(F.max("bad").alias("bad")),
        "members": _distinct("target_group_arn", "target"), "handshake": lambda df: df.agg(*remeasured("handshake")),
        "conn_clients": _distinct("client_ip"),
    },
    findings=lambda fr, th: None,
    judge=lambda m, th: None,
    counters=lambda fr, found: metrics.lb_counters(fr["requests"], fr["connections"]),
    finish=_lb_finish,
    records=("requests", "connections"),
)

# Audit events ---------------------------------------------------------------

AUDIT = Family(
    name="cloudtrail", keep=scope.is_audit_file, whole_files=True,
    parse=lambda df: {"records": audit_source.parse_audit(df)},
    select=_filtered(AuditFilter),
    encode=lambda fr, run: lines.audit_lines(fr["records"], run),
    summarise=lambda fr: {
        "totals": audit.totals(fr["records"]), "counters": audit.counters(fr["records"]),
        "hours": fr["records"].where(F.col("event_time").isNotNull()).groupBy(F.hour("event_time").alias("hour")).agg(F.count("*").alias("n")),
        "principals": fr["records"].select(audit.actor().alias("actor")).distinct(),
    },
    merge={"totals": merge_totals, "counters": _counters, "hours": _sum_by("hour"), "principals": _distinct("actor")},
    findings=lambda fr, th: rules.audit_findings(fr["records"]),
    # Per-record findings do not change when ticks merge: the stored ones are the report.
    judge=lambda m, th: m["findings"],
    counters=lambda fr, found: metrics.audit_counters(fr["records"], found),
    time="event_time",
)

FAMILIES = {f.name: f for f in (FLOWS, WAF, OBJECTS, LOAD_BALANCER, AUDIT)}

