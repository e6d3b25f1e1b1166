"""Health gauges, tables and rings, and the summary blocks of each family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators import audit, flows, lb, objects, waf
from logloom.operators.counters import Dim, count_by, fold_tail, mean, measured, remeasured, unpivot
from logloom.operators.series import LATENCY_CRIT, LATENCY_WARN

# Warn and crit limits of the gauges.
RATE_5XX = (0.01, 0.05)
CONN_ERROR_RATE = (0.000001, 0.01)
FAILING_SHOWN = 200


def _ratio(n: Column, of: Column) -> Column:
    return F.when(of == 0, F.lit(0.0)).otherwise(n / of)


def gauges(df: DataFrame) -> DataFrame:
    """Four gauges: ``(gauge, value, fraction, tone)``, from one scan folded per target."""
    per_target = df.groupBy("target").agg(
        F.count("*").alias("requests"),
        F.count_if(F.startswith(F.col("elb_status"), F.lit("5"))).alias("errors_5xx"),
        F.count_if(lb.conn_error()).alias("conn_errors"),
        F.max(d.status_digit(F.col("target_status")) == 5).alias("bad"),
        *measured(F.col("target_time"), "target_time"),
    )
    one = per_target.agg(
        F.sum("requests").alias("requests"),
        F.sum("errors_5xx").alias("errors_5xx"),
        F.sum("conn_errors").alias("conn_errors"),
        F.count_if(F.col("bad") & F.col("target").isNotNull()).alias("bad"),
        F.count("target").alias("seen"),
        *remeasured("target_time"),
    )
    total, bad, seen = F.col("requests"), F.col("bad"), F.col("seen")
    rate5, conn = _ratio(F.col("errors_5xx"), total), _ratio(F.col("conn_errors"), total)
    avg = mean("target_time")

    def gauge(name: str, value: Column, fraction: Column, tone: Column) -> Column:
        return F.struct(
            F.lit(name).alias("gauge"), value.cast("double").alias("value"),
            fraction.cast("double").alias("fraction"), tone.alias("tone"),
        )

    return one.where(total > 0).select(
        F.inline(
            F.array(
                gauge("target_response_time", avg, F.coalesce(avg / (2 * LATENCY_CRIT), F.lit(0.0)),
                      d.threshold_tone(avg, LATENCY_WARN, LATENCY_CRIT)),
                gauge("rate_5xx", rate5, rate5 / 0.10, d.threshold_tone(rate5, *RATE_5XX)),
                gauge("target_connection_errors", F.col("conn_errors"), conn / 0.05,
                      d.threshold_tone(conn, *CONN_ERROR_RATE)),
                gauge("targets_5xx", bad, _ratio(bad, seen),
                      F.when(bad == 0, "ok").when(bad == seen, "crit").otherwise("warn")),
            )
        )
    )


def group_table(df: DataFrame, n: int = 10) -> DataFrame:
    """Busiest target groups with their error tone."""
    ranked = lb.target_groups(df).orderBy(F.desc("requests"), F.asc("target_group_arn")).limit(n)
    errors = _ratio(F.col("elb_5xx") + F.col("conn_errors"), F.col("requests"))
    return ranked.select(
        d.target_group_name(F.col("target_group_arn")).alias("name"),
        F.col("target_group_arn").alias("arn"),
        "requests",
        F.col("target_2xx").alias("t2xx"),
        F.col("target_4xx").alias("t4xx"),
        F.col("target_5xx").alias("t5xx"),
        "elb_5xx", "conn_errors", "targets",
        mean("target_time").alias("avg"),
        F.col("target_time_max").alias("max"),
        d.threshold_tone(errors, *RATE_5XX).alias("tone"),
    )


def slowest_paths(df: DataFrame, n: int = 10) -> DataFrame:
    """Paths with the highest average latency: ``(path, count, avg, min, max)``."""
    return (
        lb.path_latency(df)
        .select("path", F.col("latency_count").alias("count"), mean("latency").alias("avg"),
                F.col("latency_min").alias("min"), F.col("latency_max").alias("max"))
        .orderBy(F.desc("avg"), F.asc("path"))
        .limit(n)
    )


def path_table(df: DataFrame, n: int = 10) -> DataFrame:
    """Slowest paths with percentages of the slowest maximum shown, and tones."""
    rows = slowest_paths(df, n)
    top = F.max("max").over(Window.partitionBy(F.lit(1)))

    def percent(v: Column) -> Column:
        return F.when(top > 0, F.floor(v / top * 100).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    return rows.select(
        "*",
        percent(F.col("avg")).alias("avg_pct"),
        percent(F.col("max")).alias("max_pct"),
        d.threshold_tone(F.col("avg"), LATENCY_WARN, LATENCY_CRIT).alias("avg_tone"),
        d.threshold_tone(F.col("max"), LATENCY_WARN, LATENCY_CRIT).alias("max_tone"),
    )


def ring(counts: DataFrame, n: int = 5) -> DataFrame:
    """Top keys and ``Other`` with percentages of the whole."""
    rows = fold_tail(counts, n, other="Other")
    dims = ["dim"] if "dim" in counts.columns else []
    w = Window.partitionBy(*(dims or [F.lit(1)]))
    return rows.withColumn("pct", F.col("n") * 100 / F.sum("n").over(w))


def ring_dims() -> dict[str, Dim]:
    return {
        "ELB status": Dim(d.ring_status_class(F.col("elb_status")), where=F.col("elb_status").isNotNull()),
        "Load balancer": Dim(F.col("lb")),
        "Method": Dim(F.col("method")),
        "Listener type": Dim(F.col("type")),
    }


def rings(df: DataFrame) -> DataFrame:
    return ring(count_by(df, ring_dims()))


def failing_requests(matches: DataFrame, shown: int = FAILING_SHOWN) -> DataFrame:
    """5xx and 4xx requests among the kept matches, ``shown`` of each, with the class totals.

    ``matches`` is the already limited match list, so the windows stay small.
    """
    status = F.col("elb_status")
    level = F.when(F.rlike(status, F.lit("(?s)^5..$")), "error").when(F.rlike(status, F.lit("(?s)^4..$")), "warning")
    rows = matches.withColumn("level", level).where(F.col("level").isNotNull())
    whole = Window.partitionBy("level")
    place = F.row_number().over(whole.orderBy(*[c for c in matches.columns if c not in ("labels",)]))
    return rows.withColumn("place", place).withColumn("total", F.count("*").over(whole)).where(F.col("place") <= shown)


def failing(df: DataFrame, n: int = 200, shown: int = FAILING_SHOWN) -> DataFrame:
    """Failing requests among the ``n`` earliest matches, in time order."""
    keep = ["ts", "lb", "client_ip", "elb_status", "method", "path", "user_agent"]
    first = df.select(*keep).orderBy(*keep).limit(n)
    return failing_requests(first, shown)


def flow_notes(df: DataFrame) -> DataFrame:
    """Data-quality notes: intervals whose capture skipped records."""
    return (
        flows.status_rows(df)
        .where(F.col("skipdata") > 0)
        .select(
            F.lit("skipdata").alias("note"),
            F.col("skipdata").alias("n"),
            F.concat(
                F.col("skipdata").cast("string"),
                F.lit(" rows are marked SKIPDATA: flows of those intervals were lost before logging, "
                      "real traffic is above these totals."),
            ).alias("text"),
        )
    )


# Summary blocks ------------------------------------------------------------


def audit_summary(df: DataFrame) -> DataFrame:
    return unpivot(audit.totals(df))


def lb_summary(df: DataFrame) -> DataFrame:
    v = lb.latency()
    row = df.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("received_bytes"), F.lit(0)).alias("received_bytes"),
        F.coalesce(F.sum("sent_bytes"), F.lit(0)).alias("sent_bytes"),
        F.count_if(F.startswith(F.col("elb_status"), F.lit("4"))).alias("errors_4xx"),
        F.count_if(F.startswith(F.col("elb_status"), F.lit("5"))).alias("errors_5xx"),
        F.round(F.coalesce(F.avg(v), F.lit(0.0)), 6).alias("latency_avg"),
        F.round(F.coalesce(F.max(v), F.lit(0.0)), 6).alias("latency_max"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    return unpivot(row)


def conn_summary(df: DataFrame) -> DataFrame:
    v = F.col("tls_handshake_time")
    row = df.agg(
        F.count("*").alias("connections"),
        F.count("ssl_protocol").alias("tls"),
        F.count_if(lb.failed()).alias("handshake_failed"),
        F.round(F.coalesce(F.avg(v), F.lit(0.0)), 6).alias("handshake_avg"),
        F.round(F.coalesce(F.max(v), F.lit(0.0)), 6).alias("handshake_max"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    return unpivot(row)


def waf_summary(df: DataFrame) -> DataFrame:
    blocked = F.count_if(F.col("action") == "BLOCK")
    row = df.agg(
        F.count("*").alias("requests"),
        blocked.alias("blocked"),
        F.count_if(F.col("action") == "ALLOW").alias("allowed"),
        F.count_if(waf.counted()).alias("counted"),
        F.count_if(F.col("action").isin("CAPTCHA", "CHALLENGE")).alias("challenged"),
        F.round(F.coalesce(blocked / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("block_rate"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    return unpivot(row)


def object_summary(df: DataFrame) -> DataFrame:
    return unpivot(objects.totals(df), ["requests", "errors", "denied", "anonymous", "bytes_sent"])


def flow_summary(df: DataFrame) -> DataFrame:
    row = flows.totals(df).withColumn("reject_rate", F.round("reject_rate", 6))
    return unpivot(row)


# Matching records ----------------------------------------------------------


def audit_matches(df: DataFrame, n: int = 200) -> DataFrame:
    rows = df.select(
        "event_time", F.col("recipient_account_id").alias("account"), F.col("aws_region").alias("region"),
        "event_name", audit.actor().alias("actor"), "source_ip", "error_code", "event_id",
    )
    return rows.orderBy("event_time", "event_id").limit(n)


def lb_matches(df: DataFrame, n: int = 200) -> DataFrame:
    rows = df.select(
        "ts", "lb", "client_ip", "target", "elb_status", "target_status", lb.latency().alias("latency"),
        "received_bytes", "sent_bytes", "method", lb.host().alias("host"), "path", "user_agent", "ssl_protocol",
        "ssl_cipher", F.col("actions").alias("action"), "error_reason",
    )
    return rows.orderBy(*rows.columns).limit(n)


def conn_matches(df: DataFrame, n: int = 200) -> DataFrame:
    rows = df.select(
        "ts", "lb", "client_ip", "listener",
        F.when(lb.failed(), "FAILED").otherwise(F.col("ssl_protocol")).alias("tls"), "ssl_cipher",
        F.col("tls_key_exchange").alias("key_exchange"), F.col("tls_handshake_time").alias("handshake"),
        F.col("tls_verify_status").alias("verify"), "conn_trace_id",
    )
    return rows.orderBy(*rows.columns).limit(n)


def waf_matches(df: DataFrame, n: int = 200) -> DataFrame:
    rows = df.select(
        "ts", "web_acl", "action", "rule", "client_ip", "country", "method", "host", "uri", "user_agent"
    )
    return rows.orderBy(*rows.columns).limit(n)


def object_matches(df: DataFrame, n: int = 200) -> DataFrame:
    rows = df.select(
        "ts", "bucket", "operation", "key", objects.status().alias("status"), "error_code",
        objects.principal().alias("requester"), "remote_ip", "bytes_sent", "tls_version", "user_agent",
    )
    return rows.orderBy(*rows.columns).limit(n)


def flow_matches(df: DataFrame, n: int = 200) -> DataFrame:
    rows = flows.only_flows(df).select(
        "start", "interface_id", "action", flows.source().alias("source"), "src_port",
        flows.destination().alias("destination"), "dst_port", d.protocol_name(F.col("protocol")).alias("protocol"),
        "packets", "bytes", F.col("flow_direction").alias("direction"), "vpc_id",
    )
    return rows.orderBy(*rows.columns).limit(n)
