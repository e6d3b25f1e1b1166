"""Load-balancer request and connection aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators.counters import Dim, by_hour_of_day, count_by, distinct_count, mean, measured, remeasured


def latency() -> Column:
    """Total latency: the logged one, else the sum of the three phases."""
    return F.coalesce(
        F.col("latency"), d.total_latency(F.col("request_time"), F.col("target_time"), F.col("response_time"))
    )


def host() -> Column:
    return d.host_or_sni(F.col("host"), F.col("domain_name"))


def path() -> Column:
    return d.normalize_path(F.col("path"))


def conn_error() -> Column:
    return d.target_conn_error(F.col("error_reason"), F.col("elb_status"), F.col("target"), F.col("target_status"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("received_bytes"), F.lit(0)).alias("received_bytes"),
        F.coalesce(F.sum("sent_bytes"), F.lit(0)).alias("sent_bytes"),
        F.count_if(F.startswith(F.col("elb_status"), F.lit("4"))).alias("errors_4xx"),
        F.count_if(F.startswith(F.col("elb_status"), F.lit("5"))).alias("errors_5xx"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )


def latency_stat(df: DataFrame) -> DataFrame:
    """Over measurable requests only; average and maximum are 0 when there are none."""
    v = latency()
    return df.agg(
        F.count(v).alias("count"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("avg"),
    )


def dims() -> dict[str, Dim]:
    return {
        "lb": Dim(F.col("lb")),
        "type": Dim(F.col("type")),
        "elb_status": Dim(F.col("elb_status")),
        "target_status": Dim(F.col("target_status")),
        "host": Dim(host()),
        "path": Dim(path()),
        "client_ip": Dim(F.col("client_ip")),
        "user_agent": Dim(F.col("user_agent")),
        "target": Dim(F.col("target")),
        "method": Dim(F.col("method")),
        "tls_protocol": Dim(F.col("ssl_protocol")),
        "tls_cipher": Dim(F.col("ssl_cipher")),
        "error_reason": Dim(F.col("error_reason")),
        "action": Dim(F.col("actions")),
    }


def counters(df: DataFrame) -> DataFrame:
    return count_by(df, dims())


def hour_of_day(df: DataFrame) -> DataFrame:
    return by_hour_of_day(df, F.col("ts"))


def target_time_stat(df: DataFrame) -> DataFrame:
    return df.agg(*measured(F.col("target_time"), "target_time")).withColumn("target_time_avg", mean("target_time"))


def conn_errors(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(conn_error()).alias("conn_errors"))


def targets_5xx(df: DataFrame) -> DataFrame:
    """Distinct targets that returned a 5xx, and distinct targets seen."""
    return (
        df.where(F.col("target").isNotNull())
        .groupBy("target")
        .agg(F.max(d.status_digit(F.col("target_status")) == 5).alias("bad"))
        .agg(F.count_if("bad").alias("bad"), F.count("*").alias("seen"))
    )


def _class_counts(prefix: str, status: str) -> list[Column]:
    digit = d.status_digit(F.col(status))
    return [F.count_if(digit == i).alias(f"{prefix}_{i}xx" if i else f"{prefix}_none") for i in range(6)]


def minute_timeline(df: DataFrame) -> DataFrame:
    """Per-minute requests, status classes, connection errors, target time and latency."""
    return (
        df.where(F.col("ts").isNotNull())
        .groupBy(d.minute_of(F.col("ts")).alias("minute"))
        .agg(
            F.count("*").alias("requests"),
            *_class_counts("elb", "elb_status"),
            *_class_counts("target", "target_status"),
            F.count_if(conn_error()).alias("conn_errors"),
            *measured(F.col("target_time"), "target_time"),
            *measured(latency(), "latency"),
        )
    )


TIMELINE_SUMS = (
    "requests",
    *[f"{p}_{c}" for p in ("elb", "target") for c in ("none", "1xx", "2xx", "3xx", "4xx", "5xx")],
    "conn_errors",
)


def merge_timeline(parts: DataFrame, key: Column, name: str) -> DataFrame:
    """Merge timeline rows that fall into the same bucket."""
    return parts.groupBy(key.alias(name)).agg(
        *[F.sum(c).alias(c) for c in TIMELINE_SUMS], *remeasured("target_time"), *remeasured("latency")
    )


def target_groups(df: DataFrame) -> DataFrame:
    """Per target group: traffic, target classes, errors, target time, distinct targets.

    Folded per (group, target) first: a group that takes most of the traffic is
    spread over its targets and the distinct count needs no extra pass.
    """
    sums = ["requests", *[c for c in TIMELINE_SUMS if c.startswith("target_")], "elb_5xx", "conn_errors"]
    per_target = (
        df.where(F.col("target_group_arn").isNotNull())
        .groupBy("target_group_arn", "target")
        .agg(
            F.count("*").alias("requests"),
            *_class_counts("target", "target_status"),
            F.count_if(d.status_digit(F.col("elb_status")) == 5).alias("elb_5xx"),
            F.count_if(conn_error()).alias("conn_errors"),
            *measured(F.col("target_time"), "target_time"),
        )
    )
    return per_target.groupBy("target_group_arn").agg(
        *[F.sum(c).alias(c) for c in sums], *remeasured("target_time"), F.count("target").alias("targets")
    )


def path_latency(df: DataFrame) -> DataFrame:
    """Per normalised path, measurable requests only."""
    return (
        df.select(path().alias("path"), latency().alias("v"))
        .where(F.col("path").isNotNull() & F.col("v").isNotNull())
        .groupBy("path")
        .agg(*measured(F.col("v"), "latency"))
    )


def distinct_clients(df: DataFrame) -> DataFrame:
    return distinct_count(df, F.col("client_ip"), "client_ips")


def weak_tls(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("ssl_protocol").isin(*d.LB_WEAK_TLS)).alias("weak_tls"))


# Connections ---------------------------------------------------------------


def failed() -> Column:
    return d.handshake_failed(F.col("listener"), F.col("ssl_protocol"))


def conn_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("connections"),
        F.count("ssl_protocol").alias("tls"),
        F.count_if(failed()).alias("handshake_failed"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )


def handshake_stat(df: DataFrame) -> DataFrame:
    v = F.col("tls_handshake_time")
    return df.agg(
        F.count(v).alias("count"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("avg"),
    )


def conn_dims() -> dict[str, Dim]:
    return {
        "lb": Dim(F.col("lb")),
        "listener": Dim(F.col("listener")),
        "listener_tls": Dim(d.listener_tls(F.col("listener"), F.col("ssl_protocol"))),
        "tls_protocol": Dim(F.col("ssl_protocol")),
        "tls_cipher": Dim(F.col("ssl_cipher")),
        "key_exchange": Dim(F.col("tls_key_exchange")),
        "verify_status": Dim(F.col("tls_verify_status")),
        "client_ip": Dim(F.col("client_ip")),
        "failed_client_ip": Dim(F.col("client_ip"), where=failed()),
    }


def conn_counters(df: DataFrame) -> DataFrame:
    return count_by(df, conn_dims())


def conn_distinct(df: DataFrame) -> DataFrame:
    """Distinct clients and weak-TLS connections, folded per client first."""
    return (
        df.groupBy("client_ip")
        .agg(F.count_if(F.col("ssl_protocol").isin(*d.LB_WEAK_TLS)).alias("weak"))
        .agg(F.count("client_ip").alias("client_ips"), F.coalesce(F.sum("weak"), F.lit(0)).alias("weak_tls"))
    )
