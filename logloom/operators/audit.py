"""Audit-event aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators.counters import Dim, by_hour_of_day, count_by, distinct_count


def actor() -> Column:
    u = F.col("user_identity")
    return d.actor(u["arn"], u["invoked_by"], u["user_name"], u["principal_id"])


def service() -> Column:
    return d.service_name(F.col("event_source"))


def is_write() -> Column:
    return d.is_write(F.col("read_only"), F.col("event_name"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("events"),
        F.count_if(is_write()).alias("writes"),
        F.count("error_code").alias("errors"),
        F.min("event_time").alias("first"),
        F.max("event_time").alias("last"),
    )


def dims() -> dict[str, Dim]:
    return {
        "principal": Dim(actor()),
        "event_name": Dim(F.col("event_name")),
        "service": Dim(service()),
        "account": Dim(F.col("recipient_account_id")),
        "region": Dim(F.col("aws_region")),
        "error_code": Dim(F.col("error_code")),
        "source_ip": Dim(F.col("source_ip")),
    }


def extra_dims() -> dict[str, Dim]:
    """Two more counters that dashboards over emitted lines show."""
    return {"user_agent": Dim(F.col("user_agent")), "identity_type": Dim(F.col("user_identity")["type"])}


def counters(df: DataFrame) -> DataFrame:
    return count_by(df, dims())


def hour_of_day(df: DataFrame) -> DataFrame:
    return by_hour_of_day(df, F.col("event_time"))


def distinct_principals(df: DataFrame) -> DataFrame:
    return distinct_count(df, actor(), "principals")


def distinct_source_ips(df: DataFrame) -> DataFrame:
    return distinct_count(df, F.col("source_ip"), "source_ips")
