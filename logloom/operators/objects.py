"""Object-access aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators.counters import Dim, by_hour, count_by, distinct_count



def status() -> Column:
    return F.coalesce(F.col("status"), F.lit(0))


def principal() -> Column:
    return d.principal(F.col("requester"))


def denied() -> Column:
    return d.object_denied(status(), F.col("error_code"))


def success() -> Column:
    return d.object_success(status())


def anon_write() -> Column:
    """Successful anonymous write or delete."""
    op = F.col("operation")
    return (
        success()
        & F.col("requester").isNull()
        & (d.object_write(op) | d.object_delete(op) | d.object_multi_delete(op))
    )


def anon_read() -> Column:
    """Successful anonymous read."""
    return success() & F.col("requester").isNull() & d.object_read(F.col("operation"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_sent"),
        F.count_if(d.object_error(status(), F.col("error_code"))).alias("errors"),
        F.count_if(F.col("requester").isNull()).alias("anonymous"),
        F.count_if(denied()).alias("denied"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )


def dims() -> dict[str, Dim]:
    sent, named = F.col("bytes_sent"), F.col("requester").isNotNull()
    return {
        "operation": Dim(F.col("operation")),
        "status": Dim(status(), where=status() > 0),
        "error_code": Dim(F.col("error_code")),
        "bucket": Dim(F.col("bucket")),
        "tls": Dim(F.col("tls_version")),
        "auth_type": Dim(F.col("auth_type")),
        "sig_version": Dim(F.col("sig_version")),
        "principal": Dim(principal()),
        "remote_ip": Dim(F.col("remote_ip")),
        "key": Dim(F.concat("bucket", F.lit("/"), "key")),
        "user_agent": Dim(F.col("user_agent")),
        "bytes_by_ip": Dim(F.col("remote_ip"), weight=sent),
        "bytes_by_requester": Dim(F.col("requester"), weight=sent),
        "denied_by_ip": Dim(F.col("remote_ip"), where=denied()),
        "denied_by_requester": Dim(F.col("requester"), where=denied() & named),
        "deletes_by_principal": Dim(principal(), where=success() & d.object_delete(F.col("operation"))),
        "weak_tls": Dim(principal(), where=d.object_weak_tls(F.col("tls_version"))),
        "plain_http": Dim(principal(), where=d.yes(F.col("plain_http"))),
        "sigv2": Dim(principal(), where=d.object_sigv2(F.col("sig_version"))),
    }


def counters(df: DataFrame) -> DataFrame:
    return count_by(df, dims())


def anonymous(df: DataFrame, kind: Column) -> DataFrame:
    """Per bucket: count and first time of the anonymous requests of one kind."""
    return df.where(kind).groupBy("bucket").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


def access_changes(df: DataFrame, n: int | None = None) -> DataFrame:
    """Successful policy, ACL and public-access-block changes: all of them, or the ``n`` earliest."""
    changes = (
        df.where(success() & d.object_access_change(F.col("operation")))
        .select("ts", "bucket", "operation", "key", principal().alias("principal"), "remote_ip")
    )
    return changes if n is None else changes.orderBy("ts", "bucket", "operation", "key", "principal", "remote_ip").limit(n)


def hour_by_class(df: DataFrame) -> DataFrame:
    return by_hour(df, F.col("ts"), d.object_status_class(status()), "status_class")


def distinct_buckets(df: DataFrame) -> DataFrame:
    return distinct_count(df, F.col("bucket"), "buckets")


def distinct_requesters(df: DataFrame) -> DataFrame:
    return distinct_count(df, principal(), "requesters")
