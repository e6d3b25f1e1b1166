"""Web-firewall aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.operators.counters import Dim, by_hour, count_by, distinct_count


def exploit() -> Column:
    return d.exploit_match(F.col("action"), F.col("count_rules"), F.col("labels"))


def counted() -> Column:
    """A COUNT rule matched; the top-level action is never COUNT."""
    return d.yes(F.size("count_rules") > 0)


def totals(df: DataFrame) -> DataFrame:
    blocked = F.count_if(F.col("action") == "BLOCK")
    return df.agg(
        F.count("*").alias("requests"),
        F.count_if(counted()).alias("counted"),
        F.count_if("oversize").alias("oversize"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        blocked.alias("blocked"),
        F.coalesce(blocked / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("block_rate"),
    )


def dims() -> dict[str, Dim]:
    has_client, is_block = F.col("client_ip").isNotNull(), F.col("action") == "BLOCK"
    return {
        "action": Dim(F.col("action")),
        "acl": Dim(F.col("web_acl")),
        "rule": Dim(F.col("rule"), where=F.col("action") != "ALLOW"),
        "rule_group": Dim(F.col("rule_group")),
        "client_ip": Dim(F.col("client_ip")),
        "country": Dim(F.col("country")),
        "host": Dim(F.col("host")),
        "uri": Dim(d.normalize_path(F.col("uri"))),
        "method": Dim(F.col("method")),
        "user_agent": Dim(F.col("user_agent")),
        "source": Dim(F.col("source")),
        "ja4": Dim(F.col("ja4")),
        "response_code": Dim(F.col("response_code"), where=F.col("response_code") > 0),
        "label": Dim(F.col("labels"), many=True),
        "count_rule": Dim(F.col("count_rules"), many=True),
        "blocked_client_ip": Dim(F.col("client_ip"), where=is_block),
        "blocked_country": Dim(F.col("country"), where=is_block & has_client),
        "oversize_client_ip": Dim(F.col("client_ip"), where=F.col("oversize")),
    }


def counters(df: DataFrame) -> DataFrame:
    return count_by(df, dims())


def action_by_source(df: DataFrame) -> DataFrame:
    """Actions by inspection source: ``(source, action, n)``."""
    return (
        df.where(F.col("source").isNotNull() & F.col("action").isNotNull())
        .groupBy("source", "action")
        .agg(F.count("*").alias("n"))
    )


def hour_by_action(df: DataFrame) -> DataFrame:
    return by_hour(df, F.col("ts"), F.col("action"), "action")


def client_stats(df: DataFrame) -> DataFrame:
    """Everything the client rules need, one row per client; requests without an address are client ``""``."""
    match = exploit()
    return (
        df.select(F.coalesce("client_ip", F.lit("")).alias("client"), "action", "rate_rule", "challenge_failed", "ts", "uri", match.alias("match"))
        .groupBy("client")
        .agg(
            F.count_if(F.col("action") == "BLOCK").alias("blocks"),
            F.count_if(F.col("action") == "ALLOW").alias("allows"),
            F.count("rate_rule").alias("rate_limited"),
            F.count_if("challenge_failed").alias("challenge_fails"),
            F.count("match").alias("exploits"),
            F.min(F.when(F.col("match").isNotNull(), F.col("ts"))).alias("exploit_first"),
            F.min_by("uri", F.when(F.col("match").isNotNull(), F.struct("ts", "uri"))).alias("exploit_uri"),
        )
    )


def client_counts(df: DataFrame) -> DataFrame:
    """Per client: blocks, allows, rate-limited requests, challenge failures."""
    return (
        df.where(F.col("client_ip").isNotNull())
        .groupBy("client_ip")
        .agg(
            F.count_if(F.col("action") == "BLOCK").alias("blocks"),
            F.count_if(F.col("action") == "ALLOW").alias("allows"),
            F.count("rate_rule").alias("rate_limited"),
            F.count_if("challenge_failed").alias("challenge_fails"),
        )
    )


def rate_rule_clients(df: DataFrame) -> DataFrame:
    """Requests per rate rule and client: ``(rate_rule, client_ip, n)``."""
    return df.where(F.col("rate_rule").isNotNull()).groupBy("rate_rule", "client_ip").agg(F.count("*").alias("n"))


def exploit_matches(df: DataFrame) -> DataFrame:
    """Exploit matches per client: ``(client_ip, match, n)``."""
    return (
        df.select("client_ip", exploit().alias("match"))
        .where(F.col("match").isNotNull())
        .groupBy("client_ip", "match")
        .agg(F.count("*").alias("n"))
    )


def distinct_clients(df: DataFrame) -> DataFrame:
    return distinct_count(df, F.col("client_ip"), "client_ips")
