"""Network-flow aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.functions import net
from logloom.operators.counters import Dim, by_hour, count_by, distinct_count

# SSH, RDP, MySQL, PostgreSQL, SQL Server, Redis, Elasticsearch,
# MongoDB, the Docker API, memcached.
SENSITIVE_PORTS = (22, 3389, 3306, 5432, 1433, 6379, 9200, 27017, 2375, 11211)
# FTP, Telnet, SMB.
LEGACY_PORTS = (21, 23, 445)


def source() -> Column:
    return d.effective(F.col("pkt_src_addr"), F.col("src_addr"))


def destination() -> Column:
    return d.effective(F.col("pkt_dst_addr"), F.col("dst_addr"))


def service() -> Column:
    return d.service_label(F.col("protocol"), F.col("dst_port"))


def started() -> Column:
    return d.initiator(F.col("protocol"), F.col("src_port"), F.col("dst_port"))


def accepted() -> Column:
    return d.yes(F.col("action") == "ACCEPT")


def rejected() -> Column:
    return d.yes(F.col("action") == "REJECT")


def tcp_or_udp() -> Column:
    return d.yes(F.col("protocol").isin(6, 17))


def endpoints(df: DataFrame) -> DataFrame:
    """Flows with their effective endpoints, address classes and starting side, each computed once per flow."""
    with_ends = df.select("*", source().alias("source"), destination().alias("destination"))
    return with_ends.select(
        "*",
        net.is_private(F.col("source")).alias("src_private"), net.is_public(F.col("source")).alias("src_public"),
        net.is_private(F.col("destination")).alias("dst_private"), net.is_public(F.col("destination")).alias("dst_public"),
        started().alias("started"),
    )


def is_scan() -> Column:
    """Rejected connection attempt from a public address to a known port."""
    return (
        rejected()
        & tcp_or_udp()
        & F.col("dst_port").isNotNull()
        & d.conn_attempt(F.col("protocol"), F.col("tcp_flags"))
        & F.col("src_public")
    )


def is_sweep() -> Column:
    """Flow to a private address by the side that started it."""
    return F.col("dst_private") & F.col("started") & F.col("source").isNotNull()


def is_exposed() -> Column:
    """Accepted flow a public source started to a sensitive port of a private host."""
    return (
        accepted()
        & F.coalesce(F.col("dst_port").isin(*SENSITIVE_PORTS), F.lit(False))
        & tcp_or_udp()
        & (F.coalesce(F.col("flow_direction"), F.lit("")) != "egress")
        & F.col("started")
        & F.col("dst_private")
        & F.col("src_public")
    )


def is_egress() -> Column:
    """Accepted flow a private host started to a public address."""
    return accepted() & F.col("started") & F.col("src_private") & F.col("dst_public")


def _legacy() -> Column:
    return accepted() & F.coalesce(F.col("dst_port").isin(*LEGACY_PORTS), F.lit(False)) & tcp_or_udp()


def is_legacy_in() -> Column:
    return _legacy() & F.col("src_public") & F.col("dst_private")


def is_legacy_out() -> Column:
    return _legacy() & F.col("src_private") & F.col("dst_public")


def exposed_service() -> Column:
    return F.concat(
        net.endpoint(F.col("destination"), F.col("dst_port")), F.lit("/"), d.protocol_name(F.col("protocol"))
    )


def classified(df: DataFrame) -> DataFrame:
    """What each security rule needs to know of a flow, one flag per rule."""
    return endpoints(df).select(
        "start", "bytes", "source", "destination", "dst_port", rejected().alias("is_reject"),
        is_scan().alias("is_scan"), is_sweep().alias("is_sweep"), is_exposed().alias("is_exposed"),
        is_egress().alias("is_egress"), is_legacy_in().alias("is_legacy_in"), is_legacy_out().alias("is_legacy_out"),
        F.when(is_exposed(), exposed_service()).alias("exposed_service"),
        F.when(_legacy(), service()).alias("service"),
    )


def is_flow() -> Column:
    """A missing log status means the row is a flow."""
    return F.col("log_status").isNull() | (F.col("log_status") == "OK")


def only_flows(df: DataFrame) -> DataFrame:
    """Rows that describe a flow, without NODATA and SKIPDATA status rows."""
    return df.where(is_flow())


def status_rows(df: DataFrame) -> DataFrame:
    """Counts of the status rows (of the window the caller filtered)."""
    return df.agg(
        F.count_if(F.col("log_status") == "NODATA").alias("nodata"),
        F.count_if(F.col("log_status") == "SKIPDATA").alias("skipdata"),
    )


def totals(df: DataFrame) -> DataFrame:
    """Totals over flows and status rows in one pass."""
    ok = is_flow()

    def of_flows(c: Column) -> Column:
        return F.when(ok, c)

    flows = F.count_if(ok)
    reject = F.count_if(ok & rejected())
    return df.agg(
        flows.alias("flows"),
        F.coalesce(F.sum(of_flows(F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(of_flows(F.col("packets"))), F.lit(0)).alias("packets"),
        F.count_if(F.col("log_status") == "NODATA").alias("nodata"),
        F.count_if(F.col("log_status") == "SKIPDATA").alias("skipdata"),
        F.min(of_flows(F.col("start"))).alias("first"),
        F.max(of_flows(F.col("start"))).alias("last"),
        F.count_if(ok & accepted()).alias("accepted"),
        reject.alias("rejected"),
        F.coalesce(reject / F.nullif(flows, F.lit(0)), F.lit(0.0)).alias("reject_rate"),
    )


def dims() -> dict[str, Dim]:
    pair = F.concat(source(), F.lit(" -> "), destination())
    return {
        "action": Dim(F.col("action")),
        "protocol": Dim(d.protocol_name(F.col("protocol"))),
        "service": Dim(service()),
        "interface": Dim(F.col("interface_id")),
        "direction": Dim(F.col("flow_direction")),
        "bytes_by_action": Dim(F.col("action"), weight=F.col("bytes")),
        "source": Dim(source()),
        "destination": Dim(destination()),
        "pair_bytes": Dim(pair, weight=F.col("bytes")),
        "rejects_by_source": Dim(source(), where=rejected()),
    }


def counters(df: DataFrame) -> DataFrame:
    return count_by(only_flows(df), dims())


def hour_by_action(df: DataFrame) -> DataFrame:
    return by_hour(only_flows(df), F.col("start"), F.col("action"), "action")


def distinct_interfaces(df: DataFrame) -> DataFrame:
    return distinct_count(only_flows(df), F.col("interface_id"), "interfaces")


def scanned_ports(df: DataFrame) -> DataFrame:
    """Distinct rejected destination ports per public source."""
    return _distinct_items(endpoints(only_flows(df)).where(is_scan()), "dst_port")


def swept_hosts(df: DataFrame) -> DataFrame:
    """Distinct private destinations per source that started the flow."""
    return _distinct_items(endpoints(only_flows(df)).where(is_sweep()), "destination")


def _distinct_items(df: DataFrame, item: str) -> DataFrame:
    """Pairs are folded before they are counted, so a hot source is spread over its items."""
    return df.select("source", item).distinct().groupBy("source").agg(F.count("*").alias("n"))


def exposed_services(df: DataFrame) -> DataFrame:
    """Per exposed service: flows, bytes, first flow, distinct public sources."""
    return (
        endpoints(only_flows(df))
        .where(is_exposed())
        .groupBy(exposed_service().alias("service"), "source")
        .agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes"), F.min("start").alias("first"))
        .groupBy("service")
        .agg(
            F.sum("flows").alias("flows"),
            F.sum("bytes").alias("bytes"),
            F.min("first").alias("first"),
            F.count("*").alias("sources"),
        )
    )


def egress_bytes(df: DataFrame) -> DataFrame:
    """Bytes per private source to public destinations."""
    return (
        endpoints(only_flows(df))
        .where(is_egress() & (F.col("bytes") > 0))
        .groupBy("source")
        .agg(F.sum("bytes").alias("bytes"))
    )


def legacy_flows(df: DataFrame) -> DataFrame:
    """Legacy-protocol flows by private host, direction and service."""
    inbound = is_legacy_in()
    return (
        endpoints(only_flows(df))
        .where(inbound | is_legacy_out())
        .groupBy(
            F.when(inbound, F.col("destination")).otherwise(F.col("source")).alias("host"),
            F.when(inbound, "in").otherwise("out").alias("direction"),
            service().alias("service"),
        )
        .agg(F.count("*").alias("n"))
    )


def truncated(df: DataFrame) -> DataFrame:
    """Nothing is ever dropped here: aggregates spill instead of folding keys away."""
    return df.agg(F.lit(False).alias("truncated"))
