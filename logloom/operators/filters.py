"""Typed record criteria.

Every criterion is optional; set criteria are AND-ed and the values of one
criterion are OR-ed. ``contains`` is a literal substring, never a pattern.
Cheap tests come first, because generated code evaluates an AND left to right.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.functions import net


def _has(c: Column, needle: str) -> Column:
    return d.yes(F.contains(c, F.lit(needle)))


def _has_any_case(c: Column, needle: str) -> Column:
    return d.yes(F.contains(F.lower(c), F.lit(needle.lower())))


def _one_of_any_case(c: Column, values: Iterable[str]) -> Column:
    return d.yes(F.lower(c).isin(*[v.strip().lower() for v in values]))


def _all(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for i, p in enumerate(parts):
        out = p if i == 0 else out & p
    return out


def in_window(df: DataFrame, column: str, since: datetime | None, until: datetime | None) -> list[Column]:
    """``since <= column < until``; the bounds take the column's own type, so they reach the scan."""
    ts, kind = F.col(column), df.schema[column].dataType
    out = []
    if since is not None:
        out.append(ts >= F.lit(since).cast(kind))
    if until is not None:
        out.append(ts < F.lit(until).cast(kind))
    return out


@dataclass(frozen=True)
class _Filter:
    since: datetime | None = None
    until: datetime | None = None

    TIME = "ts"

    def criteria(self) -> list[Column]:
        raise NotImplementedError

    def predicate(self, df: DataFrame) -> Column:
        return _all(in_window(df, self.TIME, self.since, self.until) + self.criteria())

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate(df))

    @property
    def narrowing(self) -> bool:
        """Specific enough that the matching records are worth listing."""
        return any(getattr(self, f.name) for f in fields(self) if f.name not in ("since", "until", *self._WIDE))

    _WIDE = ()


@dataclass(frozen=True)
class AuditFilter(_Filter):
    principal: str = ""
    resource: str = ""
    source_ip: str = ""
    events: Sequence[str] = ()
    sources: Sequence[str] = ()
    errors_only: bool = False
    writes_only: bool = False

    TIME = "event_time"
    _WIDE = ("writes_only", "sources")

    def criteria(self) -> list[Column]:
        out = []
        if self.errors_only:
            out.append(F.col("error_code").isNotNull())
        if self.events:
            out.append(_one_of_any_case(F.col("event_name"), self.events))
        if self.sources:
            short = [re.sub(r"\.amazonaws\.com$", "", s) for s in self.sources]
            out.append(_one_of_any_case(d.service_name(F.col("event_source")), short))
        if self.writes_only:
            out.append(d.is_write(F.col("read_only"), F.col("event_name")))
        if self.source_ip:
            out.append(_has_any_case(F.col("source_ip"), self.source_ip))
        if self.principal:
            u = F.col("user_identity")
            out.append(
                _has_any_case(
                    d.actor(u["arn"], u["invoked_by"], u["user_name"], u["principal_id"]), self.principal
                )
            )
        if self.resource:
            out.append(
                _has_any_case(F.col("request_parameters"), self.resource)
                | d.yes(F.exists("resources", lambda r: _has_any_case(r["arn"], self.resource)))
            )
        return out


def status_pattern(c: Column, patterns: Sequence[str]) -> Column:
    """``404`` matches exactly; ``4xx``, ``50x`` and anything shorter than three characters by prefix."""
    out = F.lit(False)
    for p in patterns:
        text = p.strip().lower()
        prefix = text.rstrip("x")
        if not prefix:
            continue
        exact = prefix == text and len(text) >= 3
        out = out | (c == text if exact else F.startswith(c, F.lit(prefix)))
    return d.yes(out)


@dataclass(frozen=True)
class LbFilter(_Filter):
    client_ip: str = ""
    host: str = ""
    path: str = ""
    target: str = ""
    user_agent: str = ""
    methods: Sequence[str] = ()
    statuses: Sequence[str] = ()
    slower_than: float = 0.0

    def criteria(self) -> list[Column]:
        out = []
        if self.slower_than > 0:
            out.append(d.yes(F.col("latency") >= self.slower_than))
        if self.statuses:
            out.append(status_pattern(F.col("elb_status"), self.statuses))
        if self.methods:
            out.append(_one_of_any_case(F.col("method"), self.methods))
        if self.client_ip:
            out.append(_has(F.col("client_ip"), self.client_ip))
        if self.target:
            out.append(_has(F.col("target"), self.target))
        if self.host:
            out.append(_has_any_case(d.host_or_sni(F.col("host"), F.col("domain_name")), self.host))
        if self.path:
            out.append(_has_any_case(F.col("path"), self.path))
        if self.user_agent:
            out.append(_has_any_case(F.col("user_agent"), self.user_agent))
        return out

    def for_connections(self, df: DataFrame) -> Column:
        """Connections know only client and time: a request-only criterion matches none."""
        request_only = (
            self.host, self.path, self.target, self.user_agent, self.methods, self.statuses, self.slower_than,
        )
        if any(request_only):
            return F.lit(False)
        client = [_has(F.col("client_ip"), self.client_ip)] if self.client_ip else []
        return _all(in_window(df, self.TIME, self.since, self.until) + client)


@dataclass(frozen=True)
class WafFilter(_Filter):
    actions: Sequence[str] = ()
    client_ip: str = ""
    countries: Sequence[str] = ()
    rule: str = ""
    uri: str = ""
    host: str = ""

    def criteria(self) -> list[Column]:
        out = []
        if self.actions:
            out.append(_one_of_any_case(F.col("action"), self.actions))
        if self.countries:
            out.append(_one_of_any_case(F.col("country"), self.countries))
        if self.client_ip:
            out.append(_has(F.col("client_ip"), self.client_ip))
        for name in ("rule", "uri", "host"):
            needle = getattr(self, name)
            if needle:
                out.append(_has_any_case(F.col(name), needle))
        return out


def _has_any_of(c: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        if n.strip():
            out = out | _has_any_case(c, n.strip())
    return out


@dataclass(frozen=True)
class ObjectFilter(_Filter):
    operations: Sequence[str] = ()
    statuses: Sequence[str] = ()
    requester: str = ""
    client_ip: str = ""
    key_prefix: str = ""
    errors_only: bool = False
    buckets: Sequence[str] = ()

    def criteria(self) -> list[Column]:
        out = []
        status = F.coalesce(F.col("status"), F.lit(0))
        if self.statuses:
            wanted = [s.strip().lower() for s in self.statuses]
            out.append(status.cast("string").isin(*wanted) | d.object_status_class(status).isin(*wanted))
        if self.errors_only:
            out.append(d.object_error(status, F.col("error_code")))
        if self.key_prefix:
            out.append(d.yes(F.startswith(F.col("key"), F.lit(self.key_prefix))))
        if self.operations:
            out.append(_has_any_of(F.col("operation"), self.operations))
        if self.buckets:
            out.append(_has_any_of(F.col("bucket"), self.buckets))
        if self.client_ip:
            out.append(_has(F.col("remote_ip"), self.client_ip))
        if self.requester:
            out.append(_has_any_case(d.principal(F.col("requester")), self.requester.strip()))
        return out


def parse_ports(items: Iterable[str]) -> list[tuple[int, int]]:
    """Ports (``22``) and inclusive ranges (``8000-8100``)."""
    out = []
    for item in items:
        text = item.strip()
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", text)
        lo, hi = (int(m[1]), int(m[2] or m[1])) if m else (1, 0)
        if lo > hi or hi > 65535:
            raise ValueError(f"port {text!r} can't be read: give a number up to 65535, or two with a hyphen between")
        out.append((lo, hi))
    return out


def parse_protocols(items: Iterable[str]) -> list[int]:
    """Protocol names and numbers 0 to 255."""
    numbers = {name: n for n, name in d.PROTOCOL_NAMES.items()}
    out = []
    for item in items:
        text = item.strip().lower()
        n = numbers.get(text, int(text) if text.isdigit() else -1)
        if not 0 <= n <= 255:
            raise ValueError(f"{text!r} is not a known protocol name or a number 0-255")
        out.append(n)
    return out


def parse_size(text: str) -> int:
    """Byte count with an optional binary unit, such as ``512MiB`` or ``10G``."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgtp]?)(?:i?b)?\s*", text.lower())
    if not m:
        raise ValueError(f"{text!r} is not a size such as 512MiB or 10GiB")
    return int(float(m[1]) * 1024 ** " kmgtp".index(m[2] or " "))


@dataclass(frozen=True)
class FlowFilter(_Filter):
    actions: Sequence[str] = ()
    src_cidrs: Sequence[str] = ()
    dst_cidrs: Sequence[str] = ()
    ports: Sequence[str] = ()
    protocols: Sequence[str] = ()
    interfaces: Sequence[str] = ()
    vpcs: Sequence[str] = ()

    TIME = "start"

    def __post_init__(self):
        net.parse_prefixes([*self.src_cidrs, *self.dst_cidrs])
        parse_ports(self.ports)
        parse_protocols(self.protocols)

    def criteria(self) -> list[Column]:
        """Every criterion but the address lists, which may need a join."""
        out = []
        if self.actions:
            out.append(_one_of_any_case(F.col("action"), self.actions))
        if self.protocols:
            out.append(d.yes(F.col("protocol").isin(*parse_protocols(self.protocols))))
        if self.ports:
            hit = F.lit(False)
            for lo, hi in parse_ports(self.ports):
                hit = hit | F.col("src_port").between(lo, hi) | F.col("dst_port").between(lo, hi)
            out.append(d.yes(hit))
        if self.interfaces:
            out.append(_one_of_any_case(F.col("interface_id"), self.interfaces))
        if self.vpcs:
            out.append(d.yes(F.col("vpc_id").isin(*self.vpcs)))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        out = df.where(self.predicate(df))
        if self.src_cidrs:
            out = net.where_any_in(out, ("src_addr", "pkt_src_addr"), self.src_cidrs)
        if self.dst_cidrs:
            out = net.where_any_in(out, ("dst_addr", "pkt_dst_addr"), self.dst_cidrs)
        return out

    def in_window(self, df: DataFrame) -> DataFrame:
        return df.where(_all(in_window(df, self.TIME, self.since, self.until)))


def emitted_flows(df: DataFrame, mode: str = "reject") -> DataFrame:
    """Flows to write out: ``reject`` drops ACCEPT only, ``all`` keeps every flow, ``none`` keeps none."""
    if mode == "all":
        return df
    if mode == "none":
        return df.where(F.lit(False))
    if mode != "reject":
        raise ValueError(f"unknown emit mode {mode!r}")
    return df.where(~d.yes(F.col("action") == "ACCEPT"))
