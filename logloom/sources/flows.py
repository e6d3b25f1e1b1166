"""Network-flow logs: each file's first line names its columns.

A gzip file is read by one task from its first line on, so the task remembers
the header and gives it on with every block of lines: files of any size take no
join, no shuffle and no row that holds a whole file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, TimestampType

from logloom.functions import net
from logloom.functions import text as x
from logloom.sources import scope as s
from logloom.sources.lines import (
    Parsed, read_lines, no_rows, parsed, salvage_contents, unreadable_of,
)

# Header name of each column.
HEADER_NAMES = {
    "version": "version", "account_id": "account-id", "interface_id": "interface-id", "src_addr": "srcaddr",
    "dst_addr": "dstaddr", "src_port": "srcport", "dst_port": "dstport", "protocol": "protocol", "packets": "packets",
    "bytes": "bytes", "start": "start", "end": "end", "action": "action", "log_status": "log-status",
    "vpc_id": "vpc-id", "subnet_id": "subnet-id", "instance_id": "instance-id", "tcp_flags": "tcp-flags",
    "type": "type", "pkt_src_addr": "pkt-srcaddr", "pkt_dst_addr": "pkt-dstaddr", "region": "region",
    "az_id": "az-id", "pkt_src_aws_service": "pkt-src-aws-service", "pkt_dst_aws_service": "pkt-dst-aws-service",
    "flow_direction": "flow-direction", "traffic_path": "traffic-path", "reject_reason": "reject-reason",
}
_ADDRESSES = ("src_addr", "dst_addr", "pkt_src_addr", "pkt_dst_addr")
_PORTS = ("src_port", "dst_port")
_INTS = ("version", "protocol", "tcp_flags", "traffic_path")
_LONGS = ("packets", "bytes")
_TIMES = ("start", "end")


def _names(header: Column) -> Column:
    """Column names of a header line; ``${name}`` is the same as ``name``."""
    return F.transform(x.space_tokens(header), lambda n: F.regexp_replace(n, r"^\$\{|\}$", ""))


def _header_error(names: Column) -> Column:
    return (
        F.when(F.coalesce(F.size(names), F.lit(0)) == 0, "header: empty")
        .when(F.exists(names, lambda n: F.rlike(n, F.lit("^[0-9]"))), "header: missing, the first line is a record")
        .when(~F.array_contains(names, "start"), "header: no start field")
    )


def _positions(names: Column) -> Column:
    """0-based place of every known column, NULL when the file has none; the last of equal names counts."""
    def place(name: str) -> Column:
        from_end = F.array_position(F.reverse(names), name)
        return F.when(from_end > 0, (F.size(names) - from_end).cast("int"))

    return F.array(*[place(h) for h in HEADER_NAMES.values()])


def _typed(name: str, v: Column) -> Column:
    if name in _ADDRESSES:
        return net.addr_text(v)
    if name in _PORTS:
        return x.port(v)
    if name in _INTS:
        return v.try_cast("int")
    if name in _LONGS:
        return x.whole(v)
    if name in _TIMES:
        return x.epoch_seconds(x.whole(v))
    return v


def parse_flow_rows(rows: DataFrame, unreadable: DataFrame | None = None) -> Parsed:
    """Record lines ``(file, pos, line, n_names, places)`` to flows."""
    tokens = rows.select("file", "pos", "n_names", "places", x.space_tokens(F.col("line")).alias("tokens"))
    columns = list(HEADER_NAMES)
    raw = tokens.select(
        "file", "pos", "n_names", "places", F.size("tokens").alias("n_tokens"),
        *[
            F.nullif(F.get(F.col("tokens"), F.get(F.col("places"), F.lit(i))), F.lit("-")).alias(f"raw_{n}")
            for i, n in enumerate(columns)
        ],
    )
    typed = raw.select(
        "file", "pos", "n_names", "n_tokens", "places",
        *[f"raw_{n}" for n in columns if n in _checked()],
        *[_typed(n, F.col(f"raw_{n}")).alias(n) for n in columns],
    )
    # The first unreadable column in the order of the file's own header.
    faults = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"raw_{n}").isNotNull() & F.col(n).isNull(),
                    F.struct(
                        F.get(F.col("places"), F.lit(i)).alias("place"),
                        F.lit(f"bad {HEADER_NAMES[n]} field").alias("err"),
                    ),
                )
                for i, n in enumerate(columns)
                if n in _checked()
            ]
        )
    )
    fault = F.array_min(faults)
    error = F.coalesce(
        fault["err"],
        F.when(F.col("n_tokens") < F.col("n_names"), "fewer fields than the header").when(
            F.col("n_tokens") > F.col("n_names"), "more fields than the header"
        ),
    )
    values = {n: F.coalesce(n, F.lit(0)) if n in _LONGS else F.col(n) for n in columns}
    record = F.struct(*[v.alias(n) for n, v in values.items()])
    return parsed(typed.select("file", "pos", error.alias("err"), record.alias("rec")), unreadable)


def _checked() -> tuple[str, ...]:
    return _ADDRESSES + _PORTS + _INTS + _LONGS + _TIMES


def _with_header(headed: DataFrame) -> DataFrame:
    """Rows with ``header`` get its error, its width and the places of its columns, once per file."""
    named = headed.withColumn("names", _names(F.col("header")))
    return named.select(
        "*", _header_error(F.col("names")).alias("header_err"), F.size("names").alias("n_names"),
        _positions(F.col("names")).alias("places"),
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """Lines ``(file, line)``, each file's in order within one partition, to blocks ``(file, first, at, header, lines)``.

    A block is at most an Arrow batch of one file's lines and the file's header; ``at`` numbers its first line. The
    ``first`` block of a file may be empty. The task function is local, so it travels to the executors by value.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, header, at = None, None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names, text = batch.column(0), batch.column(1).cast(pa.string())
            moved = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1))
            cuts = [0, *(np.flatnonzero(moved.to_numpy(zero_copy_only=False)) + 1).tolist(), len(names)]
            rows, values = [], []
            for start, end in zip(cuts, cuts[1:]):
                first = names[start].as_py() != file
                if first:
                    file, header, at, start = names[start].as_py(), text[start].as_py(), 0, start + 1
                rows.append((file, first, at, header))
                values.append(text.slice(start, end - start))
                at += end - start
            offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.int64(), pa.string()))]
            columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(values)))
            yield pa.RecordBatch.from_arrays(columns, ["file", "first", "at", "header", "lines"])

    return lines.select("file", "line").mapInArrow(blocks, "file string, first boolean, at bigint, header string, lines array<string>")


def _parse_blocks(blocks: DataFrame) -> Parsed:
    headed = _with_header(blocks)
    usable = F.when(F.col("header_err").isNull(), F.col("lines"))
    rows = headed.select("file", "n_names", "places", "at", F.posexplode(usable).alias("k", "line")).select(
        "file", (F.col("at") + F.col("k")).alias("pos"), "line", "n_names", "places"
    )
    unreadable = headed.where(F.col("first") & F.col("header_err").isNotNull()).select("file", F.col("header_err").alias("err"))
    return parse_flow_rows(rows, unreadable)


def parse_flow_files(contents: DataFrame) -> Parsed:
    """Whole files ``(file, content)`` to flows, each file one block."""
    lines = F.filter(F.split("content", "[\r\n]+"), lambda v: F.trim(v) != "")
    return _parse_blocks(contents.select("file", lines.alias("lines")).select(
        "file", F.lit(True).alias("first"), F.lit(0).cast("bigint").alias("at"), F.get(F.col("lines"), F.lit(0)).alias("header"),
        F.slice("lines", 2, 2**31 - 1).alias("lines"),
    ))


def parse_flow_lines(lines: DataFrame) -> Parsed:
    """Lines ``(file, line)`` as a scan of gzip files gives them: each file's in order within one partition, its header first."""
    return _parse_blocks(_blocks(lines))


def read_flows(spark: SparkSession, paths, strict_files: bool = True) -> Parsed:
    """Flows of text files with their own headers, of any size."""
    if strict_files:
        return parse_flow_lines(read_lines(spark, paths, is_text_flow))
    found = salvage_contents(spark, paths, is_text_flow)
    out = parse_flow_files(found.where(F.col("err").isNull()).select("file", "content"))
    return Parsed(out.good, out.bad, out.unreadable.unionByName(unreadable_of(found)))


def is_text_flow(path: Column) -> Column:
    return s.is_flow_file(path) & F.endswith(path, F.lit(".log.gz"))


_WHOLE_TYPES = (ByteType, ShortType, IntegerType, LongType)


def _stored_column(df: DataFrame, name: str) -> str | None:
    """The stored column that holds ``name``: its header name in any spelling, or a Hive-style folder."""
    have = {c.lower().replace("_", "-"): c for c in df.columns}
    folders = {"account_id": "aws-account-id", "region": "aws-region"}
    keys = (HEADER_NAMES[name], name.replace("_", "-"), folders.get(name, ""))
    return next((have[k] for k in keys if k in have), None)


def _typed_column(df: DataFrame, name: str) -> Column:
    """A stored column in its canonical type; whole numbers and timestamps are never turned into text."""
    stored = _stored_column(df, name)
    if stored is None:
        return _typed(name, F.lit(None).cast("string"))
    c, kind = F.col(f"`{stored}`"), df.schema[stored].dataType
    if isinstance(kind, _WHOLE_TYPES):
        if name in _PORTS:
            return F.when(c.between(0, 65535), c.cast("int"))
        if name in _INTS:
            return c.try_cast("int")
        if name in _LONGS:
            return c.cast("bigint")
        if name in _TIMES:
            return x.epoch_seconds(c.cast("bigint"))
    if name in _TIMES and isinstance(kind, TimestampType):
        return c
    return _typed(name, F.nullif(c.cast("string"), F.lit("-")))


def normalize_columns(df: DataFrame, *carried: Column) -> DataFrame:
    """Columnar flow logs and Hive-style partition columns under the canonical names and types, and ``carried`` columns."""
    values = {n: _typed_column(df, n) for n in HEADER_NAMES}
    out = [(F.coalesce(v, F.lit(0).cast("bigint")) if n in _LONGS else v).alias(n) for n, v in values.items()]
    return df.select(*out, *carried)


def stored_window(df: DataFrame, since: datetime | None, until: datetime | None) -> Column:
    """``since <= start < until`` in the stored columns, so that it prunes day folders, files and row groups.

    Times are stored as whole seconds; as text they are compared after the cast. A file is delivered on the day of its
    records or the next one, so the day folders reach one day beyond the window. Bounds without a zone are UTC.
    """
    stored = _stored_column(df, "start")
    if stored is None or (since is None and until is None):
        return F.lit(True) if since is None and until is None else F.lit(False)
    at = [None if t is None else t.replace(tzinfo=t.tzinfo or timezone.utc) for t in (since, until)]
    c, kind = F.col(f"`{stored}`"), df.schema[stored].dataType
    if isinstance(kind, _WHOLE_TYPES):
        ends = [None if t is None else F.lit(math.ceil(t.timestamp())).cast("bigint") for t in at]
        c = c.cast("bigint") if not isinstance(kind, LongType) else c
    else:
        c, ends = _typed_column(df, "start"), [None if t is None else F.lit(t) for t in at]
    inside = F.lit(True)
    if ends[0] is not None:
        inside = inside & (c >= ends[0])
    if ends[1] is not None:
        inside = inside & (c < ends[1])
    if {"year", "month", "day"} <= set(df.columns):
        day = F.make_date(*[F.col(p).cast("int") for p in ("year", "month", "day")])
        if at[0] is not None:
            inside = inside & (day >= F.lit(at[0].astimezone(timezone.utc).date()))
        if at[1] is not None:
            inside = inside & (day <= F.lit(at[1].astimezone(timezone.utc).date() + timedelta(days=1)))
    return inside


def read_flow_tables(
    spark: SparkSession, paths, base_path: str | None = None, since: datetime | None = None, until: datetime | None = None,
) -> Parsed:
    """Columnar flow logs, with or without Hive-style folders; with a window, only its folders and row groups are read."""
    reader = spark.read if base_path is None else spark.read.option("basePath", base_path)
    wanted = [paths] if isinstance(paths, str) else list(paths)
    stored = reader.parquet(*wanted)
    if since is not None or until is not None:
        stored = stored.where(stored_window(stored, since, until))
    good = normalize_columns(stored, F.col("_metadata.file_path").alias("file"))
    return Parsed(
        good, no_rows(spark, "file string, pos bigint, err string"), no_rows(spark, "file string, err string")
    )
