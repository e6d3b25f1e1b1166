"""Object-access logs: one space-separated request per line.

The bucket owner, host id, version id, and the query strings of the request
and the referer carry credentials and are never kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import derive as d
from logloom.functions import text as x
from logloom.sources import scope as s
from logloom.sources.lines import Parsed, lines_of, parsed, read_lines, salvage_contents, unreadable_of

# 0-based field positions and the shortest record.
POSITIONS = {
    "bucket": 1, "time": 2, "remote_ip": 3, "requester": 4, "request_id": 5, "operation": 6, "key": 7, "request": 8,
    "status": 9, "error_code": 10, "bytes_sent": 11, "object_size": 12, "total_time_ms": 13, "turnaround_ms": 14,
    "referer": 15, "user_agent": 16, "sig_version": 19, "cipher_suite": 20, "auth_type": 21, "host_header": 22,
    "tls_version": 23, "access_point_arn": 24, "acl_required": 25,
}
MIN_FIELDS = 10

_REQUEST = r"(?s)^([^ ]*) ?(.*?)(?: (HTTP/[^ ]*))?$"


def parse_objects(lines: DataFrame) -> Parsed:
    """Lines ``(file, pos, line)`` to object-access requests."""
    tokens = lines.select(
        "file", "pos", x.raw_bracketed_tokens(F.col("line")).alias("tokens"), x.unterminated(F.col("line")).alias("open")
    )
    t = F.col("tokens")
    fields = tokens.select(
        "file", "pos", "open", F.size("tokens").alias("n_tokens"),
        F.get(t, F.lit(POSITIONS["tls_version"])).alias("raw_tls"),
        x.clf_time(x.unbracketed(F.get(t, F.lit(POSITIONS["time"])))).alias("ts"),
        *[x.known(x.unbracketed(F.get(t, F.lit(i)))).alias(name) for name, i in POSITIONS.items() if name != "time"],
    )
    c = F.col
    derived = {
        "method": x.present(F.regexp_extract("request", _REQUEST, 1)),
        "path": x.present(x.before_query(F.regexp_extract("request", _REQUEST, 2))),
        "proto": x.present(F.regexp_extract("request", _REQUEST, 3)),
        "status": F.coalesce(x.whole(c("status")).cast("int"), F.lit(0)),
        "bytes_sent": F.coalesce(x.whole(c("bytes_sent")), F.lit(0)),
        "object_size": F.coalesce(x.whole(c("object_size")), F.lit(0)),
        "total_time_ms": x.whole(c("total_time_ms")),
        "turnaround_ms": x.whole(c("turnaround_ms")),
        "referer": x.present(x.before_query(c("referer"))),
        "tls_version": d.tls_version(c("tls_version")),
        "acl_required": d.yes(F.lower("acl_required") == "yes"),
        "plain_http": d.plain_http(c("raw_tls"), c("operation")),
    }
    names = (
        "ts bucket remote_ip requester request_id operation key method path proto status error_code bytes_sent "
        "object_size total_time_ms turnaround_ms referer user_agent sig_version cipher_suite auth_type host_header "
        "tls_version access_point_arn acl_required plain_http"
    ).split()
    record = F.struct(*[derived.get(n, c(n)).alias(n) for n in names])
    error = (
        F.when(c("open"), "unterminated field")
        .when(c("n_tokens") < MIN_FIELDS, "too few fields")
        .when(c("ts").isNull(), "bad time field")
        .when(c("bucket").isNull() | c("operation").isNull(), "missing bucket or operation")
    )
    return parsed(fields.select("file", "pos", error.alias("err"), record.alias("rec")))


def read_objects(spark: SparkSession, paths, buckets: Sequence[str] = (), strict_files: bool = True) -> Parsed:
    """Requests; in the partitioned layout, of the buckets whose folder name contains any given text."""

    def keep(path):
        out = s.is_object_file(path)
        if buckets:
            out = out & s.contains_any(s.path_part(path, s.BUCKET_LEVEL), buckets)
        return out

    if strict_files:
        return parse_objects(read_lines(spark, paths, keep))
    found = salvage_contents(spark, paths, keep)
    out = parse_objects(lines_of(found))
    return Parsed(out.good, out.bad, unreadable_of(found))
