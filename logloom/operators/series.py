"""Time series over the per-minute load-balancer timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators import lb
from logloom.operators.counters import mean

# The bucket sizes in minutes, the largest number of buckets in
# one chart, and the latency guide lines in seconds.
STEP_MINUTES = (1, 5, 15, 60, 360, 1440)
MAX_BUCKETS = 288
LATENCY_WARN, LATENCY_CRIT = 0.5, 1.0

CLASS_NAMES = {"2xx": "ok", "3xx": "info", "4xx": "warn", "5xx": "crit"}


def _minute_number(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 60).cast("bigint")


def grid(parts: DataFrame) -> DataFrame:
    """Step and aligned bucket range of minutes ``(minute, row)``, one row: the smallest step that fits.

    The first and the last minute are taken as whole rows, so that this plan asks for the same folded table as
    the buckets do and Spark shuffles it once for both; asked for the minute only, it would fold the log again.
    """
    lo, hi = F.col("lo"), F.col("hi")
    whole = F.struct("minute", "row")
    ends = parts.agg(F.min(whole).alias("a"), F.max(whole).alias("b"))
    span = ends.select(_minute_number(F.col("a.minute")).alias("lo"), _minute_number(F.col("b.minute")).alias("hi"))

    def fits(step: int) -> Column:
        return F.floor(hi / step) - F.floor(lo / step) + 1 <= MAX_BUCKETS

    step = F.when(fits(STEP_MINUTES[0]), STEP_MINUTES[0])
    for s in STEP_MINUTES[1:-1]:
        step = step.when(fits(s), s)
    step = step.otherwise(STEP_MINUTES[-1])
    return span.where(lo.isNotNull()).withColumn("step", step.cast("bigint")).select(
        "step",
        (F.floor(lo / F.col("step")) * F.col("step")).alias("first"),
        (F.floor(hi / F.col("step")) * F.col("step")).alias("last"),
    )


def rebucket(df: DataFrame) -> DataFrame:
    """Timeline in at most 288 aligned buckets from first to last record; empty buckets are kept."""
    return rebucket_minutes(lb.minute_timeline(df))


def rebucket_minutes(parts: DataFrame) -> DataFrame:
    """Buckets of a minute timeline, such as :func:`lb.minute_timeline` or a merged one of several scans.

    The grid is a one-row subquery over the same folded minutes; the dense bucket list has at most 288 rows.
    """
    # One value per minute, so that no chart's plan is pruned to fewer columns than the grid's.
    whole = F.struct(*[c for c in parts.columns if c != "minute"])
    minutes = parts.groupBy("minute").agg(F.any_value(whole).alias("row"))
    span = grid(minutes).select(F.struct("step", "first", "last")).scalar()
    step = span["step"]
    number = _minute_number(F.col("minute"))
    # Never null, so the join below adds no filter on it that would set this fold of the minutes apart from the grid's.
    merged = lb.merge_timeline(minutes.select("minute", "row.*"), F.coalesce(F.floor(number / step) * step, F.lit(0).cast("bigint")), "bucket_minute")
    one = parts.sparkSession.range(1, numPartitions=1)
    dense = one.select(step.alias("step"), F.explode(F.sequence(span["first"], span["last"], step)).alias("bucket_minute"))
    filled = dense.join(merged, "bucket_minute", "left")
    zero = [*lb.TIMELINE_SUMS, "target_time_count", "latency_count"]
    return filled.select(
        F.timestamp_seconds(F.col("bucket_minute") * 60).alias("bucket"),
        F.col("step").alias("step_minutes"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in zero],
        mean("target_time").alias("target_time_avg"),
        mean("latency").alias("latency_avg"),
        F.col("latency_max"),
    )


Entry = tuple[str, str, str, str, Column]


def _long(buckets: DataFrame, entries: list[Entry]) -> DataFrame:
    """One row per bucket and (chart, series, kind, tone, value)."""
    rows = F.array(
        *[
            F.struct(F.lit(chart).alias("chart"), F.lit(name).alias("series"), F.lit(kind).alias("kind"),
                     F.lit(tone).alias("tone"), v.cast("double").alias("value"))
            for chart, name, kind, tone, v in entries
        ]
    )
    points = buckets.select("bucket", F.inline(rows)).select("chart", "bucket", "series", "kind", "tone", "value")
    return _without_zero_series(points) if any(kind == "class" for _, _, kind, _, _ in entries) else points


def _without_zero_series(points: DataFrame) -> DataFrame:
    """Drop bars that are zero in every bucket (a few hundred points per series)."""
    w = Window.partitionBy("chart", "series")
    return (
        points.withColumn("_any", F.max(F.coalesce(F.col("value") != 0, F.lit(False))).over(w))
        .where(F.col("_any") | (F.col("kind") != "class"))
        .drop("_any")
    )


def _requests() -> list[Entry]:
    return [
        ("requests", "Requests", "bar", "accent", F.col("requests")),
        ("requests", "Target response time (avg)", "line", "warn", F.col("target_time_avg")),
    ]


def _classes(chart: str, prefix: str, rest: str) -> list[Entry]:
    none = F.col(f"{prefix}_none") + F.col(f"{prefix}_1xx")
    return [(chart, rest, "class", "muted", none)] + [
        (chart, name, "class", tone, F.col(f"{prefix}_{name}")) for name, tone in CLASS_NAMES.items()
    ]


def _target_status() -> list[Entry]:
    errors = ("target_status", "Target connection errors", "line", "crit", F.col("conn_errors"))
    return [*_classes("target_status", "target", "No target response"), errors]


def _latency() -> list[Entry]:
    return [
        ("latency", "Latency (avg)", "line", "accent", F.col("latency_avg")),
        ("latency", "Latency (max)", "line", "crit", F.col("latency_max")),
        ("latency", "Target response time (avg)", "line", "warn", F.col("target_time_avg")),
        ("latency", "Guide warn", "guide", "warn", F.lit(LATENCY_WARN)),
        ("latency", "Guide crit", "guide", "crit", F.lit(LATENCY_CRIT)),
    ]


def requests_chart(buckets: DataFrame) -> DataFrame:
    return _long(buckets, _requests())


def elb_status_chart(buckets: DataFrame) -> DataFrame:
    return _long(buckets, _classes("elb_status", "elb", "Other"))


def target_status_chart(buckets: DataFrame) -> DataFrame:
    return _long(buckets, _target_status())


def latency_chart(buckets: DataFrame) -> DataFrame:
    return _long(buckets, _latency())


def charts(df: DataFrame) -> DataFrame:
    """Points of all four charts, unfolded from one set of buckets."""
    return _long(rebucket(df), [*_requests(), *_classes("elb_status", "elb", "Other"), *_target_status(), *_latency()])


def legend(points: DataFrame) -> DataFrame:
    """Minimum, maximum, average and last value of every series over its non-empty buckets."""
    return (
        points.where(F.col("kind") != "guide")
        .groupBy("chart", "series")
        .agg(
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("avg"),
            F.max_by("value", F.when(F.col("value").isNotNull(), F.col("bucket"))).alias("last"),
        )
    )


def hourly_breakdown(by_hour: DataFrame, name: str) -> DataFrame:
    """Hours with traffic: total and ``ACTION n, ACTION n`` by count.

    The values of one hour are actions or status classes, a handful per hour.
    """
    w = Window.partitionBy("hour").orderBy(F.desc("n"), F.asc(name))
    entry = F.struct("place", F.concat(F.col(name), F.lit(" "), F.col("n").cast("string")).alias("text"))
    return (
        by_hour.withColumn("place", F.row_number().over(w))
        .groupBy("hour")
        .agg(
            F.sum("n").alias("n"),
            F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ", ").alias("breakdown"),
        )
    )


def busiest_hour(hours: DataFrame) -> DataFrame:
    """Hour of day with the most records; the lowest hour wins a tie."""
    return hours.orderBy(F.desc("n"), F.asc("hour")).limit(1)
