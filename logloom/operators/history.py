"""Queries over the metric history and the emitted lines (alerts and dashboard panels).

A metric history is ``(name, labels, value, at)``. Windows are partitioned by
series: one series is one scanner's metric, one sample per tick.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.lines import labels_text


def select(metrics: DataFrame, name: str, **labels: str) -> DataFrame:
    """Samples of one metric whose labels have the given values."""
    out = metrics.where(F.col("name") == name)
    for k, v in labels.items():
        out = out.where(F.try_element_at("labels", F.lit(k)) == v)
    return out


def _second(at: Column) -> Column:
    return F.unix_seconds(at.cast("timestamp"))


def increase(metrics: DataFrame, seconds: int) -> DataFrame:
    """Counter growth over the last ``seconds`` at every sample; a lower value is a restart from zero."""
    series = Window.partitionBy("name", "series").orderBy("second")
    delta = F.col("value") - F.lag("value").over(series)
    grown = (
        metrics.withColumn("series", labels_text(F.col("labels")))
        .withColumn("second", _second(F.col("at")))
        .withColumn("delta", F.coalesce(F.when(delta < 0, F.col("value")).otherwise(delta), F.lit(0.0)))
    )
    frame = series.rangeBetween(-(seconds - 1), 0)
    return grown.withColumn("increase", F.sum("delta").over(frame)).drop("series", "second", "delta")


def rate(metrics: DataFrame, seconds: int) -> DataFrame:
    """Growth per second over the last ``seconds``."""
    return increase(metrics, seconds).withColumn("rate", F.col("increase") / seconds)


def increased(metrics: DataFrame, seconds: int) -> DataFrame:
    """Samples at which the counter grew within the window."""
    return increase(metrics, seconds).where(F.col("increase") > 0)


def by_labels(df: DataFrame, value: str, labels: Sequence[str], how=F.sum) -> DataFrame:
    """``sum by (labels)`` (or ``max by``, ``min by``) at every time."""
    keys = [F.try_element_at("labels", F.lit(k)).alias(k) for k in labels]
    return df.groupBy(*keys, "at").agg(how(value).alias(value))


def held(df: DataFrame, condition: Column, keys: Sequence[str], seconds: int) -> DataFrame:
    """Rows where the condition has been true without a break for at least ``seconds``."""
    order = Window.partitionBy(*keys).orderBy("second")
    marked = (
        df.withColumn("second", _second(F.col("at")))
        .withColumn("true_now", F.coalesce(condition, F.lit(False)))
        .withColumn("breaks", F.count_if(~F.col("true_now")).over(order))
    )
    began = F.min(F.when(F.col("true_now"), F.col("second"))).over(Window.partitionBy(*keys, "breaks"))
    return (
        marked.withColumn("began", began)
        .where(F.col("true_now") & (F.col("second") - F.col("began") >= seconds))
        .drop("second", "true_now", "breaks", "began")
    )


def ratio_above(metrics: DataFrame, total: str, part: dict[str, str], labels: Sequence[str], seconds: int,
                limit: float, hold: int) -> DataFrame:
    """Share of one label value in a counter's rate above ``limit``, held for ``hold`` seconds."""
    of = by_labels(rate(select(metrics, total), seconds), "rate", labels)
    bad = by_labels(rate(select(metrics, total, **part), seconds), "rate", labels).withColumnRenamed("rate", "part")
    both = bad.join(of, [*labels, "at"]).withColumn("ratio", F.when(F.col("rate") > 0, F.col("part") / F.col("rate")))
    return held(both, F.col("ratio") > limit, labels, hold).select(*labels, "at", "ratio")


def stale(metrics: DataFrame, success: str, interval: str, labels: Sequence[str], times: float, hold: int) -> DataFrame:
    """Last success older than ``times`` intervals, held for ``hold`` seconds."""
    last = by_labels(select(metrics, success), "value", labels, F.max).withColumnRenamed("value", "success")
    every = by_labels(select(metrics, interval), "value", labels, F.max).withColumnRenamed("value", "interval")
    both = last.join(every, [*labels, "at"]).withColumn("age", _second(F.col("at")) - F.col("success"))
    return held(both, F.col("age") > times * F.col("interval"), labels, hold).select(*labels, "at", "age")


def never_succeeded(metrics: DataFrame, up: str, success: str, labels: Sequence[str], hold: int) -> DataFrame:
    """Running scanners without any success sample at that time, held for ``hold`` seconds."""
    running = by_labels(select(metrics, up).where(F.col("value") == 1), "value", labels, F.max)
    done = by_labels(select(metrics, success), "value", labels, F.max).select(*labels, "at")
    return held(running.join(done, [*labels, "at"], "left_anti"), F.lit(True), labels, hold).select(*labels, "at")


def latest(metrics: DataFrame) -> DataFrame:
    """Newest value of every series."""
    return (
        metrics.withColumn("series", labels_text(F.col("labels")))
        .groupBy("name", "series")
        .agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    )


def positive(metrics: DataFrame) -> DataFrame:
    """Series whose newest value is above zero."""
    return latest(metrics).where(F.col("value") > 0)


def overdue(metrics: DataFrame, success: str, now: Column, seconds: int) -> DataFrame:
    """Series whose newest success time is more than ``seconds`` ago."""
    return latest(select(metrics, success)).where(now - F.col("value") > seconds)


def absent(metrics: DataFrame, name: str) -> DataFrame:
    """One row when the metric has no sample at all."""
    return select(metrics, name).agg((F.count("*") == 0).alias("absent")).where(F.col("absent"))


def mean_of(metrics: DataFrame, total: str, count: str, labels: Sequence[str], seconds: int) -> DataFrame:
    """Mean of a measured quantity: growth of its sum over growth of its count."""
    s = by_labels(rate(select(metrics, total), seconds), "rate", labels).withColumnRenamed("rate", "sum_rate")
    c = by_labels(rate(select(metrics, count), seconds), "rate", labels).withColumnRenamed("rate", "count_rate")
    return s.join(c, [*labels, "at"]).select(
        *labels, "at", F.when(F.col("count_rate") > 0, F.col("sum_rate") / F.col("count_rate")).alias("mean")
    )


def either(*metrics: DataFrame) -> DataFrame:
    """Samples of the first metric, and those of the others where no earlier one has the label set at that time."""
    out = None
    for m in metrics:
        keyed = m.withColumn("series", labels_text(F.col("labels")))
        if out is None:
            out = keyed
        else:
            out = out.unionByName(keyed.join(out.select("series", "at"), ["series", "at"], "left_anti"))
    return out.drop("series")


def query_lines(lines: DataFrame, stream: dict[str, str], fields: Sequence[str], layout: str,
                equals: dict[str, str] | None = None, matches: dict[str, str] | None = None) -> DataFrame:
    """Select line streams by label, parse the JSON, filter fields by value or pattern, format a text."""
    out = lines
    for k, v in stream.items():
        out = out.where(F.try_element_at("labels", F.lit(k)) == v)
    names = list(dict.fromkeys([*fields, *(equals or {}), *(matches or {})]))
    schema = ", ".join(f"`{n}` string" for n in names)
    out = out.select("at", F.from_json("line", schema).alias("j"))
    for k, v in (equals or {}).items():
        out = out.where(F.col(f"j.{k}") == v)
    for k, v in (matches or {}).items():
        out = out.where(F.rlike(F.col(f"j.{k}"), F.lit(f"^(?:{v})$")))
    return out.select("at", F.format_string(layout, *[F.coalesce(f"j.{n}", F.lit("")) for n in fields]).alias("text"))
