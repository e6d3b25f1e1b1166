"""Generic counters, rankings and mergeable statistics.

A counter set is a long table ``(dim, key, n)``. All dimensions of a family are
filled in one scan: each record is unfolded into one small row per dimension
and the map-side partial aggregate folds them before the shuffle, so a key
that holds a third of all records still reaches the reducer as one row per
task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "(other)"


@dataclass(frozen=True)
class Dim:
    """One counter: a key (or an array of keys) and what each record adds."""

    key: Column
    weight: Column | None = None
    where: Column | None = None
    many: bool = False

    def _entry(self, name: str, key: Column) -> Column:
        weight = F.lit(1) if self.weight is None else self.weight
        return F.struct(
            F.lit(name).alias("dim"), key.cast("string").alias("key"), weight.cast("bigint").alias("w")
        )

    def entries(self, name: str) -> Column:
        """The array of rows a record adds to this counter."""
        if self.many:
            keys = self.key if self.where is None else F.when(self.where, self.key)
            return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: self._entry(name, k))
        key = self.key if self.where is None else F.when(self.where, self.key)
        if self.weight is not None:
            key = F.when(self.weight > 0, key)
        return self._entry(name, key)


def count_by(df: DataFrame, dims: Mapping[str, Dim]) -> DataFrame:
    """``(dim, key, n)`` of every dimension in one scan; absent keys are skipped."""
    single = [dim.entries(name) for name, dim in dims.items() if not dim.many]
    arrays = [dim.entries(name) for name, dim in dims.items() if dim.many]
    if single:
        arrays.insert(0, F.array(*single))
    rows = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    return (
        df.select(F.inline(rows))
        .where(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("dim", "key")
        .agg(F.sum("w").alias("n"))
    )


def counter(df: DataFrame, dim: Dim) -> DataFrame:
    """``(key, n)`` of one dimension."""
    if dim.many:
        return count_by(df, {"": dim}).select("key", "n")
    rows = df if dim.where is None else df.where(dim.where)
    weight = F.lit(1) if dim.weight is None else dim.weight
    rows = rows.select(dim.key.cast("string").alias("key"), weight.cast("bigint").alias("w"))
    if dim.weight is not None:
        rows = rows.where(F.col("w") > 0)
    return (
        rows.where(F.col("key").isNotNull() & (F.col("key") != "")).groupBy("key").agg(F.sum("w").alias("n"))
    )


def merge_counts(*parts: DataFrame) -> DataFrame:
    """One counter set from several: counts of equal keys add up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def _per_dim(df: DataFrame):
    return Window.partitionBy(*(["dim"] if "dim" in df.columns else [])).orderBy(F.col("n").desc(), F.col("key"))


def top_n(counts: DataFrame, n: int) -> DataFrame:
    """Largest ``n`` keys per dimension, count descending, then key; adds ``rank``.

    The limit on the row number reaches the map side, so no task ever sorts a
    whole dimension that other tasks have already cut to ``n`` rows.
    """
    return counts.withColumn("rank", F.row_number().over(_per_dim(counts))).where(F.col("rank") <= n)


def fold_tail(counts: DataFrame, n: int, other: str = OTHER) -> DataFrame:
    """Keep the ``n`` largest keys per dimension and fold the rest under ``other``; totals stay exact.

    The tail is the total minus the kept keys, so it is never ranked.
    """
    dims = ["dim"] if "dim" in counts.columns else []
    top = top_n(counts, n).drop("rank")
    both = counts.select(*dims, F.lit(other).alias("key"), "n").unionByName(
        top.select(*dims, F.lit(other).alias("key"), (-F.col("n")).alias("n"))
    )
    tail = both.groupBy(*dims, "key").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    return top.unionByName(tail)


def with_shares(ranked: DataFrame) -> DataFrame:
    """Share of the total, and bar percent of the maximum (whole, at least 1 when non-zero).

    Meant for ranked tables: the window covers the rows that are shown.
    """
    dims = ["dim"] if "dim" in ranked.columns else []
    w = Window.partitionBy(*dims)
    percent = F.floor(F.col("n") * 100 / F.max("n").over(w)).cast("bigint")
    return ranked.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn(
        "pct_of_max", F.when(F.col("n") > 0, F.greatest(percent, F.lit(1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    )


def distinct_count(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Exact number of distinct keys: keys are folded first, then counted."""
    return df.select(key.alias("key")).where(F.col("key").isNotNull()).distinct().agg(
        F.count("*").alias(name)
    )


def reaches(df: DataFrame, group: Column, value: Column, threshold: int) -> DataFrame:
    """Groups with at least ``threshold`` distinct values: ``(key, n)``.

    Pairs are folded first, so a group that holds a third of all rows is spread
    over as many tasks as it has values.
    """
    return (
        df.select(group.alias("key"), value.alias("value"))
        .where(F.col("key").isNotNull() & F.col("value").isNotNull())
        .distinct()
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= threshold)
    )


def earliest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` records in the given order (each task keeps only ``n``)."""
    return df.orderBy(*order).limit(n)


def by_hour_of_day(df: DataFrame, ts: Column) -> DataFrame:
    """Records per UTC hour of day, all 24 hours present: ``(hour, n)``."""
    counted = df.where(ts.isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def by_hour(df: DataFrame, ts: Column, key: Column, name: str) -> DataFrame:
    """Records per hour and value: ``(hour, <name>, n)``, only hours with records."""
    return (
        df.select(F.date_trunc("hour", ts).alias("hour"), key.alias(name))
        .where(F.col("hour").isNotNull() & F.col(name).isNotNull())
        .groupBy("hour", name)
        .agg(F.count("*").alias("n"))
    )


def measured(c: Column, prefix: str) -> list[Column]:
    """Mergeable statistic of a measure: count, sum, min, max; unmeasured values are skipped."""
    return [
        F.count(c).alias(f"{prefix}_count"),
        F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{prefix}_sum"),
        F.min(c).alias(f"{prefix}_min"),
        F.max(c).alias(f"{prefix}_max"),
    ]


def remeasured(prefix: str) -> list[Column]:
    """Merge of partial :func:`measured` statistics."""
    return [
        F.sum(f"{prefix}_count").alias(f"{prefix}_count"),
        F.sum(f"{prefix}_sum").alias(f"{prefix}_sum"),
        F.min(f"{prefix}_min").alias(f"{prefix}_min"),
        F.max(f"{prefix}_max").alias(f"{prefix}_max"),
    ]


def mean(prefix: str) -> Column:
    """Average of a measured statistic, NULL when nothing was measured."""
    count = F.col(f"{prefix}_count")
    return F.when(count > 0, F.col(f"{prefix}_sum") / count)


def unpivot(row: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """A one-row summary as ``(metric, value)`` text rows."""
    cols = list(names or row.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in cols])
    return row.select(F.inline(pairs))
