"""All registered queries by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, TimestampType

from logloom.plans.fixtures import Tables, with_tables
from logloom.session import configure


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None = None


def portable(df: DataFrame) -> DataFrame:
    """Zone-less times, 64-bit integers, doubles at six decimals: forms two engines can compare."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            # The shift moves exact ties off the rounding border, where engines differ.
            c = F.round(c + F.lit(1e-9), 6)
        elif isinstance(f.dataType, IntegerType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def _callable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(q.run(Tables(configure(spark), sf_dir)))

    return run


def all_queries() -> dict[str, Query]:
    from logloom.plans import (
        audit_queries, flow_queries, history_queries, lb_queries, object_queries, source_queries, stream_queries, waf_queries,
    )

    out: dict[str, Query] = {}
    for module in (
        flow_queries, lb_queries, waf_queries, object_queries, audit_queries, source_queries, history_queries,
        stream_queries,
    ):
        for name, q in module.queries().items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = q
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _callable(q) for name, q in all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(q.sql) for name, q in all_queries().items() if q.sql}
