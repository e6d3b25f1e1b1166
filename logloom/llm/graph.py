"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import keep

#: Ids that a task remembers; beyond that it starts anew and gives more rows.
STAR_IDS = 1 << 20


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links -> each id with the least one that they join it to, which joins the same ids with a row an id."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    def found() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(*[c.to_pylist() for c in batch.columns]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        if len(root) > STAR_IDS:
            yield found()
            root.clear()
    yield found()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Links between ids -> one row per linked id: ``id``, ``component`` (the smallest id it reaches).

    Every round takes the least label of the neighbours and then that label's own label, so labels run down long chains
    in few rounds. Each task first replaces its links by one from each id to the least it joins, so that a dense group costs
    rows in proportion to its ids. Rounds end when no label falls any more. Each is a table in the shared folder; both joins are of
    plain tables, whose hot keys (a large component's label) the join's skew handling splits. Nothing is collected.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = edges.mapInArrow(_stars, "u long, v long")
    edges = keep(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = keep(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "labels")
    least = None
    while True:
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == least:
            return labels
        least = total
        near = edges.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        moved = keep(labels.join(near, "id").select("id", F.least("component", "near").alias("component")), "labels")
        roots = moved.select(F.col("id").alias("component"), F.col("component").alias("root"))
        labels = keep(moved.join(roots, "component").select("id", F.col("root").alias("component")), "labels")
