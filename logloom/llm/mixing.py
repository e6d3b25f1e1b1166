"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Every source gets a weight and a share of the words to draw. No source may give more than ``max_epochs`` times its own
words; what a clamped source cannot take is dealt again to the others by weight. The repeated dealing has a fixed point,
the water level: targets are ``min(cap, level * weight)``. Sorted by ``cap / weight``, the level follows from running sums.

A document is taken ``floor(epochs)`` times, and once more for the fractional epoch if it is sampled. Sampling is
systematic: within a stratum (source, salt) documents stand in order of size, and every ``1 / fraction``-th is taken
from a seeded start on. Starts of a source's strata are spread evenly, so that its words come near the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import WORD, key_of, text_or_empty

GOLDEN = 0.6180339887498949


def targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0,
    source: str = "source", size: str = "source_size",
) -> DataFrame:
    """One row per source with its words -> the same rows with ``weight``, ``cap`` and ``target``.

    ``weights`` are dealt to the sources in code-point order, null last, and repeat. Both windows see one row per source
    of the corpus, never documents. If all caps together are below the share, every target is its cap. Sources without
    words get 0. An empty table gives an empty table.
    """
    by_name = Window.orderBy(F.col(f"`{source}`").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col(f"`{source}`").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % F.lit(len(weights)) + 1
    total = F.sum(F.col(size)).over(Window.partitionBy(F.lit(0)))
    clamped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(float(share)) * F.col("__mix_total") - clamped) / open_weight
    # Of the levels that their own source can still take, the first in this order, which is the largest, is the fixed point.
    feasible = F.when(F.col("__mix_level") <= F.col("cap") / F.col("weight"), F.col("__mix_level"))
    return (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("cap", F.lit(float(max_epochs)) * F.col(size))
        .withColumn("__mix_total", total)
        .withColumn("__mix_level", level)
        .withColumn("__mix_level", F.max(feasible).over(Window.partitionBy(F.lit(0))))
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("__mix_level") * F.col("weight"), F.col("cap"))))
        .drop("__mix_total", "__mix_level")
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
    salts: int = 256, source: str = "source", doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target``, ``epochs``, ``repeats`` and ``taken``; none is left out.

    ``repeats`` says how often the mix takes a document (0 too), ``taken`` how many words that makes. Columns of these
    names are replaced, other columns stay. The table of sources is small but unbounded, so it isn't broadcast: a source
    is dealt over ``salts`` keys, which also split one that holds a third of all rows.

    Null text or text without words has size 0 and takes 0 words; a null source is a source, the last one; a null id is
    sampled like any other. Repeated rows are sampled each on its own. An empty table gives an empty table.
    """
    made = {"size", "source_size", "target", "epochs", "repeats", "taken"}
    rows = docs.drop(*[c for c in docs.columns if c.lower() in made])
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10)
    rows = (
        rows.withColumn("size", F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long"))
        .withColumn("__mix_source", key_of(F.col(f"`{source}`")))
        .withColumn("__mix_draw", draw.cast("long"))
        .withColumn("__mix_salt", F.pmod(F.col("__mix_draw"), F.lit(salts)).cast("int"))
    )
    sizes = rows.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, max_epochs).select(
        key_of(F.col("source")).alias("__mix_source"), "source_size", "target",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__mix_salt"),
    )
    keys = ["__mix_source", "__mix_salt"]
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    order = Window.partitionBy(*keys).orderBy("size", "__mix_draw", F.col(f"`{doc_id}`"))
    start = F.col("__mix_salt") * F.lit(GOLDEN) + F.lit(seed * GOLDEN)
    part = F.col("epochs") - F.floor("epochs")
    turn = F.col("__mix_turn")
    sampled = F.floor(turn * part + (start - F.floor(start))) - F.floor((turn - 1) * part + (start - F.floor(start)))
    return (
        rows.join(plan, keys)
        .withColumn("epochs", epochs)
        .withColumn("__mix_turn", F.row_number().over(order))
        .withColumn("repeats", (F.floor("epochs") + sampled).cast("int"))
        .withColumn("taken", F.col("size") * F.col("repeats"))
        .drop(*keys, "__mix_draw", "__mix_turn")
    )


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as ``repeats`` says."""
    return mixed.where("repeats > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).drop("__mix_copy")
