"""Exact dedup by composable polynomial fingerprints.

The bytes of a text are the coefficients of a polynomial, taken at a fixed base modulo two primes. Chunks are hashed each
on its own; hash and shift (base to the chunk's length) form a monoid, so that hashes of neighbouring chunks combine to
the hash of both: ``h(ab) = h(a) * shift(b) + h(b)``. Chunks may lie in one row or, for texts stored in parts, in many.
Texts with equal fingerprints are then compared chunk by chunk, as least and greatest chunk of every place, which needs
one chunk in memory and is folded before it is shuffled, however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import keep, spaced, text_or_empty

#: Primes below 2^31: a product of two residues fits a 64-bit integer.
PRIMES = (2147483629, 2147483587)
BASES = (1103515245, 918273645)
CHUNK_BYTES = 65536
HASHED = "array<struct<n:bigint,h1:bigint,s1:bigint,h2:bigint,s2:bigint>>"


def _chunk_hasher(primes: Sequence[int], bases: Sequence[int], chunk_bytes: int):
    def powers(base: int, prime: int) -> np.ndarray:
        out = np.empty(chunk_bytes + 1, np.uint64)
        x = 1
        for k in range(chunk_bytes + 1):
            out[k] = x
            x = x * base % prime
        return out

    tables = []

    def hashed(chunks: pa.Array) -> pa.Array:
        if not tables:
            tables.extend(powers(b, p) for b, p in zip(bases, primes))
        flat = chunks.flatten()
        starts = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, flat.offset * 4) if len(flat) else np.zeros(1, np.int32)
        data = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) and flat.buffers()[2] else np.zeros(0, np.uint8)
        sizes = np.diff(starts)
        columns = [pa.array(sizes, pa.int64())]
        for table, prime in zip(tables, primes):
            down = table[::-1]
            out = np.empty(len(flat), np.int64)
            for k, (a, n) in enumerate(zip(starts[:-1].tolist(), sizes.tolist())):
                # Below 2^8 * 2^31 * 2^16: the sum doesn't overflow.
                out[k] = int((data[a : a + n] * down[chunk_bytes + 1 - n :]).sum(dtype=np.uint64)) % prime
            columns += [pa.array(out), pa.array(table[sizes].astype(np.int64))]
        rows = pa.StructArray.from_arrays(columns, ["n", "h1", "s1", "h2", "s2"])
        offsets = np.concatenate([[0], np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), rows)

    return F.arrow_udf(hashed, HASHED)


def combine(parts: Column, primes: Sequence[int] = PRIMES) -> Column:
    """An ordered array of chunk hashes -> struct(n, h1, s1, h2, s2) of the whole."""
    start = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in (("n", 0), ("h1", 0), ("s1", 1), ("h2", 0), ("s2", 1))])

    def both(a: Column, b: Column) -> Column:
        return F.struct(
            (a["n"] + b["n"]).alias("n"),
            *[c for k, p in zip("12", primes) for c in (
                ((a[f"h{k}"] * b[f"s{k}"] + b[f"h{k}"]) % F.lit(p)).alias(f"h{k}"), ((a[f"s{k}"] * b[f"s{k}"]) % F.lit(p)).alias(f"s{k}"),
            )],
        )

    return F.aggregate(parts, start, both)


def chunked(data: Column, chunk_bytes: int) -> Column:
    """The bytes in an array of chunks; one empty chunk for empty bytes."""
    last = F.greatest(F.floor((F.octet_length(data) - 1) / F.lit(chunk_bytes)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(data, k * F.lit(chunk_bytes) + 1, F.lit(chunk_bytes)))


def fingerprint_parts(
    parts: DataFrame, keys: Sequence[str], place: str, data: str, primes: Sequence[int] = PRIMES, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Texts stored as parts over many rows: ``keys``, ``n``, ``h1``, ``h2`` of each whole text.

    Every part is hashed where it lies, by whatever task reads it; only hashes are shuffled. ``data`` is binary, ``place``
    orders the parts; null data counts as empty. The result doesn't depend on where a text was cut.
    """
    hasher = _chunk_hasher(primes, BASES, chunk_bytes)
    one = combine(hasher(chunked(F.coalesce(F.col(data), F.lit(b"")), chunk_bytes)), primes)
    placed = parts.select(*keys, F.struct(F.col(place).alias("place"), one.alias("part")).alias("__p"))
    whole = placed.groupBy(*keys).agg(F.sort_array(F.collect_list("__p")).alias("__p"))
    return whole.select(*keys, combine(F.col("__p.part"), primes).alias("__f")).select(*keys, "__f.n", "__f.h1", "__f.h2")


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None,
    primes: Sequence[int] = PRIMES, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, and the columns of ``carry``.

    Texts are equal if their bytes are once every gap is one space. The smallest id of equal texts stays. Null text counts
    as empty, and empty texts are equal. Ids: null comes last, and if a group has no other id its rows are kept; rows that
    repeat an id and its text share their decision. An empty table gives an empty table.
    """
    hasher = _chunk_hasher(primes, BASES, chunk_bytes)
    norm = F.encode(spaced(text_or_empty(text)), "UTF-8")
    # A column of its own, used twice: else every chunk would normalise its text again.
    base = docs.withColumn("__norm", norm).select(
        F.col(f"`{doc_id}`").alias("__id"), chunked(F.col("__norm"), chunk_bytes).alias("__chunks"),
        *[c.alias(name) for name, c in (carry or {}).items()],
    )
    base = base.withColumn("__f", combine(hasher("__chunks"), primes)).select("*", "__f.n", "__f.h1", "__f.h2")
    fp = ["n", "h1", "h2"]
    rows = keep(base.select("__id", *fp, *(carry or {})), "fingerprints")
    places = base.select(*fp, F.posexplode("__chunks").alias("place", "chunk"))
    differing = places.groupBy(*fp, "place").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high")
    differing = keep(differing.select(*fp).distinct(), "unequal")
    if differing.isEmpty():
        rows = rows.withColumn("__text", F.lit("").cast("binary"))
    else:
        # Different texts met in one fingerprint: there the text itself tells the groups apart.
        whole = F.aggregate("__chunks", F.lit(b""), lambda a, b: F.concat(a, b))
        mark = differing.withColumn("__unequal", F.lit(True))
        rows = base.join(mark, fp, "left").select(
            "__id", *fp, *(carry or {}), F.when(F.col("__unequal"), whole).otherwise(F.lit(b"")).alias("__text"),
        )
    group = [*fp, "__text"]
    groups = keep(rows.groupBy(*group).agg(F.min("__id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, group).select(
        F.col("__id").alias(doc_id), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), *(carry or {}),
    )
