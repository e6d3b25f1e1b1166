"""LM scoring by stupid backoff: each document is scored by the counts of all the others.

Words, pairs and triples have 64-bit keys and are counted over all documents; nothing is collected, and the counts grow with
the corpus. Rows are dealt into blocks. A block gives each of its n-grams once, with how often it holds it, to the bucket of
the n-gram's key; one shuffle groups the buckets. A bucket sums over the blocks and tells each block how often the others
hold its n-grams, in the order they came, so that no key travels back. A block's rows meet these sums by a second shuffle,
take their own share off, and are scored. A frequent n-gram is one entry a block, so no bucket is larger for it. Pairs and
words are counted in one pass, triples in another.

With ``c`` the count that is left and ``order`` 3, ``S(w | u v) = c(u v w) / c(u v)`` if ``c(u v w)`` is ``min_count`` or more,
else ``0.4 * S(w | v)``; ``S(w | v) = c(v w) / c(v)`` if ``c(v w)`` is ``min_count`` or more, else ``0.4 * c(w) / N``. A word that
no other document holds counts as half an occurrence there, so that it scores below any other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import WORD, discard, keep
from logloom.llm.near_dedup import _mixed

BACKOFF, MIN_COUNT, UNSEEN = 0.4, 1, 0.5
#: Bytes of text that make a block, and that a bucket's n-grams come from.
BLOCK_BYTES, BUCKET_BYTES = 1 << 23, 1 << 22


def _keys(text: str | None) -> np.ndarray:
    found = (text or "").encode("utf-8", "replace").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def _sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word keys of all texts, one after the other, and the number of the text each belongs to."""
    keys = [_keys(t) for t in texts]
    return np.concatenate([np.empty(0, np.uint64), *keys]), np.repeat(np.arange(len(keys)), [len(k) for k in keys])


def _grams(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams at their last words, and these words' places; none reaches over two texts."""
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) + n - 1 if len(doc) >= n else np.empty(0, np.int64)
    out = _mixed(keys[at - (n - 1)] + np.uint64(n))
    for k in range(n - 2, -1, -1):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + keys[at - k])
    return out, at


def _dealt(keys: np.ndarray, doc: np.ndarray, n: int, buckets: int):
    """The distinct n-grams by bucket, how often each occurs, the buckets' first places; then every n-gram's place among them, and its last word's."""
    gram, at = _grams(keys, doc, n)
    gram, number, times = np.unique(gram, return_inverse=True, return_counts=True)
    bucket = gram % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return gram[order], times[order], cuts, place[number], at


def _counted(orders: tuple[int, ...], buckets: int) -> Callable[[pa.Table], pa.Table]:
    """A block's rows -> its n-grams by bucket, each once, with how often the block holds it."""

    def counted(rows: pa.Table) -> pa.Table:
        keys, doc = _sequences(rows.column("text").to_pylist())
        block, out = rows.column("block")[0].as_py(), []
        for n in orders:
            gram, times, cuts, *_ = _dealt(keys, doc, n, buckets)
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                out.append((n, int(b), block, gram[part].view(np.int64), times[part].astype(np.int32)))
        names = ("n", "bucket", "block", "grams", "times")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], list(names))

    return counted


def _summed(rows: pa.Table) -> pa.Table:
    """A bucket's entries of all blocks -> for each block, how often all others hold its n-grams, in the order they came."""
    lists = rows.column("grams").combine_chunks()
    gram, times = lists.flatten().to_numpy(), rows.column("times").combine_chunks().flatten().to_numpy()
    _, number = np.unique(gram, return_inverse=True)
    total = np.bincount(number, times).astype(np.int64)[number] - times
    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    others = pa.LargeListArray.from_arrays(cuts, pa.array(total)).cast(pa.list_(pa.int64()))
    out = pa.table([rows.column("n"), rows.column("bucket"), rows.column("block"), others], ["n", "bucket", "block", "others"])
    return out.filter(pa.array(np.add.reduceat(total, cuts[:-1]) > 0))


def _scored(min_count: int, backoff: float, order: int, total: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's rows and the counts of the other blocks -> id, scored words and sum of ln S of each row."""

    def others(keys: np.ndarray, doc: np.ndarray, n: int, sums: pa.Table) -> np.ndarray:
        """For each word, how often other rows hold the n-gram that ends with it; 0 where none does."""
        _, count, cuts, number, at = _dealt(keys, doc, n, buckets)
        there = sums.filter(pc.equal(sums.column("n"), n))
        for b, more in zip(there.column("bucket").to_pylist(), there.column("others")):
            count[cuts[b] : cuts[b + 1]] += more.values.to_numpy()
        _, mine, own = np.unique(doc[at] * max(len(count), 1) + number, return_inverse=True, return_counts=True)
        out = np.zeros(len(keys), np.int64)
        out[at] = count[number] - own[mine]
        return out

    def scored(rows: pa.Table, sums: pa.Table) -> pa.Table:
        keys, doc = _sequences(rows.column("text").to_pylist())
        size = np.bincount(doc, minlength=len(rows))
        one, two = (others(keys, doc, n, sums) for n in (1, 2))
        left = np.maximum(total - size[doc], 1)
        s = np.maximum(one, UNSEEN) / left
        before = np.concatenate([[1], one[:-1]]) if len(one) else one
        s = np.where(two >= min_count, two / np.maximum(before, 1), backoff * s)
        if order > 2:
            three = others(keys, doc, 3, sums)
            before = np.concatenate([[1], two[:-1]]) if len(two) else two
            # The second word of a text has a pair only.
            third = np.concatenate([np.zeros(min(2, len(doc)), bool), doc[2:] == doc[:-2]])
            s = np.where(third, np.where(three >= min_count, three / np.maximum(before, 1), backoff * s), s)
        follows = np.concatenate([np.zeros(min(1, len(doc)), bool), doc[1:] == doc[:-1]])
        value = np.bincount(doc[follows], np.log(s[follows]), minlength=len(rows))
        return pa.table([rows.column("id"), pa.array(np.maximum(size - 1, 0)), pa.array(value)], ["id", "n_pairs", "log_score"])

    return scored


def stupid_backoff(
    docs: DataFrame, min_count: int = MIN_COUNT, backoff: float = BACKOFF, doc_id: str = "doc_id", text: str = "text", order: int = 3,
) -> DataFrame:
    """One row per document id: id, ``n_pairs`` (scored words, all but the first), ``log_score`` (sum of ln S), ``perplexity`` (exp of the negative mean).

    Documents of fewer than two words, null and empty texts among them, have no pair, a sum of 0 and a null perplexity. Every
    row is a document of its own, scored by all other rows: a repeated row is seen in its copy. Sums of rows that share
    an id are added up, those of null ids too. The second word of a text has a pair only. Words are lower-cased in A-Z.
    Blocks and buckets have a fixed size, their number grows with the texts; only rows of one id and text always share a
    block. Of the 64-bit keys of ten billion distinct triples, three pairs are expected to be equal.
    """
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    size = int(named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    blocks, buckets = 1 + size // BLOCK_BYTES, 1 + size // BUCKET_BYTES
    dealt = named.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    sums = []
    for orders in ((1, 2), (3,))[: 2 if order > 2 else 1]:
        found = dealt.groupBy("block").applyInArrow(_counted(orders, buckets), "n int, bucket int, block int, grams array<long>, times array<int>")
        sums.append(keep(found.groupBy("n", "bucket").applyInArrow(_summed, "n int, bucket int, block int, others array<long>"), f"others_{orders[-1]}", alone=True))
    total = int(named.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0))).first()[0])
    shared = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    rows = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        _scored(min_count, backoff, order, total, buckets), "id long, n_pairs long, log_score double")
    out = keep(rows.groupBy("id").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("log_score").alias("log_score")), "scores", alone=True)
    discard(*sums)
    return out.select(F.col("id").alias(doc_id), "n_pairs", "log_score", F.exp(-F.col("log_score") / F.nullif("n_pairs", F.lit(0))).alias("perplexity"))
