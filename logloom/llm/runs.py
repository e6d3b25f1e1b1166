"""Periodic runs of words: stretches that repeat a period, found in each document's enhanced suffix array.

A batch of documents is one array of word numbers. Numbers are a document's own and every document ends with a number
that occurs once, so suffixes of different documents share no prefix and a batch of any documents gives what each of
them gives alone. Suffixes are sorted by doubling, and sorted on only while they are not yet alone.

Of each LCP interval of depth d, all children but the largest are looked through: a suffix i of such a child and the
suffix i + d or i - d in another child of the interval (their places are looked up in the inverse suffix array) are the
halves of a square that can't be moved right. Moved left as far as words agree, it becomes the run of period d. The
intervals come from one pass over the LCP array with a stack of bounds; no tree is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words that share a suffix array, a longer document apart. A bound of memory, without effect on results.
BATCH_WORDS = 1 << 17
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers that end with one that occurs once -> suffixes in order, their places (the inverse), and for each place the
    length of the prefix shared with the place before."""
    n = len(symbols)
    order = np.argsort(symbols)
    head = np.ones(n, bool)
    head[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    levels, level = [rank], np.zeros(n, np.int8)
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(open_):
        reach = 1 << (len(levels) - 1)
        at = order[open_]
        key = rank[at] * n + rank[at + reach]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        split = head.copy()
        split[0] = False
        split[1:] &= key[1:] // n == key[:-1] // n
        level[open_[split]] = len(levels)
        rank = rank.copy()
        rank[at] = open_[head][np.cumsum(head) - 1]
        levels.append(rank)
        open_ = open_[~(head & np.append(head[1:], True))]
    shared = np.zeros(n, np.int64)
    parted = np.flatnonzero(level)
    # Parted by the doubling from h to 2h: h words agree, and the rest is found by halves.
    shared[parted] = 1 << (level[parted] - 1).astype(np.int64)
    for m in range(len(levels) - 3, -1, -1):
        some = parted[level[parted] >= m + 2]
        same = levels[m][order[some - 1] + shared[some]] == levels[m][order[some] + shared[some]]
        shared[some[same]] += 1 << m
    return order, rank, shared


def smaller_children(shared: np.ndarray) -> np.ndarray:
    """Rows (first, end, interval's first, interval's end, depth) of every child of an LCP interval but its largest."""
    out: list[int] = []
    add = out.extend
    depths, bounds = [0], [[0]]
    some = np.flatnonzero(shared)
    # Only places after a shared prefix, and the place that ends such a stretch, matter.
    stops = np.setdiff1d(some + 1, some, assume_unique=True)
    at = np.union1d(some, stops)
    depth_at = np.append(shared, 0)[at]
    for k, d in zip(at.tolist(), depth_at.tolist()):
        first = k - 1
        while depths[-1] > d:
            depth, b = depths.pop(), bounds.pop()
            b.append(k)
            first = b[0]
            if len(b) == 3:
                if b[1] - first <= k - b[1]:
                    add((first, b[1], first, k, depth))
                else:
                    add((b[1], k, first, k, depth))
            else:
                sizes = [y - x for x, y in zip(b, b[1:])]
                largest = sizes.index(max(sizes))
                for c in range(len(sizes)):
                    if c != largest:
                        add((b[c], b[c + 1], first, k, depth))
        if d == depths[-1]:
            bounds[-1].append(k)
        else:
            depths.append(d)
            bounds.append([first, k])
        if not d:
            bounds[0] = [0]
    return np.array(out, np.int64).reshape(-1, 5)


def squares(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, period) of all squares whose period does not go on to the right."""
    order, place, shared = suffix_array(symbols)
    found = []
    children = smaller_children(shared)
    for k in range(0, len(children), BATCH_WORDS):
        first, end, low, high, depth = children[k : k + BATCH_WORDS].T
        size = end - first
        child = np.repeat(np.arange(len(size)), size)
        at = order[np.arange(len(child)) - (np.cumsum(size) - size)[child] + first[child]]
        for step in (depth[child], -depth[child]):
            other = at + step
            p = place[np.maximum(other, 0)]
            ok = (other >= 0) & (p >= low[child]) & (p < high[child]) & ((p < first[child]) | (p >= end[child]))
            found.append(np.stack([np.minimum(at, other)[ok], depth[child[ok]]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def _start(symbols: np.ndarray, start: int, period: int) -> int:
    """How far left a square can be moved; blocks double, so that long runs cost few steps."""
    block = 16
    while start > 0:
        low = max(0, start - block)
        differ = np.flatnonzero(symbols[low:start] != symbols[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, block = low, 2 * block
    return start


def runs(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) in order of start and period: every run of its smallest period, long enough."""
    rows = squares(symbols)
    end = rows[:, 0] + 2 * rows[:, 1]
    rows = np.column_stack([rows, end])[np.lexsort((rows[:, 1], end))]
    out = []
    while len(rows):
        # Of the squares with one end, the one of least period is primitive; multiples of its period inside its run are not.
        head = np.ones(len(rows), bool)
        head[1:] = rows[1:, 2] != rows[:-1, 2]
        top = rows[head]
        begin = np.array([_start(symbols, s, p) for s, p, _ in top.tolist()], np.int64)
        out.append(np.column_stack([begin, top[:, 2] - begin, top[:, 1]]))
        of = np.cumsum(head) - 1
        inside = (rows[:, 1] % top[of, 1] == 0) & (rows[:, 0] >= begin[of])
        rows = rows[~inside]
    found = np.concatenate(out) if out else np.empty((0, 3), np.int64)
    found = found[found[:, 1] >= np.maximum(min_length, min_exponent * found[:, 2])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of documents -> one array of numbers, and where each document begins in it."""
    parts, begins, used, at = [], [], 0, 0
    for words in texts:
        known = {w: k for k, w in enumerate(dict.fromkeys(words), used)}
        used += len(known) + 1
        begins.append(at)
        at += len(words) + 1
        parts += [np.fromiter(map(known.__getitem__, words), np.int64, len(words)), np.array([used - 1])]
    return np.concatenate(parts), np.array(begins)


def _documents(texts: list[bytes | None], min_length: int, min_exponent: int) -> Iterator[tuple[list, bytes]]:
    """Runs and collapsed text of each document of a batch."""
    words = [(t or b"").split() for t in texts]
    symbols, begins = _numbered(words)
    found = runs(symbols, min_length, min_exponent)
    of = np.searchsorted(begins, found[:, 0], "right") - 1
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    for k, own in enumerate(words):
        mine = found[cut[k] : cut[k + 1]].copy()
        mine[:, 0] -= begins[k]
        if len(mine):
            lost = np.zeros(len(own) + 1, np.int64)
            np.add.at(lost, mine[:, 0] + mine[:, 2], 1)
            np.add.at(lost, mine[:, 0] + mine[:, 1], -1)
            own = [w for w, c in zip(own, np.cumsum(lost).tolist()) if not c]
        yield [dict(zip(("start", "length", "period"), r)) for r in mine.tolist()], b" ".join(own)


def _found(min_length: int, min_exponent: int):
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, size = batch.column(1).to_pylist(), 0, 0
            for k, text in enumerate(texts):
                # Two bytes a word at least.
                size += len(text or b"") // 2
                if size >= BATCH_WORDS or k == len(texts) - 1:
                    rows = list(_documents(texts[begin : k + 1], min_length, min_exponent))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, len(rows)), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.binary())],
                        ["id", "runs", "collapsed"],
                    )
                    begin, size = k + 1, 0

    return found


def periodic_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: its id, ``runs`` (start, length, period; by start and period) and ``collapsed``.

    Words lie between white space and are numbered from 0. A run is a stretch of smallest period q with at least
    ``min_length`` words and ``min_exponent`` periods (2 or more) that neither neighbour continues. ``collapsed`` is the
    words joined by a space, without those that lie in a run after its first q words.

    Documents are independent: repeated rows and ids, and null ids, each give their own row. Null, empty and blank texts
    have no run and an empty collapsed text. Very long texts are taken whole and need memory in proportion to their words.
    Other columns are neither read nor returned. An empty table gives an empty table. Nothing is shuffled.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_found(min_length, min_exponent), f"id {kind}, runs {RUNS}, collapsed binary")
    return out.select(F.col("id").alias(doc_id), "runs", F.col("collapsed").cast("string").alias("collapsed"))
