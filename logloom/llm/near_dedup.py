"""MinHash near-dedup with an LSH forest.

A document's set is its distinct word shingles. Signatures are min-hashes; each tree of the forest is one order of them,
sorted over the whole corpus. Documents that share the first ``MIN_DEPTH`` values of a tree's order are a region, and all
pairs of a region are compared. Sorting is by range, which also splits a region that holds a third of the corpus.

Rows within ``NEAR_ROWS`` of each other are compared first, on full sets. What they leave open are rows further apart in
one region, or on two sides of a partition's border. Those are marked; where a region's marked rows are of more than one
component, they are dealt to blocks and every pair of two components is compared on full sets, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import keep
from logloom.llm.graph import components

WORDS = 5
TREES, MIN_DEPTH, DEPTH = 16, 5, 10
HASHES = TREES * MIN_DEPTH
#: Rows next to each other that are compared at once; rows of one region further apart are compared in blocks.
NEAR_ROWS = 8
#: Rows and shingles of a block, on average. Blocks bound memory, not what is compared.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1_000_000
_BLOCK = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes: A-Z lower-cased, words between white space, whole text.

    With fewer than ``words`` words the whole sequence is one shingle; without words there is none.
    """
    # Bytes know the ASCII rules only: lower() changes A-Z, split() takes 09-0D and 20.
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[k : len(h) - n + 1 + k])
    return np.unique(_mixed(out))


def signature(sets: np.ndarray, hashes: int = HASHES) -> bytes:
    """Min-hashes, 32 bits each, most significant byte first so that bytes sort as numbers."""
    seeds = _mixed(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    low = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(sets), _BLOCK):
        block = sets[start : start + _BLOCK]
        for k in range(hashes):
            x = (block ^ seeds[k]) * np.uint64(0xBF58476D1CE4E5B9)
            low[k] = min(low[k], (x ^ (x >> np.uint64(29))).min())
    return _mixed(low).__rshift__(np.uint64(32)).astype(">u4").tobytes()


def _signed(hashes: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                sets = shingles(text)
                n.append(len(sets))
                a.append(int(_mixed(sets).sum(dtype=np.uint64).astype(np.int64)))
                b.append(int(_mixed(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
                sigs.append(signature(sets, hashes) if len(sets) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sigs, pa.binary())],
                ["id", "n_shingles", "set_a", "set_b", "signature"],
            )

    return signed


def _tree_places(tree: int, trees: int = TREES) -> list[int]:
    """The hash functions of a tree in its order: its own first, then others'."""
    hashes = trees * MIN_DEPTH
    own = [tree * MIN_DEPTH + k for k in range(MIN_DEPTH)]
    return own + [(hashes // 2 + tree * MIN_DEPTH + k * 7) % hashes for k in range(DEPTH - MIN_DEPTH)]


def _region(tree: int) -> Column:
    """A number for the tree and its first values: equal for rows of one region."""
    return F.xxhash64(F.lit(tree), F.substring("signature", 4 * tree * MIN_DEPTH + 1, 4 * MIN_DEPTH))


def forest(classes: DataFrame, trees: int = TREES) -> DataFrame:
    """(id, n_shingles, signature) -> rows (tree, order, region, id, n_shingles), sorted in partitions by range."""
    rows = []
    for tree in range(trees):
        order = F.concat(*[F.substring("signature", 4 * k + 1, 4) for k in _tree_places(tree, trees)])
        rows.append(F.struct(F.lit(tree).alias("tree"), order.alias("order"), _region(tree).alias("region"), "id", "n_shingles"))
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        classes.select(F.inline(F.array(*rows)))
        .repartitionByRange(partitions, "tree", "order", "id").sortWithinPartitions("tree", "order", "id")
    )


def neighbours(percent: int, near: int):
    """Sorted rows (region, id, n_shingles) of a partition -> candidate pairs (a, b) within ``near`` rows, of sizes that allow the similarity.

    Rows (a, null, region) are marks: of each row that has rows beyond ``near`` in its region, and of the rows of the
    partition's first and last region, which may go on in another partition.
    """
    reach = near + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b, region):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, region)], ["a", "b", "region"])

        def marks(region, ids):
            return rows(ids, [None] * len(ids), region)

        tail, first = None, None
        for batch in batches:
            if not len(batch):
                continue
            now = [batch.column(k).to_numpy() for k in range(3)]
            old = 0 if tail is None else len(tail[0])
            now = now if tail is None else [np.concatenate(x) for x in zip(tail, now)]
            region, ids, sizes = now
            # A region's rows beyond the first or last 2 * reach of a partition are marked as wide.
            first = now if first is None else first
            if len(first[0]) < 2 * reach and first is not now:
                first = [np.concatenate([x, y[old:]]) for x, y in zip(first, now)]
            first = [x[: 2 * reach] for x in first]
            pairs, wide = [], np.zeros(len(ids), bool)
            for apart in range(1, reach + 1):
                # Pairs whose second row is new; the first may be in the tail of the last batch.
                i = np.arange(max(0, old - apart), max(0, len(ids) - apart))
                i = i[region[i] == region[i + apart]]
                if not len(i):
                    break
                j = i + apart
                if apart == reach:
                    wide[i] = wide[j] = True
                    break
                big, small = np.maximum(sizes[i], sizes[j]), np.minimum(sizes[i], sizes[j])
                ok = (100 * small >= percent * big) & (ids[i] != ids[j])
                pairs.append((np.minimum(ids[i], ids[j])[ok], np.maximum(ids[i], ids[j])[ok]))
            tail = [x[-2 * reach :] for x in now]
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs))
                yield rows(a, b, [None] * len(a))
            if wide.any():
                yield marks(region[wide], ids[wide])
        if tail is not None:
            for (region, ids, _), at in ((first, 0), (tail, -1)):
                edge = region == region[at]
                yield marks(region[edge], ids[edge])

    return found


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    flat = [np.concatenate(x) for x in (left, right)]
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    both = np.intersect1d(*flat)
    if not len(both):
        return out
    at = [np.searchsorted(both, x).clip(max=len(both) - 1) for x in flat]
    met = [both[p] == x for p, x in zip(at, flat)]
    order = [np.argsort(p[m], kind="stable") for p, m in zip(at, met)]
    at, row = ([x[m][o] for x, m, o in zip(xs, met, order)] for xs in (at, row))
    for start in range(0, len(both), step):
        grid = []
        for p, r, n in zip(at, row, out.shape):
            part = slice(*np.searchsorted(p, [start, start + step]))
            one = np.zeros((n, min(step, len(both) - start)), np.float32)
            one[r[part], p[part] - start] = 1
            grid.append(one)
        out += (grid[0] @ grid[1].T).astype(np.int64)
    return out


def _block_links(percent: int):
    def links(table: pa.Table) -> pa.Table:
        """Of a block against another or itself, links enough to join what is linked."""
        ids, component, n, side = (table[c].to_numpy() for c in ("id", "component", "n_shingles", "side"))
        regions = np.array(table["regions"].to_pylist(), np.int64)
        whole = table["same"][0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if whole else np.flatnonzero(side == 1)
        ok = component[left][:, None] != component[right][None]
        ok &= 100 * np.minimum(n[left][:, None], n[right][None]) >= percent * np.maximum(n[left][:, None], n[right][None])
        if whole:
            ok &= np.arange(len(left))[:, None] < np.arange(len(left))[None]
        # Rows that share a region of an earlier tree are compared there.
        tree = int((regions == table["region"][0].as_py()).any(0).argmax())
        for t in range(tree):
            ok &= regions[left, t][:, None] != regions[right, t][None]
        some, other = ok.any(1), ok.any(0)
        left, right, ok = left[some], right[other], ok[some][:, other]
        a, b = [], []
        if ok.size:
            sets = table["shingles"].to_pylist()
            sets = {k: np.frombuffer(sets[k], np.uint64) for k in {*left.tolist(), *right.tolist()}}
            sizes = [np.array([len(sets[k]) for k in x]) for x in (left, right)]
            both = overlaps([sets[k] for k in left], [sets[k] for k in right])
            ok &= 100 * both >= percent * (sizes[0][:, None] + sizes[1][None] - both)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
                x, y = find(int(component[left[i]])), find(int(component[right[j]]))
                if x != y:
                    root[x] = y
                    a.append(int(ids[left[i]])), b.append(int(ids[right[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def wide_links(marks: DataFrame, dense: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of one region: marks (id, region), dense (id, n_shingles, regions, component), sets (id, shingles).

    A region's largest component isn't compared with itself; its rows meet the others' blocks only.
    """
    rows = keep(marks.join(dense.select("id", "n_shingles", "component").hint("merge"), "id"), "wide")
    count = rows.groupBy("region", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    top = count.groupBy("region").agg(F.max(F.struct("n", "s", "component")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))

    def blocks(n: Column, s: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES)).cast("int")

    open_ = keep(top.where("n > top.n").select(
        "region", F.col("top.component").alias("most"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("few"),
        blocks(F.col("top.n"), F.col("top.s")).alias("many")), "open")
    own = F.pmod(F.xxhash64("id", "region"), F.when(F.col("component") == F.col("most"), F.col("many")).otherwise(F.col("few"))).cast("int")
    asked = rows.join(open_, "region").withColumn("own", own)

    def task(i: Column, j: Column, kind: int, side: Column) -> Column:
        same = (i == j) if kind == 0 else F.lit(False)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"), same.alias("same"))

    own, few, many = F.col("own"), F.sequence(F.lit(0), F.col("few") - 1), F.sequence(F.lit(0), F.col("many") - 1)
    among = F.transform(few, lambda k: task(F.least(own, k), F.greatest(own, k), 0, (own > k).cast("int")))
    against = F.transform(many, lambda k: task(own, k, 1, F.lit(0)))
    most = F.transform(few, lambda k: task(k, own, 1, F.lit(1)))
    tasks = F.when(F.col("component") == F.col("most"), most).otherwise(F.concat(among, against))
    dealt = asked.select("region", "id", F.explode(tasks).alias("t")).select("region", "id", "t.*")
    rest = dense.join(sets.hint("merge"), "id")
    return dealt.join(rest.hint("merge"), "id").groupBy("region", "kind", "i", "j").applyInArrow(_block_links(percent), "a long, b long")


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            good = []
            known.clear()
            for a, b, s, t in zip(*[c.to_pylist() for c in batch.columns]):
                if a not in known:
                    known.clear()
                    known[a] = shingles(s)
                x, y = known[a], shingles(t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def near_dedup(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text", trees: int = TREES) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (the smallest id it is linked with, directly or not), ``kept``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. Documents of equal sets
    are one class first, so copies cost one row each and never make pairs. Null, empty and blank texts have no shingle and
    are linked with nothing. Rows with a null id have a null component and are kept, and link nobody. Rows that share an
    id are one document in several versions: all get one component. An empty table gives an empty table.
    """
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sets = keep(ids.mapInArrow(_signed(trees * MIN_DEPTH), "id long, n_shingles long, set_a long, set_b long, signature binary"), "sets")
    named = sets.where("n_shingles > 0 AND id IS NOT NULL")
    key = ["set_a", "set_b"]
    classes = keep(named.groupBy(*key).agg(F.min(F.struct("id", "n_shingles", "signature")).alias("r")).select(*key, "r.*"), "classes")
    members = classes.select("id", "n_shingles", "signature")

    def texts_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
        # Merge joins at every size: what is measured on little data is the plan that runs on much.
        return rows.join(asked.distinct().hint("merge"), "id", "left_semi")

    def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}")).hint("merge") for k in "ab")
        whole = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
        return keep(whole.mapInArrow(_confirmed(percent), "a long, b long").distinct(), "links")

    rows = forest(members, trees).select("region", "id", "n_shingles")
    met = keep(rows.mapInArrow(neighbours(percent, NEAR_ROWS), "a long, b long, region long").distinct(), "pairs")
    pairs, marks = met.where("b IS NOT NULL").select("a", "b"), met.where("b IS NULL").select(F.col("a").alias("id"), "region")
    # A region with one marked row has no pair left.
    several = marks.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    marks = keep(marks.join(several, "region", "left_semi"), "marks")
    # The whole corpus is shuffled by id once, and only documents of pairs and marks are asked for.
    # Versions of a document each have their text; equal rows are one.
    texts = texts_of(ids, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(marks.select("id")))
    texts = texts.groupBy("id", F.xxhash64("text").alias("v")).agg(F.first("text").alias("text")).select("id", "text")
    texts = keep(texts, "texts")
    links = confirmed(pairs, texts)
    labels = components(links)
    if not marks.isEmpty():
        dense = members.join(marks.select("id").distinct(), "id", "left_semi").join(labels, "id", "left").select(
            "id", "n_shingles", F.coalesce("component", "id").alias("component"), F.array(*[_region(t) for t in range(trees)]).alias("regions"))
        shingled = keep(texts_of(texts, marks.select("id")).mapInArrow(_sets, "id long, shingles binary"), "shingles")
        more = keep(wide_links(marks, keep(dense, "dense"), shingled, percent).distinct(), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    found = keep(classes.select(*key, "id").join(labels, "id", "left").select(*key, F.coalesce("component", "id").alias("component")), "found")
    # Versions of one document may lie in several classes; then the document joins them.
    versions = named.groupBy("id", *key).agg(F.count("*").alias("n")).withColumn("many", F.count("*").over(Window.partitionBy("id"))).where("many > 1")
    bridge = keep(versions.join(found, key).select("id", F.col("component").alias("c")), "versions")
    if not bridge.isEmpty():
        joined = components(bridge.groupBy("id").agg(F.min("c").alias("m")).join(bridge, "id").select(F.col("c").alias("a"), F.col("m").alias("b")))
        found = keep(found.join(joined.withColumnRenamed("component", "root"), found["component"] == joined["id"], "left").select(
            *key, F.coalesce("root", "component").alias("component")), "found")
    whole = sets.select("id", "n_shingles", *key).join(found, key, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return whole.select(
        F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
