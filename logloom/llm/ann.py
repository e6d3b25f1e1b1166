"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt to shards of bounded size by hash. In a shard, greedy searches over the growing graph propose each
vector's neighbours; pruning keeps an edge only if no kept neighbour is much nearer to its end (relaxed by ``ALPHA``), so
that edges point in diverse directions. A query runs a beam search over every shard's graph; the shards' answers are
merged by exact distance. Searches run for many queries at once, over blocks of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import keep

SHARD_ROWS, BLOCK_QUERIES = 2000, 1024
DEGREE, BEAM, ALPHA, BUILD_BATCH = 24, 64, 1.2, 256
#: Nodes a search expands at once.
EXPANDED = 4


def _squared(vectors: np.ndarray, norms: np.ndarray, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each point to its row of nodes."""
    return np.maximum(norms[nodes] - 2 * np.einsum("bcd,bd->bc", vectors[nodes], points) + (points**2).sum(1)[:, None], 0)


def beam_search(vectors: np.ndarray, edges: np.ndarray, starts: np.ndarray, points: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Nearest found nodes of each point and their squared distances, nearest first; -1 and infinity where there are fewer.

    The beam holds the ``width`` nearest nodes seen; its nearest ones that weren't expanded yet are, until none is left.
    """
    norms, q = (vectors**2).sum(1), len(points)
    seen = np.zeros((q, len(vectors) + 1), bool)
    seen[:, -1] = True  # stands for a missing edge
    nodes = np.full((q, width), -1)
    dists = np.full((q, width), np.inf, vectors.dtype)
    done = np.ones((q, width), bool)
    fresh, rows = np.broadcast_to(starts, (q, len(starts))).copy(), np.arange(q)
    while len(rows):
        fresh.sort(1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        fresh[seen[rows[:, None], fresh]] = -1
        seen[rows[:, None], fresh] = True
        d = _squared(vectors, norms, fresh, points[rows])
        d[fresh < 0] = np.inf
        every = np.concatenate([dists[rows], d], 1)
        best = np.argsort(every, 1, kind="stable")[:, :width]
        nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], fresh], 1), best, 1)
        dists[rows] = np.take_along_axis(every, best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], fresh < 0], 1), best, 1)
        rows = np.flatnonzero(~done.all(1))
        if len(rows):
            # The first few open places of each beam.
            places = np.argsort(done[rows], 1, kind="stable")[:, :EXPANDED]
            opened = ~np.take_along_axis(done[rows], places, 1)
            picked = np.where(opened, np.take_along_axis(nodes[rows], places, 1), -1)
            done[rows[:, None], places] = True
            fresh = np.where(picked[:, :, None] >= 0, edges[picked], -1).reshape(len(rows), -1)
    return nodes, dists


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """At most ``degree`` edges for each node of ``points`` out of its row of candidates (-1: none), nearest first.

    A candidate goes once some kept neighbour is ``alpha`` times nearer to it than the node is.
    """
    norms = (vectors**2).sum(1)
    candidates = np.sort(candidates, 1)
    bad = candidates < 0
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    bad |= candidates == points[:, None]
    d = np.where(bad, np.inf, _squared(vectors, norms, candidates, vectors[points]))
    order = np.argsort(d, 1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    near, out, every = vectors[candidates], np.full((len(points), degree), -1), np.arange(len(points))
    alive = np.isfinite(d)
    for k in range(degree):
        pick = alive.argmax(1)
        has = alive[every, pick]
        if not has.any():
            break
        chosen = candidates[every, pick]
        out[has, k] = chosen[has]
        between = norms[candidates] - 2 * np.einsum("bcd,bd->bc", near, vectors[chosen]) + norms[chosen][:, None]
        alive &= (alpha * alpha * between > d) | ~has[:, None]
        alive[every, pick] = False
    return out


def build_graph(vectors: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vectors -> (edges: a row of nodes for each, -1 where there are fewer; nodes where searches start)."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    centre = int(((vectors - vectors.mean(0)) ** 2).sum(1).argmin())
    starts = np.unique(np.append(rng.choice(n, min(n, 8), replace=False), centre))
    edges = np.full((n, DEGREE), -1)
    if n <= 1:
        return edges, starts
    edges[:, : DEGREE // 2] = rng.integers(0, n, (n, DEGREE // 2))
    edges[edges == np.arange(n)[:, None]] = -1
    for batch in np.array_split(rng.permutation(n), math.ceil(n / BUILD_BATCH)):
        found, _ = beam_search(vectors, edges, starts, vectors[batch])
        edges[batch] = robust_prune(vectors, batch, np.concatenate([found, edges[batch]], 1))
        # Reverse edges: nodes that get new ones prune all they have again.
        source, target = np.repeat(batch, DEGREE), edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(hit), count.max()), -1)
        back[np.repeat(np.arange(len(hit)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        edges[hit] = robust_prune(vectors, hit, np.concatenate([edges[hit], back], 1))
    return edges, starts


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vec) of the vectors that take part: with an id, not empty, not zero, every component a finite number."""
    v = F.col(f"`{embedding}`").cast("array<float>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine).where(F.exists("vec", lambda x: x != 0))


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, vec) -> one row per shard with its graph: (shard, shards, dim, ids, starts, vectors, edges).

    Equal vectors are one node; of their ids the ``k + 1`` smallest are kept, which is all that an answer of ``k`` can
    name. Each node knows its ids. The limit applies before the shuffle, so a very common vector is never gathered.
    """
    same = Window.partitionBy("hash", "vec").orderBy("id")
    rows = rows.distinct().withColumn("hash", F.xxhash64("vec")).withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1)
    rows = keep(rows.select("id", "vec", "hash"), "vectors")
    shards = max(1, math.ceil(rows.select("hash").distinct().count() / shard_rows))

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        nodes: dict[bytes, list[int]] = {}
        for i, v in zip(pdf["id"], pdf["vec"]):
            nodes.setdefault(np.asarray(v, np.float32).tobytes(), []).append(int(i))
        vectors = np.frombuffer(b"".join(nodes), np.float32).reshape(len(nodes), -1)
        edges, starts = build_graph(vectors)
        return pd.DataFrame({
            "shard": [pdf["shard"].iloc[0]], "dim": [vectors.shape[1]], "ids": [list(nodes.values())], "starts": [starts.tolist()],
            "vectors": [vectors.tobytes()], "edges": [edges.astype(np.int32).tobytes()],
        })

    dealt = rows.withColumn("dim", F.size("vec")).withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    # By number, so that no task gets many shards because they are small.
    graphs = dealt.repartition(shards, "shard", "dim").groupBy("shard", "dim").applyInPandas(
        built, "shard int, dim int, ids array<array<long>>, starts array<int>, vectors binary, edges binary",
    )
    return keep(graphs, "graphs").withColumn("shards", F.lit(shards))


def search(graphs: DataFrame, queries: DataFrame, k: int, width: int = BEAM, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, by exact distance in double precision.

    A task takes one block of queries and one shard; both have a bounded size. Vectors of another length are no candidates.
    """
    blocks = max(1, math.ceil(queries.count() / block_queries))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("vec"))
    asked = keep(asked.groupBy("block", "dim").agg(F.collect_list("id").alias("query_ids"), F.collect_list("vec").alias("query_vecs")), "queries")
    # Pairs are made in the tasks that search them. Copies of blocks for all shards are never broadcast or shuffled.
    tasks = graphs.hint("shuffle_replicate_nl").join(asked, "dim")

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples():
                vectors = np.frombuffer(t.vectors, np.float32).reshape(-1, t.dim)
                edges = np.frombuffer(t.edges, np.int32).reshape(len(vectors), DEGREE)
                points = np.array([np.asarray(v, np.float32) for v in t.query_vecs])
                out, asking, beam = [], np.arange(len(points)), width
                while len(asking):
                    nodes, _ = beam_search(vectors, edges, np.asarray(t.starts), points[asking], beam)
                    wider = []
                    for at, found in zip(asking, nodes):
                        q, found = int(t.query_ids[at]), found[found >= 0]
                        exact = np.sqrt(((vectors[found].astype(np.float64) - points[at].astype(np.float64)) ** 2).sum(1))
                        # All nodes as near as the k-th other than the query's own: ties are broken by id, over all shards.
                        own = np.array([all(i == q for i in t.ids[o]) for o in found], bool)
                        others = np.sort(exact[~own])
                        within = np.inf if len(others) < k else others[k - 1]
                        if len(found) == beam < len(vectors) and exact.max() <= within:
                            wider.append(at)  # more nodes may be as near
                            continue
                        near = np.flatnonzero(~own & (exact <= within))
                        some = [(q, int(i), float(exact[o])) for o in near for i in t.ids[found[o]] if i != q]
                        out += sorted(some, key=lambda x: (x[2], x[1]))[:k]
                    asking, beam = np.array(wider, int), 2 * beam
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    pairs = tasks.select("dim", "ids", "starts", "vectors", "edges", "query_ids", "query_vecs")
    found = pairs.mapInPandas(answered, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Each query's ``k`` nearest of all ``vectors`` but itself: query_id, rank, vec_id, score (Euclidean distance).

    Queries are rows like those of ``vectors``. Vectors that are null, empty, zero or hold null or non-finite components
    take no part on either side, nor do null ids; rows repeated as a whole are one. Ties go to the smaller id. Fewer
    candidates give fewer rows, an empty table none.
    """
    return search(build_index(usable(vectors, vec_id, embedding), k, shard_rows), usable(queries, vec_id, embedding).distinct(), k)
