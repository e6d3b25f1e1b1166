"""Similarity join on word n-grams by prefixes that adapt to what they cost.

Where shingles have one order, two sets of |r| and |s| shingles that share at least ``t`` share ``l`` of the first
|r| - t + l and |s| - t + l (l <= t). Sets that take different l share the smaller one, as shorter prefixes lie in longer
ones. So every set chooses its own l: a longer prefix, and correspondingly more shared shingles before a pair is verified.

1. Sets alike are one class; copies never make pairs.
2. Probe: in the order of hashes, prefixes with l = ``PROBE`` + a sixteenth of the set. Sets that don't have l
   shingles there that other sets' probes have too are linked with nothing. What is left is a small part of the corpus.
3. Prefix: in the order of frequency among the sets left, rare shingles first. Shingles of one set only come first and
   never match. For each l the prefix costs its postings, its candidates (the sum of other sets per shingle) and at most
   1 / l of them a verification each; the cheapest l is taken.
4. Posting lists of the prefixes are first linked to a centre each, the set with the fewest shingles of its own, which
   joins a group of near copies in a linear number of pairs. Of the pairs left, those of two components are counted over
   all lists and verified where they share enough. The largest component of a list is not compared with itself. Sets
   that meet in a list of a frequent shingle have all their rarer shingles in their prefixes; where they share none of
   these, they share frequent ones only, and few of such pairs have enough of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import keep
from logloom.llm.graph import components
from logloom.llm.near_dedup import shingles

WORDS = 3
#: Shared shingles asked of a probe: so many, and a part of the set.
PROBE, PROBE_PART = 4, 16
#: Prefixes are lengthened by at most so many shingles; a posting and a verification cost as much as so many candidates of a list.
MATCHES, POSTING, VERIFY = 8, 8, 16
#: A shingle of more sets than these is frequent.
FREQUENT = 32


def required(n, percent: int):
    """How many shingles a set of ``n`` shares at least with any set of that similarity."""
    return (n * percent + 99) // 100


def probe_matches(n, percent: int):
    return min(required(n, percent), PROBE + n // PROBE_PART)


def _probes(words: int, percent: int):
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, need, node, probe = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                k = len(found)
                n.append(k)
                # Partners have as few as required(k) shingles, and ask no less than so many matches.
                need.append(probe_matches(required(k, percent), percent))
                node.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
                probe.append(found[: k - required(k, percent) + probe_matches(k, percent)].view(np.int64))
            longs = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, longs), pa.array(n, longs), pa.array(need, longs), pa.array(probe, pa.list_(longs))],
                ["id", "node", "n", "need", "probe"],
            )

    return probes


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_64_intdigest(f.tobytes()) - (1 << 63) for f in found], pa.int64()), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], ["node", "n", "tokens"],
            )

    return sets


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = []
            for k in range(len(batch)):
                s, t = x[k].values.to_numpy(), y[k].values.to_numpy()
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def by_token(sets: DataFrame, tokens: str) -> DataFrame:
    """(token, node), dealt by token once: what counts and what looks counts up share this shuffle. A set has a token once."""
    return sets.select(F.explode(tokens).alias("token"), "node").repartition("token")


def survivors(classes: DataFrame) -> DataFrame:
    """Classes (node, need, probe) -> the nodes whose probes share enough with others'."""
    slots = by_token(classes, "probe")
    shared = slots.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("token")
    # Merge joins at every size: what is measured on little data is the plan that runs on much.
    hits = slots.join(shared.hint("merge"), "token", "left_semi").groupBy("node").agg(F.count("*").alias("hits"))
    return classes.select("node", "need").join(hits.hint("merge"), "node").where("hits >= need").select("node")


def prefixes(sets: DataFrame, percent: int, matches: int = MATCHES, posting: int = POSTING, verify: int = VERIFY) -> DataFrame:
    """Sets (node, n, tokens) -> postings (token, df, node, n, m, f, p, l): the adapted prefix of each set without shingles of its own.

    ``m`` is how many of the set's shingles other sets have too, ``f`` how many are frequent, ``p`` how many of these its
    prefix holds, ``l`` how many shingles it asks to share.
    """
    slots = by_token(sets, "tokens")
    df = slots.groupBy("token").agg(F.count("*").alias("df"), F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("token", "df")
    met = slots.join(df.hint("merge"), "token")
    # Ordered per set: arrays of structs sort by df, then token. A set is the unit that a task holds.
    ordered = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("slots"))
    ordered = ordered.join(sets.select("node", "n").hint("merge"), "node")
    n, m = F.col("n"), F.size("slots").cast("long")
    t = F.floor((n * percent + 99) / 100)
    # Places of the prefix that are left after the shingles of its own, for l = 0.
    base = n - t - (n - m)
    first = lambda l: F.slice("slots", F.lit(1), F.greatest(F.lit(0), base + l).cast("int"))
    pairs = lambda l: F.aggregate(first(l), F.lit(0).cast("long"), lambda s, x: s + x["df"] - 1)
    costs = [F.when(t >= l, F.struct((F.greatest(F.lit(0), base + l) * posting + pairs(l) * (1 + verify / l)).alias("cost"), F.lit(l).alias("l"))) for l in range(1, matches + 1)]
    chosen = ordered.where(100 * m >= percent * n).withColumn("m", m).withColumn("l", F.array_min(F.array(*costs))["l"])
    frequent = lambda a: F.size(F.filter(a, lambda x: x["df"] > FREQUENT)).cast("long")
    chosen = chosen.withColumn("prefix", first(F.col("l"))).withColumn("f", frequent("slots")).withColumn("p", frequent("prefix"))
    return chosen.select("node", "n", "m", "f", "p", "l", F.inline("prefix"))


def _may_link(percent: int, least: Column) -> Column:
    """Whether sets of these sizes are similar enough if they share ``least``."""
    return 100 * least >= percent * (F.col("a_n") + F.col("b_n") - least)


def _side(postings: DataFrame, x: str) -> DataFrame:
    return postings.select("token", *[F.col(c).alias(x if c == "node" else f"{x}_{c}") for c in postings.columns if c != "token"])


def centre_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Each set with its lists' centres: one pair a posting at most."""
    own = F.struct(((F.col("n") - F.col("f")) / F.col("n")).alias("own"), "node", "n", "m")
    centres = postings.groupBy("token").agg(F.min(own).alias("c"), F.count("*").alias("sets")).where("sets > 1")
    centres = centres.select("token", F.col("c.node").alias("a"), F.col("c.n").alias("a_n"), F.col("c.m").alias("a_m"))
    met = _side(postings, "b").join(centres.hint("merge"), "token").where((F.col("a") != F.col("b")) & _may_link(percent, F.least("a_m", "b_m")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_pairs(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of two components that share as many postings as the less demanding of both asks."""
    rows = keep(postings.join(labels.select(F.col("id").alias("node"), "component").hint("merge"), "node", "left").withColumn(
        "component", F.coalesce("component", "node")), "postings")
    count = rows.groupBy("token", "component").agg(F.count("*").alias("sets"))
    top = count.groupBy("token").agg(F.max(F.struct("sets", "component"))["component"].alias("top"), F.count("*").alias("k")).where("k > 1").drop("k")
    rows = keep(rows.join(top.hint("merge"), "token").withColumn("in_top", F.col("component") == F.col("top")).drop("top"), "open")
    left, right = _side(rows.where("NOT in_top"), "a").hint("merge"), _side(rows, "b").hint("merge")
    rare = F.col("a_df") <= FREQUENT
    shared = F.when(rare, F.least("a_m", "b_m")).otherwise(F.least("a_f", "b_f"))
    met = left.join(right, "token").where(_may_link(percent, shared) & F.expr("a_component <> b_component AND (b_in_top OR a < b)"))
    pairs = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.count("*").alias("shared"), F.count_if(rare).alias("rare"), F.first(F.least("a_p", "b_p")).alias("p"), F.first(F.least("a_l", "b_l")).alias("l"))
    # Pairs that share a rare shingle may have been left out of the lists of frequent ones.
    return pairs.where(F.when(F.col("rare") > 0, F.col("rare") + F.col("p")).otherwise(F.col("shared")) >= F.col("l")).select("a", "b")


def jaccard_join(docs: DataFrame, percent: int = 90, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (the smallest id reachable by links, itself included).

    Two documents link if 100 * intersection >= ``percent`` * union of their distinct ``words``-word shingles (A-Z
    lower-cased, words between white space, whole texts; with fewer words the whole sequence is one shingle). Shingles
    and sets are told apart by 64-bit hashes. Documents of equal sets are linked. Null, empty and blank texts have no
    shingle and are linked with nothing. Rows with a null id have a null component and link nobody. Rows that share an id
    are one document in several versions: all get one component. Ties don't matter, as links are all or none. Other
    columns are neither read nor returned. An empty table gives an empty table. A posting list whose sets stay in
    different components although their sizes allow a link costs its square in counting, split over tasks by the join.
    """
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = keep(ids.mapInArrow(_probes(words, percent), "id long, node long, n long, need long, probe array<long>"), "probes")
    named = rows.where("n > 0 AND id IS NOT NULL")
    # Of a class, one probe stands for all, and its smallest id's text is read again.
    classes = named.groupBy("node").agg(F.min("id").alias("id"), F.first("need").alias("need"), F.first("probe").alias("probe"))
    classes = keep(classes, "classes")
    heads = classes.select("node", "id")
    left = survivors(classes)
    asked = keep(heads.join(left.hint("merge"), "node", "left_semi"), "asked")
    texts = ids.join(asked.select("id").distinct().hint("merge"), "id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(words), "node long, n long, tokens array<long>")
    sets = keep(sets.join(asked.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("node").alias(k), F.col("tokens").alias(f"tokens_{k}")).hint("merge") for k in "ab")
        whole = pairs.join(y, "b").join(x, "a").select("a", "b", "tokens_a", "tokens_b")
        return keep(whole.mapInArrow(_confirmed(percent), "a long, b long"), "links")

    postings = keep(prefixes(sets, percent), "prefixes")
    links = linked(keep(centre_pairs(postings, percent), "pairs"))
    more = keep(open_pairs(postings, components(links), percent), "pairs")
    links = links.union(linked(more))
    # Versions of one document join their classes.
    versions = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
    links = links.union(named.join(versions.hint("merge"), "id").select("a", F.col("node").alias("b")))
    labels = components(links)
    member = keep(heads.join(labels.withColumnRenamed("id", "node").hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    least = member.groupBy("component").agg(F.min("id").alias("component_id"))
    found = member.join(least.hint("merge"), "component").select("node", "component_id")
    whole = rows.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(found.hint("merge"), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return whole.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
