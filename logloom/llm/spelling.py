"""Spelling variants: words one edit apart, found by composing the vocabulary's acceptor with a one-edit transducer.

The vocabulary's acceptor is cut at prefixes into parts of at most ``PART_WORDS`` words; a part is what is accepted from
the state its prefix leads to. Composition (acceptor o one edit o acceptor) starts at a pair of such states:

* from equal states with the edit still to come: both words lie in one part. The part's minimised acceptor is composed
  with the transducer and itself; states that end alike are one state, and what an edit at a state leads to is
  enumerated once for all prefixes that reach it;
* from two states with the edit already made within the prefix: from there on the transducer only copies, so the words
  are equal after the edit. These are equal-key joins: of words without the code point at the edit (one replaced), and of
  such words with the vocabulary (one inserted or deleted).

Each pair is found at the first code point where its words differ, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import keep

MIN_POINTS, MIN_COUNT = 5, 3
#: Words of a part at most, unless they are fewer than that many code points apart anyway. Parts bound memory, not what is found.
PART_WORDS = 4096
#: Code points of a part's prefix at least, and lengths of prefixes that are counted in one pass.
SHORTEST, LENGTHS = 3, 4
PAIRS = "a string, a_n long, b string, b_n long"


class Acceptor:
    """The minimal acceptor of sorted distinct words: per state its arcs by code point and whether a word ends there. 0 is the start."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def close(depth: int) -> None:
            # States below get no more arcs: each gives way to an equal one where there is one.
            while len(path) > depth + 1:
                state = path.pop()
                key = (self.final[state], *self.arcs[state].items())
                self.arcs[path[-1]][last[len(path) - 1]] = known.setdefault(key, state)

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same)
            for point in word[same:]:
                self.arcs[path[-1]][point] = len(self.arcs)
                path.append(len(self.arcs))
                self.arcs.append({})
                self.final.append(False)
            self.final[path[-1]] = True
            last = word
        close(0)
        self._alive: dict[tuple[int, int], bool] = {}

    def alive(self, s: int, t: int) -> bool:
        """Whether some string leads from both states to an end."""
        known, stack = self._alive, [(s, t)]
        while stack:
            x, y = at = stack[-1]
            if at not in known:
                if x == y or (self.final[x] and self.final[y]):
                    known[at] = True
                else:
                    then = [(self.arcs[x][c], self.arcs[y][c]) for c in self.arcs[x].keys() & self.arcs[y].keys()]
                    open_ = next((k for k in then if k not in known), None)
                    if any(known.get(k) for k in then):
                        known[at] = True
                    elif open_:
                        stack.append(open_)
                        continue
                    else:
                        known[at] = False
            stack.pop()
        return known[s, t]

    def common(self, s: int, t: int, not_first: str = "") -> Iterator[str]:
        """The strings that lead from both states to an end and don't begin with ``not_first``."""
        stack = [(s, t, "")]
        while stack:
            x, y, read = stack.pop()
            if self.final[x] and self.final[y]:
                yield read
            for c in self.arcs[x].keys() & self.arcs[y].keys():
                if (read or c != not_first) and self.alive(self.arcs[x][c], self.arcs[y][c]):
                    stack.append((self.arcs[x][c], self.arcs[y][c], read + c))

    def edited(self, s: int) -> list[tuple[str, str]]:
        """Rests of two words that differ first at this state, by one replaced code point or one more."""
        out = []
        for c, x in self.arcs[s].items():
            # Of a stretch of one code point the last is the one too many: what follows begins otherwise.
            out += [(c + z, z) for z in self.common(x, s, c)]
            for d, y in self.arcs[s].items():
                if c < d:
                    out += [(c + z, d + z) for z in self.common(x, y)]
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of words one edit apart."""
        edits: dict[int, list[tuple[str, str]]] = {}
        stack = [(0, "")]
        while stack:
            s, read = stack.pop()
            if s not in edits:
                edits[s] = self.edited(s)
            for x, y in edits[s]:
                yield read + x, read + y
            stack += [(t, read + c) for c, t in self.arcs[s].items()]


def _composed(table: pa.Table) -> pa.Table:
    """A part's words (word, n, depth) -> its pairs whose edit lies after the prefix."""
    out: list[tuple] = []
    if len(table) > 1:
        n = dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))
        depth = table["depth"][0].as_py()
        prefix = next(iter(n))[:depth]
        for a, b in Acceptor(sorted(w[depth:] for w in n)).pairs():
            a, b = prefix + a, prefix + b
            out.append((a, n[a], b, n[b]))
    columns = list(zip(*out)) or [[]] * 4
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("a", "a_n", "b", "b_n"), columns, (pa.string(), pa.int64()) * 2)})


def _until(word: Column, length: Column) -> Column:
    return F.substr(word, F.lit(1), length)


def parted(vocabulary: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n) with ``depth``, the length of its part's prefix: the least, from ``SHORTEST``, that at most ``part_words``
    words share. A word that is itself such a prefix of more words is a part of its own, one deeper than it is long."""
    open_, low, done = vocabulary, SHORTEST, []
    while True:
        lengths = F.sequence(F.lit(low), F.lit(low + LENGTHS - 1))
        prefixes = open_.select("word", F.explode(lengths).alias("k")).withColumn("prefix", _until(F.col("word"), F.col("k")))
        wide = keep(prefixes.groupBy("k", "prefix").agg(F.count("*").alias("words")).where(F.col("words") > part_words).select("k", "prefix"), "wide")
        if wide.isEmpty():
            return _all([*done, open_.withColumn("depth", F.lit(low))])
        deepest = prefixes.join(wide.hint("merge"), ["k", "prefix"]).groupBy("word").agg(F.max("k").alias("k"))
        found = keep(open_.join(deepest, "word", "left").withColumn("depth", F.coalesce(F.col("k") + 1, F.lit(low))).drop("k"), "parts")
        low += LENGTHS
        done.append(found.where(F.col("depth") < low))
        open_ = found.where(F.col("depth") == low).drop("depth")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def near_pairs(vocabulary: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n) of distinct words -> rows (a, a_n, b, b_n): each pair of words one inserted, deleted or replaced code point apart, once."""
    words = keep(parted(vocabulary, part_words), "words")
    inner = words.groupBy(_until(F.col("word"), F.col("depth"))).applyInArrow(_composed, PAIRS)
    # The edit within the prefix, at code point k: the word without it.
    size, k = F.char_length("word"), F.col("k")
    cuts = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.least("depth", size) - 1)).alias("k")).select(
        "word", "n", "k", F.concat(_until(F.col("word"), k), F.substr(F.col("word"), k + 2)).alias("cut"),
        F.substr(F.col("word"), k + 1, F.lit(1)).alias("point"), F.substr(F.col("word"), k + 2, F.lit(1)).alias("next"),
    )
    cuts = keep(cuts, "cuts")
    left, right = (cuts.select("k", "cut", F.col("word").alias(x), F.col("n").alias(f"{x}_n")).hint("merge") for x in "ab")
    replaced = left.join(right, ["k", "cut"]).where("a < b")
    longer = cuts.where("point <> next").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("cut").alias("b")).hint("merge")
    deleted = longer.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")).hint("merge"), "b")
    return _all([f.select("a", "a_n", "b", "b_n") for f in (inner, replaced, deleted)])


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) of words that have a form, without circles -> (word, root): the last form of each word's chain.

    Every round jumps to the form's own target, so a chain of m words takes about log2(m) rounds.
    """
    at = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = at.select(F.col("word").alias("root"), F.col("root").alias("then"))
        moved = keep(at.join(then.hint("merge"), "root", "left").select(
            "word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def vocabulary(words: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT, word: str = "word") -> DataFrame:
    """One row per distinct word of enough code points and occurrences: (word, n). Nulls are no words."""
    w = F.col(f"`{word}`")
    counted = words.where(F.char_length(w) >= min_points).groupBy(w.alias("word")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def variants(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """A vocabulary (word, n) -> one row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    Near words differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts them. The form is the
    near word of largest n (ties: the smallest in code-point order) if that is twice the word's n or more, else null.
    The root is where the chain of forms ends, the word itself if it has none.

    Words are expected once each, as ``vocabulary`` returns them; nulls and repeats of texts end there, and so do extra
    columns. Very long words are taken whole. An empty vocabulary gives an empty table.
    """
    words = keep(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words, part_words)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                    F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = pairs.select(F.inline(sides)).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near", "near_n")).alias("best"))
    formed = F.col("best.near_n") >= 2 * F.col("n")
    out = keep(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("best.near_n")).alias("form_n")), "forms")
    last = roots(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
