"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only bags are labelled. A sentence is toxic with probability ``p = sigmoid(b + sum of
its words' weights)``, a document with the noisy-or ``1 - prod(1 - p)``. Weights are fitted to the bags' labels, and
then say which sentences are to blame.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are features.
STEMS = (3, 4, 5, 6)
#: Words remembered with their weight at a time.
REMEMBERED_WORDS = 200_000
#: Sentences of at least this probability are named as offending.
OFFENDING = 0.5


def sentences(text: str) -> list[set[str]]:
    """The distinct words of each sentence that has any."""
    lower = text.lower()
    return [words for s in SENTENCE.split(lower) if (words := set(TOKEN.findall(s)))]


def features(word: str) -> list[str]:
    """The word itself and its beginnings: languages that compound and inflect repeat stems, not words."""
    return [f"={word}", *(f"^{word[:n]}" for n in STEMS if len(word) > n)]


def word_weight(word: str, weights: dict[str, float]) -> float:
    return sum(weights.get(f, 0.0) for f in features(word))


def found_in(text: str) -> set[str]:
    """The features that occur in a text."""
    return {f for word in set(TOKEN.findall(text.lower())) for f in features(word)}


def choose(texts: list[str], labels: np.ndarray, least_docs: int = 4, lift: float = 3.0, z: float = 4.0) -> dict[str, int]:
    """Features that toxic bags have ``lift`` times as often as others, in ``least_docs`` of them and by ``z`` deviations."""
    toxic = Counter(f for text, y in zip(texts, labels) if y == 1 for f in found_in(text))
    names = sorted(f for f, n in toxic.items() if n >= least_docs)
    asked, clean = set(names), Counter()
    for text, y in zip(texts, labels):
        if y != 1:
            clean.update(found_in(text) & asked)
    n1, n0 = float((labels == 1).sum()), float((labels != 1).sum())
    a, c = np.array([toxic[f] for f in names], float), np.array([clean[f] for f in names], float)
    p1, p0, p = (a + 0.5) / (n1 + 1), (c + 0.5) / (n0 + 1), (a + c + 1) / (n1 + n0 + 2)
    good = (p1 >= lift * p0) & (p1 - p0 >= z * np.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n0, 1))))
    return {f: k for k, f in enumerate(f for f, ok in zip(names, good) if ok)}


def fit(texts: list[str], labels: np.ndarray, rounds: int = 120, rate: float = 0.3, decay: float = 0.005) -> tuple[dict[str, float], float]:
    """Features' weights and the bias, by full-batch Adam on the noisy-or likelihood of the bags' labels."""
    if len(labels) == 0 or labels.min() == labels.max():
        # Nothing to learn from: never toxic, or always if every label says so.
        return {}, (20.0 if len(labels) and labels.min() == 1 else -20.0)
    index = choose(texts, labels)
    feature, owner, bag_of = [], [], []
    of: dict[str, tuple[int, ...]] = {}
    for k, text in enumerate(texts):
        for words in sentences(text):
            for word in words:
                if word not in of:
                    of[word] = tuple(index[f] for f in features(word) if f in index)
            known = [f for word in words for f in of[word]]
            feature += known
            owner += [len(bag_of)] * len(known)
            bag_of.append(k)
    feature, owner, bag_of = np.array(feature, int), np.array(owner, int), np.array(bag_of, int)
    n_sentences, n_bags = len(bag_of), len(texts)
    w, b = np.zeros(len(index)), np.log(labels.mean() / max(1.0, n_sentences / n_bags))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(b + np.bincount(owner, w[feature], n_sentences), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(bag_of, np.logaddexp(0, z), n_bags))  # the product of 1 - p
        slope = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) / n_bags
        g = slope[bag_of] * p
        gw = np.bincount(feature, g[owner], len(w)) + decay * w / n_bags
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return {f: float(w[k]) for f, k in index.items()}, float(b)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = 4500, max_chars: int = 100_000,
) -> tuple[dict[str, float], float]:
    """Fit on at most ``sample`` labelled documents, those of the lowest id hashes; texts over ``max_chars`` aren't learned from.

    Both bounds make what the driver fits on bounded; they concern learning only, scores use whole texts. Rows with a null
    label, id or text teach nothing.
    """
    i = F.col(f"`{doc_id}`")
    known = labels.where(i.isNotNull() & F.col(label).isNotNull()).select(i.alias("__id"), F.col(label).cast("int").alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample)
    rows = docs.where(F.length(f"`{text}`") <= max_chars).select(i.alias("__id"), F.col(f"`{text}`").alias("__t"))
    # The labelled ids are at most ``sample`` rows, so they may be broadcast.
    found = rows.join(F.broadcast(known), "__id").orderBy(F.xxhash64("__id"), "__id", "__t", "__y").limit(sample).toPandas()
    return fit(found["__t"].tolist(), found["__y"].to_numpy(np.float64))


def score(docs: DataFrame, model: tuple[dict[str, float], float], text: str = "text", score: str = "score") -> DataFrame:
    """Documents with ``score`` and ``offending``: the sentences to blame as (sentence, probability), by place.

    Sentences count from 0 among those that have words. Null or empty texts and texts without words score 0 and have no
    offending sentence. Columns of these names are replaced; rows stay where they are.
    """
    weights, bias = model

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}

        def weight(word: str) -> float:
            w = known.get(word)
            if w is None:
                if len(known) >= REMEMBERED_WORDS:
                    known.clear()
                known[word] = w = word_weight(word, weights)
            return w

        for texts in batches:
            out = []
            for text in texts.to_pylist():
                z = np.array([bias + sum(map(weight, words)) for words in sentences(text or "")])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                whole = 1 - float(np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
                blame = [{"sentence": int(k), "probability": float(p[k])} for k in np.flatnonzero(p >= OFFENDING)]
                out.append({"score": min(1.0, max(0.0, whole)), "offending": blame})
            yield pa.array(out, pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("sentence", pa.int32()), ("probability", pa.float64())])))]))

    judged = F.arrow_udf(scored, "struct<score:double,offending:array<struct<sentence:int,probability:double>>>")
    return (
        docs.withColumn("__judged", judged(F.col(f"`{text}`")))
        .withColumn(score, F.col("__judged.score")).withColumn("offending", F.col("__judged.offending")).drop("__judged")
    )


def score_frame(texts: list[str], model: tuple[dict[str, float], float]) -> pd.Series:
    """The same score, sentence by sentence in plain Python, for tests on small data."""
    weights, bias = model
    out = []
    for text in texts:
        clean = 1.0
        for words in sentences(text or ""):
            clean *= 1 - 1 / (1 + np.exp(-np.clip(bias + sum(word_weight(w, weights) for w in words), -30, 30)))
        out.append(1 - clean)
    return pd.Series(out)
