"""Quality classifier by co-training.

Two views of a document are learned apart: its text (shares of bytes, repetition, word shapes) and its metadata (length,
language, source). In rounds, each classifier labels the unlabelled documents it is surest of for the other. Both are
then calibrated on labelled documents kept aside, and a small model on the calibrated views gives the score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets for a source or a language in the metadata view.
BUCKETS = 64
#: Calibrated log-odds are kept within this.
SURE = 12.0


def text_view(text: str | None) -> np.ndarray:
    """Byte shares (as square roots) and repetition of a whole text; zeros for null or empty text."""
    out = np.zeros(256 + 8)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out[:256] = np.sqrt(np.bincount(data, minlength=256) / len(data))
    words = text.split()
    n = len(words)
    if n:
        counts = Counter(words)
        lines = [x for x in text.split("\n") if x]
        alpha = sum(c for w, c in counts.items() if w.isalpha())
        out[256:] = (
            len(counts) / n, max(counts.values()) / n, np.log1p(n) / 10, np.log1p(len(text) / n), alpha / n,
            sum(c for w, c in counts.items() if not w[-1].isalnum()) / n, sum(c for w, c in counts.items() if w.isupper()) / n,
            len(set(lines)) / max(1, len(lines)),
        )
    return out


def meta_view(source: str | None, lang: str | None, chars: float | None) -> np.ndarray:
    """Length, hashed source and hashed language; nulls have buckets of their own."""
    out = np.zeros(2 + 2 * BUCKETS)
    size = np.log1p(max(0.0, chars)) if chars is not None and chars == chars else 0.0
    out[0], out[1] = size / 10, (size / 10) ** 2
    for k, value in enumerate((source, lang)):
        out[2 + k * BUCKETS + (zlib.crc32(f"={value}".encode()) % (BUCKETS - 1) + 1 if value is not None else 0)] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the bias last) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    s = np.ones(len(y)) if weight is None else weight
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = s * p * (1 - p) + 1e-9
        step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(keep), x.T @ (s * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    """Weights of both views, their calibration (slope, offset), and the weights of the calibrated views."""

    views: tuple[np.ndarray, np.ndarray]
    calibration: tuple[np.ndarray, np.ndarray]
    mix: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: combined probability, probability by text, probability by metadata."""
        odds = [np.clip(c[0] * _odds(x, w) + c[1], -SURE, SURE) for x, w, c in zip((text, meta), self.views, self.calibration)]
        z = np.stack([_odds(np.stack(odds, 1), self.mix), *odds], 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def co_train(
    text: np.ndarray, meta: np.ndarray, y: np.ndarray, free_text: np.ndarray, free_meta: np.ndarray,
    rounds: int = 4, share: float = 0.1, sure: float = 0.95,
) -> Model:
    """Two views of labelled rows and of unlabelled rows -> the combined model.

    Each round, a classifier labels for the other at most ``share`` of the unlabelled rows, those it is surest of, and only
    above ``sure``. Every fourth labelled row is kept for calibration. With one class of labels, all scores are that class.
    """
    views, free = (text, meta), (free_text, free_meta)
    if len(y) == 0 or y.min() == y.max():
        zero = tuple(np.zeros(x.shape[1] + 1) for x in views)
        odds = SURE if len(y) == 0 or y.max() == 1 else -SURE
        return Model(zero, (np.array([1.0, odds]),) * 2, np.array([1.0, 0.0, 0.0]))
    aside = np.arange(len(y)) % 4 == 3
    if len({*y[aside]}) < 2 or len({*y[~aside]}) < 2:
        aside = np.ones(len(y), bool)
        fitted = aside
    else:
        fitted = ~aside
    given = [np.full(len(free_text), -1.0), np.full(len(free_text), -1.0)]
    weights = [None, None]
    for turn in range(rounds + 1):
        for k in (0, 1):
            has = given[k] >= 0
            x = np.vstack([views[k][fitted], free[k][has]])
            labels = np.concatenate([y[fitted], given[k][has]])
            # A pseudo-label weighs half a label.
            weights[k] = logistic(x, labels, weight=np.concatenate([np.ones(fitted.sum()), np.full(has.sum(), 0.5)]))
        if turn == rounds or not len(free_text):
            break
        for k in (0, 1):
            p = 1 / (1 + np.exp(-np.clip(_odds(free[k], weights[k]), -30, 30)))
            certain = np.maximum(p, 1 - p)
            best = np.argsort(-certain, kind="stable")[: max(1, int(share * len(p) * (turn + 1)))]
            best = best[certain[best] >= sure]
            given[1 - k][best] = (p[best] >= 0.5).astype(float)
    calibration = []
    for k in (0, 1):
        a, b = logistic(_odds(views[k][aside], weights[k])[:, None], y[aside], 0.1)
        # A view that is no better than chance must not vote against its own order.
        calibration.append(np.array([max(a, 0.0), b]))
    odds = np.stack([np.clip(c[0] * _odds(x[aside], w) + c[1], -SURE, SURE) for x, w, c in zip(views, weights, calibration)], 1)
    return Model(tuple(weights), tuple(calibration), logistic(odds, y[aside], 0.1))


def _matrices(texts: list, sources: list, langs: list, chars: list) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.array([text_view(t) for t in texts]).reshape(len(texts), 264),
        np.array([meta_view(*x) for x in zip(sources, langs, chars)]).reshape(len(texts), 2 + 2 * BUCKETS),
    )


def _inputs(docs: DataFrame, text: str, source: str, lang: str, chars: str) -> DataFrame:
    return docs.withColumns({
        "__q_text": F.col(f"`{text}`").cast("string"), "__q_source": F.col(f"`{source}`").cast("string"),
        "__q_lang": F.col(f"`{lang}`").cast("string"), "__q_chars": F.col(f"`{chars}`").cast("double"),
    })


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", source: str = "source",
    lang: str = "lang", chars: str = "n_chars", sample: int = 3000, unlabelled: int = 1500, rounds: int = 4,
) -> Model:
    """Co-train on at most ``sample`` labelled and ``unlabelled`` other documents, those of the lowest id hashes.

    Views are computed where the documents lie; the driver gets numbers only, of a bounded count of rows. Rows with a null
    id teach nothing, nor do null labels.
    """
    i = F.col(f"`{doc_id}`")
    known = labels.where(i.isNotNull() & F.col(label).isNotNull()).select(i.alias("__q_id"), F.col(label).cast("double").alias("__q_y"))
    teach = known.orderBy(F.xxhash64("__q_id"), "__q_id", "__q_y").limit(sample)
    # Of all ids without a label, those of the lowest hash.
    some = docs.where(i.isNotNull()).select(i.alias("__q_id")).distinct().join(known.select("__q_id"), "__q_id", "left_anti")
    some = some.orderBy(F.xxhash64("__q_id"), "__q_id").limit(unlabelled).withColumn("__q_y", F.lit(-1.0))
    # Both sides are bounded by the parameters, so they may be broadcast.
    chosen = F.broadcast(teach.unionByName(some))
    rows = _inputs(docs, text, source, lang, chars).withColumn("__q_id", i).select("__q_id", "__q_text", "__q_source", "__q_lang", "__q_chars").join(chosen, "__q_id")

    def viewed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a, m = _matrices(b["__q_text"].tolist(), b["__q_source"].tolist(), b["__q_lang"].tolist(), b["__q_chars"].tolist())
            yield pd.DataFrame({"id": b["__q_id"], "y": b["__q_y"], "text": list(a), "meta": list(m)})

    found = rows.mapInPandas(viewed, "id bigint, y double, text array<double>, meta array<double>")
    found = found.orderBy(F.xxhash64("id"), "id", "y", F.hash("text")).limit(sample + unlabelled).toPandas()
    a = np.array(found["text"].tolist(), float).reshape(len(found), 264)
    m = np.array(found["meta"].tolist(), float).reshape(len(found), 2 + 2 * BUCKETS)
    y = found["y"].to_numpy(float)
    return co_train(a[y >= 0], m[y >= 0], y[y >= 0], a[y < 0], m[y < 0], rounds)


def score(
    docs: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang", chars: str = "n_chars",
) -> DataFrame:
    """Documents with ``quality_score``, ``text_score`` and ``meta_score``, each a probability; rows stay where they are.

    Null and empty texts have a text view of zeros, null metadata buckets of their own. Columns of these names are replaced.
    """

    def scored(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            p = model.score(*_matrices(*[c.to_pylist() for c in columns]))
            yield pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(3)], ["all", "text", "meta"])

    judged = F.arrow_udf(scored, "struct<all:double,text:double,meta:double>")
    return (
        _inputs(docs, text, source, lang, chars)
        .withColumn("__q", judged("__q_text", "__q_source", "__q_lang", "__q_chars"))
        .withColumns({"quality_score": F.col("__q.all"), "text_score": F.col("__q.text"), "meta_score": F.col("__q.meta")})
        .drop("__q", "__q_text", "__q_source", "__q_lang", "__q_chars")
    )
