"""Spelling variants, periodic runs and the Jaccard join against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from logloom.llm import jaccard_join, runs, spelling  # noqa: E402
from logloom.llm import queries as llm_queries  # noqa: E402

#: Extra columns bear names that the operators use themselves.
SCHEMA = "doc_id long, text string, n long, node string, token string, component string, word string, runs string, id string"
SPACE = r"[\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    some = [" ".join(rng.choice(["The", "the", "réel", "word", "words", "sword", "tree", "trees", "three", "Éclair"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    base = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    for edits in (0, 0, 1, 1, 1, 2, 2, 3, 5, 9):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(100)] = f"new{rng.randrange(10**6)}"
        some.append(" ".join(copy))
    some += [" ".join(base).upper(), "\t".join(base), " ".join(base[:95]), " ".join(base[:85]), " ".join(base + base)]
    return [*some, None, "", " \n ", "one", "one two", "ONE  two", "a\x1cb c", "mot " * 3000, "ab " * 7 + "c " + "x y " * 5]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k * 3, t, 1, *["x"] * 6) for k, t in enumerate(texts)]
    rows += [rows[5], (None, texts[60], 1, *["x"] * 6), (None, None, None, *[None] * 6), (6, texts[62], 1, *["x"] * 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def as_table(monkeypatch):
    """Let a query read this frame."""
    return lambda df: monkeypatch.setattr(llm_queries, "read", lambda *_: df)


# Spelling variants


def near(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n: dict[str, int]) -> dict[str, tuple]:
    form, out = {}, {}
    for w in n:
        best = min(((-n[v], v) for v in n if near(w, v)), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], sum(near(w, v) for v in n), form[w], n.get(form[w]), root)
    return out


def test_pairs_of_an_acceptor():
    rng = random.Random(5)
    for _ in range(300):
        words = {"".join(rng.choice("abé") for _ in range(rng.randrange(7))) for _ in range(rng.randrange(60))}
        got = sorted(tuple(sorted(p)) for p in spelling.Acceptor(sorted(words)).pairs())
        assert got == sorted((a, b) for a in words for b in words if a < b and near(a, b))
    # Long words need no recursion.
    assert len(list(spelling.Acceptor(["a" * 5000, "a" * 5001]).pairs())) == 1
    # Words that end alike share their states.
    assert len(spelling.Acceptor([a + "ending" for a in "abcdefgh"]).arcs) < 8 * 7 + 2
    assert len({t for arcs in spelling.Acceptor([a + "ending" for a in "abcdefgh"]).arcs[:1] for t in arcs.values()}) == 1


@pytest.mark.parametrize("part_words", [1, 6, 4096])
def test_variants_of_a_vocabulary(spark, part_words):
    rng = random.Random(part_words)
    words = {"ab" * 2 + "".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(1, 6))) for _ in range(90)} | {"aaaaa", "aaaaaa", "aaaaaaa", "aaaabaa", "é" * 5, "é" * 6}
    n = {w: rng.choice([3, 4, 9, 20, 41, 100]) for w in words}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long").withColumn("root", F.lit("clash")), part_words).collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == plain_variants(n) and len(got) == len(n)


def test_spelling_query(spark, docs, empty, texts, as_table):
    counts = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    as_table(docs)
    got = llm_queries.op11_spelling_variants(spark, "").collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == plain_variants({w: c for w, c in counts.items() if len(w) >= 5 and c >= 3})
    as_table(empty)
    assert llm_queries.op11_spelling_variants(spark, "").count() == 0


# Periodic runs


def plain_runs(words: list, min_length: int, min_exponent: int) -> list[tuple]:
    found, n = set(), len(words)
    for q in range(1, n // min_exponent + 1):
        k = 0
        while k < n - q:
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            size = end + q - k
            if size >= max(min_length, min_exponent * q) and not any(all(words[t] == words[t + p] for t in range(k, k + size - p)) for p in range(1, q)):
                found.add((k, size, q))
            k = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_documents():
    rng = random.Random(1)
    for _ in range(400):
        batch = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.choice(rng.choice(["a", "ab", "abcd"])) for _ in range(rng.randrange(40))]
            if words and rng.random() < 0.5:
                a = rng.randrange(len(words))
                p = 1 + (len(words) - a) // rng.randint(2, 8)
                words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            batch.append(words)
        for args in ((6, 4), (2, 2)):
            got = [[(r["start"], r["length"], r["period"]) for r in own] for own, _ in runs._documents([" ".join(w).encode() for w in batch], *args)]
            assert got == [plain_runs(w, *args) for w in batch]


def test_suffix_array_of_lcps():
    rng = np.random.default_rng(2)
    symbols = np.append(rng.integers(0, 3, 200), 9)
    order, place, shared = runs.suffix_array(symbols)
    assert (place[order] == np.arange(201)).all()
    for k in range(1, 201):
        a, b = symbols[order[k - 1] :].tolist(), symbols[order[k] :].tolist()
        same = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
        assert a < b and shared[k] == same


def test_runs_query(spark, docs, empty, as_table):
    as_table(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, planted = [], 0
    for r in docs.collect():
        words = [w for w in re.split(SPACE, r["text"] or "") if w]
        n, h = len(words), None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)], planted + 1
        own = plain_runs(words, 6, 4)
        best = min(own, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lost = {k for s, size, q in own for k in range(s + q, s + size)}
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want.append((r["doc_id"], len(own), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in own)), sha(" ".join(w for k, w in enumerate(words) if k not in lost))))
    got = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in llm_queries.op12_periodic_runs(spark, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and planted > 3 and sum(r[1] > 0 for r in want) > 3
    as_table(empty)
    assert llm_queries.op12_periodic_runs(spark, "").count() == 0


# Jaccard join


def plain_join(rows: list[tuple], percent: int, size: int) -> list[tuple]:
    """(id, number of shingles, component) of every row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = [w for w in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                known = rows[a][0] is not None and rows[b][0] is not None and both
                if known and (rows[a][0] == rows[b][0] or 100 * both >= percent * len(sets[a] | sets[b])):
                    label[a] = label[b] = min(label[a], label[b])
    ids = {k: min(rows[j][0] for j in range(len(rows)) if label[j] == label[k]) if rows[k][0] is not None else None for k in range(len(rows))}
    return sorted(str((i, len(s), ids[k])) for k, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("percent", [90, 80])
def test_jaccard_join(docs, empty, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard_join.jaccard_join(docs, percent).collect()]
    assert sorted(got) == plain_join(rows, percent, 3)
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_jaccard_join_of_copies_without_a_centre(spark):
    """Copies edited apart from each other, chains of copies, and a passage that many documents hold."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(120)], []
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(120)] = word()
        rows.append(" ".join(copy))
    chain = [word() for _ in range(80)]
    for _ in range(20):
        chain = [*chain[2:], word(), word()]
        rows.append(" ".join(chain))
    passage = [word() for _ in range(40)]
    rows += [" ".join(passage + [word() for _ in range(rng.randint(1, 30))]) for _ in range(40)]
    rng.shuffle(rows)
    table = [(100 + k, t) for k, t in enumerate(rows)]
    got = [str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard_join.jaccard_join(spark.createDataFrame(table, "doc_id long, text string"), 90).collect()]
    assert sorted(got) == plain_join(table, 90, 3)


def test_prefixes_adapt(spark):
    """Sets behind a shingle of many ask for more shared shingles than sets behind rare ones."""
    sets = [(k, 20, list(range(1000, 1020))) for k in range(2)] + [(100 + k, 20, [*range(-19, 0), -100 - k // 2]) for k in range(30)]
    got = jaccard_join.prefixes(spark.createDataFrame(sets, "node long, n long, tokens array<long>"), 80).groupBy("node").agg(F.max("l").alias("l"), F.count("*").alias("k")).collect()
    taken = {r["node"]: r["l"] for r in got}
    assert taken[0] < taken[100] and len(got) == 32
