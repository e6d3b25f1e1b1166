"""The operators against plain versions, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from logloom.llm import ann, bpe, exact_dedup, graph, line_dedup, lm_scoring, mixing, near_dedup, quality, substring_dedup, toxicity  # noqa: E402
from logloom.llm import queries as llm_queries  # noqa: E402
from logloom.llm.common import discard, keep  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, ids string, label string"
SF = "/root/testdata/sf0.001"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("ab") + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base.upper(), base.replace(" ", "\t\n"), " ".join(near), "tail " + words(rng, 30) + " " + " ".join(base.split()[:70]),
        None, "", " \n ", "one two", "one two", "é ß Σ ΑΣ <|endoftext|> don't 3.14", "long " * 30_000, words(rng, 300), "a\x00b \x1c c",
    ]
    rows = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", None if k == 3 else len(t or ""), "x", "y", "z") for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, "en", "s1", 1, "x", "y", "z"), (None, None, None, None, None, None, None, None), (7, "other version", "en", "s1", 1, "x", "y", "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_mixing(docs, empty):
    out = rows_of(mixing.mix(docs))
    assert len(out) == docs.count() and mixing.mix(empty).count() == 0
    assert sorted(map(str, out)) == sorted(map(str, rows_of(mixing.mix(docs))))
    sizes, sources = Counter(), {}
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [3, 1, 2] * len(sizes)))
    left, open_, total = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:  # deal by weight, clamp, deal again
        level = left / max(1e-9, sum(weight[s] for s in open_))
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        total |= {s: 2.0 * sizes[s] for s in over}
        left, open_ = left - sum(2 * sizes[s] for s in over), open_ - over
    total |= {s: level * weight[s] for s in open_}
    for r in out:
        assert r["target"] == pytest.approx(total[r["source"]]) and r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        sources[r["source"]] = sources.get(r["source"], 0) + r["taken"]
    assert mixing.repeat(mixing.mix(docs)).count() == sum(r["repeats"] for r in out)


def test_line_dedup(spark, docs, empty):
    pages = [(k, f"menu\nbody {k}\n menu \n\nend", None if k < 10 else "h") for k in range(20)] + [(20, "menu", "lone"), (21, None, "h"), (22, "", "h")]
    df = spark.createDataFrame(pages, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: r for r in rows_of(line_dedup.drop_boilerplate(df, 0.5, 5))}
    # "end" is boilerplate as well as "menu"; the blank line stays.
    assert got[3]["text"] == "body 3\n" and got[15]["n_dropped"] == 3 and got[15]["n_lines"] == 5
    assert got[20]["text"] == "menu" and got[21]["text"] is None and got[22]["text"] == "" and got[22]["n_lines"] == 1
    assert line_dedup.drop_boilerplate(docs).count() == docs.count() and line_dedup.drop_boilerplate(empty).count() == 0


def test_exact_dedup(docs, empty):
    def digest(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    groups = {}
    for r in docs.collect():
        groups.setdefault(digest(r["text"]), []).append(r["doc_id"])
    expected = sorted(
        (str(i), str(min((x for x in g if x is not None), default=None)), len(g), i == min((x for x in g if x is not None), default=None)) for g in groups.values() for i in g
    )
    # Tiny primes make different texts meet in one fingerprint; tiny chunks make many of them.
    for args in ({}, {"chunk_bytes": 7}, {"primes": (3, 5), "chunk_bytes": 64}):
        got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in rows_of(exact_dedup.exact_dedup(docs, **args)))
        assert got == expected
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_fingerprints_of_parts(spark):
    text = bytes(random.Random(1).randrange(256) for _ in range(5000))
    rows = [(f"cut{n}", k, text[k : k + n]) for n in (5000, 999, 64) for k in range(0, 5000, n)] + [("other", 0, text[1:]), ("null", 0, None)]
    parts = spark.createDataFrame(rows, "name string, at int, data binary").repartition(5)
    got = {r["name"]: (r["n"], r["h1"], r["h2"]) for r in exact_dedup.fingerprint_parts(parts, ["name"], "at", "data", chunk_bytes=100).collect()}
    assert got["cut5000"] == got["cut999"] == got["cut64"] != got["other"] and got["null"] == (0, 0, 0)
    h = 0
    for b in text:
        h = (h * exact_dedup.BASES[0] + b) % exact_dedup.PRIMES[0]
    assert got["cut64"][1] == h


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[129] == 100 and got[201] == 200


def test_components_of_a_dense_group_keep_links_in_proportion_to_its_ids(spark, monkeypatch):
    """1,830 links between 61 ids in 3 tasks, and a chain through them: at most 2 rows a kept link, 60 kept links a task of the group."""
    kept, keep = {}, graph.keep
    monkeypatch.setattr(graph, "keep", lambda df, name: kept.setdefault(name, keep(df, name)) if name == "edges" else keep(df, name))
    links = [(a, b) for a in range(1000, 1061) for b in range(a + 1, 1061)] + [(k, k + 1) for k in range(1060, 1070)] + [(5, None), (6, 6)]
    random.Random(3).shuffle(links)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {k: 1000 for k in range(1000, 1071)}
    assert kept["edges"].count() <= 2 * (3 * 60 + 10)


def test_near_dedup(docs, empty):
    got = {}
    for r in rows_of(near_dedup.near_dedup(docs)):
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == docs.count() and near_dedup.near_dedup(empty).count() == 0
    assert {r["component_id"] for k in (0, 1, 2, 3) for r in got[k]} == {0}
    assert all(got[k][0]["n_shingles"] == 0 and got[k][0]["kept"] for k in (5, 6)) and got[9][0]["component_id"] == 8
    assert all(r["component_id"] is None and r["kept"] for r in got[None]) and not got[1][0]["kept"] and len(got[0]) == 3


def test_near_dedup_is_brute_force_in_a_dense_region(spark):
    rng = random.Random(5)
    base, texts = words(rng, 150).split(), []
    for _ in range(120):
        one = list(base if not texts else rng.choice(texts))
        for _ in range(rng.randrange(1, 4)):
            one[rng.randrange(len(one))] = f"w{rng.randrange(9999)}"
        texts.append(one)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df).collect()}
    assert [got[k] for k in range(len(sets))] == label


def template_region(n: int, seed: int) -> list[list[str]]:
    """Texts below 85 % of each other, mostly at 80 %; every tenth shares three changes with the text before, which makes it 86 %."""
    rng = random.Random(seed)
    base, texts, last = words(rng, 800).split(), [], {}
    for k in range(n):
        changes = {p: f"w{k}_{p}" for p in rng.sample(range(5, 795), 9)}
        if k % 10 == 9:
            changes = dict([*list(last.items())[:3], *list(changes.items())[3:]])
        texts.append([changes.get(p, w) for p, w in enumerate(base)])
        last = changes
    rng.shuffle(texts)
    return texts


def plain_components(texts: list[list[str]], percent: int) -> list[int]:
    codes: dict = {}
    sets = [{codes.setdefault(tuple(t[k : k + 5]), len(codes)) for k in range(len(t) - 4)} for t in texts]
    grid = np.zeros((len(sets), len(codes)), np.float32)
    for k, s in enumerate(sets):
        grid[k, list(s)] = 1
    both, size = grid @ grid.T, grid.sum(1)
    linked, label = 100 * both >= percent * (size[:, None] + size[None] - both), np.arange(len(sets))
    while True:
        low = np.where(linked, label[None], len(sets)).min(1)
        if (low == label).all():
            return label.tolist()
        label = low


def test_near_dedup_compares_whole_regions(spark, monkeypatch):
    # A reach that is small beside the region, as a large region has it; and several blocks.
    for name, n in (("NEAR_ROWS", 1), ("FAR_ROWS", 2), ("BLOCK_ROWS", 60)):
        monkeypatch.setattr(near_dedup, name, n, raising=False)
    texts = template_region(400, 8)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df).collect()}
    assert [got[k] for k in range(len(texts))] == plain_components(texts, 85)


def test_compact_windows():
    rng = np.random.default_rng(2)
    for h in (rng.integers(0, 50, 60).astype(np.uint64), np.zeros(30, np.uint64), rng.integers(0, 1 << 60, 200).astype(np.uint64)):
        found = substring_dedup.compact_windows(h, 8)
        for lo in range(len(h) - 7):
            for hi in range(lo + 8, len(h) + 1, 5):
                assert any(a <= lo and hi <= b and h[p] == h[lo:hi].min() for a, p, b in found)


def test_longest_stretch():
    rng = np.random.default_rng(1)
    for n in range(60):
        inside = rng.random(n) < 0.5 + 0.5 * rng.random()
        value = np.where(inside, 1, -substring_dedup.MISS)
        spans = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if value[a:b].sum() >= 0]
        a, b = max(spans, key=lambda s: (s[1] - s[0], -s[0]), default=(0, 0))
        while a < b and not (inside[a] and inside[b - 1]):
            a, b = a + (not inside[a]), b - (not inside[b - 1])
        got = substring_dedup.longest_stretch(inside)
        assert got == (a, b) or got[0] == got[1] and a >= b


@pytest.mark.parametrize("edit", ["replaced", "inserted", "deleted"])
def test_substring_dedup_finds_edited_passages(spark, edit):
    rng = random.Random(edit)
    word = lambda: f"w{rng.randrange(10**6)}"
    around = lambda: [word() for _ in range(80)]
    rows, planted = [], {}
    for n in (60, 75, 90):
        for k in range(20):
            passage = [word() for _ in range(n)]
            other, at = list(passage), n // 2 if k % 2 else rng.randrange(10, n - 10)
            other[at : at + (edit != "inserted")] = [] if edit == "deleted" else [word()]
            for p in (passage, other):
                rows.append((len(rows), " ".join(around() + p + around())))
            planted[len(rows) - 1] = (len(rows) - 2, n)
    # Documents that share less: 40 words, and 60 words with every tenth one changed.
    passage = [word() for _ in range(60)]
    for p in (passage[:40], [word() if k % 10 == 9 else w for k, w in enumerate(passage)]):
        rows.append((len(rows), " ".join(around() + p + around())))
    got = rows_of(substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert all(planted.get(r["doc_id"], (None,))[0] == r["match_id"] and r["percent"] >= 80 for r in got)
    # Where a changed shingle is a minimum, the windows of that hash function end there: three functions may all be hit.
    assert len({r["doc_id"] for r in got}) >= 0.95 * len(planted)


def test_substring_dedup(docs, empty):
    got = rows_of(substring_dedup.shared_passages(docs))
    # Document 4 ends with the first 70 words of document 0.
    hit = [r for r in got if r["doc_id"] == 4 and r["match_id"] == 0]
    assert hit and hit[0]["start_word"] == 31 and hit[0]["n_words"] == 70 and hit[0]["match_start"] == 0 and hit[0]["percent"] == 100.0
    assert {r["doc_id"] for r in got} | {r["match_id"] for r in got} == {0, 1, 2, 3, 4}
    assert substring_dedup.shared_passages(empty).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 16)).astype(np.float32)
    vectors[100:400] = vectors[100]  # a very common vector
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (None, [1.0] * 16), (1005, [1.0, 2.0]), (0, vectors[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.nearest_neighbours(df, df.where("vec_id % 100 = 0"), 10, shard_rows=200).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(1))
        best = sorted((x, i) for i, x in enumerate(d) if i != q)[:10]
        hits += len({i for _, i in best} & {i for i, _ in got[q].values()})
        assert sorted(got[q]) == list(range(1, 11)) and all(s == pytest.approx(d[i]) for i, s in got[q].values())
        assert list(got[q].values()) == sorted(got[q].values(), key=lambda x: (x[1], x[0]))
    assert hits >= 0.9 * 90 and set(got) == set(range(0, 900, 100))
    assert ann.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_blocks_of_queries_meet_all_shards_without_copies_of_them(spark):
    """A broadcast of the blocks' copies for all shards would pass through the driver; shuffles of pairs grow with their number."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(600, 8)))], "vec_id long, embedding array<float>")
    both = df.unionByName(df.where("vec_id < 50").select((F.col("vec_id") + 1000).alias("vec_id"), F.slice("embedding", 1, 5).alias("embedding")))
    usable = ann.usable(both)
    out = ann.search(ann.build_index(usable, 5, shard_rows=100), usable.distinct(), 5, block_queries=64)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "block" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    got = out.collect()
    assert len(got) == 650 * 5 and all((r["query_id"] < 1000) == (r["vec_id"] < 1000) for r in got)


def test_neighbours_at_one_distance_are_ordered_by_id(spark):
    """More vectors lie at the tenth place's distance than an answer, and than a beam, holds; a clashing column does no harm."""
    for ties, size in ((30, 32), (150, 160)):
        rows = [(0, [1.0] * size)] + [(k, [1.0 + (j == k) for j in range(size)]) for k in range(ties, 0, -1)]
        rows += [(500 + k, [1.0 + 0.5 * (j == k) for j in range(size)]) for k in range(1, 4)]
        df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "vec_id long, embedding array<float>, shard int").repartition(2)
        got = ann.nearest_neighbours(df, df.where("vec_id = 0"), 10).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == [501, 502, 503, 1, 2, 3, 4, 5, 6, 7] and [r["score"] for r in got] == [0.5] * 3 + [1.0] * 7


def plain_backoff(texts, order=3, min_count=1):
    """Sums and scored words per id, the branches taken, by counts with each row's own taken off."""
    count = lambda rows, n: Counter(g for t in rows for g in zip(*(t[k:] for k in range(n))))
    everything = [count([t for _, t in texts], n) for n in (1, 2, 3)]
    score, pairs, branches = Counter(), Counter(), Counter()
    for i, t in texts:
        one, two, three = ({g: everything[n - 1][g] - c for g, c in count([t], n).items()} for n in (1, 2, 3))
        total = sum(everything[0].values()) - len(t)
        for k in range(1, len(t)):
            grams, s = [(three, two, t[k - 2 : k + 1])] if order > 2 and k > 1 else [], 1.0
            for table, context, gram in [*grams, (two, one, t[k - 1 : k + 1]), (None, None, t[k : k + 1])]:
                gram = tuple(gram)
                if table is None:
                    s *= max(one[gram], 0.5) / max(total, 1)
                elif table[gram] >= min_count:
                    s *= table[gram] / context[gram[:-1]]
                else:
                    s *= 0.4
                    continue
                branches[len(gram), one[gram[-1:]] > 0] += 1
                break
            score[i] += np.log(s)
            pairs[i] += 1
    return score, pairs, branches


@pytest.mark.parametrize("order, min_count", [(3, 1), (3, 2), (2, 1)])
def test_lm_scoring(docs, empty, order, min_count):
    out = {r["doc_id"]: r for r in rows_of(lm_scoring.stupid_backoff(docs, min_count, order=order))}
    texts = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    score, pairs, _ = plain_backoff(texts, order, min_count)
    for i, r in out.items():
        assert r["n_pairs"] == pairs[i] and r["log_score"] == pytest.approx(score[i]) and (r["perplexity"] is None) == (pairs[i] == 0)
    assert set(out) == {i for i, _ in texts} and lm_scoring.stupid_backoff(empty).count() == 0


def test_lm_scoring_in_many_blocks(spark, monkeypatch):
    """Counts of blocks and buckets add up, also those of repeated rows and ids, and only the scores stay on disk."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 400)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 900)
    kept = []
    monkeypatch.setattr(lm_scoring, "keep", lambda df, name, **more: kept.append((name, keep(df, name, **more))) or kept[-1][1])
    rng = random.Random(4)
    texts = [(k % 50, [f"w{int(rng.random() ** 3 * 40)}" for _ in range(rng.choice([0, 1, 2, 3, 40, 90]))]) for k in range(60)]
    texts += texts[:3] + [texts[5]] * 20
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts] + [(70, None), (None, "w1 w2 w3")], "doc_id long, text string").repartition(5)
    score, pairs, branches = plain_backoff([*texts, (70, []), (None, ["w1", "w2", "w3"])])
    assert {(3, True), (2, True), (1, True)} <= set(branches)
    out = {r["doc_id"]: r for r in rows_of(lm_scoring.stupid_backoff(df))}
    assert set(out) == {i for i, _ in texts} | {70, None}
    assert all(r["n_pairs"] == pairs[k] and r["log_score"] == pytest.approx(score[k]) for k, r in out.items())
    assert [name for name, df in kept if os.path.exists(df.inputFiles()[0].removeprefix("file://"))] == ["scores"]


def test_kept_tables_leave_no_shuffle_files(spark):
    def shuffle_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files))
        return {n for n in names if n.startswith("shuffle_")}

    setting, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files()
    set_to = spark.conf.get(setting)
    df = spark.range(100000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("n")).groupBy("k").agg(F.sum("n").alias("n"))
    kept = keep(df, "sums", alone=True)
    for _ in range(100):  # the files are removed in the background
        if not shuffle_files() - before:
            break
        time.sleep(0.1)
    assert not shuffle_files() - before and spark.conf.get(setting) == set_to
    file = kept.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 100000 and os.path.exists(file)
    discard(kept)
    assert not os.path.exists(file)


def test_lm_scoring_counts_every_word(spark, tmp_path):
    rng = random.Random(6)
    # More distinct words than any fixed vocabulary: half of them rare. The last but three is made of words seen nowhere else.
    texts = [[f"r{k}_{p}" if rng.random() < 0.5 else f"c{rng.randrange(20)}" for p in range(200)] for k in range(400)]
    texts += [[f"x{p}" for p in range(8)], ["lone"], ["r0_1", "r0_1"], ["c1", "c2", "c3"] * 50]
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score, pairs, branches = plain_backoff(list(enumerate(texts)))
    assert {(3, True), (2, True), (1, True), (1, False)} <= set(branches)
    out = {r["doc_id"]: r for r in rows_of(llm_queries.op8_lm_scoring(spark, str(tmp_path)))}
    assert set(out) == set(range(len(texts)))
    assert all(r["n_pairs"] == pairs[k] and r["log_score"] == pytest.approx(score[k]) for k, r in out.items())
    assert max((r["perplexity"], k) for k, r in out.items() if r["perplexity"] is not None)[1] == 400


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = llm_queries.vocabulary_path()
    plain = Tokenizer.from_file(path)
    plain.no_truncation()
    for r in rows_of(bpe.recode(docs, path).unionByName(bpe.decode(bpe.encode(docs, path), path))):
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == plain.decode(ids, skip_special_tokens=False) and r["size"] in ("x", None)
    assert bpe.recode(empty, path).count() == 0
    encoder = bpe.Encoder(path)
    long = ["a" * 500, "!?" * 200, "tion" * 300 + "é", "日本語" * 90, "ſ K Å ǅ ŉ ẞ", "́ x\x85y"]
    assert encoder.encode(long) == [x.ids for x in plain.encode_batch(long, add_special_tokens=False)]
    digest = rows_of(llm_queries.digests(docs.where("doc_id = 5"), path))[0]
    assert digest["n_tokens"] == 0 and digest["ids_sha256"] == digest["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_toxicity(spark, docs, empty):
    rng = random.Random(9)
    rows = [(k, ". ".join(words(rng, 8) + (" vile" if k % 7 == 0 and s == 3 else "") for s in range(6))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 7 == 0), 1) for k in range(200)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(df, labels)
    out = rows_of(toxicity.score(df, model))
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 7 == 0) for r in out)
    assert all([s["sentence"] for s in r["offending"]] == [3] for r in out if r["doc_id"] % 7 == 0)
    plain = toxicity.score_frame([r["text"] for r in out], model)
    assert np.allclose(plain, [r["score"] for r in out])
    odd = rows_of(toxicity.score(docs, model))
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd) and all(r["score"] == 0 for r in odd if not r["text"])
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(4)
    rows = [(k, words(rng, 60) if k % 5 else " ".join(w + "%%%" for w in words(rng, 60).split()), "en", f"s{k % 3}", 100) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = rows_of(quality.score(df, quality.train(df, labels)))
    assert np.mean([(r["quality_score"] >= 0.5) == (r["doc_id"] % 5 > 0) for r in out if r["doc_id"] >= 200]) > 0.97
    odd = rows_of(quality.score(docs, quality.train(docs, labels)))
    assert len(odd) == docs.count() and all(0 <= r["quality_score"] <= 1 for r in odd)
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_quality_pool_is_of_all_unlabelled(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"text {k}", "en", "s", k) for k in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    ids = [r["doc_id"] for r in df.orderBy(F.xxhash64("doc_id")).collect()]
    # All but the 20 highest hashes have labels.
    labels = spark.createDataFrame([(k, k % 2) for k in ids[:280]], "doc_id long, quality int")
    monkeypatch.setattr(quality, "co_train", lambda text, meta, y, free_text, free_meta, rounds: free_meta)
    got = quality.train(df, labels, unlabelled=10)
    expected = np.array([quality.meta_view("s", "en", float(k)) for k in ids[280:290]])
    assert got.shape == expected.shape and (got == expected).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = llm_queries.op9_toxicity(spark, sf).where("held_out").join(labels, "doc_id").selectExpr("avg(int(predicted = toxic)) AS a").first()["a"]
    assert got > 0.97


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    rows, columns = docs.select("doc_id", "text", "lang", "source", "n_chars"), ["doc_id", "text", "lang", "source", "n_chars"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        if k == 2:
            ids = [r["doc_id"] for r in out.collect()]
            assert ids.count(0) == 1 and not {1, 2, 3} & set(ids) and ids.count(None) == 2
        assert stage(spark, rows.limit(0), SF).count() == 0


def test_pipeline_drops_near_copies_of_80_percent(spark):
    import corpus_pipeline

    base = words(random.Random(12), 200).split()
    # 196 shingles; 4 changed words leave 176 of 216 (81 %), 5 leave 171 of 221 (77 %).
    texts = [base, [f"x{p}" if p in (20, 60, 100, 140) else w for p, w in enumerate(base)], [f"y{p}" if p in (30, 70, 110, 150, 180) else w for p, w in enumerate(base)]]
    df = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, SF).collect()) == [0, 2]


def test_sql_twins(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
    import duckdb
    from check_oracle import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in llm_queries.oracle_sql().items():
        text, _, fine = compare(spark, con, name, llm_queries.queries()[name], sql, SF)
        assert fine, text


def test_substring_dedup_meets_the_next_id_where_the_smallest_shares_too_little(spark):
    """Documents 1 and 2 hold a passage, document 0 holds it with an early word changed, or only 30 or 40 words of it."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    around = lambda n: [word() for _ in range(n)]
    rows, sharing = [], []
    for n in (50, 52, 60):
        for k in range(20):
            passage = around(n)
            first = passage[:3] + [word()] + passage[4:50] if k % 2 else passage[k // 2 : k // 2 + (30 if k % 4 else 40)]
            for p in (first, passage, passage):
                rows.append((len(rows), " ".join(around(60) + p + around(60))))
            sharing.append((len(rows) - 1, len(rows) - 2))
    # The same words many times over are one place; a text's stretches are told apart wherever they lie.
    rows += [(len(rows), "la " * 5000), (len(rows) + 1, "la " * 70)]
    got = rows_of(substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {(r["doc_id"], r["match_id"]) for r in got} >= {*sharing, (len(rows) - 1, len(rows) - 2)}


def test_stretches_have_one_hash_wherever_they_lie():
    s = np.arange(1, 300, dtype=np.uint64) % 100
    part = substring_dedup._Stretches(s)
    a, b, c = part(np.array([10, 110, 11]), np.array([60, 160, 61]))
    assert a == b != c and part.powers.dtype == np.uint64


def test_substring_dedup_compares_each_surroundings_once():
    rng = np.random.default_rng(23)
    of = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    line, width = of(7), 46

    def agreement(x, y, at, q):
        forward = next((k for k in range(width) if at + k >= len(x) or q + k >= len(y) or x[at + k] != y[q + k]), width)
        back = next((k for k in range(width) if k > at or k > q or x[at - k] != y[q - k]), width)
        return forward + back

    x = np.concatenate([of(20), *[line] * 30, of(60), line, of(9)])
    y = np.concatenate([of(5), *[line] * 12, x[225:260], *[line] * 400, of(30)])
    a, b = substring_dedup._Text(x, width), substring_dedup._Text(y, width)
    at = np.flatnonzero(np.isin(x, y))
    got = substring_dedup.counterparts(a, b, at, np.searchsorted(b.numbers()[0], x[at]))
    for i, q in zip(at.tolist(), got.tolist()):
        places = np.flatnonzero(y == x[i]).tolist()
        best = max(agreement(x, y, i, p) for p in places)
        assert q == next(p for p in places if agreement(x, y, i, p) == best)
    # A line that comes 400 times is looked at from its ends and once inside.
    assert len(b.places()[0]) < 400 < len(y) // 7

    text = np.where(np.arange(len(x)) % 11 == 5, 0, x)
    codes = (np.arange(len(x)) * 3).tolist()
    inside = np.isin(text, y)
    before = substring_dedup.coverable(inside, width)
    for lo in range(0, len(x) - width, 13):
        start, stop = substring_dedup.longest_stretch(inside[lo:])
        assert stop - start < width or before[-1] - before[lo] >= width
    whole = substring_dedup._Text(y[:400], width)
    assert (0, 400, 0, 400, 100.0) in substring_dedup._passages(whole, whole, codes, 50, 80, 3)
