"""The registered query of each operator, and SQL twins where SQL can express one."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import (
    ann, bpe, exact_dedup, jaccard_join, line_dedup, lm_scoring, mixing, near_dedup, quality, runs, spelling, substring_dedup, toxicity,
)
from logloom.llm.common import GAP, ascii_lower, spaced, text_or_empty

WORD_SQL = r"[^\x20\x09-\x0D]+"
GAP_SQL = r"[\x20\x09-\x0D]+"
#: Documents below this quality are rejected: surely junk only.
QUALITY_FLOOR = 0.5
TOXIC_FROM = 0.7
NEAR_PERCENT = 85
NEIGHBOURS = 10
BOILERPLATE_RATIO, BOILERPLATE_PAGES = 0.1, 5
VOCABULARY_FILE = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY_FILE)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "epochs", F.col("repeats").cast("long").alias("repeats"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(read(spark, sf_dir, "documents"), BOILERPLATE_RATIO, BOILERPLATE_PAGES)
    return out.select(
        "doc_id", "source", "n_lines", "n_dropped", F.length("text").cast("long").alias("chars_left"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", "quality_score", "text_score", "meta_score", (F.col("quality_score") >= QUALITY_FLOOR).alias("kept"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.encode(spaced(text_or_empty("text")), "UTF-8"), 256)
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), carry={"text_sha256": digest})


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(read(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), NEIGHBOURS)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), NEAR_PERCENT)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.stupid_backoff(read(spark, sf_dir, "documents"), min_count=1, order=3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    third = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    model = toxicity.train(docs, labels.where(third != 1))
    return toxicity.score(docs, model).select(
        "doc_id", (third == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.transform("offending", lambda s: s["sentence"]).alias("offending_sentences"),
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Ids and decoded text of encoded documents as digests."""
    return bpe.recode(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


#: A spelling is a run of letters; one of ``SPELLING_EVERY`` (by hash of document and run) loses a code point first.
LETTERS = "[A-Za-z\u00C0-\u00FF]+"
SPELLING_EVERY = 97
JOIN_PERCENT = 90


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    # A word is never longer than its run.
    low = found.where(F.char_length("run") >= spelling.MIN_POINTS).select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr(F.col("run"), F.lit(1), place), F.substr(F.col("run"), place + 2))
    words = hashed.select(F.when(F.col("h") % SPELLING_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.vocabulary(words)).select("word", "n", "n_near", "form", "form_n", "root")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten (by hash of its id) the words from some place on repeat the first few there."""
    words = F.filter(F.split(F.col("text"), GAP), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.expr("g % nullif(n, 0)"))
    left = F.col("n") - F.col("a")
    rows = rows.withColumn("p", F.floor(left / (F.col("g") % 8 + 3)) + 1)
    start, period, left = F.col("a").cast("int"), F.col("p").cast("int"), left.cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", start + 1, period), F.ceil(left / period).cast("int"))), F.lit(1), left)
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), start), tail), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(repeated_tails(read(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("o"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("best", best)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    length = -F.col("best.o")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.expr("best.o * -1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"), JOIN_PERCENT)


MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             2.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
v AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap, coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight, cap)) AS target FROM v),
j AS (SELECT d.doc_id, d.size, d.draw, d.draw % 256 AS salt, t.source, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, row_number() OVER (PARTITION BY source, salt ORDER BY size, draw, doc_id) AS turn,
             (salt * 0.6180339887498949::DOUBLE + 10.506577808748213::DOUBLE) - floor(salt * 0.6180339887498949::DOUBLE + 10.506577808748213::DOUBLE) AS start,
             epochs - floor(epochs) AS part FROM j),
k AS (SELECT *, (floor(epochs) + floor(turn * part + start) - floor((turn - 1) * part + start))::BIGINT AS repeats FROM r)
SELECT doc_id, size, source_size, target, size * repeats AS taken, source, epochs, repeats FROM k
"""

LINES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, source, lines[i] AS line, regexp_replace(lines[i], '^{GAP_SQL}|{GAP_SQL}$', '', 'g') AS bare, i
      FROM (SELECT r, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
p AS (SELECT source, bare, count(DISTINCT r) AS pages FROM l WHERE bare <> '' GROUP BY source, bare),
h AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
b AS (SELECT p.source, p.bare FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source WHERE pages >= {BOILERPLATE_PAGES} AND pages > {BOILERPLATE_RATIO} * host_pages),
k AS (SELECT l.r, l.i, l.line, b.bare IS NOT NULL AS lost FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare),
g AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE lost) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '') AS cleaned FROM k GROUP BY r)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN 0 ELSE g.n END AS n_lines, g.n_dropped,
       CASE WHEN d.text IS NOT NULL THEN length(g.cleaned) END AS chars_left, CASE WHEN d.text IS NOT NULL THEN sha256(g.cleaned) END AS text_sha256
FROM d JOIN g ON d.r = g.r
"""

EXACT_SQL = rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{GAP_SQL}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d
"""

#: crc32 by its table of 256 values, which follows from the polynomial 0xEDB88320 (3988292384).
SPELLING_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || [0::BIGINT for k in range(8)], lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
    FROM range(256) r(i))),
low AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
d AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS x FROM low WHERE length(run) >= {spelling.MIN_POINTS} GROUP BY id, run),
h AS (
  SELECT run, c, xor(list_reduce([4294967295] || [('0x' || substr(x, 2 * k + 1, 2))::BIGINT for k in range(length(x) // 2)],
                                 lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])), 4294967295) AS h FROM d, t),
w AS (SELECT CASE WHEN h % {SPELLING_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= {spelling.MIN_POINTS} GROUP BY word HAVING sum(c) >= {spelling.MIN_COUNT}),
cuts AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS k FROM v)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.k = b.k AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cuts c JOIN v ON c.cut = v.word
  UNION SELECT v.word, c.word, c.n FROM cuts c JOIN v ON c.cut = v.word),
best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best, max(near_n) AS near_n FROM near GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * n THEN best[2] END AS form,
         CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
chain AS (
  SELECT word, word AS last, 0 AS steps FROM f
  UNION ALL SELECT chain.word, f.form, steps + 1 FROM chain JOIN f ON chain.last = f.word WHERE f.form IS NOT NULL)
SELECT f.*, r.root FROM f JOIN (SELECT word, max_by(last, steps) AS root FROM chain GROUP BY word) r ON f.word = r.word
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # Imported here: the pipeline is made of this package's operators.
    import corpus_pipeline

    named = {name: f for name, f in vars(sys.modules[__name__]).items() if name.startswith("op") and callable(f)}
    return dict(sorted(named.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIX_SQL, "op2_line_dedup": LINES_SQL, "op4_exact_dedup": EXACT_SQL, "op11_spelling_variants": SPELLING_SQL}
