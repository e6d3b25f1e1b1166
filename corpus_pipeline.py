"""From raw documents to token digests: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay; ``run`` writes every stage's result to the
shared folder and reads it again for the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm import line_dedup, mixing, near_dedup, quality
from logloom.llm.common import keep
from logloom.llm.queries import BOILERPLATE_PAGES, BOILERPLATE_RATIO, QUALITY_FLOOR, digests, vocabulary_path

#: Near copies in the pipeline. A pair of 80 % shares no region of 16 trees in 0.2 % of cases, of 24 trees in 0.007 %.
NEAR_PERCENT, NEAR_TREES = 80, 24


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the co-trained classifier rejects go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col("quality_score") >= QUALITY_FLOOR).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, documents stay; ``n_chars`` follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs, BOILERPLATE_RATIO, BOILERPLATE_PAGES)
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", chars).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one row of each document. Rows without an id all stay."""
    kept = near_dedup.near_dedup(docs, NEAR_PERCENT, trees=NEAR_TREES).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy("text", "source", "lang")
    rows = docs.join(kept, "doc_id", "left_semi").withColumn("__copy", F.row_number().over(one)).where("__copy = 1")
    return rows.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat(mixing.mix(docs)).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return digests(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("bpe encoding and decoding", bpe_stage),
]

#: Classifier, near-dedup and tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
