"""What the operators share: word and gap patterns, tables in the shared folder, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import shared_dir

#: White space is these six bytes everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Spark removes a write's shuffle files when it ends, not when the driver's next garbage collection gets to them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, alone: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs a read.

    Each call has a folder of its own, so reruns never meet. The folder belongs to the job, as checkpoints do. ``alone``
    says that the frame is used for this write only, so that its shuffle files can go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true" if alone else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Delete tables of :func:`keep` that no later step reads."""
    for df in kept:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = hadoop.Path(df.sparkSession._jvm.java.net.URI(folder))
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def spaced(text: Column) -> Column:
    """The text with every gap as one space; nothing is trimmed."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(column: Column) -> Column:
    """A text key that is never null: two columns have the same key if both are null or they are equal."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))
