"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


SETTINGS = {
    # Every log family is recorded in UTC.
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles a method above 8000 bytes of bytecode. The wide
    # parsing and counting stages exceed that as one generated method and would
    # run interpreted, about ten times slower; above this limit Spark splits
    # the stage into operators with small generated methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on or profit from."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for tables a job needs to keep between stages.

    A cluster names it in ``spark.checkpoint.dir``; only a local session
    without that setting gets a scratch folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
