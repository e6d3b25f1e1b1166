from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.retainedStages", "100000")  # tests read the records of all stages so far
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def write(tmp_path):
    """Write a text file (gzipped when its name ends in .gz) under the test's folder."""
    import gzip

    def _write(name: str, text: str | bytes) -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        data = text.encode() if isinstance(text, str) else text
        if name.endswith(".gz") and isinstance(text, str):
            data = gzip.compress(data)
        path.write_bytes(data)
        return str(path)

    return _write


def rows(df):
    """Rows as a sorted list of dicts."""
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=repr)
