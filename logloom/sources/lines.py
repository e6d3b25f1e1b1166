"""Text files to lines, and the common shape of every reader's result."""

from __future__ import annotations

import gzip
import io
import itertools
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_SCHEMA = "file string, pos bigint, line string"
CONTENT_SCHEMA = "file string, content string"


@dataclass(frozen=True)
class Parsed:
    """Records, lines that could not be parsed, and files that could not be read.

    ``good`` has the canonical columns and ``file``; ``bad`` is ``(file, pos,
    err)`` with errors that name a field and never quote content;
    ``unreadable`` is ``(file, err)``.
    """

    good: DataFrame
    bad: DataFrame
    unreadable: DataFrame
    rows: DataFrame | None = None

    def cached(self) -> tuple[Parsed, DataFrame]:
        """The same result parsed once and kept, and the frame to release afterwards."""
        if self.rows is None:
            good = self.good.persist()
            return Parsed(good, self.bad, self.unreadable), good
        rows = self.rows.persist()
        return parsed(rows, self.unreadable), rows

    def bad_report(self) -> DataFrame:
        """Per file: number of bad lines and the first error."""
        return self.bad.groupBy("file").agg(F.count("*").alias("bad"), F.min_by("err", "pos").alias("first_error"))


def parsed(rows: DataFrame, unreadable: DataFrame | None = None) -> Parsed:
    """Split rows ``(file, pos, rec, err)`` into records and bad lines.

    Both are unfolded from an array that is empty on the other side. A filter
    would be pushed below the projections and parse every line a second time.
    """
    good = rows.select("file", F.inline(F.when(F.col("err").isNull(), F.array("rec"))))
    bad = rows.select("file", "pos", F.explode(F.when(F.col("err").isNotNull(), F.array("err"))).alias("err"))
    if unreadable is None:
        unreadable = no_rows(rows.sparkSession, "file string, err string")
    return Parsed(good, bad, unreadable, rows)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def load_text(spark: SparkSession, paths, keep, columns: list[Column], schema: str, **options) -> DataFrame:
    """Text of the files that pass ``keep``; a path that matches nothing gives no rows."""
    wanted = [paths] if isinstance(paths, str) else [p for p in (paths or []) if p]
    if not wanted:
        return no_rows(spark, schema)
    try:
        df = spark.read.text(wanted, recursiveFileLookup=True, **options)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return no_rows(spark, schema)
        raise
    if keep is not None:
        df = df.where(keep(F.col("_metadata.file_path")))
    return df.select(*columns)


def read_lines(spark: SparkSession, paths, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(file, pos, line)``: non-blank lines without a trailing carriage return; ``pos`` orders the lines of a file."""
    columns = [
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    ]
    return clean(load_text(spark, paths, keep, columns, LINE_SCHEMA))


def read_contents(spark: SparkSession, paths, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(file, content)``: one row per file, for envelopes that only make sense whole."""
    columns = [F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")]
    return load_text(spark, paths, keep, columns, CONTENT_SCHEMA, wholetext=True)


def clean(lines: DataFrame) -> DataFrame:
    """Drop blank lines and the carriage return of CRLF files."""
    return lines.withColumn("line", F.regexp_replace("line", "\r+$", "")).where(F.trim("line") != "")


def salvage_contents(spark: SparkSession, paths, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(file, content, err)``: like :func:`read_contents`, but a corrupt file is a row with an error.

    The text reader fails the job on a corrupt gzip member, so this slower path
    reads the bytes and decompresses them in the task, one file at a time.
    """
    wanted = [paths] if isinstance(paths, str) else [p for p in (paths or []) if p]
    if not wanted:
        return no_rows(spark, CONTENT_SCHEMA + ", err string")
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(wanted)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return no_rows(spark, CONTENT_SCHEMA + ", err string")
        raise
    if keep is not None:
        raw = raw.where(keep(F.col("path")))
    return decode_contents(raw)


def decode_contents(raw: DataFrame) -> DataFrame:
    """Decode ``binaryFile`` rows; works on batches and on streams.

    The task function is local, so it travels to the executors by value and
    needs no installed package there.
    """

    def decode(data: bytes) -> tuple[str | None, str | None]:
        try:
            if data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
            return data.decode("utf-8", errors="replace"), None
        except (OSError, EOFError, zlib.error):
            return None, "corrupt gzip data"

    def decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [decode(bytes(data)) for data in pdf["content"]]
            yield pd.DataFrame(
                {"file": pdf["path"].to_list(), "content": [c for c, _ in out], "err": [e for _, e in out]}
            )

    return raw.select("path", "content").mapInPandas(decode_batches, CONTENT_SCHEMA + ", err string")


def path_of(name: Column) -> Column:
    """The path behind a scan's ``_metadata.file_path``, which is URL-encoded."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def is_gzip(content: Column) -> Column:
    """Whether text is in fact undecoded gzip data: the reader decompresses by name only."""
    return F.substring(content.cast("binary"), 1, 2) == F.lit(b"\x1f\x8b")


def lines_of(contents: DataFrame) -> DataFrame:
    """``(file, pos, line)`` of whole files, split in the task that holds them."""
    return clean(
        contents.where(F.col("content").isNotNull()).select(
            "file", F.posexplode(F.split("content", "\n")).alias("pos", "line")
        ).select("file", F.col("pos").cast("bigint").alias("pos"), "line")
    )


def literal(paths: list[str]) -> list[str]:
    """Listed paths for a reader, which takes names for patterns."""
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]


def lines_of_files(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """``(file, pos, line)`` of listed files as Spark's reader streams them, also from gzip; no row holds a file.

    Unless ``strict``, a damaged file gives the lines before the damage.
    """
    if not paths:
        return no_rows(spark, LINE_SCHEMA)
    options = {"recursiveFileLookup": True, "lineSep": "\n", "ignoreCorruptFiles": not strict}
    return spark.read.options(**options).text(literal(paths)).select(
        path_of(F.col("_metadata.file_path")).alias("file"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def whole_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The listed files that Spark's line reader reads from end to end and whose text is no undecoded gzip data.

    A strict pass over the lines settles it in the usual case. Files of a pass that meets a damaged one are halved until
    damaged files stand alone: no row holds a file, and none is read more often than the files can be halved.
    """
    if not paths:
        return []
    undecoded = F.min_by(is_gzip(F.col("line")), "pos").alias("undecoded")
    try:
        found = lines_of_files(spark, paths, strict=True).groupBy("file").agg(undecoded).where("undecoded")
        other = {r["file"] for r in found.collect()}
    except (PySparkException, Py4JJavaError) as e:
        if "FAILED_READ_FILE" not in str(e):
            raise
        half = len(paths) // 2
        return whole_files(spark, paths[:half]) + whole_files(spark, paths[half:]) if half else []
    return [p for p in paths if p not in other]


def _stored(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, size, part)``: the stored bytes of listed files, parted at line feeds; one task has all of a file, in order.

    No codec is used, whatever a file's name is. Compressed data has a line feed every few hundred bytes, so no row holds
    a file, and rows are sorted on disk where memory can't hold them. Files that are gone give no row.
    """
    options = {
        "recursiveFileLookup": True, "lineSep": "\n", "ignoreMissingFiles": True,
        "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
        # Spark's own Hadoop jar has the second name, others the first.
        "io.compress.passthrough.extension": ".gz", "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".gz",
    }
    at = F.col("_metadata")
    parts = spark.read.options(**options).text(literal(paths)).select(
        path_of(at["file_path"]).alias("file"), at["file_size"].alias("size"), at["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").cast("binary").alias("part"))
    return parts.repartition("file").sortWithinPartitions("file", "block", "pos").select("file", "size", "part")


def _line_tasks() -> tuple[Callable, Callable]:
    """Task functions for rows of :func:`_stored`: how many lines a file has or why it can't be read, and a file's lines.

    A file is decompressed as its parts come in. The functions are local, so they travel to the executors by value.
    """

    class Joined(io.RawIOBase):
        """Pieces of bytes as a stream; ``data`` has the first two bytes at least, if there are so many."""

        def __init__(self, found: Iterator[bytes]):
            self.found, self.data, self.at = found, b"", 0
            while len(self.data) < 2 and (piece := next(found, None)) is not None:
                self.data += piece

        def readable(self) -> bool:
            return True

        def readinto(self, buffer: memoryview) -> int:
            while self.at == len(self.data):
                if (piece := next(self.found, None)) is None:
                    return 0
                self.data, self.at = piece, 0
            n = min(len(buffer), len(self.data) - self.at)
            buffer[:n] = self.data[self.at : self.at + n]
            self.at += n
            return n

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            file, size, part = batch.columns
            start, found = 0, pc.run_end_encode(file)
            for path, stop in zip(found.values.to_pylist(), found.run_ends.to_pylist()):
                yield path, size[start].as_py(), b"\n".join(part[start:stop].to_pylist())
                start = stop

    def stored(found: Iterator[tuple[str, int, bytes]]) -> Iterator[bytes]:
        n, size = -1, 0
        for _, size, data in found:
            if n >= 0:
                yield b"\n"
            yield data
            n += 1 + len(data)
        if n < size:
            yield b"\n"  # the file's last byte

    def pieces(found: Iterator[tuple[str, int, bytes]]) -> Iterator[bytes]:
        joined = Joined(stored(found))
        stream = io.BufferedReader(joined, 1 << 20)
        if joined.data[:2] == b"\x1f\x8b":
            stream = gzip.GzipFile(fileobj=stream)
        while piece := stream.read(1 << 20):
            yield piece

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        for path, found in itertools.groupby(runs(batches), lambda run: run[0]):
            yield path, pieces(found)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, found in files(batches):
            n, last, err = 0, b"\n", None
            try:
                for piece in found:
                    n, last = n + piece.count(b"\n"), piece[-1:]
            except (OSError, EOFError, zlib.error):
                n, last, err = 0, b"\n", "corrupt gzip data"
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n + (last != b"\n")], pa.int64()), pa.array([err], pa.string())], ["file", "n", "err"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(path: str, at: int, text: bytes) -> pa.RecordBatch:
            found = text.decode("utf-8", errors="replace").split("\n")
            columns = [pa.array([path] * len(found)), pa.array(range(at, at + len(found)), pa.int64()), pa.array(found, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["file", "pos", "line"])

        for path, found in files(batches):
            at, begun = 0, []
            for piece in found:
                head, cut, tail = piece.rpartition(b"\n")
                if cut:
                    batch = batch_of(path, at, b"".join([*begun, head]))
                    yield batch
                    at, begun = at + batch.num_rows, []
                begun.append(tail)
            if rest := b"".join(begun):
                yield batch_of(path, at, rest)

    return counted, lines


def count_lines(raw: DataFrame) -> DataFrame:
    """``(file, n, err)`` of listed ``binaryFile`` rows, of which only the paths are used: a file's lines, or why it can't be read."""
    spark, paths = raw.sparkSession, [r["path"] for r in raw.select("path").collect()]
    if not paths:
        return no_rows(spark, "file string, n bigint, err string")
    return _stored(spark, paths).mapInArrow(_line_tasks()[0], "file string, n bigint, err string")


def decode_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, pos, line)`` of files that :func:`count_lines` could read to their end; a file damaged since then is an error."""
    if not paths:
        return no_rows(spark, LINE_SCHEMA)
    return _stored(spark, paths).mapInArrow(_line_tasks()[1], LINE_SCHEMA)


def unreadable_of(contents: DataFrame) -> DataFrame:
    return contents.where(F.col("err").isNotNull()).select("file", "err")


def scan_stats(read: DataFrame, matched: Column) -> DataFrame:
    """Files, records and matching records of a scan: folded per file first."""
    return (
        read.groupBy("file")
        .agg(F.count("*").alias("n"), F.count_if(matched).alias("m"))
        .agg(
            F.count("*").alias("objects"), F.coalesce(F.sum("n"), F.lit(0)).alias("records_read"),
            F.coalesce(F.sum("m"), F.lit(0)).alias("records_matched"),
        )
    )


def read_keys(read: DataFrame) -> DataFrame:
    """Files that gave records, once each."""
    return read.select("file").distinct().orderBy("file")


def unseen(listed: DataFrame, seen: DataFrame) -> DataFrame:
    """Listed files that no committed run has read."""
    return listed.join(seen.select("file"), "file", "left_anti")
