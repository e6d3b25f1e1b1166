"""The rolling scanner: a stream whose batches are ticks.

The stream joins new files with a clock that has one row for every trigger, so each interval gives a tick, also on a quiet
folder; a tick that takes longer than the interval is followed by one tick, not by those it missed.

Every tick writes its lines, findings, summaries, retry ledger and metric snapshot under its batch number and its tick
row last. A batch that fails is repeated under the same number and overwrites what it left behind, and readers only
trust batches with a tick row, so each file counts exactly once. The checkpoint survives a restart. What lies before the
lookback is deleted at the end of a tick; running totals live on in the newest snapshot.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators import lines, metrics, rules
from logloom.operators.counters import earliest
from logloom.sources import lines as src
from logloom.streaming.families import Family, Frames

TICK_SCHEMA = (
    "at timestamp, result string, objects bigint, records_read bigint, records_matched bigint, "
    "errors bigint, duration double"
)
RETRY_SCHEMA = "file string, err string, attempts int, first_seen timestamp, next_at timestamp, modified timestamp"
SEEN_SCHEMA = "file string, at timestamp"
SKIPPED_SCHEMA = "file string, modified timestamp, at timestamp"
SNAPSHOT_SCHEMA = "name string, type string, labels map<string,string>, value double"
BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
SEEN_MARGIN = timedelta(hours=48)
#: The longest pause between two tries of a file, as a power of two of the interval.
LONGEST_PAUSE = 10
#: Bound of state that ticks leave and a prune deletes; lines are output and stay.
STATE = ("findings", "retry", "skipped", "given_up", "snapshot")


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass(frozen=True)
class Options:
    """How a scanner runs. ``criteria`` are the filter fields of the family."""

    source: str
    tables: str
    checkpoint: str
    lookback: timedelta = timedelta(hours=24)
    interval: str = "15 minutes"
    once: bool = False
    strict_files: bool = False
    max_files: int | None = None
    max_attempts: int | None = None  # an unreadable file is tried as long as it is there, unless a limit is given
    retry_files: int = 1000  # tries of one tick; other files that are due wait for the next one
    max_events: int = 1000  # earliest matches a report shows
    cap: int | None = None  # of findings in counters and reports; CRITICAL ones always stay
    event_time: bool = True  # lines in order of record time, else as they come
    criteria: dict = field(default_factory=dict)
    thresholds: dict = field(default_factory=dict)
    clock: Callable[[], datetime] = utc_now
    after_write: Callable[[Frames, int], None] | None = None


def _clock(spark: SparkSession, schema: str) -> DataFrame:
    """A stream with one all-null row for every trigger."""
    beat = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return beat.select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])


def start(spark: SparkSession, family: Family, o: Options) -> StreamingQuery:
    """Start the scanner. The file source remembers what it has read; old entries are forgotten after the lookback."""
    age = int((o.lookback + SEEN_MARGIN).total_seconds())
    reader = spark.readStream.option("maxFileAge", f"{age}s").option("recursiveFileLookup", True)
    if o.max_files:
        reader = reader.option("maxFilesPerTrigger", o.max_files)
    if not o.strict_files and not family.whole_files:
        # Names only: the tick has Spark read the files line by line, so that no row holds a file.
        stream = reader.format("binaryFile").schema(BINARY_SCHEMA).load(o.source).select(F.col("path").alias("file"))
        stream = stream.where(family.keep(F.col("file"))).unionByName(_clock(spark, "file string"))
    elif not o.strict_files:
        # Two sources on one folder: whole texts without the files that can't be read, and all names. A name without a
        # text is a damaged file.
        texts = reader.format("text").option("wholetext", True).option("ignoreCorruptFiles", True).load(o.source)
        texts = texts.select(src.path_of(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("content"))
        names = reader.format("binaryFile").schema(BINARY_SCHEMA).load(o.source)
        names = names.select(F.col("path").alias("file"), F.lit(None).cast("string").alias("content"))
        stream = texts.unionByName(names).where(family.keep(F.col("file")))
        stream = stream.unionByName(_clock(spark, "file string, content string"))
    else:
        stream = reader.format("text").option("wholetext", family.whole_files).load(o.source)
        stream = stream.select(F.col("_metadata.file_path").alias("file"), "value").where(family.keep(F.col("file")))
        stream = stream.unionByName(_clock(spark, "file string, value string"))
    writer = stream.writeStream.foreachBatch(lambda df, batch_id: run_tick(df, batch_id, family, o))
    writer = writer.option("checkpointLocation", o.checkpoint)
    trigger = {"availableNow": True} if o.once else {"processingTime": o.interval}
    return writer.trigger(**trigger).start()


def interval_seconds(o: Options) -> float:
    amount, unit = o.interval.split()
    return float(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def _table(o: Options, name: str) -> str:
    return f"{o.tables.rstrip('/')}/{name}"


def _write(df: DataFrame, o: Options, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{_table(o, name)}/batch_id={batch_id}")


def _arrived(df: DataFrame, o: Options, batch_id: int, kept: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """New texts ``(file, content)`` that can be read, and the names ``(file)`` of new files without one.

    The two sources list the folder one after the other, so a file may reach one of them a batch earlier. Whichever
    comes second finds the file among those seen; texts are only compared if there is such a file.
    """
    seen = read_table(df.sparkSession, o, "seen", SEEN_SCHEMA).where(F.col("batch_id") < batch_id).select("file").distinct()
    df = df.withColumn("whole", F.col("content").isNotNull() & ~src.is_gzip(F.coalesce("content", F.lit("")))).persist()
    kept.append(df)
    texts = df.where("whole").select("file", "content")
    names = df.where("NOT whole").select("file").distinct()
    again = texts.select("file").join(seen, "file", "left_semi")
    fresh = texts if again.isEmpty() else texts.join(seen, "file", "left_anti")
    damaged = names.join(texts.select("file"), "file", "left_anti").join(seen, "file", "left_anti")
    return fresh, damaged


def _arrived_files(df: DataFrame, there: DataFrame, o: Options, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Names ``(file)`` of new files that Spark's reader streams from end to end, and of the other new ones."""
    spark = df.sparkSession
    seen = read_table(spark, o, "seen", SEEN_SCHEMA).where(F.col("batch_id") < batch_id).select("file")
    new = df.select("file").distinct().join(there.select("file"), "file", "left_semi").join(seen, "file", "left_anti")
    paths = [r["file"] for r in new.collect()]  # the source has them on the driver too
    whole = set(src.whole_files(spark, paths))
    return tuple(spark.createDataFrame([(p,) for p in paths if (p in whole) == kept], "file string") for kept in (True, False))


def _first_tries(damaged: DataFrame, waiting: DataFrame, there: DataFrame, now: datetime) -> DataFrame:
    """Ledger rows of damaged files that are not in the ledger yet; they are due at once."""
    new = damaged.join(waiting.select("file"), "file", "left_anti").join(there, "file")
    return new.select(
        "file", F.lit("corrupt gzip data").alias("err"), F.lit(0).alias("attempts"), F.lit(now).alias("first_seen"),
        F.lit(now).alias("next_at"), "modified",
    )


def _parse(df: DataFrame, family: Family, o: Options, pending: DataFrame | None, kept: list[DataFrame]):
    """Parsed records, unreadable files ``(file, err)`` and the files of the batch and of earlier failures.

    Only ``pending`` files, which Spark's reader could not read, are decompressed in Python.
    """
    if not o.strict_files and not family.whole_files:
        return _parse_lines(df, family, pending, kept)
    if o.strict_files:
        unreadable = src.no_rows(df.sparkSession, "file string, err string")
        if family.whole_files:
            return family.parse(df.select("file", F.col("value").alias("content"))), unreadable, df.select("file")
        numbered = df.select("file", F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
        return family.parse(src.clean(numbered)), unreadable, df.select("file")
    readable, unreadable, files = df.select("file", "content"), src.no_rows(df.sparkSession, "file string, err string"), df.select("file")
    if pending is not None:
        found = src.decode_contents(pending).persist()  # at most ``retry_files`` files
        kept.append(found)
        readable = readable.unionByName(found.where(F.col("err").isNull()).select("file", "content"))
        unreadable, files = src.unreadable_of(found), files.unionByName(found.select("file"))
    return family.parse(readable), unreadable, files


def _parse_lines(files: DataFrame, family: Family, pending: DataFrame | None, kept: list[DataFrame]):
    """Like :func:`_parse`, for families whose files are read line by line.

    One task decompresses a file; its lines are dealt anew, so that many parse them.
    """
    spark = files.sparkSession
    read, unreadable = src.lines_of_files(spark, [r["file"] for r in files.collect()]), src.no_rows(spark, "file string, err string")
    if pending is not None:
        found = src.count_lines(pending).persist()  # at most ``retry_files`` files
        kept.append(found)
        read = read.unionByName(src.decode_lines(spark, [r["file"] for r in found.where(F.col("err").isNull()).collect()]))
        unreadable, files = src.unreadable_of(found), files.unionByName(found.select("file"))
    return family.parse(src.clean(read.repartition("file", "pos"))), unreadable, files


def run_tick(df: DataFrame, batch_id: int, family: Family, o: Options) -> None:
    """One tick over the new files of a batch; the clock's row is none."""
    started, now = time.monotonic(), o.clock()
    spark = df.sparkSession
    try:
        objects, read, matched, errors, added = _write_results(df.where(F.col(df.columns[0]).isNotNull()), batch_id, family, o, now)
    except Exception:
        row = (now, "failed", 0, 0, 0, 0, time.monotonic() - started)
        _write_row(spark, row, f"{_table(o, 'failed_ticks')}/{batch_id}-{time.time_ns()}")
        raise
    result = "ok" if errors == 0 else "partial"
    row = (now, result, objects, read, matched, errors, time.monotonic() - started)
    _write_snapshot(spark, family, o, batch_id, row, added)
    # The tick row commits the batch, so it is written last.
    _write_row(spark, row, f"{_table(o, 'ticks')}/batch_id={batch_id}")
    prune(spark, o)


def _write_row(spark: SparkSession, row: tuple, path: str) -> None:
    spark.createDataFrame([row], TICK_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def _write_results(df: DataFrame, batch_id: int, family: Family, o: Options, now: datetime) -> tuple[int, int, int, int, DataFrame]:
    """Everything a tick leaves behind; returns files, records read, records matched, unreadable files and added counts."""
    spark = df.sparkSession
    criteria = dict(o.criteria) | {"since": now - o.lookback, "until": now}
    waiting = pending_files(spark, o, batch_id)
    there = listing(spark, family, o)
    kept: list[DataFrame] = []
    try:
        if not o.strict_files:
            df, damaged = _arrived(df, o, batch_id, kept) if family.whole_files else _arrived_files(df, there, o, batch_id)
            waiting = waiting.unionByName(_first_tries(damaged, waiting, there, now))
        due, later = _due(waiting, there, o, now)
        kept.append(due)
        again = _reread(spark, due)
        if again is None and _last_before(spark, o, batch_id) is not None and df.isEmpty():
            # A quiet tick adds nothing to any table but the ledgers and the snapshot.
            _write(later, o, "retry", batch_id)
            _write_skipped(spark, there, o, batch_id, now)
            return 0, 0, 0, read_table(spark, o, "retry", RETRY_SCHEMA, [batch_id]).count(), src.no_rows(spark, SNAPSHOT_SCHEMA)
        parts, unreadable, files = _parse(df, family, o, again, kept)
        frames: Frames = {}
        parsed: dict[str, src.Parsed] = {}
        for name, part in parts.items():
            parsed[name], rows = part.cached()
            kept.append(rows)
            unreadable = unreadable.unionByName(parsed[name].unreadable)
            frames[name] = family.select(parsed[name].good, name, criteria)
        unreadable = unreadable.persist()
        kept.append(unreadable)

        run = f"{now:%Y%m%dT%H%M%SZ}-{batch_id}"
        found = family.findings(frames, family.thresholds | o.thresholds)
        written = family.encode(frames, run)
        if found is not None:
            _write(found, o, "findings", batch_id)
            found = read_table(spark, o, "findings", None, [batch_id]).drop("batch_id")
            written = written.unionByName(lines.finding_lines(found, run, family.name))
        _write(lines.by_event_time(written).drop("stream") if o.event_time else written, o, "lines", batch_id)
        for name, summary in family.summarise(frames).items():
            _write(summary, o, f"summary/{name}", batch_id)
        for name, frame in frames.items():
            _write(_first_matches(frame, family, o), o, f"matches/{name}", batch_id)
        for name, p in parsed.items():
            _write(p.bad_report(), o, f"bad/{name}", batch_id)
        errors = _write_retries(unreadable, due, later, there, o, batch_id, now)
        read_now = files.select("file").distinct().join(unreadable.select("file"), "file", "left_anti")
        _write(read_now.withColumn("at", F.lit(now)), o, "seen", batch_id)
        _write_skipped(spark, there, o, batch_id, now)
        if o.after_write is not None:
            o.after_write(frames, batch_id)
        read = sum(p.good.count() for p in parsed.values())
        matched = sum(f.count() for f in frames.values())
        if found is not None and o.cap is not None and family.name != "cloudtrail":
            found = rules.cap_aggregate(found, o.cap)
        # A few rows, computed now, while the records are still there.
        added = spark.createDataFrame(family.counters(frames, found).collect(), SNAPSHOT_SCHEMA)
        return read_table(spark, o, "seen", SEEN_SCHEMA, [batch_id]).count(), read, matched, errors, added
    finally:
        for k in kept:
            k.unpersist()


def _first_matches(frame: DataFrame, family: Family, o: Options) -> DataFrame:
    """The earliest records; a hash of all columns that have an order breaks ties."""
    plain = [F.col(f"`{f.name}`") for f in frame.schema.fields if "map<" not in f.dataType.simpleString()]
    return earliest(frame.withColumn("tie", F.xxhash64(*plain)), o.max_events, family.time, "tie").drop("tie")


# Metric snapshots ------------------------------------------------------------


def _last_before(spark: SparkSession, o: Options, batch_id: int) -> int | None:
    return ticks(spark, o).where(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]


def _failures(spark: SparkSession, o: Options) -> DataFrame:
    """Failed attempts with the batch they were made for."""
    try:
        rows = spark.read.schema(TICK_SCHEMA).parquet(_table(o, "failed_ticks") + "/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return src.no_rows(spark, TICK_SCHEMA + ", batch_id bigint")
    return rows.withColumn("batch_id", F.regexp_extract(F.col("_metadata.file_path"), r"/failed_ticks/(\d+)-", 1).cast("bigint"))


def _write_snapshot(spark: SparkSession, family: Family, o: Options, batch_id: int, row: tuple, added: DataFrame) -> None:
    """All series after this tick: the snapshot before, and what this tick adds. No earlier tick is read again."""
    tick = spark.createDataFrame([row], TICK_SCHEMA)
    failed = _failures(spark, o).where(F.col("batch_id") == batch_id).count()
    seen = read_table(spark, o, "seen", SEEN_SCHEMA).where(F.col("batch_id") <= batch_id).count()
    added = added.unionByName(metrics.scan_counters(tick, failed)).unionByName(
        metrics.scan_gauges(tick, seen, o.lookback.total_seconds(), interval_seconds(o)))
    last = _last_before(spark, o, batch_id)
    before = read_table(spark, o, "snapshot", SNAPSHOT_SCHEMA, [] if last is None else [last]).drop("batch_id")
    _write(metrics.carried_on(before, metrics.for_subcommand(added, family.name)).coalesce(1), o, "snapshot", batch_id)


# Unreadable and old files ------------------------------------------------------


def listing(spark: SparkSession, family: Family, o: Options) -> DataFrame:
    """Files of the source with their time of change; names are listed, nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(o.source)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified")).where(family.keep(F.col("file")))


def pending_files(spark: SparkSession, o: Options, batch_id: int) -> DataFrame:
    """Files the latest committed tick could not read."""
    last = None if o.strict_files else _last_before(spark, o, batch_id)
    if last is None:
        return src.no_rows(spark, RETRY_SCHEMA)
    return read_table(spark, o, "retry", RETRY_SCHEMA, [last]).drop("batch_id")


def _due(waiting: DataFrame, there: DataFrame, o: Options, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The ledger met with the listing: files to try now (changed ones, or those whose pause is over) and files that wait.

    Files that are no longer listed leave the ledger.
    """
    listed = waiting.join(there.withColumnRenamed("modified", "changed"), "file")
    ready = (F.col("next_at") <= F.lit(now)) | (F.col("changed") > F.col("modified"))
    due = listed.where(ready).orderBy("next_at", "file").limit(o.retry_files).persist()
    return due.drop("changed"), listed.drop("changed").join(due.select("file"), "file", "left_anti")


def _reread(spark: SparkSession, due: DataFrame) -> DataFrame | None:
    """The files to try again, at most ``retry_files`` paths, as ``binaryFile`` rows; bytes are read where they are asked for."""
    paths = [r["file"] for r in due.select("file").collect()]
    if not paths:
        return None
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    return reader.load(src.literal(paths)).select("path", "content")


def _write_retries(
    unreadable: DataFrame, due: DataFrame, later: DataFrame, there: DataFrame, o: Options, batch_id: int, now: datetime,
) -> int:
    """The ledger after this tick; returns how many files are unreadable. Each try doubles the pause before the next."""
    joined = unreadable.dropDuplicates(["file"]).join(due.select("file", "attempts", "first_seen"), "file", "left").join(there, "file", "left")
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    pause = (F.pow(F.lit(2.0), F.least(attempts, F.lit(LONGEST_PAUSE)) - 1) - 1) * int(interval_seconds(o))
    rows = joined.select(
        "file", "err", attempts.alias("attempts"), F.coalesce("first_seen", F.lit(now)).alias("first_seen"),
        (F.lit(now) + F.make_dt_interval(secs=pause)).alias("next_at"), F.coalesce("modified", F.lit(now)).alias("modified"),
    )
    if o.max_attempts is not None:
        # Given up, but on record.
        _write(rows.where(F.col("attempts") >= o.max_attempts), o, "given_up", batch_id)
        rows = rows.where(F.col("attempts") < o.max_attempts)
    _write(rows.unionByName(later), o, "retry", batch_id)
    gone = unreadable.select("file").distinct().count() if o.max_attempts is not None else 0
    return max(gone, read_table(unreadable.sparkSession, o, "retry", RETRY_SCHEMA, [batch_id]).count())


def _write_skipped(spark: SparkSession, there: DataFrame, o: Options, batch_id: int, now: datetime) -> None:
    """Files the source passes over as too old, once each: never read, and older than the newest file by more than its age limit."""
    newest = there.agg(F.max("modified")).first()[0]
    if newest is None:
        return
    old = there.where(F.col("modified") < F.lit(newest - o.lookback - SEEN_MARGIN))
    for name, schema in (("seen", SEEN_SCHEMA), ("skipped", SKIPPED_SCHEMA), ("retry", RETRY_SCHEMA)):
        known = read_table(spark, o, name, schema)
        # This batch's rows of an earlier attempt don't count, but what it has read does.
        known = known if name == "seen" else known.where(F.col("batch_id") != batch_id) if name == "skipped" else known.where(F.col("batch_id") == batch_id)
        old = old.join(known.select("file").distinct(), "file", "left_anti")
    _write(old.select("file", "modified", F.lit(now).alias("at")), o, "skipped", batch_id)


# Reading back ---------------------------------------------------------------


def read_table(spark: SparkSession, o: Options, name: str, schema: str | None = None,
               batches: list[int] | None = None) -> DataFrame:
    """A tick table with its ``batch_id``, of some batches only (partition pruning)."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema + ", batch_id bigint")
        df = reader.parquet(_table(o, name))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA") or schema is None:
            raise
        return src.no_rows(spark, schema + ", batch_id bigint")
    return df if batches is None else df.where(F.col("batch_id").isin(*batches) if batches else F.lit(False))


def ticks(spark: SparkSession, o: Options) -> DataFrame:
    """Committed ticks."""
    return read_table(spark, o, "ticks", TICK_SCHEMA)


def failed_ticks(spark: SparkSession, o: Options) -> DataFrame:
    """Attempts that committed nothing; their batch was repeated."""
    return _failures(spark, o).drop("batch_id")


def committed(spark: SparkSession, o: Options, since: datetime | None = None) -> list[int]:
    """Batch numbers with a tick row; a day has about a hundred."""
    t = ticks(spark, o)
    if since is not None:
        t = t.where(F.col("at") >= F.lit(since))
    return sorted(r["batch_id"] for r in t.select("batch_id").collect())


def report(spark: SparkSession, family: Family, o: Options) -> Frames:
    """The whole lookback: merged summaries of every committed tick, and rules judged again over them.

    Thresholds that no single tick reaches are crossed here. Beside the merged summaries there are ``findings`` (capped
    by ``Options.cap``), ``severities`` and ``dropped`` of all of them, ``matches_<records>`` (the earliest of all
    ticks) and ``scan``, what the ticks read together.
    """
    since = o.clock() - o.lookback
    batches = committed(spark, o, since)
    out: Frames = {}
    for name, merge in family.merge.items():
        out[name] = merge(read_table(spark, o, f"summary/{name}", None, batches))
    found = read_table(spark, o, "findings", None, batches).drop("batch_id") if family.name == "cloudtrail" else family.judge(out, family.thresholds | o.thresholds)
    if found is not None:
        out["findings"] = rules.cap_audit(found, o.cap) if family.name == "cloudtrail" else rules.cap_aggregate(found, o.cap)
        out["severities"], out["dropped"] = rules.severity_counts(found), rules.dropped_by(found, out["findings"])
    for name in family.records:
        out[f"matches_{name}"] = _first_matches(read_table(spark, o, f"matches/{name}", None, batches).drop("batch_id"), family, o)
    out["scan"] = ticks(spark, o).where(F.col("at") >= F.lit(since)).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("objects", "records_read", "records_matched", "errors", "duration")])
    return out | family.finish(out)


def tick_history(spark: SparkSession, family: Family, o: Options) -> DataFrame:
    """Every series after every tick since the lookback, as a metric history.

    Snapshots are read as they are. After a failed attempt nothing but the failures and the time of the last scan move.
    """
    at = ticks(spark, o).select("batch_id", "at")
    rows = read_table(spark, o, "snapshot", SNAPSHOT_SCHEMA).join(at, "batch_id").select("name", "type", "labels", "value", "at")
    last = read_table(spark, o, "snapshot", SNAPSHOT_SCHEMA).where(F.col("name") == metrics.PREFIX + "scans_total").where("labels.result = 'failed'")
    tried = _failures(spark, o).select("batch_id", "at", "duration")
    # How often a batch had failed until then, on top of the snapshot before it.
    count = F.row_number().over(Window.partitionBy("batch_id").orderBy("at"))
    base = last.join(at.select("batch_id"), "batch_id").select(F.col("batch_id").alias("before"), "value")
    failed = tried.withColumn("k", count).join(base, base["before"] < tried["batch_id"], "left").groupBy("batch_id", "at", "duration", "k").agg(
        F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))
    own = lambda *more: F.create_map(F.lit("subcommand"), F.lit(family.name), *[F.lit(x) for x in more])
    point = lambda name, kind, labels, value: F.struct(
        F.lit(metrics.PREFIX + name).alias("name"), F.lit(kind).alias("type"), labels.alias("labels"), value.cast("double").alias("value"))
    points = F.array(
        point("scans_total", "counter", own("result", "failed"), F.col("value") + F.col("k")),
        point("last_scan_timestamp_seconds", "gauge", own(), F.unix_micros("at") / 1e6), point("scan_duration_seconds", "gauge", own(), F.col("duration")),
    )
    return rows.unionByName(failed.select("at", F.inline(points)).select("name", "type", "labels", "value", "at"))


def prune(spark: SparkSession, o: Options) -> list[int]:
    """Delete the state of ticks that lie before the lookback, and files seen 48 hours before that; returns the ticks' numbers.

    Written lines are output and stay, running totals are in the snapshot of the newest tick.
    """
    now = o.clock()
    forgotten = read_table(spark, o, "seen", SEEN_SCHEMA).where(F.col("at") < F.lit(now - o.lookback - SEEN_MARGIN)).select("batch_id").distinct()
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(o.tables)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = list(STATE)
    for folder in ("summary", "bad", "matches"):
        path = jvm.org.apache.hadoop.fs.Path(root, folder)
        if fs.exists(path):
            names += [f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(path)]

    # The newest tick holds the running totals, and of the ticks with files the newest one keeps the tables' columns known.
    full = [n for n in names if n.startswith("matches/")][:1]
    batches = [int(s.getPath().getName().partition("=")[2]) for n in full for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root, n)) if s.isDirectory()]
    stay = {_last_before(spark, o, 1 << 62), *sorted(batches)[-1:]}
    old = ticks(spark, o).where(F.col("at") < F.lit(now - o.lookback)).select("batch_id").collect()
    old = sorted({r["batch_id"] for r in old} - stay)

    def delete(name: str, batch: int) -> None:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"{name}/batch_id={batch}"), True)

    for row in forgotten.collect():
        delete("seen", row["batch_id"])
    # The tick row goes last: until then the batch still counts as committed and a broken prune is repeated.
    for batch in old:
        for name in [*names, "ticks"]:
            delete(name, batch)
    return old
