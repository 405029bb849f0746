"""Structured Streaming: file streams, runs to the end of what is there, upsert logs, stateful operators.

All of these are plain DataFrame to DataFrame functions over streams; `appended` and `upserted` start the query, wait
until it has worked off all files that exist, and give what it wrote. Progress, state and results are kept in the folder that
driver and executors share, so a query that is started again under the same `home` goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from corvane.shared import new_dir


def new_home(spark: SparkSession, name: str) -> str:
    """A new folder for a query's progress, state and results, in the folder that driver and executors share."""
    return new_dir(spark, f"stream-{name}")


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet file path, or files in the folder path, as a stream, with the schema they have now; `files_per_batch` bounds a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a pattern that only this name matches: a file source takes a pattern's single file, but not a plain path to a file
    parent, _, name = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{parent}/[{name[0]}]{name[1:]}")


def _ended(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


def start_append(stream: DataFrame, home: str, **trigger) -> StreamingQuery:
    """Starts appending final rows as Parquet files; trigger is availableNow=True unless another is named (processingTime="1 minute")."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/progress").option("path", f"{home}/rows")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def appended(stream: DataFrame, home: str) -> DataFrame:
    """Rows of a stream in append mode once all present files are read; each is written exactly once."""
    _ended(start_append(stream, home))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/rows")


def start_upsert(stream: DataFrame, home: str, mode: str = "update", **trigger) -> StreamingQuery:
    """Starts writing each batch's changed rows into a log of batches.

    A batch overwrites its own folder only, so a batch that is tried again changes nothing and no batch rewrites what others
    wrote. Compaction is a separate job: `latest` of the log, written anew.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{home}/log/batch_id={batch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/progress").foreachBatch(put)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, home: str, keys: list[str], schema) -> DataFrame:
    """The newest row of each key in an upsert log (null keys are a key)."""
    log = spark.read.schema(schema.add("batch_id", "long") if "batch_id" not in schema.names else schema).parquet(f"{home}/log")
    rest = [c for c in log.columns if c not in (*keys, "batch_id")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("newest"))
    return newest.select(*keys, *[F.col("newest")[c].alias(c) for c in rest])


def upserted(stream: DataFrame, home: str, keys: list[str], mode: str = "update") -> DataFrame:
    """State of an update- or complete-mode stream by key once all present files are read."""
    _ended(start_upsert(stream, home, mode))
    return latest(stream.sparkSession, home, keys, stream.schema)


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, by: list[str]) -> DataFrame:
    """start, by..., n of each tumbling window. In append mode a window is given once the newest time is `late` past its end; rows of windows given before are dropped."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), *by, "n")


def first_of_each(stream: DataFrame, keys: list[str], ts: str | None = None, late: str | None = None) -> DataFrame:
    """One row of each key. With ts and late, keys are remembered that long only, so state stays bounded."""
    if ts and late:
        return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def followed_by(first: DataFrame, then: DataFrame, on: Column, ts: str, then_ts: str, within: str, late: str, how: str = "inner") -> DataFrame:
    """Rows of `first` with rows of `then` at most `within` later; both sides' state ends with the watermark. With leftOuter, rows without partner follow once none can come."""
    a, b = first.withWatermark(ts, late), then.withWatermark(then_ts, late)
    gap = (F.col(then_ts) >= F.col(ts)) & (F.col(then_ts) <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return a.join(b, on & gap, how)


def running_profile(stream: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """key, n, total, last_ts so far, for each key that a batch touches: custom state that takes a key's rows in Arrow batches, in any order.

    Null values count in n, not in total; null times never are the last. The state of a key is three numbers, however
    many rows it has.
    """
    source = stream.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, None)
        for frame in frames:
            n, total, newest = n + len(frame), total + float(frame["value"].sum()), frame["at"].max()
            if pd.notna(newest):
                last = int(newest) if last is None else max(last, int(newest))
        state.update((n, total, last))
        yield pd.DataFrame({"key": pd.Series([k[0]]), "n": [n], "total": [total], "last_us": pd.array([last], dtype="Int64")})

    kind = source.schema["key"].dataType.simpleString()
    out = source.groupBy("key").applyInPandasWithState(
        step, f"key {kind}, n long, total double, last_us long", "n long, total double, last long", "update", GroupStateTimeout.NoTimeout)
    return out.select(F.col("key").alias(key), "n", "total", F.timestamp_micros("last_us").alias("last_ts"))


def union_under_policy(a: DataFrame, b: DataFrame, ts: str, late_a: str, late_b: str) -> DataFrame:
    """Two streams of one schema as one, each with its own allowance for late rows; which of the two watermarks holds is decided where the query starts (`policy`)."""
    return a.withWatermark(ts, late_a).union(b.withWatermark(ts, late_b))


@contextmanager
def policy(spark: SparkSession, which: str) -> Iterator[None]:
    """Queries started inside take the lowest ('min': no stream's rows are late for another's sake) or the highest ('max') of their streams' watermarks.

    The setting is part of a query's progress: a query that goes on under the same home keeps its first policy.
    """
    if which not in ("min", "max"):
        raise ValueError("the policy is min or max")
    name = "spark.sql.streaming.multipleWatermarkPolicy"
    before = spark.conf.get(name)
    spark.conf.set(name, which)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def backfilled(history: DataFrame, live: DataFrame, home: str) -> DataFrame:
    """Rows of a history that is loaded once and of a stream that goes on from there, both in one target under home.

    The history is written under a name of its own, whole or not at all: if a run finds it complete it isn't loaded again, and one that broke off
    is overwritten. The stream's rows are written exactly once by its progress. So a run that is repeated under the same home adds only what is new.
    What the history holds must not come through the stream too: cut both at one point.
    """
    spark = live.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/history/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        history.select(*live.columns).write.mode("overwrite").parquet(f"{home}/history")
    rows = appended(live, home)
    return spark.read.schema(live.schema).parquet(f"{home}/history").unionByName(rows)


def debounced(stream: DataFrame, key: str, at: str, width: int, flush_after: str | None = None) -> DataFrame:
    """(key, fired_at, requested_at, coalesced) in update mode: requests (at: microseconds) of a key fire at once, but not within `width` of the last firing; those in between go with the next that fires.

    With flush_after (an allowance for late requests), requests that wait fire `width` after the last firing once the watermark has passed that, though no request comes.
    The state of a key is three numbers. Requests that come late count at their own time, as waiting ones if a firing was after them.
    """
    source = stream.select(F.col(key).alias("key"), F.col(at).alias("at"), F.timestamp_micros(at).alias("when"))
    source = source.withWatermark("when", flush_after) if flush_after else source

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, first, n = state.get if state.exists else (None, None, 0)
        out = []
        if state.hasTimedOut:
            out.append((last + width, first, n))
            last, first, n = last + width, None, 0
        else:
            for t in sorted(int(v) for frame in frames for v in frame["at"].dropna()):
                first, n = t if first is None else min(first, t), n + 1
                if last is None or t - last >= width:
                    out.append((t, first, n))
                    last, first, n = t, None, 0
        if last is not None:
            state.update((last, first, n))
            if flush_after and n:
                state.setTimeoutTimestamp(max((last + width) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(out), "fired_at": [o[0] for o in out], "requested_at": [o[1] for o in out], "coalesced": [o[2] for o in out]})

    kind = source.schema["key"].dataType.simpleString()
    timeout = GroupStateTimeout.EventTimeTimeout if flush_after else GroupStateTimeout.NoTimeout
    out = source.groupBy("key").applyInPandasWithState(step, f"key {kind}, fired_at long, requested_at long, coalesced long", "last long, first long, n long", "append" if flush_after else "update", timeout)
    return out.withColumnRenamed("key", key)
