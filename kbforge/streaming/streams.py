"""Streaming forms of the event-log operators. State is bounded by watermarks or time-outs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import Index, build_index, open_index
from ..sources.scratch import fresh_dir, shuffles_released


def tail(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 64) -> DataFrame:
    """A stream over the files of an append-only log, at most so many ``files`` a batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def signal_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events that have a type, with event time and a watermark of ``late``."""
    return events.where(F.col("event_type").isNotNull()).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def divergence(events: DataFrame, opened: str, closed: str) -> DataFrame:
    """Windows of three days, a day apart, in which more was opened than closed."""
    counts = events.groupBy(F.window("at", "3 days", "1 day"), "project_id").agg(F.count_if(F.col("event_type") == opened).alias("opened"), F.count_if(F.col("event_type") == closed).alias("closed"))
    return counts.where("opened > closed").select(F.to_date("window.start").alias("start"), "project_id", "opened", "closed")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Activity sessions of each user, closed by a pause of ``gap``."""
    grouped = events.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("started"), "n")


def repeated_call_alarms(calls: DataFrame, allowed: int = 3, keep_ms: int = 86_400_000, buckets: int = 1024) -> DataFrame:
    """(session_id, step, tool, args, calls): an alarm when a session's step repeats a call more than ``allowed`` times; the count of a key is forgotten when the watermark has passed its last call by ``keep_ms``.

    Keys are dealt by their hash into ``buckets``; a bucket's counts are one state, brought up to date
    by one call for all of its keys. A batch rewrites the counts of the buckets that it has calls for;
    ``buckets`` must stay the same over the runs of a stream.
    """
    fields = "session_id long, step date, tool string, args string"
    names = [f.split()[0] for f in fields.split(", ")]

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_pandas().set_index("key") if state.exists else None
        parts = [f.groupby("key")["at_ms"].agg(n="size", last="max") for f in frames if len(f)] if not state.hasTimedOut else []
        watermark = state.getCurrentWatermarkMs()
        if parts:
            new = pd.concat(parts).groupby(level="key").agg({"n": "sum", "last": "max"})
            if held is not None:
                old = held.reindex(new.index)
                new = pd.DataFrame({"n": new["n"] + old["n"].fillna(0).astype("int64"), "last": new["last"].where(old["last"].isna(), np.maximum(new["last"], old["last"].fillna(0).astype("int64")))})
            new["until"] = np.maximum(new["last"], watermark) + keep_ms
            held = new if held is None else pd.concat([held[~held.index.isin(new.index) & (held["until"] >= watermark)], new])
            over = new[new["n"] > allowed]
            if len(over):
                yield pd.DataFrame({"key": over.index, "calls": over["n"].to_numpy()})
        else:
            held = held[held["until"] >= watermark]
        if not len(held):
            state.remove()
            return
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(held.reset_index(), preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as to:
            to.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(max(int(held["until"].min()), watermark + 1))

    key = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    timed = calls.select(key.alias("key"), F.unix_millis("at").alias("at_ms"), "at").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    counted = timed.groupBy("bucket").applyInPandasWithState(count, "key string, calls long", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return counted.select(F.from_json("key", fields).alias("key"), "calls").select("key.*", "calls")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now through the stream, and the result table.

    Complete results replace each other; appended ones go to a file sink, exactly once.
    """
    spark = stream.sparkSession
    out, log = fresh_dir(spark, name), fresh_dir(spark, f"{name}-log")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def once(stream: DataFrame, keys: list[str], within: tuple[str, str] | None = None) -> DataFrame:
    """The first row of each of ``keys``. State holds every key ever seen, or, with ``within`` (a time column and a delay), those of that long before the watermark."""
    return stream.dropDuplicates(keys) if within is None else stream.withWatermark(*within).dropDuplicatesWithinWatermark(keys)


def ingest_once(stream: DataFrame, name: str, process: Callable[[DataFrame], DataFrame], keys: list[str], folder: str | None = None, within: tuple[str, str] | None = None) -> DataFrame:
    """Each version of a source processed once, over all runs that share ``folder``: all that has been processed so far.

    The keys seen are state of the stream and live in its checkpoint, below ``folder`` (a fresh one
    if none is given), beside the results; a run reads new files and the state of their keys only,
    which ``within`` bounds (``once``). A batch that runs again replaces its own folder. A source
    without rows gives an empty table.
    """
    spark = stream.sparkSession
    base = folder or fresh_dir(spark, name)
    out, log = f"{base}/rows", f"{base}/log"

    def batch(df: DataFrame, number: int) -> None:
        process(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    once(stream, keys, within).writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    if not _exists(spark, out):
        return process(spark.createDataFrame([], stream.schema))
    return spark.read.parquet(out).drop("batch")


def ingest_index(
    stream: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], fields: Callable[[], dict[str, Column]], keys: list[str], folder: str, slots: int, key: str = "chunk_id", owner: str | None = None, buckets: int = 32, within: tuple[str, str] | None = None
) -> Index:
    """The search index below ``folder``, grown by what is new in ``stream``: each version of a source is chunked and indexed once.

    A batch's chunks become blocks and totals of their own, which a search sums up, so nothing that
    is indexed already is read or written. A batch that runs again replaces its own blocks. What a
    batch has shuffled goes with it.
    """
    spark = stream.sparkSession
    path = f"{folder}/index"

    def batch(df: DataFrame, number: int) -> None:
        build_index(to_chunks(df), fields(), key, owner, buckets=buckets, path=path, batch=number, slots=slots)

    with shuffles_released(spark):
        once(stream, keys, within).writeStream.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    if not _exists(spark, f"{path}/totals"):
        batch(spark.createDataFrame([], stream.schema), -1)
    return open_index(spark, path, buckets, slots)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
