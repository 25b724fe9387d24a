"""Windowed reports on streams. Each takes a batch or a streaming frame with an event-time column `ts`.

The traces know no lateness; here event time is when a request was queued, and
rows later than the watermark are dropped. Timestamps without zone are cast,
as watermarks need zoned ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.aggregates import inline_each, set_name, with_zeros
from ..operators.fairshare import global_scale

register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package

MIB = 1048576
# The idle gap after which a queue is dropped, fairness and report rounds, the heartbeat limit in seconds.
GAP, FAIRNESS_ROUND, REPORT_ROUND, LOST_AFTER_S = "10 seconds", "500 milliseconds", "5 seconds", 1524000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(df: DataFrame, delay: str) -> DataFrame:
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", delay) if df.isStreaming else df


def _edges(df: DataFrame, name: str = "w") -> DataFrame:
    return df.withColumns({"window_start": F.unix_micros(F.col(f"{name}.start")), "window_end": F.unix_micros(F.col(f"{name}.end"))}).drop(name)


def stream_throughput(df: DataFrame, key: str = "jobid", width: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """ST1: MB and operations of each key in each window; edges in microseconds since 1970."""
    rows = timed(df, delay).groupBy(F.window("ts", width).alias("w"), key).agg((F.sum("nlen") / MIB).alias("mb"), F.count("*").alias("ops"))
    return _edges(rows)


def active_periods(df: DataFrame, key: str, gap: str = GAP, delay: str = "10 seconds") -> DataFrame:
    """ST2: periods of requests of a key with no idle gap of `gap` or more: their edges and number."""
    rows = timed(df, delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("requests"))
    return _edges(rows)


def round_counts(df: DataFrame, width: str = FAIRNESS_ROUND, delay: str = "10 seconds") -> DataFrame:
    """ST3: operations of each job in each round, and on each server if requests name one; nnode is the job's largest there."""
    by = ["server", "jobid"] if "server" in df.columns else ["jobid"]
    rows = timed(df, delay).groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("ops"), F.max("nnode").alias("nnode"))
    return _edges(rows)


def scaled_rounds(counts: DataFrame, n_servers: int) -> DataFrame:
    """ST3: finished round counts, merged over servers (nnode is the first server's), with each job's scale factor."""
    if "server" in counts.columns:
        counts = counts.groupBy("window_start", "window_end", "jobid").agg(F.sum("ops").alias("ops"), F.min_by("nnode", "server").alias("nnode"))
    return global_scale(counts, n_servers, ["window_start"])


def fairness_rounds(df: DataFrame, n_servers: int, width: str = FAIRNESS_ROUND) -> DataFrame:
    """ST3: round counts with each job's scale factor; on a stream, apply it in foreachBatch to complete rounds."""
    return scaled_rounds(round_counts(df, width), n_servers)


def put_rounds(batch: DataFrame, batch_id: int, n_servers: int, path: str) -> None:
    """ST3: the scaled rounds of one batch, in a folder of their own under `path`.

    A batch that comes again after a failure replaces what it wrote before, so
    that each round is there once. Each batch has whole rounds, as they are
    finished by the watermark.
    """
    rows = scaled_rounds(batch, n_servers).withColumn("batch", F.lit(batch_id))
    rows.write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_fairness_rounds(df: DataFrame, n_servers: int, path: str, checkpoint: str, width: str = FAIRNESS_ROUND):
    """ST3: the streaming form; finished rounds are scaled and put under `path` once each, by number of their batch."""
    put = lambda batch, batch_id: put_rounds(batch, batch_id, n_servers, path)
    return round_counts(df, width).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)


def decision_rounds(df: DataFrame, width: str = REPORT_ROUND, delay: str = "10 seconds", sets: DataFrame | None = None) -> DataFrame:
    """ST4: (window, ids, id, n): how often each id of a candidate set was chosen in a round, 0 included, over all threads.

    A row is one decision, or as many as its column `n` says, with its `candidates`, or with a batch frame `sets` (set_id,
    candidates) the `set_id` made by `set_name`. A window's state has a row for each choice
    and, without `sets`, one for each set, which holds its members; only what leaves it has a row for each member.
    """
    rows = timed(df, delay).withColumn("times", (F.col("n") if "n" in df.columns else F.lit(1)).cast("long"))
    kind = (df if sets is None else sets).schema["candidates"].dataType
    chosen, none = F.col("chosen").cast(kind.elementType), F.lit(None)
    if sets is None:
        members = F.array_sort(F.array_distinct("candidates"))
        row = lambda has, x, n, m: F.struct(has.alias("has"), x.cast(kind.elementType).alias("id"), n.alias("times"), m.cast(kind).alias("members"))
        both = F.array(row(F.lit(True), chosen, F.col("times"), none), row(F.lit(False), none, F.lit(0).cast("long"), members))
        rows = rows.select("ts", set_name("candidates").alias("set_id"), F.inline(both))
    else:
        rows = rows.select("ts", "set_id", F.lit(True).alias("has"), chosen.alias("id"), "times", none.cast(kind).alias("members"))
    counted = rows.groupBy(F.window("ts", width).alias("w"), "set_id", "has", "id").agg(F.sum("times").alias("n"), F.first("members", True).alias("members"))
    choice = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    found = counted.groupBy("w", "set_id").agg(F.collect_list(choice).alias("chosen"), F.first("members", True).alias("members"))
    if sets is not None:
        found = found.drop("members").join(sets.select("set_id", F.array_sort(F.array_distinct("candidates")).alias("members")), "set_id")
    found = found.where("members IS NOT NULL").select("w", F.array_join("members", ",").alias("ids"), with_zeros("members", "chosen").alias("counts"))
    return _edges(found.select("w", "ids", inline_each("counts")))


def lost_connections(heartbeats: DataFrame, threshold_s: float = LOST_AFTER_S, now: DataFrame | None = None) -> DataFrame:
    """ST5: (conn_id, last_us): connections whose last heartbeat is older than the threshold, those between servers aside; `now` is the newest of all."""
    beats = timed(heartbeats, "0 seconds")
    last = beats.where("NOT inter_server").groupBy("conn_id").agg(F.max(F.unix_micros("ts")).alias("last_us"))
    now = now if now is not None else beats.agg(F.max(F.unix_micros("ts")).alias("now_us"))
    return last.crossJoin(F.broadcast(now)).where(F.col("now_us") - F.col("last_us") > threshold_s * 1e6).select("conn_id", "last_us")


class _Watch(StatefulProcessor):
    """The last heartbeat of a connection and a timer that reports it as lost."""

    def __init__(self, threshold_us: int):
        self.threshold_us = threshold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = [int(b["us"].max()) for b in rows]
        (known,) = self.last.get() if self.last.exists() else (None,)
        last = max([*beats, *([] if known is None else [known])])
        if last != known:
            self.last.update((last,))
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(max((last + self.threshold_us) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (last,) = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"conn_id": [key[0]], "last_us": [last]})

    def close(self) -> None:
        pass


def stream_lost_connections(heartbeats: DataFrame, threshold_s: float = LOST_AFTER_S, delay: str = "10 seconds") -> DataFrame:
    """ST5 on a stream: one state row and one event-time timer for each connection, reported when it is lost.

    The state lies in RocksDB, beside the heap of the executors and in the
    stream's checkpoint; the session is set to that store, as this kind of state needs it.
    """
    heartbeats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = timed(heartbeats, delay).where("NOT inter_server").select("conn_id", "ts", F.unix_micros("ts").alias("us"))
    watch = _Watch(int(threshold_s * 1e6))
    return rows.groupBy("conn_id").transformWithStateInPandas(watch, "conn_id long, last_us long", "Append", "EventTime")
