"""File events as streams: debouncing, change detection, hysteresis of a queue, and batches for ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET_MS = 300


def debounced(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(branch_id, path, kind, first_ms, last_ms, coalesced): events of a path closer than the quiet time are one, the latest kind counts.

    events: branch_id, path, kind, ts_ms, event_id. The batch twin of debounce_stream, by event time.
    """
    w = Window.partitionBy("branch_id", "path").orderBy("ts_ms", "event_id")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(w)
    e = events.withColumn("burst", F.sum(F.when(gap.isNull() | (gap >= quiet_ms), 1).otherwise(0)).over(w))
    return e.groupBy("branch_id", "path", "burst").agg(F.max_by("kind", F.struct("ts_ms", "event_id")).alias("kind"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("coalesced")).drop("burst")


def debounce_stream(events: DataFrame, quiet_ms: int = QUIET_MS, watermark: str = "1 minute") -> DataFrame:
    """The same over a stream with a timestamp column ts: a session window per path that closes after the quiet time."""
    s = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", f"{quiet_ms} milliseconds"), "branch_id", "path")
    return s.agg(F.max_by("kind", "ts").alias("kind"), F.count(F.lit(1)).alias("coalesced")).select("branch_id", "path", "kind", F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("closed_ts"), "coalesced")


def mtime_changes(polls: DataFrame) -> DataFrame:
    """(path, ts_ms): polls (path, mtime, ts_ms) in which a path is new or has another mtime; missing ones are not reported."""
    w = Window.partitionBy("path").orderBy("ts_ms")
    before = F.lag("mtime").over(w)
    return polls.withColumn("b", before).filter(F.col("b").isNull() | (F.col("b") != F.col("mtime"))).select("path", "ts_ms")


def backlog_states(depths: DataFrame, hwm: int, lwm: int, hold_ms: int) -> DataFrame:
    """(ts_ms, depth, degraded): on at the high-water mark, off once the depth has been below the low-water mark for hold_ms.

    depths: one queue's (ts_ms, depth). The decision at a time needs the times since which the depth is high or low, which
    are running values.
    """
    w = Window.orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    d = depths.withColumn("low", F.col("depth") < lwm)
    d = d.withColumn("not_low_at", F.max(F.when(~F.col("low"), F.col("ts_ms"))).over(w))
    first_low = F.min(F.when(F.col("low"), F.col("ts_ms"))).over(Window.partitionBy("not_low_at").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("since", first_low).withColumn("clears", F.col("low") & (F.col("ts_ms") - F.col("since") >= hold_ms))
    mark = F.when(F.col("depth") >= hwm, True).when(F.col("clears"), False)
    return d.select("ts_ms", "depth", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)).alias("degraded"))


def hysteresis_stream(depths: DataFrame, hwm: int, lwm: int, hold_ms: int = 0) -> DataFrame:
    """(queue, ts_ms, depth, degraded) of a stream (queue, ts_ms, depth): on at the high-water mark, off once the depth has been
    below the low-water mark for hold_ms, by the times of the depths; the stream's twin of backlog_states().

    The state of a queue is whether it is on and since when it is low. Rows of a micro-batch are taken in the order of
    their times; one that is older than the last of the batch before is taken as it comes.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, since = state.get if state.exists else (False, None)
        rows = pd.concat(list(parts)).sort_values("ts_ms", kind="stable")
        out = []
        for ts, depth in zip(rows["ts_ms"].tolist(), rows["depth"].tolist()):
            since = (ts if since is None else since) if depth < lwm else None
            on = True if depth >= hwm else False if since is not None and ts - since >= hold_ms else on
            out.append((key[0], ts, int(depth), on))
        state.update((on, since))
        yield pd.DataFrame(out, columns=["queue", "ts_ms", "depth", "degraded"])

    return depths.groupBy("queue").applyInPandasWithState(step, "queue string, ts_ms bigint, depth bigint, degraded boolean", "on boolean, since bigint", "append", GroupStateTimeout.NoTimeout)


def expired(rows: DataFrame, now_ms: int, ttl_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Rows (patches, locks, cache entries) older than their time to live."""
    return rows.filter(F.lit(now_ms) - F.col(ts) > ttl_ms)


def routed(changes: DataFrame, patches: DataFrame) -> DataFrame:
    """(path, action): a changed path with a pending patch is promoted if it has a token, reverted if not; others are indexed."""
    p = patches.groupBy("path").agg(F.max("has_token").alias("token"))
    return changes.select("path").distinct().join(p, "path", "left").select("path", F.when(F.col("token"), "promote").when(F.col("token").isNotNull(), "revert").otherwise("reindex").alias("action"))


def missed_events(disk: DataFrame, indexed: DataFrame, quiet_ms: int = QUIET_MS, most: int = 20) -> DataFrame:
    """(path, mtime): up to ``most`` files whose change is older than the debounce but not indexed; the report is a sample."""
    j = disk.join(indexed.select("path", "indexed_ms"), "path", "left")
    return j.filter(F.col("mtime") > F.coalesce("indexed_ms", F.lit(0)) + quiet_ms + 500).orderBy("path").limit(most).select("path", "mtime")


def ingest_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch to ``handle(batch, epoch)``; a batch may come twice, under the same epoch."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
