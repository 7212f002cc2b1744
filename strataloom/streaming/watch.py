"""File events as a stream: events of a path are coalesced until it is quiet; too many at once are an error."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataloom.sources.sinks import Snapshots

QUIET, LATE, PENDING = "500 milliseconds", "10 seconds", 4096


def coalesced(events: DataFrame, quiet: str = QUIET, late: str = LATE) -> DataFrame:
    """(path, settled_at, events, deleted) of (ts, path, kind): one row when a path has been quiet."""
    return (
        events.withWatermark("ts", late)
        .groupBy("path", F.session_window("ts", quiet).alias("w"))
        .agg(F.count("*").alias("events"), F.bool_or(F.col("kind") == "delete").alias("deleted"))
        .select("path", F.col("w.end").alias("settled_at"), "events", "deleted")
    )


class Overflow(RuntimeError):
    """More settled paths in one batch than may be pending; nothing was dropped, the query stops."""


def watch(events: DataFrame, apply: Callable[[DataFrame, bool], None], checkpoint: str, pending: int = PENDING, **options) -> StreamingQuery:
    """Hand each batch of settled paths to ``apply`` with whether it needs a full refresh (something was deleted)."""

    def batch(rows: DataFrame, _: int) -> None:
        settled = rows.persist()
        try:
            n, deleted = settled.agg(F.count("*"), F.coalesce(F.bool_or("deleted"), F.lit(False))).collect()[0]
            if n > pending:
                raise Overflow(f"{n} settled paths, {pending} may be pending")
            if n:
                apply(settled, deleted)
        finally:
            settled.unpersist()

    writer = coalesced(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return writer.trigger(**(options or {"processingTime": "1 second"})).start()


#: Times that a batch is tried, and seconds before the next try, which double.
TRIES, WAIT = 3, 0.1


def retried(apply: Callable[[DataFrame, bool], None], tries: int = TRIES, wait: float = WAIT) -> Callable[[DataFrame, bool], None]:
    """``apply`` tried again after an error; the last one stops the query, whose checkpoint keeps the batch."""

    def run(rows: DataFrame, full: bool) -> None:
        for left in range(tries - 1, -1, -1):
            try:
                return apply(rows, full)
            except Exception:
                if not left:
                    raise
                time.sleep(wait * 2 ** (tries - 1 - left))

    return run


def refresher(store: Snapshots, table: str, key: str, read: Callable[[DataFrame | None], DataFrame]) -> Callable[[DataFrame, bool], None]:
    """Publishes the rows of settled files in place of their former ones; after a deletion all are read anew.

    ``read`` gives the rows of paths (path), or of all files for None. Rows of a path that it no longer gives are gone.
    """

    def apply(rows: DataFrame, full: bool) -> None:
        name = f"{table}-{uuid.uuid4().hex[:12]}"
        if full or store.current() is None:
            store.publish(name, {table: read(None)})
        else:
            touched = rows.select("path").distinct()
            store.publish(name, {table: store.updated(table, key, read(touched), touched.select(F.col("path").alias(key)))})

    return apply


def windows(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extension: counts and sums by tumbling window and kind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


#: Events of an episode at most, and how long one stays open without any.
EPISODE_EVENTS, LEASE_MS = 256, 30 * 60 * 1000


def episodes(events: DataFrame, cap: int = EPISODE_EVENTS, lease_ms: int = LEASE_MS, late: str = LATE) -> DataFrame:
    """(session, events, first, last, ended) of (session, ts, kind): a row when a session ends, is full, or its lease runs out.

    State is a count and two times for each open session, whatever the number of its events.
    """
    schema = "session string, events long, first timestamp, last timestamp, ended string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            n, first, last = state.get
            out.append((key[0], n, first, last, "lease"))
            state.remove()
        else:
            n, first, last = state.get if state.exists else (0, None, None)
            for part in batches:
                for ts, kind in part[["ts", "kind"]].sort_values("ts", kind="stable").itertuples(index=False):
                    at = int(ts.value // 1000)
                    n, first, last = n + 1, at if first is None else min(first, at), at if last is None else max(last, at)
                    if kind == "end" or n >= cap:
                        out.append((key[0], n, first, last, "end" if kind == "end" else "full"))
                        n, first, last = 0, None, None
            if n:
                state.update((n, first, last))
                state.setTimeoutTimestamp(last // 1000 + lease_ms)
            elif state.exists:
                state.remove()
        rows = pd.DataFrame(out, columns=["session", "events", "first", "last", "ended"])
        for c in ("first", "last"):
            rows[c] = pd.to_datetime(rows[c].astype("int64"), unit="us")
        yield rows

    return events.withWatermark("ts", late).groupBy("session").applyInPandasWithState(step, schema, "n long, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)
