"""Bursts of change events: an event belongs to the burst before it unless a quiet spell lies between, or that burst's last event came ``limit`` or more after its first.

A quiet spell begins a burst whatever was before, but a limit is counted from a burst's first event, so each burst of a busy stretch depends on the one before. For a table the events are dealt
in ranges of time. A range with a quiet spell leaves the same open burst behind however it was entered; one without gives a small table: for the times within ``limit`` of its
border at which the open burst may be full, the burst that is open at its end. These tables (a few rows for each range) are followed from range to range, and then each range
cuts itself. No task holds more than a range, whatever the length of a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.work import stored
from .live import ROCKSDB

OUT = "first_ts timestamp, last_ts timestamp, n long, first_seq long, last_seq long"


def next_starts(t: np.ndarray, quiet: int, limit: int) -> np.ndarray:
    """For each event (times rising): the next one that begins a burst, if this one does; len(t) if none."""
    n = len(t)
    # A burst takes in the event after the first that is limit or more behind its start, but not the one after that.
    full = np.minimum(np.searchsorted(t, t + limit, "left") + 1, n)
    full = np.maximum(full, np.arange(n) + 1)
    breaks = np.flatnonzero(np.diff(t) >= quiet) + 1
    quiet_at = np.append(breaks, n)[np.searchsorted(breaks, np.arange(n), "right")]
    return np.minimum(full, quiet_at)


def last_starts(following: np.ndarray) -> np.ndarray:
    """For each event: the last one that begins a burst on the way from it."""
    n = len(following)
    to = np.where(following < n, following, np.arange(n))
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def _entered(t: np.ndarray, start: int, before: int, quiet: int, limit: int) -> int:
    """The first event of a range that begins a burst, if one from ``start`` is open and ``before`` is the last event's time so far."""
    if t[0] - before >= quiet or before - start >= limit:
        return 0
    first_quiet = np.flatnonzero(np.diff(t) >= quiet)
    full = int(np.searchsorted(t, start + limit, "left")) + 1
    return min(len(t), full, int(first_quiet[0]) + 1 if len(first_quiet) else len(t))


def bursts(events: DataFrame, quiet_ms: int = 300, limit_ms: int = 2000) -> DataFrame:
    """first_ts, last_ts, n, first_seq, last_seq of the bursts of a table of events (seq, ts); of events at one time the smaller seq is earlier."""
    spark, quiet, limit = events.sparkSession, quiet_ms * 1000, limit_ms * 1000
    rows = events.select(F.unix_micros("ts").alias("t"), "seq").filter("t IS NOT NULL")
    ranged = stored(rows.repartitionByRange("t", "seq").withColumn("range", F.spark_partition_id().cast("long")), "ranges")
    edges = [tuple(r) for r in ranged.groupBy("range").agg(F.min("t"), F.max("t")).orderBy("range").collect()]  # one row for each range
    before = {r: (edges[k - 1][2] if k else None) for k, (r, _, _) in enumerate(edges)}

    def whole(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        t, seq = table["t"].to_numpy(), table["seq"].to_numpy()
        order = np.lexsort((seq, t))
        return table["range"][0].as_py(), t[order], seq[order]

    def left_open(table: pa.Table) -> pa.Table:
        """range, upto, t, seq: the burst that is open at the range's end, if the one open at its start is full at a time of upto or less; null upto: however it was entered."""
        at, t, seq = whole(table)
        to = last_starts(next_starts(t, quiet, limit))
        breaks = np.flatnonzero(np.diff(t) >= quiet) + 1
        if before[at] is None or t[0] - before[at] >= quiet or len(breaks):
            end = to[breaks[-1] if len(breaks) else 0]
            return pa.table({"range": [at], "upto": pa.array([None], pa.int64()), "t": [int(t[end])], "seq": [int(seq[end])]})
        some = min(len(t), int(np.searchsorted(t, before[at] + limit, "left")) + 2)  # of these one is the first to begin a burst, or none is
        full = np.concatenate(([before[at]], t[: some - 1]))  # what must have come before each
        last = np.append(np.flatnonzero(np.diff(to[:some])), some - 1)  # runs that end alike
        return pa.table({"range": np.full(len(last), at), "upto": full[last], "t": t[to[last]], "seq": seq[to[last]]})

    found: dict[int, list[tuple]] = {}
    for r in ranged.groupBy("range").applyInArrow(left_open, "range long, upto long, t long, seq long").collect():
        found.setdefault(r["range"], []).append((r["upto"], r["t"], r["seq"]))
    firsts: dict[int, tuple | None] = {}
    state: tuple[int, int] | None = None
    for r, _, _ in edges:
        firsts[r] = state
        for upto, t, seq in sorted(found[r], key=lambda e: (e[0] or 0, e[1])):
            if upto is None or state[0] + limit <= upto:
                state = (t, seq)
                break

    def cut(table: pa.Table) -> pa.Table:
        at, t, seq = whole(table)
        following, start = next_starts(t, quiet, limit), firsts[at]
        k = 0 if start is None else _entered(t, start[0], before[at], quiet, limit)
        head = k
        begins = []
        while k < len(t):
            begins.append(k)
            k = int(following[k])
        lows, first = ([0] if head else []) + begins, ([start] if head else []) + [(int(t[b]), int(seq[b])) for b in begins]
        highs = [*lows[1:], len(t)]
        return pa.table({"t": pa.array([f[0] for f in first], pa.int64()), "first": pa.array([f[1] for f in first], pa.int64()), "last_t": pa.array([int(t[h - 1]) for h in highs], pa.int64()), "n": pa.array([h - low for low, h in zip(lows, highs, strict=True)], pa.int64()),
            "first_seq": pa.array([int(seq[low:h].min()) for low, h in zip(lows, highs, strict=True)], pa.int64()), "last_seq": pa.array([int(seq[low:h].max()) for low, h in zip(lows, highs, strict=True)], pa.int64())})

    parts = ranged.groupBy("range").applyInArrow(cut, "t long, first long, last_t long, n long, first_seq long, last_seq long")
    one = parts.groupBy("t", "first").agg(F.max("last_t").alias("last_t"), F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))
    return one.select(F.timestamp_micros("t").alias("first_ts"), F.timestamp_micros("last_t").alias("last_ts"), "n", "first_seq", "last_seq")


class OpenBurst(StatefulProcessor):
    """The open burst of a root; a timer ends it after a quiet spell."""

    def __init__(self, quiet_ms: int, limit_ms: int):
        self.quiet, self.limit = quiet_ms * 1000, limit_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long, first_seq long, last_seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events, done = pd.concat(list(rows)).sort_values(["t", "seq"]), []
        now = tuple(self.open.get()) if self.open.exists() else None
        for t, seq in zip(events["t"].tolist(), events["seq"].tolist(), strict=True):
            if now is not None and (t - now[1] >= self.quiet or now[1] - now[0] >= self.limit):
                done.append(now)
                now = None
            now = (t, t, 1, seq, seq) if now is None else (now[0], max(now[1], t), now[2] + 1, min(now[3], seq), max(now[4], seq))
        self.open.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((now[1] + self.quiet) // 1000 + 1)
        yield self._frame(key, done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = [tuple(self.open.get())] if self.open.exists() else []
        self.open.clear()
        yield self._frame(key, done)

    @staticmethod
    def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = ["root", "first_us", "last_us", "n", "first_seq", "last_seq"]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=names).astype({"root": "object", **dict.fromkeys(names[1:], "int64")})

    def close(self) -> None:
        pass


def live_bursts(events: DataFrame, quiet_ms: int = 300, limit_ms: int = 2000, late: str = "0 seconds") -> DataFrame:
    """The bursts of each root of a stream of events (root, seq, ts) that come in the order of their times: root, first_us, last_us, n, first_seq, last_seq, once each, when a burst has ended."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.withWatermark("ts", late).select("root", "ts", "seq", F.unix_micros("ts").alias("t"))
    return rows.groupBy("root").transformWithStateInPandas(OpenBurst(quiet_ms, limit_ms), "root string, first_us long, last_us long, n long, first_seq long, last_seq long", "Append", "EventTime")
