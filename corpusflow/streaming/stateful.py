"""Keyed stream state: rate limits, cached values and alerts held per key, each with event-time expiry.

State lives in Spark's state store (RocksDB), one small value or list per key; a batch touches only the keys it has rows
for, and a timer removes a key's state once the watermark has passed its use. Rows behind the watermark get no answer,
as in every watermarked operator.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the setting of the session comes back afterwards."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER_KEY) if before is None else spark.conf.set(PROVIDER_KEY, before)


def _gathered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


class _Keyed(StatefulProcessor):
    """Shared timer handling: one timer per key, moved to the latest moment its state is needed."""

    handle: StatefulProcessorHandle

    def expire_at(self, moment_ms: int) -> None:
        waiting = list(self.handle.listTimers())
        if waiting and max(waiting) >= moment_ms:
            return
        for timer in waiting:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(moment_ms)

    def close(self) -> None:
        pass


class _Limiter(_Keyed):
    """Counts the requests of one (key, window) across batches."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _gathered(rows).sort_values(["us", "event_id"], kind="stable")
        before = self.used.get()[0] if self.used.exists() else 0
        place = before + np.arange(1, len(frame) + 1)
        start = int(key[-1])
        allowed = place <= self.limit
        self.used.update((min(int(place[-1]), self.limit),))
        self.expire_at((start + self.seconds) * 1000)
        yield pd.DataFrame({
            **{f"key{i}": [k] * len(frame) for i, k in enumerate(key[:-1])}, "event_id": frame["event_id"], "window_start": start, "allowed": allowed,
            "remaining": np.maximum(self.limit - place, 0), "reset_time": start + self.seconds,
            "retry_after": np.where(allowed, 0, start + self.seconds - frame["sec"])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())


def limited(requests: DataFrame, keys: Sequence[str], limit: int, seconds: int) -> DataFrame:
    """Streaming twin of ``monitoring.fixed_window_limit``: keys, event_id, window_start, allowed, remaining, reset_time, retry_after.

    ``requests`` has us, sec, event_id, the keys and a watermark. Requests of one batch count in the order of their time,
    those of later batches after them. A window's count goes when the watermark passes its end. A batch's requests of
    one key and window are one group; what a batch holds is bounded by the trigger.
    """
    # a request beyond the limit needs no more than its place, so the count kept is at most the limit
    framed = requests.withColumn("window_start", (F.floor(F.col("sec") / seconds) * seconds).cast("long"))
    kept = framed.select(*keys, "window_start", "event_id", "us", "sec", "at")
    schema = T.StructType([T.StructField(f"key{i}", requests.schema[k].dataType) for i, k in enumerate(keys)] + [
        T.StructField("event_id", T.LongType()), T.StructField("window_start", T.LongType()), T.StructField("allowed", T.BooleanType()),
        T.StructField("remaining", T.LongType()), T.StructField("reset_time", T.LongType()), T.StructField("retry_after", T.LongType())])
    out = kept.groupBy(*keys, "window_start").transformWithStateInPandas(_Limiter(limit, seconds), schema, "Append", "EventTime")
    return out.withColumnsRenamed({f"key{i}": k for i, k in enumerate(keys)})


class _Cache(_Keyed):
    """The writes of one key that a read at or behind the watermark can still need."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.writes = handle.getListState("writes", "sec long, entry long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _gathered(rows)
        stored = [tuple(w) for w in self.writes.get()] if self.writes.exists() else []
        fresh = frame[frame["is_write"]]
        known = stored + list(zip(fresh["sec"].tolist(), fresh["event_id"].tolist(), fresh["value"].tolist()))
        known.sort(key=lambda w: (w[0], w[1]))
        reads = frame[~frame["is_write"]]
        if len(reads):
            at = np.searchsorted([w[0] for w in known], reads["sec"].to_numpy(), side="right") - 1
            found = [known[i] if i >= 0 and known[i][0] > s - self.ttl and key[0] is not None else None for i, s in zip(at, reads["sec"])]
            yield pd.DataFrame({"read_id": reads["event_id"].to_numpy(), "k": pd.array([key[0]] * len(reads), "Int64"), "sec": reads["sec"].to_numpy(),
                                "cached_at": pd.array([f and f[0] for f in found], "Int64"), "payload": pd.array([f and f[2] for f in found], "Float64"),
                                "hit": [f is not None for f in found]})
        # a read still to come is not older than the watermark: of older writes only the last one can serve it
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        old = [w for w in known if w[0] <= mark]
        kept = [w for w in old[-1:] if w[0] > mark - self.ttl] + [w for w in known if w[0] > mark]
        if kept:
            self.writes.put(kept)
            self.expire_at((kept[-1][0] + self.ttl) * 1000)
        elif stored:
            self.writes.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.writes.clear()
        return iter(())


def cached(events: DataFrame, ttl: int, is_write: Column, is_read: Column) -> DataFrame:
    """Streaming twin of ``aggregates.latest_before``: read_id, k, sec, cached_at, payload, hit for every read.

    ``events`` has k, sec, event_id, value and a watermark ``at``. A read sees the latest write of its key at most ``ttl``
    seconds old that has arrived with it or before; reads of a null key miss.
    """
    rows = events.filter(is_write | is_read).select("k", "sec", "event_id", "value", "at", is_write.alias("is_write"))
    schema = "read_id long, k long, sec long, cached_at long, payload double, hit boolean"
    return rows.groupBy("k").transformWithStateInPandas(_Cache(ttl), schema, "Append", "EventTime")


class _Alerts(_Keyed):
    """Whether a rule is met for one series, since when, and whether that has been reported."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, hold long, severity string, fired boolean")

    def _report(self, key, rows) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["severity", "started", "state", "tick"])
        return frame.assign(rule=key[0], series=key[1])[["rule", "series", "severity", "started", "state", "tick"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.open.get()) if self.open.exists() else None
        out, frame = [], _gathered(rows).sort_values("tick", kind="stable")
        for tick, met, hold, severity in zip(frame["tick"].tolist(), frame["met"].tolist(), frame["hold"].tolist(), frame["severity"].tolist()):
            if now is None and met:
                now = (tick, hold, severity, False)
            elif now is not None:
                started, held, level, fired = now
                if not fired and tick - started >= held:
                    out.append((level, started, "firing", started + held))
                    now = (started, held, level, True)
                if not met:
                    if now[3]:
                        out.append((level, started, "resolved", tick))
                    now = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
            if not now[3]:
                self.handle.registerTimer((now[0] + now[1]) * 1000)
        if out:
            yield self._report(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            started, hold, severity, fired = self.open.get()
            if not fired:
                self.open.update((started, hold, severity, True))
                yield self._report(key, [(severity, started, "firing", started + hold)])


def alert_changes(judged: DataFrame) -> DataFrame:
    """Streaming twin of ``monitoring.held_alerts``: rule, series, severity, started, state, tick of every change.

    ``judged`` has rule, series, tick, met, hold, severity and a watermark ``at``; samples of a series come in order. A
    stretch is reported as firing when a sample or the watermark shows that it has held, and as resolved afterwards.
    """
    schema = "rule string, series long, severity string, started long, state string, tick long"
    rows = judged.select("rule", "series", "tick", "met", "hold", "severity", "at")
    return rows.groupBy("rule", "series").transformWithStateInPandas(_Alerts(), schema, "Append", "EventTime")
