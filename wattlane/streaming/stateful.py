"""Per-device state on streams: spikes, cooldown, heartbeat, count windows.

Each processor gives the same rows as its batch operator on the same input in
the same arrival order.  State per device is bounded: the samples of one rule
window, one time, or fewer rows than a window.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MS = 1000


def _ordered(rows: Iterator[pd.DataFrame], by: Sequence[str]) -> pd.DataFrame:
    """This batch's rows of one device, in order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


class SpikeProcessor(StatefulProcessor):
    """Baseline of each sample: the oldest sample of the last window."""

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "t long, x double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows, ["t", "offset"])
        held = deque((r[0], r[1]) for r in self.samples.get())
        out = []
        for offset, t, x in zip(frame["offset"], frame["t"], frame["x"]):
            while held and held[0][0] < t - self.window_us:
                held.popleft()
            out.append((key[0], int(offset), float(x), held[0][1] if held else None))
            held.append((int(t), float(x)))
        self.samples.put(list(held))
        yield pd.DataFrame(out, columns=["device_id", "offset", "value", "baseline"])

    def close(self) -> None:
        pass


def spike_stream(readings: DataFrame, field: str, window_seconds: float, clock: str = "received_at") -> DataFrame:
    """Streaming form of the spike baseline."""
    rows = readings.where(F.col(field).isNotNull()).select(
        "device_id", "offset", F.unix_micros(clock).alias("t"), F.col(field).cast("double").alias("x")
    )
    return rows.groupBy("device_id").transformWithStateInPandas(
        SpikeProcessor(int(window_seconds * 1_000_000)),
        "device_id STRING, offset LONG, value DOUBLE, baseline DOUBLE", "append", "none",
    )


class CooldownProcessor(StatefulProcessor):
    """Rows that pass the cooldown of their key."""

    def __init__(self, cooldown_us: int, columns: Sequence[str]) -> None:
        self.cooldown_us = cooldown_us
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows, ["at_us", "offset"])
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for t in frame["at_us"]:
            passes = last is None or t - last >= self.cooldown_us
            last = int(t) if passes else last
            keep.append(passes)
        self.last.update((last,))
        yield frame.loc[keep, self.columns]

    def close(self) -> None:
        pass


def cooldown_stream(events: DataFrame, keys: Sequence[str], time: str, seconds: float) -> DataFrame:
    """Streaming form of the cooldown; ``events`` carry an offset."""
    fields = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)
    return events.withColumn("at_us", F.unix_micros(time)).groupBy(*keys).transformWithStateInPandas(
        CooldownProcessor(int(seconds * 1_000_000), events.columns), fields, "append", "none"
    )


class HeartbeatProcessor(StatefulProcessor):
    """Offline transitions by silence, driven by status rows and event-time timers.

    State is (last seen, is live, last failure) in microseconds.
    """

    def __init__(self, timeout_us: int, cooldown_us: int) -> None:
        self.timeout_us = timeout_us
        self.cooldown_us = cooldown_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.device = handle.getValueState("device", "seen long, live boolean, failed long")

    def _deadline(self, seen: int, failed: int | None) -> int:
        at = seen + self.timeout_us
        return at if failed is None else max(at, failed + self.cooldown_us)

    def _load(self):
        return tuple(self.device.get()) if self.device.exists() else (None, False, None)

    def _rows(self, key, fired) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], s, f) for s, f in fired], columns=["device_id", "last_us", "offline_us"])
        return frame.astype({"last_us": "int64", "offline_us": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, live, failed = self._load()
        fired = []
        frame = _ordered(rows, ["t", "offset"])
        for t, status in zip(frame["t"], frame["status"]):
            t = int(t)
            if live and self._deadline(seen, failed) < t:
                failed = self._deadline(seen, failed)
                fired.append((seen, failed))
            seen, live = t, status not in ("offline", "maintenance")
        self.device.update((seen, live, failed))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if live:
            # Timers count in milliseconds: round up, never fire early.
            self.handle.registerTimer(-(-self._deadline(seen, failed) // MS))
        yield self._rows(key, fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, live, failed = self._load()
        fired = []
        if live:
            failed = self._deadline(seen, failed)
            fired.append((seen, failed))
            self.device.update((seen, False, failed))
        yield self._rows(key, fired)

    def close(self) -> None:
        pass


def heartbeat_stream(
    status: DataFrame, timeout_seconds: float = 30, cooldown_seconds: float = 300, lateness: str = "86400 seconds"
) -> DataFrame:
    """Streaming form of the heartbeat failures, in event time."""
    rows = status.select("device_id", "time", "offset", "status", F.unix_micros("time").alias("t"))
    fired = rows.withWatermark("time", lateness).groupBy("device_id").transformWithStateInPandas(
        HeartbeatProcessor(int(timeout_seconds * 1_000_000), int(cooldown_seconds * 1_000_000)),
        "device_id STRING, last_us LONG, offline_us LONG", "append", "eventTime",
    )
    return fired.select(
        "device_id", F.timestamp_micros("last_us").alias("last_seen"), F.timestamp_micros("offline_us").alias("offline_at")
    )


class CountWindowProcessor(StatefulProcessor):
    """Windows of a fixed number of readings per device."""

    def __init__(self, size: int, columns: Sequence[str], schema: str) -> None:
        self.size = size
        self.columns = list(columns)
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", self.schema)
        self.done = handle.getValueState("done", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows, ["offset"])[self.columns]
        held = [tuple(r) for r in self.buffer.get()]
        held += [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False, name=None)]
        first = int(self.done.get()[0]) if self.done.exists() else 0
        full = len(held) // self.size
        out = pd.DataFrame(held[: full * self.size], columns=self.columns)
        out["window_id"] = [first + i // self.size for i in range(len(out))]
        out["window_pos"] = [i % self.size for i in range(len(out))]
        rest = held[full * self.size:]
        self.buffer.put(rest) if rest else self.buffer.clear()
        self.done.update((first + full,))
        yield out

    def close(self) -> None:
        pass


def count_window_stream(readings: DataFrame, size: int = 8) -> DataFrame:
    """Streaming form of the count windows; rows need device_id and offset."""
    fields = ", ".join(f"`{n}` {t}" for n, t in readings.dtypes)
    return readings.groupBy("device_id").transformWithStateInPandas(
        CountWindowProcessor(size, readings.columns, fields),
        fields + ", window_id LONG, window_pos INT", "append", "none",
    )
