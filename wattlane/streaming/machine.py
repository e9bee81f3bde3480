"""One state machine per device: rolling spikes, silence, cooldowns and the registry entry.

Messages of a device are handled in order of arrival (of one instant: status before
readings, then by offset). The state holds

* the samples of each field that a spike rule reads, for the longest window of the field,
* the silence timer: a device whose last status is live goes offline ``timeout`` after it was
  last seen (by a status, or by any message with ``liveness="any"``), but not within a
  cooldown of its last such failure,
* the last alert of each (event type, severity), for one alert cooldown,
* the registry entry: firmware and first arrival of the first message, last status.

An offline transition clears the samples, so no baseline reaches back over it. Timers run in
event time on arrival. All but the registry entry expires: a timer at the last expiry removes
samples, marks and the last failure of a device that has gone quiet.

The output has one row per finding; ``kind`` says which columns it fills:

| kind | columns |
| --- | --- |
| spike | offset, rule, at_us, ref_us (time of the reading), value, base (the baseline) |
| offline | at_us, ref_us (last seen) |
| alert | offset (null for an offline transition), rule, at_us |
| unknown | offset of a reported event whose device is not registered |
| device | the registry entry: at_us (last arrival), ref_us (last seen), first_us, firmware, status |
"""
from __future__ import annotations

from bisect import bisect_left, insort_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import micros
from ..operators import rules
from ..schemas import DEFAULT_DEVICE_STATUS
from ..settings import Settings
from ..sources.rules_config import Rule

FINDINGS = (
    "device_id STRING, kind STRING, offset LONG, rule STRING, at_us LONG, ref_us LONG, first_us LONG, "
    "value DOUBLE, base DOUBLE, firmware STRING, status STRING"
)
NAMES = [part.split()[0] for part in FINDINGS.split(", ")]
Finding = Row(*NAMES)
#: Order of the kinds of message within one instant.
STATUS, READING, REPORT = 0, 1, 2
ASLEEP = ("offline", "maintenance")
OFFLINE_RULE, OFFLINE_KEY = "device_offline_heartbeat", ("DEVICE_FAILURE", "CRITICAL")
US, MS = 1_000_000, 1_000


@dataclass(frozen=True)
class Spike:
    """A spike rule as the machine needs it."""

    name: str
    field: int
    window_us: int
    percent: float
    key: str | None  # of its alerts; null if it gives none


@dataclass
class Device:
    """The registry entry and the silence timer, in microseconds."""

    seen: int | None = None
    due: int | None = None  # earliest time of the silence, while live
    failed: int | None = None
    status: str = DEFAULT_DEVICE_STATUS
    firmware: str | None = None
    first: int | None = None
    last: int | None = None
    timer: int | None = None  # the one timer that is registered, in milliseconds

    SCHEMA = "seen long, due long, failed long, status string, firmware string, first long, last long, timer long"

    def row(self) -> tuple:
        return (self.seen, self.due, self.failed, self.status, self.firmware, self.first, self.last, self.timer)


class Series:
    """Samples of one field in order of time."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, float]] = []

    def baseline(self, since: int) -> float | None:
        at = bisect_left(self.rows, since, key=lambda r: r[0])
        return self.rows[at][1] if at < len(self.rows) else None

    def add(self, t: int, x: float) -> None:
        insort_right(self.rows, (t, x), key=lambda r: r[0])

    def cut(self, since: int) -> None:
        del self.rows[:bisect_left(self.rows, since, key=lambda r: r[0])]


def alert_key(event_type: str, severity: str) -> str:
    return f"{event_type}\x1f{severity}"


class DeviceMachine(StatefulProcessor):
    def __init__(self, spikes: Sequence[Spike], fields: int, timeout_us: int, cooldown_us: int, alert_us: int,
                 offline_alerts: bool, readings_live: bool = False) -> None:
        self.spikes = list(spikes)
        self.timeout_us, self.cooldown_us, self.alert_us = timeout_us, cooldown_us, alert_us
        self.offline_alerts, self.readings_live = offline_alerts, readings_live
        self.longest = [max((s.window_us for s in spikes if s.field == f), default=0) for f in range(fields)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.device_state = handle.getValueState("device", Device.SCHEMA)
        self.sample_state = handle.getListState("samples", "field int, t long, x double")
        self.mark_state = handle.getListState("marks", "name string, t long")

    # State of one key, held in memory while its rows are handled. Each call to the state is a
    # message to the JVM, so what is not there is not asked for and what is as before not written.

    def _load(self, key: tuple) -> None:
        self.id = key[0]
        self.entry = self.device_state.get()
        self.device = Device(*self.entry) if self.entry is not None else Device()
        known = self.entry is not None
        self.held_samples = [tuple(s) for s in self.sample_state.get()] if known else []
        self.held_marks = [tuple(m) for m in self.mark_state.get()] if known else []
        self.series = [Series() for _ in self.longest]
        for field, t, x in self.held_samples:
            if field < len(self.series):
                self.series[field].rows.append((t, x))
        self.marks = dict(self.held_marks)
        self.out: list[Row] = []

    def _save(self, now: int) -> None:
        for series, longest in zip(self.series, self.longest, strict=True):
            series.cut(now - longest)
        self.marks = {k: t for k, t in self.marks.items() if t + self.alert_us > now}
        if self.device.failed is not None and self.device.failed + self.cooldown_us <= now:
            self.device.failed = None
        samples = [(f, t, x) for f, series in enumerate(self.series) for t, x in series.rows]
        marks = list(self.marks.items())
        for state, before, after in ((self.sample_state, self.held_samples, samples), (self.mark_state, self.held_marks, marks)):
            if after != before:
                state.put(after) if after else state.clear()
        ends = [t + self.alert_us for t in self.marks.values()]
        ends += [series.rows[-1][0] + longest + 1 for series, longest in zip(self.series, self.longest, strict=True) if series.rows]
        if self.device.failed is not None:
            ends.append(self.device.failed + self.cooldown_us)
        silence = self._silence()
        # While live the silence comes first; what has expired by then goes with it.
        at = silence if silence is not None else max(ends, default=None)
        timer = None if at is None else -(-at // MS)  # rounded up: never early
        if timer != self.device.timer:
            if self.device.timer is not None:
                self.handle.deleteTimer(self.device.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
            self.device.timer = timer
        if self.device.row() != self.entry:
            self.device_state.update(self.device.row())

    def _emit(self, kind: str, **values) -> None:
        self.out.append(Finding(self.id, kind, *[values.get(n) for n in NAMES[2:]]))

    def _entry(self) -> None:
        d = self.device
        if d.first is not None:
            self._emit("device", at_us=d.last, ref_us=d.seen, first_us=d.first, firmware=d.firmware, status=d.status)

    # Transitions.

    def _silence(self) -> int | None:
        d = self.device
        if d.due is None:
            return None
        return d.due if d.failed is None else max(d.due, d.failed + self.cooldown_us)

    def _alert(self, name: str, at: int, rule: str, offset: int | None) -> None:
        last = self.marks.get(name)
        if last is None or at - last >= self.alert_us:
            self.marks[name] = at
            self._emit("alert", offset=offset, rule=rule, at_us=at)

    def _go_offline(self, at: int) -> None:
        d = self.device
        d.failed, d.due, d.status, d.last = at, None, "offline", max(at, d.last)
        self._emit("offline", at_us=at, ref_us=d.seen)
        for series in self.series:
            series.cut(at)
        if self.offline_alerts:
            self._alert(alert_key(*OFFLINE_KEY), at, OFFLINE_RULE, None)

    def _register(self, t: int, firmware: str | None) -> None:
        if self.device.first is None:
            self.device.first, self.device.firmware = t, firmware
        self.device.last = t

    def _read(self, t: int, offset: int, seen: int, values: list) -> None:
        for spike in self.spikes:
            x = values[spike.field]
            base = None if x is None else self.series[spike.field].baseline(t - spike.window_us)
            if base is not None and base > 0 and (x - base) / base * 100.0 >= spike.percent:
                self._emit("spike", offset=offset, rule=spike.name, at_us=t, ref_us=seen, value=x, base=base)
                if spike.key is not None:
                    self._alert(spike.key, t, spike.name, offset)
        for series, longest, x in zip(self.series, self.longest, values, strict=True):
            if x is not None and longest:
                series.add(t, x)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load(key)
        fields = [f"x{i}" for i in range(len(self.longest))]
        t = 0
        for row in sorted(rows, key=lambda r: (r["t"], r["order"], r["offset"] is None, r["offset"] or 0)):
            t, order, offset, seen = row["t"], row["order"], row["offset"], row["seen"]
            status, firmware, x = row["status"], row["firmware"], [row[f] for f in fields]
            silence = self._silence()
            # A status at the very moment of the silence is in time for it; a reading is not.
            if silence is not None and (silence < t or (silence == t and order != STATUS)):
                self._go_offline(silence)
            if order == REPORT and self.device.first is None:
                self._emit("unknown", offset=offset)
                continue
            if order != REPORT:
                self._register(t, firmware)
            d = self.device
            if order == STATUS:
                d.status, d.seen = status, seen
                d.due = None if status in ASLEEP else max(t, seen + self.timeout_us)
            elif order == READING and self.readings_live and d.due is not None:
                d.seen = max(d.seen, seen)
                d.due = max(t, d.seen + self.timeout_us)
            for cause in row["causes"] or ():
                self._alert(cause["name"], t, cause["rule"], offset)
            if order == READING:
                self._read(t, offset, seen, x)
        self._entry()
        self._save(t)
        yield from self.out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load(key)
        now = int(expiredTimerInfo.getExpiryTimeInMs()) * MS
        silence = self._silence()
        if silence is not None and silence <= now:
            self._go_offline(silence)
            self._entry()
        self._save(now)
        yield from self.out

    def close(self) -> None:
        pass


def spike_rules(rule_list: Sequence[Rule]) -> list[Rule]:
    return [r for r in rule_list if rules.complete_spike(r) and r.field in rules.NUMERIC_FIELDS]


def _alerts(settings: Settings, severity: str) -> bool:
    return settings.alerts_enabled and (severity == "CRITICAL" or not settings.alert_critical_only)


def _cause(rule: Column, event_type: Column, severity: Column, settings: Settings) -> Column:
    """A struct of alert key and rule, null where the severity gives no alert."""
    wanted = F.lit(settings.alerts_enabled)
    if settings.alert_critical_only:
        wanted = wanted & (severity == "CRITICAL")
    return F.when(wanted, F.struct(F.concat(event_type, F.lit("\x1f"), severity).alias("name"), rule.alias("rule")))


def machine_rows(checked: DataFrame, rule_list: Sequence[Rule], settings: Settings) -> DataFrame:
    """What the machine needs of each valid message."""
    proposed = settings.processing_mode == "proposed"
    order = F.when(F.col("message_type") == "status", STATUS).when(F.col("message_type") == "telemetry", READING).otherwise(REPORT)
    none = F.array().cast("array<struct<name:string,rule:string>>")
    fired = rules.threshold_array(rule_list if proposed else [], set(rules.NUMERIC_FIELDS))
    of_reading = none if fired is None else F.transform(
        fired, lambda h: _cause(h["rule_name"], h["event_type"], h["severity"], settings))
    down = (F.col("status") == "offline") & F.lit(proposed)
    of_status = F.array(F.when(down, _cause(F.lit("device_offline_status"), *map(F.lit, OFFLINE_KEY), settings)))
    of_report = F.array(_cause(F.lit("device_event"), F.col("event_type"), F.col("severity"), settings))
    causes = F.when(order == READING, of_reading).when(order == STATUS, of_status).otherwise(of_report)
    return checked.where(F.col("error_type").isNull() & F.col("device_id").isNotNull()).select(
        "device_id", "received_at", micros("received_at").alias("t"), order.alias("order"), "offset",
        micros("time").alias("seen"), F.when(order == STATUS, F.col("status")).alias("status"),
        F.col("firmware_version").alias("firmware"), F.filter(causes, lambda c: c.isNotNull()).alias("causes"),
        *[F.when(order == READING, F.col(f)).alias(f"x{i}") for i, f in enumerate(rules.NUMERIC_FIELDS)])


def device_findings(
    checked: DataFrame, rule_list: Sequence[Rule], settings: Settings = Settings(), lag: str = "5 seconds"
) -> DataFrame:
    """The findings (``FINDINGS``) of a stream of checked messages.

    ``lag`` is how far arrivals may be out of order over the parts of a batch's source; what
    comes later than that has no part in spikes and silence (its thresholds are judged all the same).
    """
    spikes = [
        Spike(r.name, rules.NUMERIC_FIELDS.index(r.field), max(1, int(r.window_seconds * US)), float(r.percent),
              alert_key(r.event_type, r.severity) if _alerts(settings, r.severity) else None)
        for r in spike_rules(rule_list)] if settings.processing_mode == "proposed" else []
    machine = DeviceMachine(
        spikes, len(rules.NUMERIC_FIELDS), int(settings.heartbeat_timeout_seconds * US), int(settings.heartbeat_cooldown_seconds * US),
        int(settings.alert_cooldown_seconds * US), _alerts(settings, OFFLINE_KEY[1]),
        settings.liveness == "any")
    rows = machine_rows(checked, rule_list, settings).withWatermark("received_at", lag)
    return rows.groupBy("device_id").transformWithState(machine, FINDINGS, "append", "eventTime")
