"""How often a micro-batch asks for state, windows and time ranges."""
from __future__ import annotations

from datetime import datetime, timedelta

from wattlane.operators import sequences, verifier
from wattlane.plans.queries_stream import window_means
from wattlane.schemas import KEYS
from wattlane.sources.tables import TableStore
from wattlane.streaming import ingest, machine


class State:
    def __init__(self, calls, name):
        self.calls, self.name, self.value = calls, name, None

    def get(self):
        self.calls.append(f"{self.name}.get")
        return self.value if self.name == "device" else iter(self.value or [])

    def _set(self, value, call):
        self.calls.append(f"{self.name}.{call}")
        self.value = value

    def put(self, value):
        self._set(value, "put")

    def update(self, value):
        self._set(value, "update")

    def clear(self):
        self._set(None, "clear")


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getValueState(self, name, schema):
        return State(self.calls, name)

    getListState = getValueState

    def listTimers(self):
        self.calls.append("list")
        return iter(sorted(self.timers))

    def deleteTimer(self, t):
        self.calls.append("delete")
        self.timers.discard(t)

    def registerTimer(self, t):
        self.calls.append("register")
        self.timers.add(t)


def _row(t, order, offset, status=None, x=None):
    return {"t": t, "order": order, "offset": offset, "seen": t, "status": status, "firmware": "f", "causes": [], "x0": x}


def test_a_device_asks_for_no_more_state_than_it_has():
    s = 1_000_000
    handle = Handle()
    m = machine.DeviceMachine([machine.Spike("jump", 0, 60 * s, 30.0, None)], 1, 30 * s, 300 * s, 300 * s, True)
    m.init(handle)
    list(m.handleInputRows(("a",), iter([_row(s, machine.STATUS, 1, "online")]), None))
    assert handle.calls == ["device.get", "register", "device.update"] and handle.timers == {31_000}
    handle.calls.clear()
    list(m.handleInputRows(("a",), iter([_row(2 * s, machine.READING, 2, x=100.0)]), None))
    # The silence is due when it was: its timer stays.
    assert handle.calls == ["device.get", "samples.get", "marks.get", "samples.put", "device.update"] and handle.timers == {31_000}
    handle.calls.clear()
    out = list(m.handleInputRows(("a",), iter([_row(3 * s, machine.STATUS, 3, "online"), _row(4 * s, machine.READING, 4, x=200.0)]), None))
    assert [r.kind for r in out] == ["spike", "device"] and handle.timers == {33_000} and "list" not in handle.calls

    class Expired:
        def getExpiryTimeInMs(self):
            return 33_000

    out = list(m.handleExpiredTimer(("a",), None, Expired()))
    assert [r.kind for r in out] == ["offline", "alert", "device"]
    assert handle.timers == {333_000}  # the one cooldown's end


def test_windows_of_a_batch_are_counted_once(spark, tmp_path, monkeypatch):
    t0 = datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(d, i, t0 + timedelta(seconds=i), 220.0, 5.0, 1000.0 + i, None if i % 5 else 40.0) for d in "ab" for i in range(19)], ingest.OPEN_WINDOW)
    expected = sorted(map(tuple, verifier.verdicts(rows.where("device_id = 'a'"), window_means()).collect()))
    asked, count = [], sequences.count_windows

    def counted(*args, **options):
        asked.append(1)
        return count(*args, **options)

    monkeypatch.setattr(sequences, "count_windows", counted)
    monkeypatch.setattr(verifier, "count_windows", counted)
    store = TableStore(spark, str(tmp_path))
    for version, part in ((1, "offset < 11"), (2, "offset >= 11")):
        ingest.write_verdicts(store, rows.where(f"device_id = 'a' AND {part}"), window_means(), version)
    assert len(asked) == 2
    found = store.scan("verdicts").select("device_id", "window_id", "offset", "recon_error", "threshold", "confirmed")
    assert sorted(map(tuple, found.collect())) == expected and len(expected) == 16
    assert store.state("open_windows", 3, ingest.OPEN_WINDOW).count() == 3


def test_range_of_times_from_other_rows(spark, tmp_path):
    """The range may come from rows that have more times; what is new stays the same."""
    store = TableStore(spark, str(tmp_path))
    t0 = datetime(2024, 1, 1, 23, 59)
    some = spark.createDataFrame([(t0 + timedelta(seconds=30 * i), f"d{i}") for i in range(6)], "time timestamp, device_id string")
    assert list(KEYS["reading_keys"]) == ["time", "device_id"]
    store.append("reading_keys", some.where("device_id < 'd3'"), 1)
    new = store.unseen("reading_keys", some.where("device_id <> 'd5'"), 2, among=some)
    assert sorted(r.device_id for r in new.collect()) == ["d3", "d4"]
    assert store.unseen("reading_keys", some.where("false"), 2, among=some).count() == 0
