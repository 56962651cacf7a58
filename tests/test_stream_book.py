"""Entries of a stream's key: few calls of the state store, and a bounded number in memory."""

import pandas as pd

from tallyline.streaming import stateful


class Store:
    def __init__(self, entries=()):
        self.rows, self.calls = dict(entries), []

    def exists(self):
        return bool(self.rows)

    def getValue(self, key):
        self.calls.append("get")
        return self.rows.get(key)

    def containsKey(self, key):
        self.calls.append("contains")
        return key in self.rows

    def updateValue(self, key, value):
        self.calls.append("update")
        self.rows[key] = value

    def removeKey(self, key):
        self.calls.append("remove")
        del self.rows[key]


def test_a_key_without_entries_reads_none():
    store = Store()
    book = stateful._Book(store)
    for i in range(5):
        assert book.get(i) is None
        book.put(i, (i,))
    book.put(3, None)
    book.put(9, None)
    book.write()
    assert store.calls == ["update"] * 4 and store.rows == {(i,): (i,) for i in (0, 1, 2, 4)}


def test_memory_is_bounded_and_entries_survive(monkeypatch):
    monkeypatch.setattr(stateful, "HELD", 3, raising=False)
    store = Store({(100,): (7,), (101,): (8,)})
    book = stateful._Book(store)
    for i in range(20):
        assert book.get(i) is None
        book.put(i, (i,))
        assert len(book.seen) <= 3
    assert book.get(100) == (7,) and book.get(4) == (4,)
    book.put(4, None)
    book.put(101, None)
    book.write()
    assert (4,) not in store.rows and (101,) not in store.rows and store.rows[100,] == (7,) and store.rows[19,] == (19,)


def test_rows_leave_as_soon_as_they_are_a_batch(monkeypatch):
    monkeypatch.setattr(stateful, "BATCH", 2)
    rows = [(1,)]
    assert not list(stateful._full(rows, ["a"])) and rows == [(1,)]
    rows.append((2,))
    assert [list(p["a"]) for p in stateful._full(rows, ["a"])] == [[1, 2]] and rows == []


class Kept(Store):
    def get(self):
        return self.rows["v"]

    def update(self, value):
        self.rows["v"] = value

    def clear(self):
        self.calls.append("clear")
        self.rows.clear()

    def iterator(self):
        self.calls.append("read")
        return iter(sorted(self.rows.items()))


class Timed:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Kept())

    def getValueState(self, name, value):
        return self.states.setdefault(name, Kept())

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class At:
    def __init__(self, mark, at):
        self.mark, self.at = mark, at

    def getCurrentWatermarkInMs(self):
        return self.mark

    def getExpiryTimeInMs(self):
        return self.at


def due(processor, handle, mark):
    """What the timers before ``mark`` charge."""
    out = []
    while ready := [t for t in handle.timers if t < mark]:
        handle.timers.remove(ready[0])
        out += [tuple(r) for pdf in processor.handleExpiredTimer((1,), At(mark, ready[0]), At(mark, ready[0])) for r in pdf.itertuples(index=False)]
    return sorted(out)


def test_unknown_work_takes_one_timer_and_one_call_per_open_task(monkeypatch):
    handle, processor = Timed(), stateful._Unknown(100)
    processor.init(handle)
    rows = [(i, "dispatch", i, 10 * i) for i in range(40)] + [(i, "settle", 0, 10 * i + 5) for i in range(0, 40, 4)]
    feed = lambda x: list(processor.handleInputRows((1,), iter([pd.DataFrame(x, columns=["task_id", "op", "units", "at_ms"])]), None))
    feed(rows)
    work = handle.states["work"]
    assert work.calls == ["update"] * 30 and handle.timers == [100]
    left = [(1, i, i, 10 * i + 100) for i in range(40) if i % 4]
    assert due(processor, handle, 200) == [r for r in left if r[3] < 200]
    assert work.calls.count("read") == 1 and handle.timers == [200]
    feed([(50, "dispatch", 7, 60), (11, "settle", 0, 61), (13, "dispatch", 8, 1000), (13, "dispatch", 9, 900)])
    assert handle.timers == [160]
    monkeypatch.setattr(stateful, "HELD", 4)
    want = sorted([r for r in left if r[3] >= 200 and r[1] not in (11, 13)] + [(1, 50, 7, 160)])
    assert due(processor, handle, 800) == want and work.rows == {(13,): (8, 1100)}
    assert due(processor, handle, 1100) == [] and due(processor, handle, 1101) == [(1, 13, 8, 1100)]
    assert not work.rows and not handle.timers and not handle.states["first"].rows
