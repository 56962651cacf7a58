"""Stateful processors against plain models, whole and split into batches."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyline.session import fresh_dir
from tallyline.streaming import jobs, stateful

LIMITS = ({"rpm": 3, "tpm": 40, "concurrency": 3}, {"rpm": 4, "tpm": 36, "concurrency": 4})
WIDTH, ATTEMPTS, BASE, CEILING = 100, 3, 20, 60


class Memory:
    """Stands in for the state store."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = tuple(value)


class Entries(dict):
    """Stands in for a map state; counts what is written."""

    written = 0

    def exists(self):
        return len(self) > 0

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self.written += 1
        self[key] = tuple(value)

    def removeKey(self, key):
        self.written += 1
        del self[key]

    def containsKey(self, key):
        return key in self

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.maps = {}

    def getValueState(self, name, schema):
        return Memory()

    def getMapState(self, name, key_schema, schema):
        return self.maps.setdefault(name, Entries())


def model(rows):
    """Two token buckets refilled at each window, leases, a reset time and retry states, one row at a time."""
    left, window = {}, None
    leases, calls, reset, out = {}, {}, 0, []
    for r in rows:
        w = r["at_ms"] // WIDTH
        if w != window:
            window, left = w, {s: {"rpm": lim["rpm"], "tpm": lim["tpm"]} for s, lim in zip(("provider", "global"), LIMITS)}
        who, n, why = r["logical"], r["tokens"], []
        call = calls.get(who)
        if r["op"] == "acquire":
            a = r["attempt"]
            if a == 0 and call:
                why = ["terminal" if call["over"] else "identity"]
            elif a > 0 and not call:
                why = ["identity"]
            elif a >= ATTEMPTS:
                why = ["retry_exhausted"]
            elif a > 0 and call["over"]:
                why = ["terminal"]
            elif a > 0 and (call["retry"] is None or a != call["last"] + 1):
                why = ["identity"]
            elif r["at_ms"] < reset:
                why = ["provider_reset"]
            elif a > 0 and r["at_ms"] < call["retry"]:
                why = ["retry_backoff"]
            else:
                for s, lim in zip(("provider", "global"), LIMITS):
                    why += [f"{s}_rpm"] * (left[s]["rpm"] < 1) + [f"{s}_tpm"] * (left[s]["tpm"] < n) + [f"{s}_concurrency"] * (len(leases) >= lim["concurrency"])
            if not why:
                for s in left:
                    left[s]["rpm"] -= 1
                    left[s]["tpm"] -= n
                leases[who] = (n, w)
                calls[who] = {"last": a, "retry": None, "over": False}
        elif who not in leases:
            why = ["no_lease"]
        elif n > leases[who][0]:
            why = ["actual_above_lease"]
        else:
            held, taken = leases.pop(who)
            if taken == w:
                for s in left:
                    left[s]["tpm"] += held - n
            nxt, retry = call["last"] + 1, None
            if r["op"] == "limited":
                reset = max(reset, r["at_ms"] + r["reset_ms"])
            if r["op"] != "complete" and nxt < ATTEMPTS:
                retry = r["at_ms"] + min(BASE * 2 ** (nxt - 1), CEILING)
                if r["op"] == "limited":
                    retry = max(retry, reset)
            call["retry"], call["over"] = retry, retry is None
        out.append((r["seq"], not why, "|".join(why), len(leases)))
    return out


def test_a_small_batch_writes_little():
    """A ledger, and a provider, with 100,000 closed ids take ten rows."""
    op = lambda seq, name, who, res, act: {"seq": seq, "operation": name, "attempt_id": who, "res_units": res, "act_units": act}
    ledger, handle = stateful._Ledger(10**9, None), Handle()
    ledger.init(handle)
    feed = lambda p, rows: [r for pdf in p.handleInputRows((1,), iter([pd.DataFrame(rows)]), None) for r in pdf.itertuples()]
    feed(ledger, [op(2 * i + j, name, i, 5 if not j else None, 5 if j else None) for i in range(100_000) for j, name in enumerate(("reserve", "settle"))])
    ids = handle.maps["ids"]
    assert len(ids) == 100_000
    ids.written = 0
    out = feed(ledger, [op(300_000 + i, "reserve", 99_995 + i, 5, None) for i in range(10)])
    assert [r.reason for r in out] == ["identity_conflict"] * 5 + [None] * 5 and ids.written == 5 and len(ids) == 100_005
    lim = {"rpm": 10**6, "tpm": 10**9, "concurrency": 10**6}
    quota, handle = stateful._Quota(lim, lim, 10**9, 3, 10, 100, None), Handle()
    quota.init(handle)
    call = lambda seq, name, who: {"seq": seq, "at_ms": seq, "op": name, "logical": who, "attempt": 0, "tokens": 1, "reset_ms": 0}
    feed(quota, [call(2 * i + j, name, i) for i in range(100_000) for j, name in enumerate(("acquire", "complete"))])
    handle.maps["calls"].written = 0
    out = feed(quota, [call(300_000 + i, "acquire", 99_995 + i) for i in range(10)])
    assert [r.reasons for r in out] == ["terminal"] * 5 + [""] * 5 and handle.maps["calls"].written == 5


def test_retention_forgets_ended_ids_only():
    op = lambda seq, name, who, res: {"seq": seq, "operation": name, "attempt_id": who, "res_units": res, "act_units": None}
    ledger, handle = stateful._Ledger(100, 50), Handle()
    ledger.init(handle)
    got = []
    for rows in ([op(1, "reserve", 7, 5), op(2, "cancel", 7, None), op(3, "reserve", 8, 5)], [op(60, "reserve", 9, 5)], [op(61, "reserve", 7, 5), op(62, "reserve", 8, 5)]):
        got += [r.reason for pdf in ledger.handleInputRows((1,), iter([pd.DataFrame(rows)]), None) for r in pdf.itertuples()]
    assert got == [None, None, None, None, None, "identity_conflict"] and set(handle.maps["ids"]) == {(7,), (8,), (9,)}


def test_deadline_of_the_first_attempt():
    lim = {"rpm": 9, "tpm": 99, "concurrency": 9}
    quota = stateful._Quota(lim, lim, 1000, 3, 10, 100, None)
    quota.init(Handle())
    row = lambda seq, at, op, who, attempt, deadline: {"seq": seq, "at_ms": at, "op": op, "logical": who, "attempt": attempt, "tokens": 1, "reset_ms": 0, "deadline_ms": deadline}
    rows = [row(1, 50, "acquire", 1, 0, 49), row(2, 50, "acquire", 1, 0, 70), row(3, 51, "fail", 1, 0, None), row(4, 90, "acquire", 1, 1, 500),
            row(5, 90, "acquire", 2, 0, None), row(6, 91, "fail", 2, 0, None), row(7, 10**6, "acquire", 2, 1, 5),
            row(8, 10**6, "acquire", 3, 0, 10**6 + 9), row(9, 10**6, "fail", 3, 0, None), row(10, 10**6 + 2, "acquire", 3, 1, None)]
    got = [r.reasons for pdf in quota.handleInputRows((1,), iter([pd.DataFrame(rows)]), None) for r in pdf.itertuples()]
    assert got == ["deadline", "", "", "deadline", "", "", "", "", "", "terminal"]  # the retry of call 3 would be due past its deadline


@pytest.mark.parametrize("batches", [1, 4])
def test_every_row_has_one_outcome(spark, batches):
    rnd = random.Random(9)
    rows, times = [], {}
    for pos in range(120):
        run, who = rnd.randint(1, 2), rnd.randint(max(0, pos // 3 - 30), pos // 3)
        at = times.setdefault((run, who), 10 * pos - rnd.choice([0, 0, 0, 300]))  # a repeat has the time of its row
        rows.append((run, who, pos, at, rnd.choice("ab")))
    df = spark.createDataFrame(rows, "run_id long, event_id long, pos long, at_ms long, digest string")
    path = fresh_dir(spark, "once")
    for k in range(batches):
        df.where(F.col("pos").between(k * 120 // batches, (k + 1) * 120 // batches - 1)).coalesce(1).write.mode("append").parquet(path)
    got = {r.pos: r.outcome for r in jobs.drain(stateful.append_outcomes(jobs.tail(spark, path, df.schema, 1), 250), "once").collect()}
    known, high, want, forgotten = {}, {}, {}, 0
    for run, who, pos, at, digest in rows:
        if (run, who) in known:
            want[pos] = "repeat" if known[run, who][0] == digest else "conflict"
            if got[pos] == "late":  # forgotten by then
                assert known[run, who][1] < high[run] - 250
                want[pos], forgotten = "late", forgotten + 1
        elif at < high.get(run, -(10**9)) - 250:
            want[pos] = "late"
        else:
            want[pos], known[run, who] = "accepted", (digest, at)
            high[run] = max(at, high.get(run, at))
    assert got == want and set(want.values()) == {"accepted", "repeat", "conflict", "late"}


def history(seed):
    rnd = random.Random(seed)
    at, rows, newest, waiting = 0, [], 0, []
    for seq in range(900):
        at += rnd.randint(1, 30) if seq % 200 < 100 else rnd.randint(0, 9)  # sparse and dense phases
        op = rnd.choice(["acquire"] * 4 + ["complete", "fail", "fail", "limited"])
        who, attempt = rnd.randint(max(0, newest - 6), newest), rnd.choice([0, 1, 1, 1, 2, 3])
        if op == "acquire" and rnd.random() < 0.5:
            newest += 1
            who, attempt = newest, 0
            waiting.append(who)
        elif op != "acquire" and waiting and rnd.random() < 0.9:
            who = waiting.pop(rnd.randrange(len(waiting)))
        rows.append({"provider": 1, "seq": seq, "at_ms": at, "op": op, "logical": who, "attempt": attempt,
                     "tokens": rnd.randint(0, 24) if op == "acquire" else rnd.randint(0, 8), "reset_ms": rnd.randint(1, 40)})
        if op == "fail":  # an impatient retry
            rows.append(rows[-1] | {"op": "acquire", "attempt": 1, "at_ms": at})
            waiting.append(who)
    return [r | {"seq": i} for i, r in enumerate(rows)]


@pytest.mark.parametrize("batches", [1, 7])
def test_quota_stream_equals_model(batches):
    seen = set()
    for seed in (1, 2, 3):
        rows = history(seed)
        q = stateful._Quota(*LIMITS, WIDTH, ATTEMPTS, BASE, CEILING, 10**9)
        q.init(Handle())
        got, size = [], len(rows) // batches + 1
        for i in range(0, len(rows), size):
            for pdf in q.handleInputRows((1,), iter([pd.DataFrame(rows[i : i + size])]), None):
                got += [(r.seq, r.ok, r.reasons, r.open) for r in pdf.itertuples()]
        want = model(rows)
        assert got == want
        seen |= {w for _, _, why, _ in want for w in why.split("|")}
    assert {"provider_rpm", "provider_tpm", "provider_reset", "retry_backoff", "identity", "terminal", "retry_exhausted", "no_lease"} <= seen


def test_window_and_status_streams_equal_batch(spark):
    rows = [(i % 3, i, i * 40_000, ("signup", "purchase", "view")[i % 3 if i < 20 else 2], i) for i in range(40)]
    df = spark.createDataFrame(rows, "run_id long, sequence long, at_ms long, kind string, units long").withColumn("at", F.timestamp_millis("at_ms"))
    path = fresh_dir(spark, "t")
    for lo in (0, 20):
        df.where(F.col("sequence").between(lo, lo + 19)).write.mode("append").parquet(path)
    use = jobs.drain_updates(jobs.quota_stream(jobs.tail(spark, path, df.schema), "run_id", "at", "units", "5 minutes", "1 minute"), ["run_id", "window_ms"], "u")
    want = df.groupBy("run_id", (F.floor(F.col("at_ms") / 300000) * 300000).alias("window_ms")).agg(F.count("*").alias("calls"), F.sum("units").alias("tokens"))
    assert sorted(map(tuple, use.collect())) == sorted(map(tuple, want.collect()))
    st = jobs.drain_updates(jobs.status_stream(jobs.tail(spark, path, df.schema, 1), "run_id", "sequence", "kind", ["purchase"]), ["run_id"], "s")
    assert {r.run_id: (r.state, r.events) for r in st.collect()} == {0: ("running", 14), 1: ("purchase", 13), 2: ("running", 13)}
