"""Stateful processors: late rows, ledgers, quota admission, unknown work, circuits.

Rows of a key are taken in sequence order inside a micro-batch and must not go back across batches.
State lies in the RocksDB store: a few numbers per key, and one entry per id, of which a batch reads and writes only
those it names.  Closed ids are kept for good, so that a key's state grows with its ids, unless the caller gives a
retention: repeats older than that are not recognised then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyline.streaming.jobs import ROCKS

BATCH = 10_000
HELD = 50_000  # entries of one key in memory


def _ordered(rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """One key's rows of one micro-batch; batch size is set at the source."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def _emit(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    for i in range(0, len(rows), BATCH):
        yield pd.DataFrame(rows[i : i + BATCH], columns=columns)


def _full(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows decided so far, taken out of ``rows``, once they are a batch."""
    if len(rows) >= BATCH:
        yield from _emit(rows, columns)
        rows.clear()


def _run(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time_mode)


class _Book:
    """Entries by id of one key: those a batch touches are read once and written once, or again for each HELD of them.

    Each call of the store is a round trip: a key that had no entries is asked once, and what was not stored is not removed.
    """

    def __init__(self, state) -> None:
        self.state, self.seen, self.changed, self.stored = state, {}, set(), {}
        self.empty = not state.exists()

    def get(self, ident: int) -> tuple | None:
        if ident not in self.seen:
            self._room()
            found = None if self.empty else self.state.getValue((ident,))
            self.seen[ident] = None if found is None else tuple(found)
            self.stored[ident] = found is not None
        return self.seen[ident]

    def put(self, ident: int, entry: tuple | None) -> None:
        if ident not in self.seen:
            self._room()
        self.seen[ident] = entry
        self.changed.add(ident)

    def _room(self) -> None:
        if len(self.seen) >= HELD:
            self.write()
            self.seen, self.stored = {}, {}

    def write(self) -> None:
        empty = self.empty
        for ident in sorted(self.changed):
            if self.seen[ident] is not None:
                self.state.updateValue((ident,), self.seen[ident])
                self.empty = False
                self.stored[ident] = True
            elif self.stored[ident] if ident in self.stored else not empty and self.state.containsKey((ident,)):
                self.state.removeKey((ident,))
                self.stored[ident] = False
        self.changed = set()

    def sweep(self, over) -> None:
        """Remove the entries that ``over`` names; reads all of the key's entries."""
        if self.state.exists():
            for ident in [k[0] for k, entry in self.state.iterator() if over(tuple(entry))]:
                self.state.removeKey((ident,))


class _Once(StatefulProcessor):
    def __init__(self, delay: int | None) -> None:
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "high long, swept long")
        self.ids = handle.getMapState("ids", "id long", "digest string, at long")

    def handleInputRows(self, key, rows, timerValues):
        high, swept = self.marks.get() if self.marks.exists() else (None, None)
        book, out = _Book(self.ids), []
        for r in _ordered(rows, "pos").itertuples(index=False):
            who, at = int(r.event_id), int(r.at_ms)
            known = book.get(who)
            if known is not None:
                outcome = "repeat" if known[0] == r.digest else "conflict"
            elif self.delay is not None and high is not None and at < high - self.delay:
                outcome = "late"
            else:
                outcome = "accepted"
                book.put(who, (r.digest, at))
                high = at if high is None else max(high, at)
            out.append((key[0], who, r.pos, outcome))
            yield from _full(out, ["run_id", "event_id", "pos", "outcome"])
        book.write()
        swept = high if swept is None else swept
        if self.delay is not None and high is not None and high - swept > self.delay:
            # what is older can only come again as a late row
            book.sweep(lambda entry: entry[1] < high - self.delay)
            swept = high
        if high is not None:
            self.marks.update((int(high), int(swept)))
        yield from _emit(out, ["run_id", "event_id", "pos", "outcome"])

    def close(self) -> None:
        pass


def append_outcomes(events: DataFrame, delay_ms: int | None = None) -> DataFrame:
    """Exactly-once append by event id with an outcome for every row (X2): accepted, repeat, conflict or late.

    ``events``: run_id, event_id, pos (order of the log in its run), at_ms, digest (of the content).  The first row of an id is
    accepted, a later one repeats it, or conflicts if its digest differs.  All ids of a run are kept; with ``delay_ms``, a
    row of an unknown id that is older than the run's newest accepted time by more than that is late and not accepted, and
    ids as old as that are forgotten now and then, so that their repeats, which have the same time, count as late too.
    """
    schema = "run_id long, event_id long, pos long, outcome string"
    return _run(events, "run_id", _Once(delay_ms), schema, "None")


class _Late(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "at long")

    def handleInputRows(self, key, rows, timerValues):
        high = self.high.get()[0] if self.high.exists() else None
        out = []
        pdf = _ordered(rows, "sequence")
        for seq, at in zip(pdf["sequence"], pdf["at_ms"], strict=True):
            if high is not None and at < high:
                out.append((key[0], seq, at, high))
            else:
                high = at
        self.high.update((int(high),))
        yield from _emit(out, ["run_id", "sequence", "at_ms", "high_mark"])

    def close(self) -> None:
        pass


def late_events(events: DataFrame) -> DataFrame:
    """Rows older than the newest seen of their run; nothing is dropped silently."""
    return _run(events, "run_id", _Late(), "run_id long, sequence long, at_ms long, high_mark long", "None")


class _Ledger(StatefulProcessor):
    def __init__(self, cap: int, retain: int | None) -> None:
        self.cap, self.retain = cap, retain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "spent long, held long, last long, swept long")
        self.ids = handle.getMapState("ids", "id long", "units long, ended long")  # ended: sequence number, -1 while active

    def _decide(self, r, live, spent, held):
        """(reason, spent, held, entry) of one operation on an id; reason None means applied."""
        op, seq = r.operation, int(r.seq)
        res, act = (None if pd.isna(v) else int(v) for v in (r.res_units, r.act_units))
        active, ended = live is not None and live[1] < 0, live is not None and live[1] >= 0
        if op not in ("reserve", "settle", "cancel"):
            return "unknown_operation", spent, held, live
        if (op == "reserve" and (res is None or act is not None)) or (op == "settle" and act is None) or (op == "cancel" and act is not None):
            return "malformed_input", spent, held, live
        if op == "reserve":
            if active or ended:
                return "identity_conflict", spent, held, live
            if spent + held + res > self.cap:
                return "capacity_exceeded", spent, held, (0, seq)
            return None, spent, held + res, (res, -1)
        if not active:
            return ("terminal_attempt" if ended else "unknown_attempt"), spent, held, live
        if op == "settle" and act > live[0]:
            return "actual_over_reservation", spent, held, live
        return None, spent + (act if op == "settle" else 0), held - live[0], (0, seq)

    def _forgotten(self, entry, last) -> bool:
        return self.retain is not None and 0 <= entry[1] <= last - self.retain

    def handleInputRows(self, key, rows, timerValues):
        spent, held, last, swept = self.sums.get() if self.sums.exists() else (0, 0, 0, 0)
        book, out, now = _Book(self.ids), [], last
        for r in _ordered(rows, "seq").itertuples(index=False):
            who = int(r.attempt_id)
            live = book.get(who)
            if live is not None and self._forgotten(live, last):
                live = None
            reason, spent, held, entry = self._decide(r, live, spent, held)
            if entry != book.get(who):
                book.put(who, entry)
            now = int(r.seq)
            out.append((key[0], r.seq, reason is None, reason, spent, held))
            yield from _full(out, ["ledger", "seq", "applied", "reason", "spent_units", "held_units"])
        book.write()
        if self.retain is not None and now - swept >= self.retain:
            book.sweep(lambda entry: self._forgotten(entry, now))
            swept = now
        self.sums.update((int(spent), int(held), int(now), int(swept)))
        yield from _emit(out, ["ledger", "seq", "applied", "reason", "spent_units", "held_units"])

    def close(self) -> None:
        pass


def ledger_stream(ops: DataFrame, cap: int, retain: int | None = None) -> DataFrame:
    """Reserve, settle and cancel rows to decision rows (X5); equals ``ledgers.replay_ledger`` while no id is forgotten.

    ``retain``: ended ids older than this many sequence numbers are forgotten, and can reserve again; None keeps all.
    """
    schema = "ledger long, seq long, applied boolean, reason string, spent_units long, held_units long"
    return _run(ops, "ledger", _Ledger(cap, retain), schema, "None")


class _Quota(StatefulProcessor):
    """Two fixed-window buckets (provider and aggregate), leases, reset window and retry state."""

    def __init__(self, provider: dict, aggregate: dict, width: int, attempts: int, base: int, ceiling: int,
                 retain: int | None) -> None:
        self.limits = (("provider", provider), ("global", aggregate))
        self.width, self.attempts, self.base, self.ceiling, self.retain = width, attempts, base, ceiling, retain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.use = handle.getValueState("use", "win long, calls long, tokens long, open long, reset long, at long, swept long")
        # ready: time of the next attempt or -1; lease: tokens held or -1, from the window win; deadline: -1 for none
        self.calls = handle.getMapState("calls", "id long", "attempt long, ready long, dead boolean, at long, lease long, win long, deadline long")

    def _backoff(self, n: int) -> int:
        return min(self.base << min(n - 1, 62), self.ceiling)

    def _identity(self, known, attempt):
        if known is None:
            return None if attempt == 0 else "identity"
        last, ready, dead, *_ = known
        if attempt == 0:
            return "terminal" if dead else "identity"
        if attempt >= self.attempts:
            return "retry_exhausted"
        if dead:
            return "terminal"
        return None if ready >= 0 and attempt == last + 1 else "identity"

    def _forgotten(self, entry, at) -> bool:
        return self.retain is not None and entry[4] < 0 and entry[3] <= at - self.retain

    def handleInputRows(self, key, rows, timerValues):
        win, calls, tokens, open_, reset, past, swept = self.use.get() if self.use.exists() else (-1, 0, 0, 0, 0, 0, 0)
        book, out, at = _Book(self.calls), [], past
        for r in _ordered(rows, "seq").itertuples(index=False):
            at, who, n = int(r.at_ms), int(r.logical), int(r.tokens)
            if at // self.width != win:
                win, calls, tokens = at // self.width, 0, 0
            known = book.get(who)
            if known is not None and self._forgotten(known, past):
                known = None
            reasons, retry = [], None
            if r.op == "acquire":
                asked = getattr(r, "deadline_ms", None)
                deadline = known[6] if known is not None else -1 if pd.isna(asked) else int(asked)
                bad = self._identity(known, int(r.attempt))
                if bad:
                    reasons = [bad]
                elif 0 <= deadline < at:
                    reasons = ["deadline"]
                elif at < reset:
                    reasons, retry = ["provider_reset"], reset
                elif known is not None and at < known[1]:
                    reasons, retry = ["retry_backoff"], known[1]
                else:
                    for scope, lim in self.limits:
                        reasons += [f"{scope}_{name}" for name, full in (("rpm", calls >= lim["rpm"]), ("tpm", tokens + n > lim["tpm"]),
                                                                        ("concurrency", open_ >= lim["concurrency"])) if full]
                if not reasons:
                    calls, tokens, open_ = calls + 1, tokens + n, open_ + 1
                    book.put(who, (int(r.attempt), -1, False, at, n, win, deadline))
            elif known is None or known[4] < 0:
                reasons = ["no_lease"]
            else:
                last, _, _, _, held, when, deadline = known
                if n > held:
                    reasons = ["actual_above_lease"]
                else:
                    open_ -= 1
                    if when == win:
                        tokens -= held - n
                    nxt = last + 1
                    if r.op == "limited":
                        reset = max(reset, at + int(r.reset_ms))
                    if r.op in ("fail", "limited") and nxt < self.attempts:
                        retry = at + self._backoff(nxt)
                        retry = max(retry, reset) if r.op == "limited" else retry
                        retry = None if 0 <= deadline < retry else retry  # too late: the call ends here
                    book.put(who, (last, -1 if retry is None else int(retry), retry is None, at, -1, -1, deadline))
            out.append((key[0], r.seq, not reasons, "|".join(reasons), retry, open_, calls, tokens))
            yield from _full(out, ["provider", "seq", "ok", "reasons", "retry_at", "open", "calls", "tokens"])
        book.write()
        if self.retain is not None and at - swept >= self.retain:
            book.sweep(lambda entry: self._forgotten(entry, at))
            swept = at
        self.use.update((int(win), int(calls), int(tokens), int(open_), int(reset), int(at), int(swept)))
        yield from _emit(out, ["provider", "seq", "ok", "reasons", "retry_at", "open", "calls", "tokens"])

    def close(self) -> None:
        pass


def quota_admission_stream(rows: DataFrame, provider: dict, aggregate: dict, width: int, attempts: int = 3, base: int = 100,
                           ceiling: int = 10_000, retain: int | None = None) -> DataFrame:
    """Admission with leases, resets and retries that cross windows.

    ``rows``: provider, seq, at_ms, op (acquire / complete / fail / limited), logical, attempt, tokens, reset_ms and, if calls have
    one, deadline_ms: the deadline of a call is that of its first admitted attempt; later acquires are refused, and a call whose
    next attempt would come after it ends.
    ``retain``: calls without a lease are forgotten after this many ms; None keeps all.
    """
    schema = "provider long, seq long, ok boolean, reasons string, retry_at long, open long, calls long, tokens long"
    return _run(rows, "provider", _Quota(provider, aggregate, width, attempts, base, ceiling, retain), schema, "None")


class _Unknown(StatefulProcessor):
    def __init__(self, patience_ms: int) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.work = handle.getMapState("work", "task long", "units long, due long")
        self.first = handle.getValueState("first", "at long")  # the only timer: no open work is due before it

    def handleInputRows(self, key, rows, timerValues):
        work, first = _Book(self.work), None
        for r in _ordered(rows, "at_ms").itertuples(index=False):
            if r.op == "dispatch":
                end = int(r.at_ms) + self.patience
                work.put(int(r.task_id), (int(r.units), end))
                first = end if first is None else min(first, end)
            elif r.op == "settle":
                work.put(int(r.task_id), None)
        work.write()
        known = self.first.get()[0] if first is not None and self.first.exists() else None
        if first is not None and (known is None or first < known):
            if known is not None:
                self.handle.deleteTimer(known)
            self._wait(first)
        yield pd.DataFrame({"run_id": [], "task_id": [], "charged": [], "due_ms": []}).astype("int64")

    def _wait(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.first.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All work due by now is charged at once, in one reading of the key's open work, or one for each HELD that is due."""
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        more = True
        while more:
            out, following, more = [], None, False
            for (task,), (units, due) in self.work.iterator():
                if due >= now:
                    following = due if following is None else min(following, due)
                elif len(out) < HELD:
                    out.append((key[0], int(task), int(units), int(due)))
                else:
                    more = True
            if following is None and not more:
                self.work.clear()
            else:
                for _, task, *_ in out:
                    self.work.removeKey((task,))
            yield from _emit(out, ["run_id", "task_id", "charged", "due_ms"])
        if following is None:
            self.first.clear()
        else:
            self._wait(int(following))

    def close(self) -> None:
        pass


def unknown_inflight(rows: DataFrame, at: str, delay: str, patience_ms: int) -> DataFrame:
    """Dispatched work without a settlement after ``patience_ms`` is charged its full reservation.

    ``rows``: run_id, task_id, op (dispatch / settle), units, at_ms and the event-time column ``at``.
    """
    df = rows.withWatermark(at, delay)
    return _run(df, "run_id", _Unknown(patience_ms), "run_id long, task_id long, charged long, due_ms long", "EventTime")


class _Circuit(StatefulProcessor):
    def __init__(self, threshold: int, cooldown_ms: int) -> None:
        self.threshold, self.cooldown = threshold, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "failures long, until long")

    def handleInputRows(self, key, rows, timerValues):
        n, until = self.seen.get() if self.seen.exists() else (0, -1)
        out = []
        for r in _ordered(rows, "sequence").itertuples(index=False):
            if r.failed:
                n += 1
                if n >= self.threshold:
                    until = int(r.at_ms) + self.cooldown
                    out.append((key[0], "opened", r.sequence, n, until))
        if out:
            self.handle.registerTimer(until)
        self.seen.update((int(n), int(until)))
        yield from _emit(out, ["run_id", "state", "sequence", "failures", "until_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, until = self.seen.get()
        rows = [(key[0], "cooled", None, n, until)] if expiredTimerInfo.getExpiryTimeInMs() >= until else []
        yield from _emit(rows, ["run_id", "state", "sequence", "failures", "until_ms"])

    def close(self) -> None:
        pass


def circuit_stream(events: DataFrame, at: str, delay: str, threshold: int, cooldown_ms: int) -> DataFrame:
    """Circuit openings after ``threshold`` failures and the end of the last cooldown.

    ``events``: run_id, sequence, at_ms, failed and the event-time column ``at``.
    """
    df = events.withWatermark(at, delay)
    schema = "run_id long, state string, sequence long, failures long, until_ms long"
    return _run(df, "run_id", _Circuit(threshold, cooldown_ms), schema, "EventTime")
