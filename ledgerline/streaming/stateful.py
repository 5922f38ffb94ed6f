"""Operators with state over streams: order, timers and expiry.

Rows may come in any order within the watermark. A key's rows wait in its list state until the watermark has passed
them, which a timer of event time tells; then they are worked on in the order of (ts, event_id), exactly as the batch
operators do, and rows later than the watermark are dropped by Spark. What a key holds is dropped when no row that may
still come can be affected by it: after the window and the lock (R3), after the window (R4), as soon as a run has ended
(R8). So memory is the rows that came within the watermark and the keys that are at work, and dropping changes no result.

A restart from the checkpoint takes state and timers up again; batches are written under their number, so none counts twice.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerline.storage import workers_import_us

LATE = "10 minutes"
#: Rows that go to a list state at once.
_CHUNK = 4096
_DAY_MS = 86_400_000


class Step:
    """What an ordered operator does: fields after (us, event_id) of a waiting row, the state it keeps, and how rows change it."""

    row: str = "us long, event_id long"
    state: str

    def run(self, state: tuple | None, key: Any, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
        """The new state (None: nothing to keep) and the rows made of rows, which are all there are up to the last one's time."""
        raise NotImplementedError

    def ends(self, state: tuple) -> int | None:
        """The time in us from which on state no longer matters; None: never."""
        return None


class Ordered(StatefulProcessor):
    """Runs a step over each key's rows in the order of their time."""

    def __init__(self, step: Step, out: str) -> None:
        self.step = step
        self.out = [f.split()[0] for f in out.split(", ")]
        self.fields = [f.split()[0] for f in step.row.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.step.row)
        self.held = handle.getValueState("held", self.step.state)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, chunk = None, []
        for row in rows:
            chunk.append(tuple(row[f] for f in self.fields))
            first = chunk[-1][0] if first is None else min(first, chunk[-1][0])
            if len(chunk) == _CHUNK:
                self.waiting.appendList(chunk)
                chunk = []
        if chunk:
            self.waiting.appendList(chunk)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        if self.waiting.exists():
            for row in self.waiting.get():
                (due if row[0] <= now else later).append(tuple(row))
        state, made = self.held.get() if self.held.exists() else None, []
        if due:
            due.sort(key=lambda r: r[:2])
            state, made = self.step.run(state, key[0], due)
            self.waiting.clear()
            for at in range(0, len(later), _CHUNK):
                self.waiting.appendList(later[at : at + _CHUNK])
            if later:
                self._wake(min(r[0] for r in later))
        ends = self.step.ends(state) if state else None
        if state is None or ends is not None and ends <= now:
            self.held.clear()
        elif due:
            self.held.update(state)
            if ends is not None:
                self._wake(ends + 1000)
        named = Row(*self.out)
        return (named(*r) for r in made)

    def close(self) -> None:
        pass


def _ordered(stream: DataFrame, key: str, step: Step, out: str, late: str) -> DataFrame:
    workers_import_us(stream.sparkSession)
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    columns = [f.split()[0] for f in step.row.split(", ")]
    return rows.select(key, "ts", *columns).groupBy(key).transformWithState(Ordered(step, out), out, "append", "EventTime")


class _Lockout(Step):
    row = "us long, event_id long, is_failure boolean"
    state = "recent array<long>, until long"

    def __init__(self, failures: int, window: int, lock: int) -> None:
        self.failures, self.window, self.lock = failures, window, lock

    def run(self, state, key, rows):
        recent, until, made, i = list(state[0]) if state else [], state[1] if state else -1, [], 0
        while i < len(rows):
            us, j = rows[i][0], i
            if not rows[i][2]:
                recent, until, i = [], -1, i + 1
                continue
            while j < len(rows) and rows[j][0] == us and rows[j][2]:
                j += 1
            # Failures of one instant count together, as in a window over time.
            recent = recent[bisect_left(recent, us - self.window) :] + [us] * (j - i)
            locks = len(recent) >= self.failures
            for r in rows[i:j]:
                made.append((r[1], key, len(recent), until > us, locks))
                until = us + self.lock if locks else until
            i = j
        return ((recent, until) if recent else None), made

    def ends(self, state):
        return max(state[0][-1] + self.window, state[1])


def stream_failure_lockout(events: DataFrame, *, failures: int = 5, window_s: int = 900, lock_s: int = 300, late: str = LATE) -> DataFrame:
    """R3 over a stream, with the columns of failure_lockout. A key's state is its failures within the window and the end of its lock."""
    step = _Lockout(failures, window_s * 1_000_000, lock_s * 1_000_000)
    return _ordered(events, "auth_key", step, "event_id long, auth_key long, in_window long, was_locked boolean, locks boolean", late)


class _Burst(Step):
    state = "count int, began long"

    def __init__(self, needed: int, window: int) -> None:
        self.needed, self.window = needed, window

    def run(self, state, key, rows):
        count, began = state or (0, rows[0][0])
        made = []
        for us, event_id in rows:
            if us - began > self.window:
                count, began = 0, us
            count += 1
            fired = count >= self.needed
            made.append((None if key is None else str(key), event_id, fired))
            if fired:
                count, began = 0, us
        return (count, began), made

    def ends(self, state):
        return state[1] + self.window


def stream_burst_detector(hits: DataFrame, *, key: str, hits_needed: int = 5, window_s: float = 60.0, late: str = LATE) -> DataFrame:
    """R4 over a stream, with the columns of burst_detector. A key's state is its counter and when the window began."""
    return _ordered(hits, key, _Burst(hits_needed, int(window_s * 1_000_000)), "key string, event_id long, fired boolean", late)


class _Streaks(StatefulProcessor):
    """Carries each source's run of failures from pane to pane. Panes come in the batch in which the watermark passes them, so all that a batch brings are later than those before it."""

    def __init__(self, idle: int | None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "run int, last long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        run, last = (self.held.get() if self.held.exists() else None) or (0, 0)
        made = []
        for row in sorted(((r["pane"], r["n"], r["at"], r["us"], r["ids"]) for r in rows), key=lambda r: r[0]):
            _, n, places, times, ids = row
            before, runs = -1, []
            for at, us in zip(places, times, strict=True):
                run = run + 1 if at == before + 1 and (self.idle is None or us - last < self.idle) else 1
                before, last = at, us
                runs.append(run)
            if before < n - 1:
                run = 0
            if runs:
                made.append((key[0], ids, runs))
        if run:
            self.held.update((run, last))
            if self.idle is not None:
                self.handle.registerTimer(-(-(last + self.idle) // 1000) + 1)
        else:
            self.held.clear()
        return (Row(source=s, ids=i, runs=r) for s, i, r in made)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.held.exists() and self.held.get()[1] + self.idle <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_failure_streak(events: DataFrame, *, every: int = 3, most: int = 5, cooldown_s: int = 60, idle_s: int | None = None, late: str = LATE, pane: str = "10 seconds") -> DataFrame:
    """R8 over a stream, with the columns of failure_streak. A source's state is the length of its run, while it lasts.

    Spark gathers a source's events by pane of time and lets a pane go when the watermark has passed it; what is done one
    after the other, pane by pane, are the pane's failures and their places in it. So few and busy sources share all cores
    for their events, and a task for a source has the failures of the panes that a batch closes.
    idle_s: a run whose source has been silent for so long is forgotten. That is not a rule of failure_streak, so it is off
    unless given; without it a source that fails and never returns stays, a number and a time.
    """
    from ledgerline.streaming.operators import delays

    workers_import_us(events.sparkSession)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    event = F.struct(F.unix_micros("ts").alias("us"), "event_id", F.col("error").isNotNull().alias("bad"))
    panes = rows.groupBy(F.window("ts", pane).alias("w"), "source").agg(F.array_sort(F.collect_list(event)).alias("e"))
    bad = F.filter(F.transform("e", lambda x, i: F.struct(x["us"].alias("us"), x["event_id"].alias("event_id"), i.alias("at"), x["bad"].alias("bad"))), lambda x: x["bad"])
    panes = panes.select("source", F.window_time("w").alias("closes"), F.unix_micros("w.start").alias("pane"), F.size("e").alias("n"), bad.alias("b"))
    panes = panes.select("source", "closes", "pane", "n", F.col("b.at").alias("at"), F.col("b.us").alias("us"), F.col("b.event_id").alias("ids"))
    step = _Streaks(None if idle_s is None else idle_s * 1_000_000)
    runs = panes.groupBy("source").transformWithState(step, "source string, ids array<long>, runs array<int>", "append", "EventTime")
    runs = runs.select("source", F.inline(F.arrays_zip(F.col("ids").alias("event_id"), F.col("runs").alias("run"))))
    return runs.select("event_id", "source", "run", *delays(F.col("run"), every, most, cooldown_s))


class _Latest(StatefulProcessor):
    """The highest row of a key that has come; a row goes out when it is higher than all before."""

    def __init__(self, schema: str, idle_ms: int) -> None:
        self.schema, self.idle_ms = schema, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came, best = max(((r["came"], (r["report_version"], r["us"], r["id"])) for r in rows), key=lambda r: r[1])
        held = tuple(self.held.get()) if self.held.exists() else None
        newer = held is None or best > held[:3]
        self.held.update((*(best if newer else held[:3]), came))
        self.handle.registerTimer(came + self.idle_ms)
        if newer:
            yield Row(logical_key=key[0], id=best[2], report_version=best[0])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.held.exists() and self.held.get()[3] + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_latest(reports: DataFrame, *, idle_ms: int = 30 * _DAY_MS) -> DataFrame:
    """R2: (logical_key, id, report_version) whenever a key has a newer version than any before.

    Event time is here the time of arrival, so no report is too late, however old it is. A key that nothing has come for in
    idle_ms leaves the state; what comes for it later counts as new, so the table that the rows are merged into keeps the
    highest version, as `versions.latest` does.
    """
    workers_import_us(reports.sparkSession)
    version = reports.schema["report_version"].dataType.simpleString()
    rows = reports.select("logical_key", "report_version", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"), "id", F.current_timestamp().alias("arrived"))
    rows = rows.withWatermark("arrived", "1 second").withColumn("came", F.unix_millis("arrived"))
    step = _Latest(f"report_version {version}, us long, id string, came long", idle_ms)
    return rows.groupBy("logical_key").transformWithState(step, f"logical_key string, id string, report_version {version}", "update", "EventTime")


def stream_newest(reports: DataFrame, *, pane: str = "30 days") -> DataFrame:
    """R2 where keys are very many: (logical_key, id, report_version, created_us), the newest version of each key that a batch has news of.

    As stream_latest, but by Spark's own aggregation, so that no key calls for Python: a key's state is its newest version of
    those that arrived in a pane of time, and leaves when that is over. What comes for a key in another pane counts as new,
    and a batch that brings nothing newer repeats what is known; the table that the rows are merged into keeps the highest.
    """
    newest = F.max(F.struct("report_version", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), "id")).alias("r")
    rows = reports.select("logical_key", "report_version", "created_at", "id", F.current_timestamp().alias("arrived")).withWatermark("arrived", "1 second")
    return rows.groupBy(F.window("arrived", pane), "logical_key").agg(newest).select("logical_key", "r.id", "r.report_version", "r.created_us")
