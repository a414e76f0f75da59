"""Folds over events in order of their time, the same on a batch and on a stream: audits of changes, rate limit, jobs.

On a stream a key's events wait in its state until the watermark has passed them, so rows that come in another order are
folded as a batch would fold them; timers do what time alone brings about, and a key nothing is known of any more leaves
the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from veilmark.functions.fold import fold_by_key

#: Seconds of quiet that end a burst of changes; least seconds between two audits; requests a window; the window's seconds.
QUIET, SPACING, REQUESTS, RATE_WINDOW = 2, 30, 5, 60
#: Seconds a job is kept after its last change.
KEEP = 86_400
_START = datetime(1970, 1, 1, tzinfo=UTC)
_SECOND = 1_000_000


def _time(micros: int) -> datetime:
    return _START + timedelta(microseconds=micros)


def _micros(time: datetime) -> int:
    return (time.replace(tzinfo=time.tzinfo or UTC) - _START) // timedelta(microseconds=1)


class OrderedFold:
    """What happens to one key. Its state is JSON; times are microseconds.

    `reads` are the columns of an event beside its time, in the order that breaks ties of equal times; `gives` is the
    DDL of a result. `step` takes an event, `advance` what time brings about up to and with `now`; both return the new
    state (None: nothing to remember) and results. `due` is when `advance` has something to do next (None: never).
    """

    reads: tuple[str, ...] = ()
    gives: str = ""

    def step(self, state: Any, now: int, event: list) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def advance(self, state: Any, now: int) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def due(self, state: Any) -> int | None:
        raise NotImplementedError


class AuditFold(OrderedFold):
    """Changes to audits: a burst ends after `quiet` seconds without a change; then its audit fires, unless it is not
    immediate and the last one is less than `spacing` seconds ago: then at the end of that time, with all that has come since.

    A change restarts the quiet period, also while an audit waits. A change at the very time an audit fires comes after it.
    State: time of the last audit, end of the quiet period, changes, paths, immediate.
    """

    reads, gives = ("path", "immediate"), "fired_at timestamp, n bigint, paths array<string>, immediate boolean"

    def __init__(self, quiet: int = QUIET, spacing: int = SPACING):
        self.quiet, self.spacing = quiet * _SECOND, spacing * _SECOND

    def due(self, state):
        last, quiet_end, _, _, immediate = state
        if quiet_end is None:
            return last + self.spacing
        return quiet_end if immediate or last is None else max(quiet_end, last + self.spacing)

    def advance(self, state, now):
        fired = []
        while state is not None and self.due(state) <= now:
            at = self.due(state)
            if state[1] is None:
                state = None
            else:
                fired.append((_time(at), state[2], sorted(state[3]), state[4]))
                state = [at, None, 0, [], False]
        return state, fired

    def step(self, state, now, event):
        state, fired = self.advance(state, now)
        last, _, n, paths, immediate = state or [None, None, 0, [], False]
        path, at_once = event
        if path is not None and path not in paths:
            paths = [*paths, path]
        return [last, now + self.quiet, n + 1, paths, bool(immediate or at_once)], fired


class RateFold(OrderedFold):
    """Requests: admitted if fewer than `most` were admitted in the `seconds` before. State: the admitted times."""

    reads, gives = ("id",), "id bigint, ts timestamp, admitted boolean"

    def __init__(self, most: int = REQUESTS, seconds: int = RATE_WINDOW):
        self.most, self.window = most, seconds * _SECOND

    def due(self, state):
        return state[-1] + self.window + 1

    def advance(self, state, now):
        return [t for t in state or [] if t >= now - self.window] or None, []

    def step(self, state, now, event):
        times = self.advance(state, now)[0] or []
        admitted = len(times) < self.most
        return (times + [now] if admitted else times) or None, [(event[0], _time(now), admitted)]


class JobFold(OrderedFold):
    """Events of a job to its states: queued, then running, then completed or failed, which are final.

    A step may be left out, but none goes back: a late `running` doesn't wake a finished job, and what comes before
    `queued` is of no job. At equal times the earlier step comes first. `keep` seconds after its last change a job
    expires; then only `queued` begins it anew. State: repository, status, created, updated.
    """

    reads, gives = ("step_no", "repo_url", "status"), "repo_url string, status string, created_at timestamp, updated_at timestamp"
    STEPS = ("queued", "running", "completed", "failed")

    def __init__(self, keep: int = KEEP, tell_expired: bool = True):
        self.keep, self.tell_expired = keep * _SECOND, tell_expired

    def due(self, state):
        return state[3] + self.keep + 1

    def advance(self, state, now):
        if state is None or self.due(state) > now:
            return state, []
        return None, [(state[0], "expired", _time(state[2]), _time(self.due(state) - 1))] if self.tell_expired else []

    def step(self, state, now, event):
        state, out = self.advance(state, now)
        _, repo_url, status = event
        if status not in self.STEPS:
            return state, out
        if state is None:
            if status != "queued":
                return state, out
            state = [repo_url, status, now, now]
        else:
            was = self.STEPS.index(state[1])
            if was >= 2 or self.STEPS.index(status) <= was:
                return state, out
            state = [state[0] if state[0] is not None else repo_url, status, state[2], now]
        return state, [*out, (state[0], status, _time(state[2]), _time(now))]


def fold_batch(df: DataFrame, fold: OrderedFold, key: str, time: str = "ts", to_end: bool = False) -> DataFrame:
    """(key, results) of a table's events: partitioned by key, sorted, streamed through its task in constant memory.

    `to_end` lets time run on behind a key's last event. A null key is a key; events without a time are left out. Equal
    events count each; an empty table gives no rows.
    """
    names = StructType.fromDDL(fold.gives).names
    rows = df.filter(F.col(time).isNotNull()).select(F.col(key), F.col(time).cast("timestamp").alias("at"), *fold.reads, F.lit(False).alias("end"))
    if to_end:
        last = rows.groupBy(key).agg(F.max("at").alias("at"))
        rows = rows.unionByName(last.withColumn("end", F.lit(True)), allowMissingColumns=True)

    def step(state: Any, row: dict) -> tuple:
        if row["end"]:
            out = []
            while state is not None and (due := fold.due(state)) is not None:
                state, found = fold.advance(state, due)
                out += found
        else:
            state, out = fold.step(state, _micros(row["at"]), [row[c] for c in fold.reads])
        return state, {"results": [dict(zip(names, x, strict=True)) for x in out]}

    folded = fold_by_key(rows, [key], ["end", "at", *fold.reads], step, f"results array<struct<{_inner(fold.gives)}>>")
    return folded.select(key, F.explode("results").alias("r")).select(key, "r.*")


def _inner(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


class _Processor(StatefulProcessor):
    """Keeps a key's events until the watermark has passed them, then folds them in order."""

    def __init__(self, fold: OrderedFold, key: str):
        self.fold, self.key, self.names = fold, key, StructType.fromDDL(fold.gives).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held string")

    def _read(self) -> tuple[list, Any]:
        found = self.held.get() if self.held.exists() else None
        return json.loads(found[0]) if found else [[], None]

    def _write(self, waiting: list, state: Any) -> None:
        if not waiting and state is None:
            self.held.clear()
            return
        self.held.update((json.dumps([waiting, state]),))
        due = self.fold.due(state) if state is not None else None
        times = [w[0] for w in waiting] + ([due] if due is not None else [])
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting, state = self._read()
        for frame in rows:
            values = [[None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in frame[c]] for c in self.fold.reads]
            waiting += [[t.value // 1000, list(x)] for t, *x in zip(frame["at"], *values, strict=True)]
        self._write(waiting, state)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, state = self._read()
        ready = sorted((w for w in waiting if w[0] <= now), key=lambda w: (w[0], [(x is not None, x) for x in w[1]]))
        out = []
        for at, event in ready:
            state, found = self.fold.step(state, at, event)
            out += found
        if state is not None:
            state, found = self.fold.advance(state, now)
            out += found
        if ready or out or state is None:
            self._write([w for w in waiting if w[0] > now], state)
        if out:
            columns = {n: list(v) for n, v in zip(self.names, zip(*out, strict=True), strict=True)}
            yield pd.DataFrame({self.key: [key[0]] * len(out), **columns})


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_stream(df: DataFrame, fold: OrderedFold, key: str, time: str = "ts") -> DataFrame:
    """The same for a stream with a watermark on `time` (of type timestamp): each result once, when the watermark says it holds.

    Rows behind the watermark are late and left out. State lies in RocksDB, which this sets for the session, and in
    the checkpoint, so a restart goes on where it stopped. What a key keeps is what `fold` does, and events not yet
    behind the watermark.
    """
    df.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    rows = df.select(F.col(key), F.col(time).alias("at"), *fold.reads)
    kind = dict(df.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(_Processor(fold, key), f"{key} {kind}, {fold.gives}", "append", "eventTime")


def _jobs(events: DataFrame) -> DataFrame:
    steps = F.create_map(*[F.lit(x) for i, s in enumerate(JobFold.STEPS) for x in (s, i)])
    return events.withColumn("step_no", steps[F.col("status")])


def audits(changes: DataFrame, quiet: int = QUIET, spacing: int = SPACING) -> DataFrame:
    """Changes (root, ts, path, immediate) to audits: root, fired_at, n, paths, immediate."""
    return fold_batch(changes, AuditFold(quiet, spacing), "root", to_end=True)


def audits_stream(changes: DataFrame, quiet: int = QUIET, spacing: int = SPACING) -> DataFrame:
    return fold_stream(changes, AuditFold(quiet, spacing), "root")


def job_log(events: DataFrame, keep: int = KEEP) -> DataFrame:
    """Events (job_id, repo_url, status, ts) to the states that jobs went through, expiry before a new event included."""
    return fold_batch(_jobs(events), JobFold(keep), "job_id")


def job_log_stream(events: DataFrame, keep: int = KEEP) -> DataFrame:
    return fold_stream(_jobs(events), JobFold(keep), "job_id")


def job_states(events: DataFrame, keep: int = KEEP) -> DataFrame:
    """Each job's last state: job_id, repo_url, status, created_at, updated_at; only legal steps count."""
    order = F.struct("updated_at", F.create_map(*[F.lit(x) for i, s in enumerate(JobFold.STEPS) for x in (s, i)])[F.col("status")].alias("step_no"))
    last = fold_batch(_jobs(events), JobFold(keep, tell_expired=False), "job_id").groupBy("job_id").agg(F.max_by(F.struct("repo_url", "status", "created_at", "updated_at"), order).alias("r"))
    return last.select("job_id", "r.*")


def rate_limit_stream(requests: DataFrame, key: str = "client", most: int = REQUESTS, seconds: int = RATE_WINDOW) -> DataFrame:
    """Requests (key, ts, id) of a stream with admitted; a client without a request for `seconds` leaves the state."""
    return fold_stream(requests.withColumnRenamed(key, "client"), RateFold(most, seconds), "client")
