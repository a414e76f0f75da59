"""Event streams: debounce, throttle, rate limit, jobs that can be joined, hash chains. Folds that run on streams too are in `ordered`."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.functions.fold import fold_by_key
from veilmark.functions.paths import any_of, matches_glob, sensitive_pattern, under_skipped
from veilmark.streaming.ordered import KEEP, QUIET, RATE_WINDOW, REQUESTS, SPACING

#: Seconds in which a finished job serves a new request.
REUSE = 900


def relevant_changes(changes: DataFrame, rule_globs: list[str]) -> DataFrame:
    """Changes (ts, root, path) that a rule or sensitive pattern cares for and that lie in no skipped directory, with
    immediate: whether the root itself or a sensitive path changed. Works on streams: nothing is kept."""
    p = F.col("path")
    sensitive = sensitive_pattern(p).isNotNull()
    return changes.filter(~under_skipped(p) & (sensitive | any_of([matches_glob(p, *rule_globs)]) | (p == ""))).withColumn("immediate", sensitive | (p == ""))


def debounce(changes: DataFrame, key: str = "root", quiet: int = QUIET) -> DataFrame:
    """One row a burst: key, started, fires (the quiet period after its last change), n, paths, immediate.

    A session window, so it runs on a batch or, behind a watermark, on a stream; counts combine before the shuffle.
    A change that comes exactly `quiet` seconds after the last one starts a new burst; as session windows that touch
    are one, the window's gap is a microsecond shorter.
    """
    window = F.session_window("ts", f"{quiet * 1_000_000 - 1} microseconds")
    columns = [F.count("*").alias("n")]
    if "path" in changes.columns:
        columns.append(F.array_sort(F.collect_set("path")).alias("paths"))
    if "immediate" in changes.columns:
        columns.append(F.bool_or("immediate").alias("immediate"))
    return changes.groupBy(key, window.alias("w")).agg(*columns).select(key, F.col("w.start").alias("started"), (F.col("w.end") + F.expr("INTERVAL '0.000001' SECOND")).alias("fires"), *[c for c in ("n", "paths", "immediate") if c == "n" or (c == "paths" and "path" in changes.columns) or (c == "immediate" and "immediate" in changes.columns)])


def throttle(bursts: DataFrame, key: str = "root", spacing: int = SPACING) -> DataFrame:
    """Bursts (key, fires, immediate) with fired_at: their own time if the last audit is long enough ago or they are
    immediate, else the end of the spacing; what comes before that time joins the same audit."""

    def step(state: tuple | None, row: dict) -> tuple:
        # state: (time of the last audit, time of the waiting one)
        now = row["fires"].timestamp()
        last, waiting = state or (None, None)
        if waiting is not None and now >= waiting:
            last, waiting = waiting, None
        due = now if row["immediate"] or last is None or now - last >= spacing else last + spacing
        if due == now:
            return (now, None), {"fired_at": _time(now)}
        return (last, due), {"fired_at": _time(due)}

    return fold_by_key(bursts, [key], ["fires"], step, "fired_at timestamp")


def _time(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, UTC)


def _admit(times: list[float], now: float, most: int, seconds: float) -> tuple[list[float], bool]:
    times = [t for t in times if t >= now - seconds]
    return (times + [now], True) if len(times) < most else (times, False)


def rate_limit(requests: DataFrame, key: str = "client", order: str = "ts", most: int = REQUESTS, seconds: int = RATE_WINDOW, tie: str | None = None) -> DataFrame:
    """Requests with admitted: whether fewer than `most` were admitted in the `seconds` before; refused ones don't count."""

    def step(state: list | None, row: dict) -> tuple:
        times, admitted = _admit(state or [], row[order].timestamp(), most, seconds)
        return times, {"admitted": admitted}

    return fold_by_key(requests, [key], [order, *([tie] if tie else [])], step, "admitted boolean")


def live_jobs(jobs: DataFrame, now, keep: int = KEEP) -> DataFrame:
    return jobs.filter(F.unix_micros("updated_at") >= F.unix_micros(now) - keep * 1_000_000)


def reusable_jobs(jobs: DataFrame, now, reuse: int = REUSE, keep: int = KEEP) -> DataFrame:
    """(repo_url, job_id): the newest job of a repository that a request can join: waiting, running, or lately completed."""
    fresh = F.unix_micros("created_at") >= F.unix_micros(now) - reuse * 1_000_000
    fit = live_jobs(jobs, now, keep).filter(F.col("status").isin("queued", "running") | ((F.col("status") == "completed") & fresh))
    return fit.groupBy("repo_url").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


def pending_jobs(jobs: DataFrame, now, keep: int = KEEP) -> DataFrame:
    return live_jobs(jobs, now, keep).agg(F.count(F.when(F.col("status").isin("queued", "running"), 1)).alias("pending"))


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what was waiting or running has failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def hash_chain(entries: DataFrame, ledger: str = "ledger", order: str = "seq", body: str = "entry") -> DataFrame:
    """Entries with previous_hash and line: each line holds the SHA-256 of the line before it, null for a ledger's first."""

    def step(state: str | None, row: dict) -> tuple:
        line = json.dumps({"entry": row[body], "previousHash": state}, ensure_ascii=False, separators=(",", ":"))
        return hashlib.sha256(line.encode()).hexdigest(), {"previous_hash": state, "line": line}

    return fold_by_key(entries, [ledger], [order], step, "previous_hash string, line string")


def broken_links(lines: DataFrame, ledger: str = "ledger", order: str = "seq") -> DataFrame:
    """Lines of a chain (line string) whose previousHash is not the hash of the line before."""
    before = F.sha2(F.lag("line").over(Window.partitionBy(ledger).orderBy(order)), 256)
    broken = ~F.get_json_object("line", "$.previousHash").eqNullSafe(before)
    return lines.select("*", broken.alias("__broken")).filter("__broken").drop("__broken")
