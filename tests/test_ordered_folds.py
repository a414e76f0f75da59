"""Audits, jobs and rate limit: a stream in any order within the watermark, restarted, equals the batch; state goes when its time is over."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from veilmark.streaming import ordered

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, folder, schema, batches, make, name, delay="20 seconds"):
    """Rows of a stream whose files come one after the other; the query is stopped and started again between them."""
    source, state = str(folder / "in"), []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source).withWatermark("ts", delay))
        writer = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination(120)
        state = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]] or state
    out = spark.read.parquet(str(folder / "out"))
    return out, state


CHANGES = "root string, ts timestamp, path string, immediate boolean"


def changes(seed, roots, n, span):
    rng = random.Random(seed)
    return [(rng.choice(roots), at(round(rng.uniform(0, span), rng.choice([0, 3]))), f"p{rng.randrange(9)}", rng.random() < 0.08) for _ in range(n)]


def fired(rows):
    """A plain simulation of the timers, one root at a time."""
    out = []
    for root in {r[0] for r in rows}:
        last, timer, paths, n, now = None, None, set(), 0, False

        def due():
            return timer if now or last is None or timer - last >= dt.timedelta(seconds=30) else last + dt.timedelta(seconds=30)

        for _, t, path, immediate in sorted((r for r in rows if r[0] == root), key=lambda r: r[1]):
            if timer is not None and due() <= t:
                last = due()
                out.append((root, last, n, sorted(paths), now))
                timer, paths, n, now = None, set(), 0, False
            paths.add(path)
            n, now, timer = n + 1, now or immediate, t + dt.timedelta(seconds=2)
        out.append((root, due(), n, sorted(paths), now))
    return sorted(out)


def test_audits(spark):
    rows = changes(1, ["a", "b", "c"], 400, 900) + [("solo", at(5), "x", False), ("tie", at(1), "x", False), ("tie", at(3), "y", False), ("tie", at(3), "x", True)]
    assert sorted(map(tuple, ordered.audits(spark.createDataFrame(rows, CHANGES).repartition(3)).collect())) == fired(rows)
    assert ordered.audits(spark.createDataFrame([], CHANGES)).count() == 0
    odd = ordered.audits(spark.createDataFrame([(None, at(0), None, None), (None, None, "y", True)], CHANGES)).collect()
    assert [tuple(r) for r in odd] == [(None, at(2), 1, [], False)]


@pytest.mark.parametrize("parts", [1, 4])
def test_audits_stream_equals_batch(spark, tmp_path, parts):
    rows = changes(parts, ["a", "b"], 120, 400)
    rows.sort(key=lambda r: r[1])
    rng = random.Random(2)
    jittered = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.uniform(0, 15)))  # within the watermark's delay
    size = -(-len(rows) // parts)
    batches = [jittered[i : i + size] for i in range(0, len(rows), size)] + [[("end", at(10_000), "x", False)], [("end", at(30_000), "x", False)]]
    out, _ = run(spark, tmp_path, CHANGES, batches, ordered.audits_stream, f"audits{parts}")
    assert sorted(tuple(r) for r in out.filter("root != 'end'").collect()) == fired(rows)


def test_stream_drops_late_rows_and_forgets(spark, tmp_path):
    batches = [[(f"k{i}", at(i), "p", False) for i in range(50)], [("end", at(5000), "x", False)], [("k1", at(9), "late", True), ("end", at(9000), "x", False)], [("end", at(12_000), "x", False)]]
    out, state = run(spark, tmp_path, CHANGES, batches, ordered.audits_stream, "late")
    assert out.filter("array_contains(paths, 'late')").count() == 0 and out.filter("root != 'end'").count() == 50
    assert state is not None
    left = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "cp"))
    assert [r["key"][0] for r in left.collect()] == ["end"]


JOBS = "job_id string, repo_url string, status string, ts timestamp"


def test_job_steps(spark):
    rows = [
        ("a", "u", "queued", 0), ("a", "u", "completed", 10), ("a", "u", "running", 20),  # late: stays completed
        ("b", "u", "running", 0), ("b", "u", "queued", 5),  # nothing before queued
        ("c", "v", "failed", 7), ("c", "v", "queued", 7), ("c", None, "running", 7),  # one time: in the order of steps
        ("d", "w", "queued", 0), ("d", "w", "running", 200), ("d", "w", "queued", 300),  # expired, then new
        ("e", "w", "queued", 0), ("e", "w", "running", 100), ("e", "w", "nonsense", 101), ("e", "x", "queued", 150),
    ]
    df = spark.createDataFrame([(j, u, s, at(t)) for j, u, s, t in rows], JOBS).repartition(3)
    got = sorted(map(tuple, ordered.job_states(df, keep=100).collect()))
    assert got == [
        ("a", "u", "completed", at(0), at(10)), ("b", "u", "queued", at(5), at(5)), ("c", "v", "failed", at(7), at(7)),
        ("d", "w", "queued", at(300), at(300)), ("e", "w", "running", at(0), at(100)),
    ]
    assert ordered.job_log(df, keep=100).filter("job_id = 'd'").orderBy("updated_at").select("status").collect() == [("queued",), ("expired",), ("queued",)]


def test_jobs_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"j{rng.randrange(12)}", "u", rng.choice(ordered.JobFold.STEPS), at(rng.randrange(600))) for _ in range(200)]
    rows.sort(key=lambda r: r[3])
    batches = [rows[:90], rows[90:], [("end", "u", "queued", at(50_000))], [("end", "u", "running", at(90_000))]]
    out, _ = run(spark, tmp_path, JOBS, batches, lambda s: ordered.job_log_stream(s, keep=60), "jobs")
    wanted = ordered.job_log(spark.createDataFrame(rows, JOBS), keep=60)
    got = out.filter("job_id != 'end'")
    key = lambda df: sorted(map(tuple, df.filter("status != 'expired'").collect()))
    assert key(got) == key(wanted)
    assert got.filter("status = 'expired'").count() == got.filter("status = 'queued'").count()  # in the end all have


def test_rate_limit_stream(spark, tmp_path):
    schema = "client string, ts timestamp, id bigint"
    rng = random.Random(4)
    rows = [(rng.choice("cd"), at(rng.randrange(300)), i) for i in range(120)]
    rows.sort(key=lambda r: r[1])
    out, _ = run(spark, tmp_path, schema, [rows[:60], rows[60:], [("end", at(9000), 0)]], ordered.rate_limit_stream, "rates")
    wanted = ordered.fold_batch(spark.createDataFrame(rows, schema), ordered.RateFold(), "client")
    assert sorted(map(tuple, out.filter("client != 'end'").collect())) == sorted(map(tuple, wanted.collect()))
    assert {r["client"]: r["n"] for r in out.groupBy("client").agg(F.count("*").alias("n")).collect()}["c"] > 5


def test_fold_of_a_long_key(spark):
    """One key with very many events streams through: no array, no window."""
    df = spark.range(60_000).select(F.lit("k").alias("root"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("p").alias("path"), F.lit(False).alias("immediate"))
    began = time.time()
    assert ordered.audits(df).collect()[0]["n"] == 60_000 and time.time() - began < 60
