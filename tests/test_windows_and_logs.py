"""Windowed scans against whole ones, rotated logs, and an index that changes part by part."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from veilmark.functions import paths as P
from veilmark.operators import spans, windows
from veilmark.plans import samples as S
from veilmark.sources import logs

T0 = dt.datetime(2024, 1, 1)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "start", "end", "entity_type", "value", "source", "rule_ord").collect()), key=str)


@pytest.mark.parametrize(("window", "overlap"), [(150, 300), (1000, 300), (100_000, 300)])
def test_window_scan_equals_whole(spark, window, overlap):
    rng = random.Random(window)
    texts = []
    for i in range(12):
        parts = [rng.choice(S.FINDINGS) if rng.random() < 0.4 else " ".join(rng.choice(["wörd", "text", "12", "a.b", "\n"]) for _ in range(rng.randrange(30))) for _ in range(40)]
        texts.append((i % 10, " \n".join(parts)))
    df = spark.createDataFrame([*texts, (None, texts[0][1]), (50, None), (51, "")], "doc_id int, text string").repartition(3)
    assert found(windows.window_scan(df, window=window, overlap=overlap)) == found(spans.detect(df))


def test_words_are_never_cut(spark):
    rng = random.Random(2)
    word = lambda n: "".join("+" if i % 20 == 19 else rng.choice("abcdefghijkmnpqrstuvwxyz23456789ABCDEFGH") for i in range(n)) + "a"
    key = "x " * 90 + "-----BEGIN RSA " + "PRIVATE KEY-----\n" + "MIIEabc\n" * 20 + "-----END RSA " + "PRIVATE KEY----- " + "y " * 90
    df = spark.createDataFrame([(1, key), (2, " ".join(word(rng.choice([40, 90, 180, 900])) for _ in range(40))), (3, word(5000)), (4, "é" * 900)], "doc_id int, text string")
    whole = found(spans.detect(df))
    assert found(windows.window_scan(df, window=200, overlap=250)) == whole and len(whole) > 10
    assert [r for r in found(windows.window_scan(df, window=70, overlap=20)) if r[0] != 1] == [r for r in whole if r[0] != 1]


def test_a_long_text_is_many_tasks(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('plain words here ann@corp.example \\n', 60000)").alias("text"))
    pieces = windows.cut(df, "doc_id", "text")
    assert pieces.count() == 11 and pieces.select("own_start").distinct().count() == 11
    assert windows.window_scan(df, enabled=["email"]).count() == 60_000


def test_first_fit_is_linear(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 4).cast("int").alias("end"), F.lit(1).alias("rule_ord"), F.lit("t").alias("entity_type"), F.lit("v").alias("value"))
    assert spans.first_fit(df).count() == n // 2


# ---- logs


def test_rotation(spark, tmp_path):
    rng = random.Random(1)
    folder, wanted, state = str(tmp_path / "log"), {}, {}
    for batch in range(4):
        rows = [(rng.choice(["a", "b"]), batch * 1000 + i, "é" * rng.randrange(40)) for i in range(60)]
        df = spark.createDataFrame(rows, "log string, seq int, line string").repartition(3)
        for _ in range(1 + batch % 2):  # every second batch comes twice
            logs.append_rotated(df, folder, batch, most=500)
        for log, _, line in sorted(rows, key=lambda r: r[1]):
            number, size = state.get(log, (0, 0))
            if size > 500:
                number, size = number + 1, 0
            state[log] = number, size + len(line.encode()) + 1
            wanted.setdefault((log, number), []).append(line)
    got = {}
    for r in logs.read_log(spark, folder, keep=None).collect():
        got.setdefault((r["log"], r["file_no"]), []).append(r["line"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}
    newest = {(r["log"], r["file_no"]) for r in logs.read_log(spark, folder).collect()}
    assert newest == {(log, n) for log, (top, _) in state.items() for n in (top, top - 1)}
    lines = open(sorted(glob.glob(f"{folder}/log=a/file_no=0/batch=0/part-*"))[0], encoding="utf-8").read().split("\n")[:-1]
    assert lines == wanted["a", 0][: len(lines)]


def test_rotation_nulls(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 2, "x" * 20), ("l", 1, "")], "log string, seq int, line string")
    assert sorted((str(r["log"]), r["seq"], r["file_no"]) for r in logs.rotated(df, most=0).collect()) == [("None", 1, 0), ("None", 2, 1), ("l", 1, 0)]


# ---- index


def test_index(spark, tmp_path):
    rng = random.Random(8)
    folder, held = str(tmp_path / "index"), {}
    names = [p[0] for p in S.PATHS] + [f"d{i}/k.pem" for i in range(60)]
    sensitive = {r["p"] for r in spark.createDataFrame([(n,) for n in names], "p string").filter(P.sensitive_pattern(F.col("p")).isNotNull()).collect()}
    assert logs.read_index(spark, folder).count() == 0
    for batch in range(5):
        rows = [(rng.choice(names), T0 + dt.timedelta(seconds=rng.randrange(20)), rng.random() < 0.4) for _ in range(25)] + [(None, T0, False), ("", T0, False)]
        df = spark.createDataFrame(rows, "path string, ts timestamp, removed boolean")
        if batch == 3:  # breaks off before its commit: not seen
            before = sorted(r[0] for r in logs.read_index(spark, folder).collect())
            broken = spark.createDataFrame([("x/k.pem", 1, 3)], "path string, part int, version bigint")
            logs._written_by_parts(broken, f"{folder}/paths", "part", "version")
            assert sorted(r[0] for r in logs.read_index(spark, folder).collect()) == before
        for _ in range(1 + batch % 2):
            logs.upsert_index(df, folder, batch, parts=8)
        last = {}
        for path, ts, removed in rows:
            if path:
                last[path] = max(last.get(path, (ts, removed)), (ts, removed))
        for path, (_, removed) in last.items():
            held[path] = not removed and path in sensitive
        assert sorted(r[0] for r in logs.read_index(spark, folder).collect()) == sorted(p for p, there in held.items() if there)


def test_index_writes_touched_parts_only(spark, tmp_path):
    folder = str(tmp_path / "index")
    first = spark.createDataFrame([(f"d{i}/k.pem", T0, False) for i in range(80)], "path string, ts timestamp, removed boolean")
    logs.upsert_index(first, folder, 0, parts=8)
    logs.upsert_index(spark.createDataFrame([("d1/k.pem", T0, True)], "path string, ts timestamp, removed boolean"), folder, 1, parts=8)
    assert len(glob.glob(f"{folder}/paths/part=*/version=1")) == 1 and logs.read_index(spark, folder).count() == 79


def test_index_stream(spark, tmp_path):
    schema = "path string, ts timestamp, removed boolean"
    source, folder = str(tmp_path / "in"), str(tmp_path / "index")
    for rows in ([("a/x.pem", T0, False), (".env", T0, False)], [("a/x.pem", T0 + dt.timedelta(seconds=1), True), ("b/y.pem", T0, False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(lambda df, n: logs.upsert_index(df, folder, n)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(r[0] for r in logs.read_index(spark, folder).collect()) == [".env", "b/y.pem"]
