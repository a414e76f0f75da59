"""Importance resampling, the Merkle manifest and quality rules, against brute force."""

import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SMALL, docs, sentence, words  # noqa: E402

from veilmark.llm import merkle, quality_rules, queries, ranking, resample  # noqa: E402
from veilmark.llm.common import table, written  # noqa: E402

AWKWARD = [
    (1, None), (2, ""), (3, "..."), (4, sentence(4, 30)), (4, sentence(4, 30)), (5, sentence(4, 30)), (6, "É é É " * 10 + "ABC abc " * 5), (None, sentence(9, 40)),
    (None, sentence(9, 40)), (7, "a b c " * 60_000), (8, sentence(8, 19)), (9, sentence(8, 20)), (-3, "x\ty\x0bz w v " * 9),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def small():
    return duckdb.connect()


@pytest.mark.parametrize("name", ["op11_resample", "op12_merkle_manifest"])
def test_queries_equal_sql(spark, small, name):
    for t in ("documents", "benchmark"):
        small.sql(f"create or replace view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = [tuple(map(str, r)) for r in df.select(*columns).collect()]
    assert sorted(got) == sorted(tuple(map(str, r)) for r in small.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall())


def test_numbered_splits_hot_groups(spark):
    rows = [("hot", random.Random(i).randrange(50)) for i in range(3000)] + [(None, i) for i in range(40)] + [(f"g{i}", i) for i in range(20)]
    df = written(spark.createDataFrame(rows, "g string, v bigint").repartition(7).withColumn("tie", F.monotonically_increasing_id()))
    got = ranking.numbered(df, ["g"], [F.col("v").asc(), F.col("tie").asc()])
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append((r["at"], r["v"]))
        assert r["group_rows"] == sum(g == r["g"] for g, _ in rows)
    for g, found in by.items():
        assert [at for at, _ in sorted(found)] == list(range(len(found)))
        assert [v for _, v in sorted(found)] == sorted(v for h, v in rows if h == g)


# ---- resampling


def drawn(rows, target, percent, least, longest, buckets, seed):
    def runs(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    def bucket(run):
        return zlib.crc32(run.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for run in runs(text):
                counts[bucket(run)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f = runs(text)
        weight = sum(gain[bucket(r)] for r in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append((i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return sorted(map(str, [(*r, n + 1) for n, r in enumerate(able) if n < len(able) * percent // 100])), sorted(map(str, out))


@pytest.mark.parametrize(("percent", "longest"), [(10, 1), (55, 2), (100, 3), (0, 1)])
def test_resampling(spark, percent, longest):
    rows = AWKWARD + [(100 + i, sentence(i, 15 + i % 12) + " café THE end") for i in range(60)]
    target = ["the end of a café", None, "", sentence(5, 30)]
    df = docs(spark, rows).repartition(5)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, longest=longest, buckets=500, seed="7").collect()
    wanted, every = drawn(rows, target, percent, 20, longest, 500, "7")
    assert sorted(str(tuple(r)[:5]) for r in got) == every
    assert sorted(str(tuple(r)) for r in got if r["rank"] is not None) == wanted


def test_resampling_empty_tables(spark):
    none, some = docs(spark, []), docs(spark, [(1, sentence(1, 30))])
    assert resample.resample(none, some).count() == 0
    assert [r["rank"] for r in resample.resample(some, none, percent=100).collect()] == [1]
    assert [r["rank"] for r in resample.resample(some, none).collect()] == [None]
    assert resample.bucket_counts(spark.createDataFrame(spark.sparkContext.emptyRDD(), "text string"), buckets=9).tolist() == [0] * 9


# ---- Merkle manifest


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def step(tree, at, fanout):
    """Siblings of leaf `at`, level by level, as (left, right)."""
    found = []
    for level in tree[:-1]:
        run = at // fanout * fanout
        found.append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
        at //= fanout
    return found


@pytest.mark.parametrize(("sizes", "fanout", "depth"), [({"a": 1, "b": 16, None: 17, "é": 3}, 16, 2), ({"hot": 700, "c": 1, "d": 64, "e": 65}, 4, 2), ({"x": 300}, 2, 3), ({f"s{i}": i % 5 + 1 for i in range(40)}, 3, 1), ({"one": 1}, 16, 2)])
def test_manifest(spark, sizes, fanout, depth):
    rows = [(g, sha(f"{g}{i}"), i // 2 if i % 3 else None) for g, n in sizes.items() for i in range(n)]
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "tree string, node string, doc_id bigint").repartition(6)
    shape = merkle.Shape(fanout, depth)
    got = merkle.merkle_manifest(df, [F.col("doc_id").asc_nulls_first()], shape).withColumn("proof", merkle.proof()).withColumn("again", merkle.folded_root("node")).withColumn("other", merkle.folded_root("sha2(node, 256)"))
    trees = {}
    for g in sizes:
        trees[g] = levels([n for _, n in sorted((((i is not None, i or 0), n) for h, n, i in rows if h == g))], fanout)
    order = sorted(sizes, key=lambda g: (g is not None, (g or "").encode()))
    top = levels([trees[g][-1][0] for g in order], fanout)
    count = 0
    for r in got.collect():
        count += 1
        g = r["tree"]
        path = step(trees[g], trees[g][0].index(r["node"]), fanout) + step(top, order.index(g), fanout)
        assert (r["subroot"], r["root"]) == (trees[g][-1][0], top[-1][0])
        assert r["proof"] == "".join(a + b for a, b in path)
        assert r["again"] == r["root"]
        assert path == [] or r["other"] != r["root"]
    assert count == len(rows)


def test_manifest_awkward_rows(spark):
    """Nulls in any column, repeated rows, clashing names, an empty table; a leaf's fields can't run into each other."""
    df = docs(spark, AWKWARD)
    leaves = df.select(F.col("sha").alias("tree"), merkle.leaf_of(F.col("doc_id"), F.col("text")).alias("node"), "doc_id", "row_key", "id", "lang")
    got = merkle.merkle_manifest(leaves, [F.col("doc_id").asc_nulls_first()]).withColumn("again", merkle.folded_root("node")).collect()
    assert len(got) == len(AWKWARD) and all(r["again"] == r["root"] for r in got)
    assert sorted(r["node"] for r in got) == sorted(sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)) for r in AWKWARD)
    assert merkle.merkle_manifest(leaves.filter("false"), []).count() == 0


# ---- quality rules

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = SPACE.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = set()
    seen = {}
    for i, x in enumerate(windows):
        seen.setdefault(x, []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(8))
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_base_counts(spark):
    rng = random.Random(3)
    texts = [t for _, t in AWKWARD if t is None or len(t) < 10_000]
    texts += [" ".join(rng.choice(["a", "b", "#é", "\n", "c\nc", "|"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["\n".join([sentence(1, 9)] * 3 + [" ", "\t", "x", "x ", "x"]), "w " * 8, "w " * 9, "a b c d e f g h " * 3, "é\r\né\né"]
    got = quality_rules.quality(docs(spark, list(enumerate(texts))), None).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:7] == base(texts[r["doc_id"]])
        assert r["kept"] is not r["base_failed"] and r["probability"] is None


def test_quality_long_and_empty(spark):
    r = quality_rules.quality(docs(spark, [(7, "a b c " * 100_000)]), None).first()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (300_000, 300_000, True)
    assert quality_rules.quality(docs(spark, []), None).count() == 0


def test_quality_slots_do_not_depend_on_slices(monkeypatch):
    text = " ".join(sentence(i, 50) for i in range(20)) + " |||é"
    prepared, hashes = quality_rules._prepared([text])
    (text, _, numbers), at = prepared[0], {}
    for size in (1 << 18, 7):
        monkeypatch.setattr(quality_rules, "_SLICE", size)
        at[size] = [np.sort(np.concatenate([s for k, s in quality_rules.gram_slots(text, numbers, hashes, 12) if k == kind])) for kind in (0, 1)]
    assert all((a == b).all() for a, b in zip(at[7], at[1 << 18], strict=True))
    assert len(at[7][0]) == 2 * len(numbers) - 1 and len(at[7][1]) == sum(len(text) - n + 1 for n in (2, 3, 4))


def test_quality_held_out(spark):
    """Labels that the fit never saw: junk goes, clean documents stay, and probabilities mean what they say."""
    folder = "/root/testdata/sf0.01"
    every, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality_rules.fit(every, labels.filter("doc_id % 3 != 0"))
    rows = quality_rules.quality(every, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert len(good) > 80 and len(bad) > 10
    assert np.mean([r["probability"] >= 0.5 for r in good]) > 0.97 and np.mean([r["kept"] for r in bad]) < 0.1
    assert abs(np.mean([r["probability"] for r in rows]) - len(good) / len(rows)) < 0.08


def test_quality_labels(spark):
    """Nulls, other values and contradicting labels teach nothing; without both classes there is no model."""
    texts = docs(spark, [(i, sentence(i, 30)) for i in range(40)] + [(None, "x"), (5, "again"), (6, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 0), (2, 1), (31, 3), (32, None), (None, 1), (4, 0)], "doc_id bigint, quality int")
    got = {r["doc_id"]: (r["label"], r["text"]) for r in quality_rules.training_rows(texts, labels, 100).collect()}
    assert set(got) == set(range(30)) - {1, 2} and all(got[i][0] == i % 2 for i in got) and got[5][1] == min(sentence(5, 30), "again")
    few = quality_rules.training_rows(texts, labels, 3).collect()
    assert len(few) == 6 and {(r["label"], r["weight"]) for r in few} == {(0.0, 14 / 3), (1.0, 14 / 3)}
    assert quality_rules.fit(texts, labels.filter("quality = 1")) is None
    assert quality_rules.fit(texts, labels.filter("false")) is None
