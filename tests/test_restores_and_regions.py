"""Texts restored as of their time, and values found in pages, against plain loops."""

import datetime as dt
import random
import re
import unicodedata

from pyspark.sql import functions as F

from veilmark.operators import regions, restores

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def restored(texts, mappings):
    out = []
    for i, ts, text in texts:
        needs = set(re.findall(restores.PLACEHOLDER, text or ""))
        fit = [m for m in mappings if ts is not None and needs and m[1] <= ts and (m[2] is None or ts < m[2]) and needs <= set(m[3])]
        best = max(fit, key=lambda m: (m[1], m[0]), default=None)
        for k, v in (best[3] if best else {}).items():
            text = text.replace(k, v)
        out.append((i, text, best[0] if best else None))
    return sorted(out, key=str)


def test_restore_as_of(spark):
    rng = random.Random(3)
    mappings, texts = [], []
    for i in range(150):
        t = rng.randrange(40_000)
        keys = [f"{{{{EMAIL_{k}}}}}" for k in range(1, rng.randrange(2, 5))] + [f"{{{{PERSON_{k}}}}}" for k in range(1, rng.randrange(1, 3))]
        ttl = rng.choice([None, 0, 100, 3000, rng.randrange(1, 20_000)])
        mappings.append((f"m{i:03}", at(t), None if ttl is None and rng.random() < 0.5 else at(t + (ttl or 50)), {k: f"v{i}{k[2:-2]}" for k in keys}))
    for i in range(500):
        parts = rng.sample(["{{EMAIL_1}}", "{{EMAIL_3}}", "{{PERSON_1}}", "{{OTHER_9}}", "plain", "{{EMAIL_1}}", "{{email_1}}"], rng.randrange(1, 4))
        texts.append((i, at(rng.choice([rng.randrange(50_000), rng.choice(mappings)[1].timestamp() - T0.timestamp()])), " ".join(parts)))
    texts += [(900, None, "{{EMAIL_1}}"), (901, at(9000), None), (902, at(9000), ""), (903, at(20_000), "{{EMAIL_1}}"), (903, at(20_000), "{{EMAIL_1}}"), (None, at(30_000), "{{EMAIL_1}} {{PERSON_1}}")]
    df = spark.createDataFrame(texts, "id int, ts timestamp, text string").withColumn("mapping", F.lit("own"))
    held = spark.createDataFrame(mappings, "mapping_id string, created_at timestamp, expires_at timestamp, mapping map<string,string>")
    got = sorted(((r["id"], r["text"], r["mapping_id"]) for r in restores.restore_as_of(df.repartition(3), held).collect()), key=str)
    assert got == restored(texts, mappings) and sum(m is not None for _, _, m in got) > 150
    assert restores.restore_as_of(df, held.filter("false")).filter("mapping_id is not null").count() == 0
    assert restores.restore_as_of(df.filter("false"), held).count() == 0


def test_restore_ties(spark):
    held = spark.createDataFrame([("a", at(0), None, {"{{EMAIL_1}}": "x"}), ("b", at(0), at(10), {"{{EMAIL_1}}": "y"}), ("c", at(5), at(7), {"{{EMAIL_1}}": "z"})], "mapping_id string, created_at timestamp, expires_at timestamp, mapping map<string,string>")
    df = spark.createDataFrame([(s, at(s), "{{EMAIL_1}}") for s in (-1, 0, 4, 5, 6, 7, 9, 10, 99)], "id int, ts timestamp, text string")
    assert [r["text"] for r in restores.restore_as_of(df, held, bucket_seconds=3).orderBy("id").collect()] == ["{{EMAIL_1}}", "y", "y", "z", "z", "y", "y", "x", "x"]


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def by_hand(text, value):
    """Places by trying every start and the shortest end; greedy, without overlaps."""
    wanted, out, i = plain(value), [], 0
    while wanted and i < len(text):
        end = next((j for j in range(i + 1, min(len(text), i + 3 * len(wanted) + 3) + 1) if plain(text[i:j]) == wanted and plain(text[i])), None)
        if end is None:
            i += 1
            continue
        while end < len(text) and unicodedata.category(text[end]) == "Mn":
            end += 1
        out.append((i, end))
        i = end
    return out


def test_regions(spark):
    rng = random.Random(5)
    letters = ["a", "A", "á", "Á", "á", "b", "B", " ", "é", "E", "ß", "aa"]
    pages = [(d, p, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))) for d in range(12) for p in range(3)]
    values = [(d, i, "".join(rng.choice(letters[:7] + letters[8:]) for _ in range(rng.randrange(1, 4)))) for d in range(10) for i in range(6)]
    pages += [(20, 0, None), (20, 1, ""), (None, 0, "abc"), (11, 9, "abc")]
    values += [(20, 1, "a"), (0, 90, None), (0, 91, ""), (0, 92, "́"), (None, 93, "abc")]
    p, v = spark.createDataFrame(pages, "doc_id int, page int, text string"), spark.createDataFrame(values, "doc_id int, value_id int, value string")
    wanted, first = [], {}
    for d, i, value in values:
        if d is not None and value and plain(value):
            first[d, plain(value)] = min(first.get((d, plain(value)), i), i)
    for (d, value), i in first.items():
        wanted += [(d, page, i, s, e) for doc, page, text in pages if doc == d and text for s, e in by_hand(text, value)]
    found = regions.find_regions(p.repartition(3), v)
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and len(wanted) > 100
    plan = {(r["doc_id"], r["value_id"]): (r["n_regions"], r["resolved"]) for r in regions.redaction_plan(p, v).collect()}
    assert len(plan) == len(values)
    for d, i, value in values:
        n = sum(w[0] == d and w[2] == first.get((d, plain(value or ""))) for w in wanted) if value and d is not None else 0
        assert plan[d, i] == (n, n > 0)
    black = {(r["doc_id"], r["page"]): r["text"] for r in regions.redact_regions(p, found).collect()}
    for d, page, text in pages:
        covered = {k for w in wanted if w[:2] == (d, page) for k in range(w[3], w[4])}
        assert d is None or black[d, page] == (None if text is None else "".join("█" if k in covered else c for k, c in enumerate(text)))


def test_places_are_handed_on_in_parts():
    import pyarrow as pa

    wanted = [{"value_id": 1, "value": "é"}, {"value_id": 2, "value": "x"}]
    given = pa.RecordBatch.from_pylist([{"doc_id": d, "page": 0, "text": text, "wanted": wanted} for d, text in ((1, "E" * 50_000), (2, "x"), (3, ""))])
    schema = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("value_id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    parts = list(regions._searched(iter([given, given]), schema))
    assert max(p.num_rows for p in parts) <= 1 << 14
    rows = pa.Table.from_batches(parts).to_pylist()
    assert len(rows) == 100_002 and [r["start"] for r in rows[:50_000]] == list(range(50_000)) and rows[50_000] == {"doc_id": 2, "page": 0, "value_id": 2, "start": 0, "end": 1}
