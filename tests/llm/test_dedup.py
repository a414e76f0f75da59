"""Exact dedup, the n-gram join, and repeated passages."""

import hashlib
import random
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SMALL, docs, near_classes, sentence, words  # noqa: E402

from veilmark.llm import components, exact_dedup, ngram_join, passages, queries, shingles  # noqa: E402

AWKWARD = [(5, "a  b"), (3, "a\tb"), (3, "a b"), (1, None), (2, ""), (None, "a b"), (7, "x" * 200_000), (7, "x" * 200_000), (9, "A b"), (4, " "), (6, " ")]


def test_exact_dedup_awkward(spark):
    rows = exact_dedup.exact_dedup(docs(spark, AWKWARD)).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows)
    norm = {id(r): re.sub(r"[ \t-\r]+", " ", r[1] or "") for r in AWKWARD}
    groups: dict = {}
    for r in AWKWARD:
        groups.setdefault(norm[id(r)], []).append(r[0])
    assert len(rows) == len(AWKWARD)
    for doc, keep, size, _, sha in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == sha)
        ids = groups[text]
        assert keep == min(i for i in ids if i is not None) and size == len(ids) and (doc if doc >= 0 else None) in ids
    assert sum(r["kept"] for r in rows) == len(groups)


def test_exact_dedup_tiny_filter_is_still_exact(spark):
    df = docs(spark, [(i, f"text {i % 700}") for i in range(1000)])
    rows = exact_dedup.exact_dedup(df, bits_per_row=1, max_filter_bits=1 << 16).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in rows} == {(i, i % 700) for i in range(1000)}


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(docs(spark, [])).count() == 0


def test_drop_exact_copies_keeps_columns(spark):
    df = docs(spark, AWKWARD)
    left = exact_dedup.drop_exact_copies(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 6, 7, 9]


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands, rows = ngram_join.bands_and_rows(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_ngram_join_awkward(spark):
    a, b = sentence(1, 60), sentence(2, 60)
    near = a.replace(a.split()[30], "changed")  # one of 60 words: 51 of 61 grams
    rows = [(5, a), (3, near), (4, a.upper()), (9, b), (1, None), (2, ""), (8, "!!"), (10, "two words"), (11, "Two, words!"), (12, "three words here"), (5, a), (13, "x " * 30_000)]
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.ngram_join(docs(spark, rows)).collect()]
    wanted = [(doc, c, n, doc == c) for (doc, _), (c, n) in near_classes(rows).items()]
    assert sorted(got) == sorted(wanted)


def test_ngram_join_large_group_against_all_pairs(spark):
    rng = random.Random(3)
    base = sentence(1, 80).split()
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, sentence(50 + i, 40)) for i in range(60)] + [(2000 + i, rows[0][1]) for i in range(50)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs(spark, rows)).collect()}
    assert got == {doc: v for (doc, _), v in near_classes(rows).items()}


def test_ngram_join_null_ids_and_empty(spark):
    a = sentence(4, 30)
    rows = ngram_join.ngram_join(docs(spark, [(None, a), (7, a), (None, "lonely text of some words here")])).collect()
    assert sorted(((str(r["doc_id"]), r["class_id"]) for r in rows), key=str) == [("7", 7), ("None", 7), ("None", None)]
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0


def test_similar_equals_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    left, right = np.nonzero(ngram_join.similar(sets, 0.5))
    wanted = {(i, j) for i in range(80) for j in range(i + 1, 80) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == wanted


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert all(find(n) == got.get(n, n) for n in parent)
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_word_hashes():
    texts = [b"a bb a", b"", b"\xc3\xa9 a", b"x" * 3000, b"a"]
    found = list(shingles.word_hashes(texts))
    assert [len(f) for f in found] == [3, 0, 2, 1, 1] and found[0][0] == found[0][2] == found[2][1] == found[4][0] != found[0][1]


def test_compact_windows_cover_every_run():
    rng = random.Random(4)
    for _ in range(400):
        values = np.array([rng.randrange(rng.choice([2, 6, 20])) for _ in range(rng.randrange(1, 30))], np.uint64)
        if rng.random() < 0.3:
            values = np.concatenate([values[:3], np.tile(values[:4], 6), values])
        least = rng.randrange(1, 6)
        found = passages.compact_windows(values, least)
        for i in range(len(values)):
            for j in range(i + least, len(values) + 1):
                holds = any(low <= i <= c < j <= high and values[c] == values[i:j].min() for low, c, high, _, _ in found)
                assert holds or any(a < i and j <= b for _, _, _, a, b in found)
        for _, c, _, a, b in found:
            assert a <= c < b and any((values[a + p : b] == values[a : b - p]).all() for p in range(1, least + 1)) or b == a + 1


def test_windows_of_many_texts_are_those_of_the_trees():
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, k, m).astype(np.uint64) for k in (2, 3, 5, 30, 10**9) for m in (0, 3, 49, 50, 51, 400)]
    texts.append(np.tile(rng.integers(1, 99, 7).astype(np.uint64), 60))
    tools = passages.Signatures(5, 46, 16, 3)
    _, first, owner, _, windows = tools.of(texts)
    got = {(t, *row) for t, row in zip(owner.tolist(), (windows - first[owner][:, None]).tolist(), strict=True)}
    want = set()
    for t, words in enumerate(texts):
        grams = shingles.gram_hashes(words, 5) if len(words) >= 50 else np.empty(0, np.uint64)
        want |= {(t, c, a, b) for seed in tools.seeds for _, c, _, a, b in passages.compact_windows(grams * seed, 46, grams)}
    assert got == {w for w in want if w[1] >= 15 or w[1] + 16 <= len(texts[w[0]]) - 4}
    assert len(tools.of([])[3]) == len(tools.of([np.empty(0, np.uint64)])[3]) == 0


def test_passages_awkward(spark):
    p, q = sentence(1, 60), sentence(2, 55)
    edited = p.split()
    edited[30] = "other"
    rows = [
        (1, f"{sentence(11, 40)} {p} {sentence(12, 40)}"), (2, f"{sentence(13, 25)} {p.upper()}, {sentence(14, 70)}"), (3, f"{q} {sentence(15, 30)}"), (4, sentence(16, 90)), (5, f"{sentence(17, 9)} {q}"),
        (6, sentence(18, 49)), (7, sentence(18, 49)), (8, None), (9, ""), (10, sentence(19, 50)), (11, sentence(19, 50)), (12, f"{sentence(20, 30)} {' '.join(edited)} {sentence(21, 20)}"),
        (13, "same " * 3000), (14, sentence(22, 20) + " same" * 200), (15, f"{sentence(23, 60)} x {sentence(23, 60)}"), (1, f"{sentence(11, 40)} {p} {sentence(12, 40)}"), (None, sentence(24, 80)),
    ]
    found = sorted((r["doc_id"], r["start_word"], r["end_word"], r["class_id"]) for r in passages.repeated_passages(docs(spark, rows)).collect())
    assert sorted(set(found)) == [
        (1, 40, 100, 1), (2, 25, 85, 1), (3, 0, 55, 3), (5, 9, 64, 3), (10, 0, 50, 10), (11, 0, 50, 10), (12, 30, 90, 1), (13, 0, 3000, 13), (14, 20, 220, 13),
    ]


def test_passages_with_inserted_and_removed_words(spark):
    p, q, long = sentence(1, 95).split(), sentence(2, 95).split(), sentence(3, 300).split()
    often = [w for i in range(0, 300, 45) for w in [*long[i : i + 45], f"new{i}"]]
    texts = [p, [*p[:47], "inserted", *p[47:]], q, [*q[:44], *q[46:]], long, often]
    rows = [(i, f"{sentence(100 + i, 30)} {' '.join(w)} {sentence(200 + i, 30)}") for i, w in enumerate(texts)]
    got = {r["doc_id"]: (r["start_word"], r["end_word"], r["class_id"]) for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == {0: (30, 125, 0), 1: (30, 126, 0), 2: (30, 125, 2), 3: (30, 123, 2), 4: (30, 330, 4), 5: (30, 336, 4)}


def test_passages_keep_links_through_a_third_text(spark):
    p, q = sentence(1, 60), sentence(2, 60)
    rows = [(1, f"{sentence(11, 30)} {p} {sentence(12, 30)}"), (3, f"{sentence(13, 30)} {q} {sentence(14, 30)}"), (5, f"{sentence(15, 30)} {p} {q}"), (7, f"{p} {sentence(16, 90)} {sentence(3, 60)}"), (8, sentence(3, 60))]
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["class_id"]) for r in passages.repeated_passages(docs(spark, rows)).collect())
    assert got == [(1, 30, 90, 1), (3, 30, 90, 1), (5, 30, 150, 1), (7, 0, 60, 1), (7, 150, 210, 7), (8, 0, 60, 7)]


def test_passages_large_group(spark):
    p = sentence(1, 70)
    rows = [(i, f"{sentence(100 + i, 30)} {p} {sentence(5000 + i, 30)}") for i in range(600)]
    got = {r["doc_id"]: (r["start_word"], r["end_word"], r["class_id"]) for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == {i: (30, 100, 0) for i in range(600)}


def test_passages_recall_of_changed_passages(spark):
    """Planted pairs whose passages are similar by at least 0.8: nine of ten are found, whatever changed; texts of their own are left alone."""
    rng, rows, planted = random.Random(7), [], []
    for kind in ("substituted", "inserted", "removed"):
        for length in (60, 95):
            for k in range(40):
                i = len(rows)
                p = [f"p{i}x{j}" for j in range(length)]
                q = list(p)
                for _ in range(1 if length == 60 else 2):
                    at = rng.randrange(5, len(q) - 5)
                    q[at : at + 1] = [] if kind == "removed" else [f"new{rng.random()}"] + ([q[at]] if kind == "inserted" else [])
                for w in (p, q):
                    rows.append((len(rows), f"{sentence(3 * len(rows), 40)} {' '.join(w)} {sentence(3 * len(rows) + 1, 40)}"))
                planted.append((kind, i))
    clean = range(len(rows), len(rows) + 150)
    rows += [(i, sentence(9 * i + 2, 150)) for i in clean]
    covered: dict = {}
    for r in passages.repeated_passages(docs(spark, rows)).collect():
        covered[r["doc_id"]] = max(covered.get(r["doc_id"], 0), min(r["end_word"], 40 + 100) - max(r["start_word"], 40))
    for kind in ("substituted", "inserted", "removed"):
        hits = [min(covered.get(i, 0), covered.get(i + 1, 0)) >= 45 for k, i in planted if k == kind]  # both show most of a least passage
        assert sum(hits) >= 0.9 * len(hits), (kind, sum(hits))
    assert not set(covered) & set(clean)


def test_passages_empty(spark):
    assert passages.repeated_passages(docs(spark, [])).count() == 0


@pytest.fixture(scope="module")
def small():
    return duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()


def test_op2_against_all_pairs(spark, small):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.queries()["op2_ngram_join"](spark, SMALL).collect()}
    assert got == {doc: v for (doc, _), v in near_classes(small).items()}


def test_op10_finds_all_verbatim_passages(spark, small):
    at: dict = {}
    tokens = {i: words(t) for i, t in small}
    for i, w in tokens.items():
        for j in range(len(w) - 49):
            at.setdefault(tuple(w[j : j + 50]), set()).add(i)
    wanted = {(i, k) for i, w in tokens.items() for j in range(len(w) - 49) if len(at[tuple(w[j : j + 50])]) > 1 for k in range(j, j + 50)}
    rows = queries.queries()["op10_passages"](spark, SMALL).collect()
    assert wanted <= {(r["doc_id"], k) for r in rows for k in range(r["start_word"], r["end_word"])}
    assert all(r["n_words"] == r["end_word"] - r["start_word"] >= 50 for r in rows)
    # every passage is in another document too: one holds three fifths of its five-word runs at least
    held = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in tokens.items()}
    for r in rows:
        w = tokens[r["doc_id"]][r["start_word"] : r["end_word"]]
        own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        others = [i for i in held if i != r["doc_id"] and len(own & held[i]) * 5 >= min(len(own), 46) * 3]
        assert others, (r["doc_id"], r["start_word"])


def test_op3_against_sql(spark):
    df = queries.queries()["op3_exact_dedup"](spark, SMALL)
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    columns = sorted(df.columns)
    wanted = connection.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()['op3_exact_dedup']})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(wanted)


def test_op3_stays_in_the_jvm(spark):
    plan = queries.queries()["op3_exact_dedup"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
