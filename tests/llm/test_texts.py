"""Licence scan, decontamination, SentencePiece, language ID."""

import hashlib
import random
import re
import sys
import unicodedata
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SMALL, docs, sentence, words  # noqa: E402

from veilmark.llm import decontaminate, language_id, license_rules, license_scan, queries, sentence_pieces  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def small():
    return duckdb.sql(f"select doc_id, text, lang from '{SMALL}/documents.parquet'").fetchall()


def base(text):
    w = words(text)
    hits = [(i, label) for phrase, label in license_rules.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in hits}))


LICENSED = [
    None, "", "ALL RIGHTS RESERVED", "cc by cc by-sa 4.0; CC BY 3.0", "Licensed under the GNU General Public License, version 3 or later.", "SPDX-License-Identifier: MIT", "all rights\nreserved all  rights reserved",
    "éall rights reserved", "The MIT license and the Apache License 2.0 (see http://www.apache.org/licenses/LICENSE-2.0)", "x " * 50_000 + "all rights reserved", "Copyright (c) 2020 Nobody",
]


def test_license_base_counts(spark):
    rows = license_scan.scan_licenses(docs(spark, list(enumerate(LICENSED)))).collect()
    for r in rows:
        found = [d for d in r["detections"] if license_scan.is_base(d["rule"])]
        starts = [d["start_word"] for d in found]
        got = r["n_words"], len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({d["label"] for d in found}))
        assert got == base(LICENSED[r["doc_id"]])


def test_license_suppression():
    labels = lambda t: [(d["label"], d["rule"].split(":")[0]) for d in license_scan.detect(t)[1]]
    assert labels(LICENSED[4]) == [("gpl-3", "grant"), ("gpl", "base")]
    assert labels(LICENSED[5]) == [("mit", "tag")]
    assert labels("the Expat license") == [("mit", "named")]
    assert len(license_rules.rules()) > 300 and all(p >= q for (_, _, p, _, _), (_, _, q, _, _) in zip(license_rules.rules(), license_rules.rules()[1:], strict=False))


def test_license_guards_hold():
    """No rule matches a text without one of its keywords: the prefilter loses nothing."""
    import re

    texts = [" ".join(words(t)) for t in LICENSED if t] + [address.replace("(?:", "").replace(")?", "").replace(")", "") for *_, address in license_rules.FAMILIES]
    for rule, _, _, keyword, regex in license_rules.rules():
        for t in texts:
            for m in re.finditer(f"(?<= )(?:{regex})(?= )", f" {t} "):
                assert any(k in m[0] for k in keyword.split("|")), rule


def test_op1_against_brute_force(spark, small):
    texts = {i: t for i, t, _ in small}
    rows = queries.queries()["op1_license_scan"](spark, SMALL).collect()
    assert len(rows) == len(small)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        before, row = row, [i + 1]
        for j, t in enumerate(text):
            row.append(min(before[j] + (p != t), before[j + 1] + 1, row[j] + 1))
    return min(row)


def test_edit_search_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        pattern, text = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 70))) for _ in range(2))
        bits: dict = {}
        for i, c in enumerate(pattern):
            bits[c] = bits.get(c, 0) | 1 << i
        assert decontaminate.edit_search(bits, len(pattern), text)[0] == distance(pattern, text)


def test_edited_items_are_found():
    rng = random.Random(2)
    items = [(" ".join(words(f"ä{sentence(i, 25)}")), 8) for i in range(20)]
    index = decontaminate.PieceIndex(items)
    for n, (item, budget) in enumerate(items):
        w = list(item)
        for _ in range(budget):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["q"], [w[at], "z"]])
        found = {m[0]: m[1] for m in index.matches(f"é before {''.join(w)} after".encode())}
        assert found.get(n, 99) <= budget
    assert index.matches(sentence(99, 400).encode()) == []


def test_matches_equal_the_table():
    """Every item, however edited, against the table of all distances; few letters, so that pieces stand at many wrong places too."""
    rng, held = random.Random(4), 0
    for _ in range(150):
        items = list({" ".join("".join(rng.choices("abé日", k=rng.randint(1, 6))) for _ in range(rng.randint(5, 12))) for _ in range(3)})
        items = [(w, decontaminate.error_budget(w, 0.1, 20)) for w in items if len(w) >= 20]
        parts = []
        for item, budget in items:
            w = list(item)
            for _ in range(rng.randint(0, budget + 2)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["q"], ["日"], [w[at], "z"], [w[at], "日"]])
            parts += ["".join(rng.choices("abé日 ", k=rng.randint(0, 60))), "".join(w)]
        text = " ".join(parts)
        found = {n: d for n, d, _ in decontaminate.PieceIndex(items).matches(text.encode())}
        wanted = {n: distance(item, text) for n, (item, _) in enumerate(items)}
        assert found == {n: d for n, d in wanted.items() if d <= items[n][1]}
        held += len(found)
    assert 100 < held < 400


def test_short_items_are_whole_words(monkeypatch):
    """Items under 8 bytes, across the seams of what is looked at at once; they don't narrow the other pieces' heads."""
    monkeypatch.setattr(decontaminate, "_SCAN_BYTES", 32)
    rng, some = random.Random(3), ["a", "b", "q", "é", "日", "ab", "yes", "quiz", "ü7", "sevenly"]
    for _ in range(300):
        text = " ".join(rng.choices(some, k=rng.randint(0, 50)))
        items = list({" ".join(rng.choices(some, k=rng.randint(1, 4))) for _ in range(5)})
        index = decontaminate.PieceIndex([(w, 0) for w in items])
        places = {n: f" {text} ".find(f" {w} ") for n, w in enumerate(items)}
        assert {n: (d, end) for n, d, end in index.matches(text.encode())} == {n: (0, at + len(items[n])) for n, at in places.items() if at >= 0}
    assert decontaminate.PieceIndex([("q", 0), (sentence(1, 20), 5)]).width == 8


def test_contaminations_awkward(spark):
    item = sentence(1, 12)
    rows = [(1, f"x {item.upper()}! y"), (2, None), (3, ""), (4, sentence(2, 40)), (5, item), (5, item), (None, f"{item}")]
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "too short"), (11, "")], "item_id bigint, text string")
    found = decontaminate.contaminations(docs(spark, rows), bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in found) == sorted((d, i, 0) for d in ("1", "5", "5", "None") for i in (7, 8))
    df = docs(spark, rows)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.contaminations(docs(spark, []), bench).count() == 0 and decontaminate.contaminations(df, bench.limit(0)).count() == 0


def test_benchmark_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_PASS_CHARS", 200)
    bench = spark.createDataFrame([(i, sentence(i, 12)) for i in range(12)], "item_id bigint, text string")
    rows = [(i, f"a {sentence(i, 12)} b") for i in range(12)] + [(99, sentence(77, 30))]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs(spark, rows), bench).collect()) == [(i, i) for i in range(12)]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()] == [99]


def test_op6_finds_every_verbatim_item(spark, small):
    bench = duckdb.sql(f"select item_id, text from '{SMALL}/benchmark.parquet'").fetchall()
    joined = {i: f" {' '.join(words(t))} " for i, t, _ in small}
    wanted = {(d, i) for d, t in joined.items() for i, x in bench if " ".join(words(x)) in t}
    rows = queries.queries()["op6_decontaminate"](spark, SMALL).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["distance"] == 0} == wanted


HARD = ["", " ", "  ", "a ", "  a  b ", "▁", "a▁b", "▁▁x ", "x\n\n y\t z", "\x00a", "日本語 テスト", "😀 a", "</s> <s> [INST]", " a　b", "é é", "a" * 5000, " " * 40, "﻿x", "<0x0A> <unk>", None]


def test_pieces_equal_the_library(spark, small):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = HARD + [t for _, t, _ in small]
    rows = sentence_pieces.encode_and_decode(docs(spark, list(enumerate(texts))), MODEL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == sp.decode(ids) and r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_an_item_may_lose_its_longest_word(spark):
    rng = random.Random(5)
    rows, bench = [], []
    for i in range(40):
        w = [f"{rng.choice('bcdfgh')}{'aeiou'[k % 5]}{rng.choice(['rn', 'lt', 'mp', 'ndow', 'zzle'])}" for k in range(18)]
        bench.append((i, " ".join(w)))
        w[w.index(max(w, key=len))] = "qqxyq"
        rows.append((i, f"some words before {' '.join(w)} and some behind"))
    bench = spark.createDataFrame(bench, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs(spark, [*rows, (99, sentence(3, 50))]), bench).collect()}
    assert {(i, i) for i in range(40)} <= found and not [d for d, _ in found if d == 99]


def test_short_items_match_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "what is two plus 2?"), (2, "水の分子式は"), (3, "?!")], "item_id bigint, text string")
    rows = [(1, "He asked: What is two plus 2? Four."), (2, "what is two plus 22"), (3, "問題 水の分子式は 何"), (4, "awhat is two plus 2"), (5, "what is two plus 2"), (6, "?!")]
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminations(docs(spark, rows), bench).collect()}
    assert found == {(1, 1, 0), (5, 1, 0), (3, 2, 0)}


@pytest.mark.parametrize(
    "line,label",
    [
        ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"), ("// SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"), ("SPDX-License-Identifier: MPL-2.0", "mpl"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"), ("SPDX-License-Identifier: EPL-2.0", "epl"), ("SPDX-License-Identifier: AGPL-3.0-only", "agpl"),
        ("SPDX-License-Identifier: OFL-1.1", "ofl"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "mit"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"), ("Licensed under the GPLv3.", "gpl-3"),
        ("This is licensed under GPL v2", "gpl-2"), ("GNU GPL version 3 or later", "gpl-3"), ("released under the LGPL license", "lgpl"), ("the MPL 2.0 applies", "mpl"),
        ("a BSD-style license", "bsd-like"), ("MIT licensed", "mit"), ("License :: OSI Approved :: MIT License", "mit"), ("CC BY-NC-SA 4.0", "cc-by-nc"), ("two-clause BSD", "bsd-2-clause"),
        ("Creative Commons Attribution-ShareAlike", "cc-by-sa"), ("GNU General Public License v2 (GPLv2)", "gpl-2"), ("Apache-2.0", "apache"),
    ],
)
def test_license_lines(line, label):
    assert label in {d["label"] for d in license_scan.detect(f"some words before {line} and words behind")[1]}


@pytest.mark.parametrize("line", ["a driving licence unicode", "my driving license php", "licence is elastic", "the gpl mountains", "apache helicopters", "he passed with mit", "bsd", "cc by", "a licence to fish", "epl results"])
def test_no_license(line):
    assert [d for d in license_scan.detect(f"some words before {line} and words behind")[1] if not license_scan.is_base(d["rule"])] == []


def test_full_table_changes_nothing():
    with open(MODEL, "rb") as f:
        model = f.read()
    small, large = sentence_pieces.ChunkTable(model, most=3), sentence_pieces.ChunkTable(model)
    assert all(small.encode(t or "") == large.encode(t or "") for t in HARD)


def test_with_pieces_keeps_columns(spark):
    df = docs(spark, [(1, "a b"), (2, None), (3, "▁")])
    rows = {r["doc_id"]: r for r in sentence_pieces.with_pieces(df, MODEL).collect()}
    assert set(rows[1].asDict()) == set(df.columns) | {"ids", "round_trip"} and rows[1]["round_trip"] and not rows[3]["round_trip"] and rows[2]["ids"] == [2]
    assert sentence_pieces.with_pieces(docs(spark, []), MODEL).count() == 0


def test_gram_hashes_slices(monkeypatch):
    text = "Ein Satz, 12 wörter!  und\tmehr ü" * 40
    whole = language_id.gram_hashes(text, 3)
    monkeypatch.setattr(language_id, "_SLICE", 7)
    assert language_id.gram_hashes(text, 3).tolist() == whole.tolist()
    assert len(language_id.gram_hashes("12 !?", 3)) == len(language_id.gram_hashes(None, 3)) == 0 and len(language_id.gram_hashes("a", 3)) > 0


def test_language_awkward(spark):
    train = [("the cat and the dog", "en")] * 5 + [("der hund und die katze", "de")] * 5 + [(None, "en"), ("zzz", None)]
    df = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(train)], "doc_id bigint, text string, lang string, score string")
    filters = language_id.fit(df)
    assert filters.languages == ["de", "en"]
    test = spark.createDataFrame([(1, "the dog", "de"), (2, "die katze", "en"), (3, None, "en"), (4, "123 !", "en"), (5, "", None), (6, "qqqq", "x"), (6, "qqqq", "x")], "doc_id bigint, text string, lang string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language_id.predict(test, filters).collect())
    assert got[:5] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")] and [g[1] in ("de", "en") for g in got[5:]] == [True, True]
    kept = language_id.keep_known_languages(test, filters)
    assert kept.columns == test.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    none = language_id.fit(df.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(test, none).collect()} == {"und"}


def test_over_64_languages(spark):
    rows = [(i, f"{chr(0x4E00 + 7 * i) * 3} {chr(0x4E01 + 7 * i) * 4}", f"l{i:03}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, language_id.fit(df)).collect()}
    assert got == {i: f"l{i:03}" for i in range(70)}


def _exact_counts(text, grams_of):
    """For each language how many of a text's n-grams it holds, by sets; and how many there are."""
    at = []
    for c in (text or "").lower():
        at.append(c if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc", "Me") else " ")
    flat = "  " + re.sub(" +", " ", "".join(at) + " ") if at and at[0] != " " else " " + re.sub(" +", " ", "".join(at) + " ")
    grams = [flat[i : i + 3] for i in range(len(flat) - 2)]
    grams = [g for g in grams if g.strip()]
    return len(grams), {lang: sum(g in held for g in grams) for lang, held in grams_of.items()}, grams


def test_op9_against_exact_sets(spark):
    rng = random.Random(8)
    alphabets = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "mnopqrst", "dd": "कखगघ\u093e\u093f\u094d"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))
    learned = [(i, text(lang, 40), lang) for i, lang in enumerate(sorted(alphabets) * 12)]
    filters = language_id.fit(spark.createDataFrame(learned, "doc_id bigint, text string, lang string"))
    holders: dict = {}
    for _, t, lang in learned:
        for g in set(_exact_counts(t, {})[2]):
            holders[lang, g] = holders.get((lang, g), 0) + 1
    grams_of = {lang: {g for (x, g), n in holders.items() if x == lang and n >= max(0.005 * 12, 1)} for lang in alphabets}
    for k in range(60):
        t = f"{text(rng.choice(sorted(alphabets)), 12)}, {text(rng.choice(sorted(alphabets)), rng.randint(0, 14))}"
        total, counts, _ = _exact_counts(t, grams_of)
        best = max(counts.values())
        lang, score = filters.predict(t)
        assert counts[lang] >= best - 1 and abs(score - counts[lang] / total) < 0.02


def test_combining_marks_belong_to_words():
    assert len(language_id.gram_hashes("क\u093f", 3)) == 3  # one word of two code points, an edge on each side


def test_op9_held_out(spark):
    folder = "/root/testdata/sf0.01"
    langs = dict(duckdb.sql(f"select doc_id, lang from '{folder}/documents.parquet'").fetchall())
    import zlib

    rows = queries.queries()["op9_language_id"](spark, folder).collect()
    assert len(rows) == len(langs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
