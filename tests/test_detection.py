import random

import pytest
from pyspark.sql import functions as F

from veilmark.functions import checks
from veilmark.functions.catalog import RULES
from veilmark.operators import blobs, rewrite, risk, spans

KEY = bytes(range(32))
SK = "sk-" + "ant-" + "a1" * 20


def found(spark, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = spans.detect(df, **options).orderBy("doc_id", "start").collect()
    return [(r["doc_id"], r["entity_type"], r["value"]) for r in rows]


def test_plain_findings(spark):
    assert found(spark, "mail joe@x.org at 10.0.0.1") == [(0, "email", "joe@x.org"), (0, "ipAddress", "10.0.0.1")]
    assert found(spark, "", "nothing") == []


def test_checks_reject(spark):
    assert found(spark, "card 4111 1111 1111 1112", "GB00" + "WEST12345698765432", "cost $5", "api_key = your_" + "a1" * 12) == []
    assert found(spark, "card 4111 1111 1111 1111")[0][1] == "creditCardLike"
    assert found(spark, "GB82" + "WEST12345698765432")[0][1] == "iban"


def test_no_phone(spark):
    texts = ["2024-01-02", "2024.01.02", "12.30.45", "12345-6789", "123-45-6789", "10.20.30.40", "12345678", "40.7128 74.0060"]
    assert not [x for x in found(spark, *(f"call {t} now" for t in texts)) if x[1] == "phone"]


def test_phone(spark):
    texts = ["+1 415 555 2671", "+44 20 7946 0958", "8 (495) 123-45-67", "415-555-2671", "(415) 555-2671"]
    assert [x[0] for x in found(spark, *(f"call {t} now" for t in texts)) if x[1] == "phone"] == list(range(5))


def test_rule_order_breaks_ties(spark):
    assert found(spark, f"key {SK}") == [(0, "openAIAPIKey", SK)]
    pem = "-----BEGIN OPENSSH " + "PRIVATE KEY-----\nx\n-----END OPENSSH " + "PRIVATE KEY-----"
    assert found(spark, pem) == [(0, "privateKey", pem)]


def test_dictionary_forms(spark):
    entries = [spans.DictionaryEntry("client", "Acme Corp"), spans.DictionaryEntry("regex", "proj-[0-9]+"), spans.DictionaryEntry("regex", "[bad"), spans.DictionaryEntry("internalDomain", "in.acme"), spans.DictionaryEntry("client", " ")]
    assert found(spark, "Acme Corp, acme corp, Acme Corps; PROJ-7 in.acme x.in.acme", dictionary=entries) == [(0, "customClient", "Acme Corp"), (0, "customSensitiveTerm", "PROJ-7"), (0, "customInternalDomain", "in.acme")]
    df = spark.createDataFrame([(0, "ACME corp, macme corps")], "doc_id int, text string")
    assert spans.dictionary_substrings(df, "doc_id", "text", entries[:1]).count() == 2


def test_inline_marks(spark):
    key = "token = " + "ab12" * 6
    text = f"{key} # skip-me\n# skip-me-next-line\n{key}\n{key}"
    assert len(found(spark, text, ignore_marker="skip-me", enabled=["apiKeyGeneric"])) == 1
    assert len(found(spark, text, enabled=["apiKeyGeneric"])) == 3


def test_sealed_places_are_left_out(spark):
    sealed = spark.range(1).select(rewrite.seal_value(F.lit("joe@x.org"), F.lit("SECRET"), KEY)).first()[0]
    assert found(spark, f"see {sealed}") == []
    live = "AKIA" + "ABCDEFGHIJ234567"
    assert [x[1] for x in found(spark, "{{EMAIL:v1." + live + "}}")] == ["awsAccessKeyId"]


def test_seal_vector_and_errors(spark):
    token = "{{EMAIL:v1.ay0pF8pgS30I1UA9cZxHpe-EDanFkPg3ybpjGzk-L3jor00}}"
    nonce = bytes.fromhex("6b2d2917ca604b7d08d5403d")
    row = spark.range(1).select(
        rewrite.open_token(F.lit(token), KEY), rewrite.open_token(F.lit(token.replace("EMAIL", "PHONE")), KEY), rewrite.open_token(F.lit(token), bytes(32)),
        rewrite.open_token(F.lit("{{EMAIL:v1.short}}"), KEY), rewrite.seal_value(F.lit("a@b.com"), F.lit("EMAIL"), KEY, F.lit(nonce)), rewrite.seal_value(F.lit("x" * 65_537), F.lit("A"), KEY),
    ).first()
    assert tuple(row) == ("a@b.com", None, None, None, token, None)


def test_mask_numbers_and_restores(spark):
    docs = spark.createDataFrame([(0, "ü joe@x.org 10.0.0.1 joe@x.org ann@x.org"), (1, "plain")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in rewrite.mask(spans.with_findings(docs)).withColumn("back", rewrite.restore(F.col("text"), F.col("mapping"))).collect()}
    assert rows[0]["text"] == "ü {{EMAIL_1}} {{IP_1}} {{EMAIL_1}} {{EMAIL_2}}"
    assert rows[0]["back"] == "ü joe@x.org 10.0.0.1 joe@x.org ann@x.org" and rows[1]["text"] == "plain"


ROWS = [(1, "a long text with mail ann@corp.example"), (1, "zed@corp.example and a later text"), (None, "mail a@b.co"), (None, None), (2, ""), (2, "mail a@b.co"), (2, "mail a@b.co")]


def test_null_and_repeated_ids_are_rewritten(spark):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in ROWS], "doc_id int, text string, mapping string, places array<int>")
    rows = spans.with_findings(df)
    masked = rewrite.mask(rows)
    assert sorted(str(r["text"]) for r in masked.collect()) == sorted(["a long text with mail {{EMAIL_1}}", "{{EMAIL_1}} and a later text", "mail {{EMAIL_1}}", "None", "", "mail {{EMAIL_1}}", "mail {{EMAIL_1}}"])
    assert "Exchange" not in masked._jdf.queryExecution().executedPlan().toString()
    assert sorted(str(r[0]) for r in masked.select(rewrite.restore(F.col("text"), F.col("mapping"))).collect()) == sorted(str(t) for _, t in ROWS)
    assert not [r for r in rewrite.redact(rows).collect() if "@" in (r["text"] or "")]
    sealed = rewrite.seal_findings(rows, KEY)
    assert not [r for r in sealed.collect() if "@" in (r["text"] or "")]
    opened = rewrite.unseal(sealed, KEY)
    assert opened.columns == ["doc_id", "text", "mapping", "places", "findings"]
    assert sorted(str(r["text"]) for r in opened.collect()) == sorted(str(t) for _, t in ROWS)
    found = spans.detect(df).collect()
    assert all(v[r["start"] : r["end"]] == r["value"] for r in found for v in [next(t for i, t in ROWS if i == r["doc_id"] and t and r["value"] in t)]) and len(found) == 5


def test_authenticated_tokens_are_left_out(spark):
    live = "AKIA" + "ABCDEFGHIJ234567"
    token = spark.range(1).select(rewrite.seal_value(F.lit("joe@x.org"), F.lit("EMAIL"), KEY)).first()[0]
    assert found(spark, f"{token} {live}", key=KEY) == [(0, "awsAccessKeyId", live)]
    assert found(spark, f"{token} {live}", key=bytes(32))[-1] == (0, "awsAccessKeyId", live)


def test_many_findings_keep_their_places(spark):
    text = " ".join(f"u{i}@x{i}.org" for i in range(1500))
    df = spark.createDataFrame([(0, text)], "doc_id int, text string")
    rows = spans.detect(df, enabled=["email"]).collect()
    assert len(rows) == 1500 and all(text[r["start"] : r["end"]] == r["value"] for r in rows)
    assert rewrite.mask(spans.with_findings(df, enabled=["email"])).first()["text"].endswith("{{EMAIL_1500}}")


def test_scrub_summary(spark):
    df = spans.with_findings(spark.createDataFrame([("a@b.co c@d.co",), ("none",), (None,), ("x@y.zz " * 20,)], "text string"))
    assert tuple(rewrite.scrub_summary(df, limit=100).first()) == (1, 2, 1)


def test_spans_without_ends_open_nothing(spark):
    rows = [(1, "t", None, None, 0.9), (1, "t", 0, 5, 0.1), (1, "t", 5, None, 0.2), (1, "t", 5, 8, 0.3), (1, "t", 7, 9, 0.4)]
    df = spark.createDataFrame(rows, "doc_id int, entity_type string, start int, end int, confidence double")
    got = spans.merge_same_type(df).select("start", "end", "confidence").collect()
    assert sorted(map(tuple, got)) == [(0, 5, 0.1), (5, 9, 0.9)]
    fits = spans.first_fit(df.withColumns({"rule_ord": F.lit(1), "value": F.lit("v")})).select("start", "end").collect()
    assert sorted(map(tuple, fits)) == [(0, 5), (5, 8)]
    assert [r[0] for r in spans.outermost(df.filter("end is null or end = 8").select("doc_id", "start", "end", "confidence"), "doc_id").select("confidence").orderBy("confidence").collect()] == [0.2, 0.3, 0.9]


def test_quantities_round_as_in_sql(spark, tmp_path):
    import duckdb

    from veilmark.plans import planning

    lineitem = f"{tmp_path}/lineitem.parquet"
    duckdb.sql(f"copy (select * replace (l_quantity + 0.5 as l_quantity, case when l_linenumber = 2 then null else l_partkey end as l_partkey) from '/root/testdata/sf0.001/lineitem.parquet' where l_orderkey < 200) to '{lineitem}' (format parquet)")
    connection = duckdb.connect()
    connection.sql(f"create view lineitem as select * from '{lineitem}'")
    for name in ("same_type_spans", "first_fit_spans", "outermost_regions"):
        df = planning.queries()[name](spark, str(tmp_path))
        wanted = connection.sql(f"select {', '.join(df.columns)} from ({planning.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, wanted)), name


def test_outermost_regions(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), s := rng.randint(0, 30), s + rng.randint(1, 10), i) for i in range(80)]
    got = spans.outermost(spark.createDataFrame(rows, "page int, start int, end int, n int"), "page").collect()
    key = lambda r: (r[1], -r[2], r[3])
    wanted = [r for r in rows if not any(o[0] == r[0] and o[1] <= r[1] and o[2] >= r[2] and o != r and key(o) < key(r) for o in rows)]
    assert sorted(map(tuple, got)) == sorted(wanted)


@pytest.mark.parametrize(
    "total,critical,tier,wanted",
    [
        (19, False, "neutral", (19, "low", "allow")), (20, False, "neutral", (20, "medium", "warn")), (49, False, "neutral", (49, "medium", "warn")), (50, False, "neutral", (50, "high", "mask")),
        (500, False, "neutral", (75, "high", "mask")), (500, False, "secretsConfig", (500, "critical", "block")), (10, False, "secretsConfig", (10, "medium", "warn")),
        (90, False, "docsOrTests", (75, "medium", "warn")), (80, True, "docsOrTests", (100, "critical", "block")), (300, True, "neutral", (300, "critical", "block")),
    ],
)
def test_risk(spark, total, critical, tier, wanted):
    row = spark.range(1).select(risk.assess(F.lit(total), F.lit(critical), F.lit(tier)).alias("r")).select("r.*").first()
    assert (row["score"], row["level"], row["action"]) == wanted


def test_islands_equal_a_sequential_fold(spark):
    rng = random.Random(5)
    kinds = [("email", "regex", 100), ("jwt", "secret", 1000), ("highEntropyString", "secret", 95), ("creditCardLike", "regex", 120)]
    rows = [(d, s, s + rng.randint(1, 12), *rng.choice(kinds), i) for d in range(60) for i, s in enumerate(sorted(rng.sample(range(100), 12)))]
    df = spark.createDataFrame([(d, s, e, t, "v", 1.0, src, i) for d, s, e, t, src, _, i in rows], "doc_id int, start int, end int, entity_type string, value string, confidence double, source string, rule_ord int")
    wanted = []
    for d in range(60):
        kept: list = []
        for _, s, e, t, _, p, _ in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], -r[5], r[6])):
            if kept and s < kept[-1][2]:
                last = kept[-1]
                kept[-1] = (d, last[1], max(last[2], e), t if p > last[4] else last[3], max(p, last[4]))
            else:
                kept.append((d, s, e, t, p))
        wanted += [k[:4] for k in kept]
    got = spans.resolve_overlaps(df).select("doc_id", "start", "end", "entity_type").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_blob_budget(spark):
    import base64

    one = base64.b64encode(b"some readable text, number one").decode()
    df = spark.createDataFrame([(0, f"{one} and {one}"), (1, " ".join([one] * 130)), (2, base64.b64encode(bytes(range(60))).decode())], "doc_id int, text string")
    rows = blobs.decode_blobs(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("accepted").cast("int")).alias("ok"), F.bool_or("exceeded").alias("over")).collect()
    assert {r["doc_id"]: (r["n"], r["ok"], r["over"]) for r in rows} == {0: (2, 2, False), 1: (130, 128, True)}


def test_blobs_of_24_characters_with_padding(spark):
    import base64

    texts = [b"x" * 15, b"y" * 16, b"z" * 17, b"w" * 18]
    df = spark.createDataFrame([(i, f"x {base64.b64encode(t).decode()} y") for i, t in enumerate(texts)], "doc_id int, text string")
    assert sorted((r["doc_id"], r["decoded"]) for r in blobs.decode_blobs(df).collect()) == [(i, t.decode()) for i, t in enumerate(texts) if len(t) >= 16]


def test_quick_guards_lose_no_match(spark):
    phones = ["+12345", "+1 (415) 555", "8 (495) 123-45-67", "12 34 56", "(020)-7946.0958", "12) 34 56"]
    cards = ["4111 1111 1111 1111", "4-1-1-1-1-1-1-1-1-1-1-1-1"]
    others = ["GB82" + "WEST12345698765432", "1.2.3.4", "255.255.255.255", "gho_" + "a1" * 20, "GHP_" + "A1" * 20, "TOKEN\n:\t" + "a1" * 12, "a1" * 20, "\t" + "b2+" * 20 + "\n", "(" + "c3" * 30 + ")"]
    texts = [t for v in (*phones, *cards, *others) for t in (v, f"é\U0001f600 {v} and {v}\uffff {v}", f"x\n{v}")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bare = [type(r)(r.ord, r.type, r.source, r.confidence, r.regex) for r in RULES]
    columns = ["doc_id", "start", "end", "rule_ord", "value"]
    got, wanted = (sorted(map(tuple, spans.extract_spans(df, "doc_id", "text", rules).select(*columns).collect())) for rules in (RULES, bare))
    assert got == wanted and {RULES[r[3]].type for r in got} >= {"phone", "creditCardLike", "iban", "ipAddress", "githubToken", "apiKeyGeneric", "highEntropyString"}
    assert all(texts[d][a:b] == v for d, a, b, _, v in got)
    assert all(r.guard or r.near for r in RULES)


def test_jwt_header(spark):
    import base64

    def jwt(head):
        return base64.urlsafe_b64encode(head).decode().rstrip("=") + ".eyJhIjoxfQ.sig"

    df = spark.createDataFrame([(jwt(b'{"alg":"none"}'),), (jwt(b'{"alg":null}'),), (jwt(b'{"typ":"x"}'),), ("eyJ.x.y",), ("a.b",)], "v string")
    assert [r[0] for r in df.select(checks.jwt_plausible(F.col("v"))).collect()] == [True, True, False, False, False]


def test_catalog():
    assert len(RULES) == 37 and [r.ord for r in RULES] == list(range(37))


def test_a_text_is_searched_in_small_parts(spark):
    """Guards on numbers and long words look at a part of the text; what they hold out of it is no part of any match."""
    df = spark.createDataFrame([(1, "plain words of a text, " * 200 + "call 415-555-2671 or token_abcdefghijklmnopqrst")], "doc_id int, text string")
    parts = df.selectExpr(*[f"array_join(regexp_extract_all(lower(concat(' ', text)), {spans.quoted(regex)}, 0), '') as {name}" for name, regex in spans._PARTS.items()]).first()
    assert parts["numbers"] == "415-555-2671 or token" and parts["long"] == " token_abcdefghijklmnopqrst"
    plan = spans.with_findings(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sk-[A-Za-z0-9_-]{32,}") == 3  # replaced, split and listed in one expression: the scan is planned once
    assert {r.near_in for r in RULES if r.type in ("phone", "ipAddress", "creditCardLike", "iban", "money")} == {"numbers"}
    assert all(len(m) == 1 and m in spans._MARKS for r in RULES for m in r.marks)


def test_parts_lose_no_match(spark):
    """Matches at the seams of parts: behind brackets, signs and other numbers, of the least length, at either end of the text."""
    texts = [
        "5$6 7+1 415 555 2671", "(415)555-2671 x)415 555-2671", "12\f000 USD", "1\x0b000\x0bEUR", "7руб 8 РУБ 9руб.", "€ 5 €5", "x5.10.20.30.40", "١٢٣ 10.0.0.1", "xoxb-" + "a1b2c3d4e5", "xoxb-" + "a1b2c3d4e", " sk-" + "a1" * 16,
        "İgsk_" + "a1" * 10, "AKIA" + "ABCDEFGHIJ234567", "a\tAIza" + "a1B" * 11 + "cd", "token:" + "a1" * 10, "secret=" + "a1" * 10, "token = " + "a1" * 10, "x@y.zz", "A@B.CO", "K@K.KK", "HTTP://x", "hTTps://y", "Redis://a:b@c", "a.LOCAL b.lan.", "CN1234 INV_777 ord-12345 agr\n123",
        "GB82" + "WEST12345698765432", "4111-1111 1111--1111", "+/" * 20 + "1", "é" + "a1" * 20, "re_" + "abcdef_" + "a1" * 8, "sg." + "a" * 22 + "." + "b1" * 21 + "c",
    ]
    for text in (texts, [f"{a} {b}" for a, b in zip(texts, texts[1:])], ["\n".join(texts), "".join(texts)]):
        df = spark.createDataFrame(list(enumerate(text)), "doc_id int, text string")
        bare = [spans.Pattern(r.ord, r.type, r.source, r.confidence, r.pattern) for r in RULES]
        listed = lambda rules: sorted(map(tuple, spans.extract_spans(df, "doc_id", "text", rules).collect()))  # noqa: B023, E731
        assert listed(RULES) == listed(bare) and len(listed(bare)) > 15
