"""The table function gives what the DataFrame scan does."""

import random

from pyspark.sql import functions as F

from veilmark.functions.checks import plausible
from veilmark.operators import rewrite, spans, sql_functions
from veilmark.plans import samples as S


def test_checks_agree(spark):
    rng = random.Random(4)
    kinds = ["money", "phone", "creditCardLike", "iban", "jwt", "highEntropyString", "apiKeyGeneric", "email", "awsAccessKey"]
    values = ["$5", "$55", "+1 415 555 2671", "2024-01-02", "10.20.30.40", "4111 1111 1111 1111", "4111 1111 1111 1112", "GB82" + "WEST12345698765432", "GB00" + "WEST12345698765432", "eyJ" + "hbGciOiJub25lIn0.e.x", "a.b.c", "=.b.c", "abc", "a/b/1", "a/b=1", "a+1", "{{x}}", "your_key", "", "é", None]
    values += ["".join(rng.choice("0123456789 -.") for _ in range(rng.randrange(8, 22))) for _ in range(200)]
    df = spark.createDataFrame([(k, v) for k in kinds for v in values], "k string, v string")
    assert df.filter(~plausible(F.col("k"), F.col("v")).eqNullSafe(F.expr(sql_functions.plausible_sql("k", "v")))).count() == 0


def test_equals_detect(spark):
    key = bytes(range(32))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*S.FINDINGS, None, "", "\n".join(S.FINDINGS), "mail ann@corp.example and " + S.FINDINGS[2]])], "doc_id int, text string")
    sealed = rewrite.seal_findings(spans.with_findings(docs), key).select((F.col("doc_id") + 100).alias("doc_id"), F.concat("text", F.lit(" AKIA" + "ABCDEFGHIJ234567")).alias("text"))
    docs = spark.createDataFrame(docs.unionByName(sealed).collect(), "doc_id int, text string")
    docs.createOrReplaceTempView("some_docs")
    sql_functions.register(spark)
    got = spark.sql("SELECT d.doc_id, s.* FROM some_docs d, LATERAL detect_spans(d.text) s")
    wanted = spans.detect(docs)
    assert sorted(map(tuple, got.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect())) and wanted.count() > 40
    flat = spark.sql("SELECT d.doc_id, s.* FROM (SELECT doc_id, find_spans(text) AS found FROM some_docs) d, LATERAL inline(found) s")
    assert sorted(map(tuple, flat.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (got, flat)]
    assert all("EvalPython" not in p and "InArrow" not in p and "NestedLoop" not in p for p in plans) and "Join" not in plans[1]


def test_left_join_and_choice_of_rules(spark):
    spark.createDataFrame([(1, "ann@corp.example 10.0.0.1"), (2, None)], "doc_id int, text string").createOrReplaceTempView("two_docs")
    sql_functions.register(spark, enabled=["email"], table_name="mails", array_name="mail_array")
    rows = spark.sql("SELECT doc_id, entity_type, value FROM two_docs LEFT JOIN LATERAL (SELECT * FROM mails(text)) ON true ORDER BY doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, "email", "ann@corp.example"), (2, None, None)]
    total = spark.sql("SELECT doc_id, (SELECT count(*) FROM mails(text)) AS n FROM two_docs ORDER BY doc_id").collect()
    assert [tuple(r) for r in total] == [(1, 1), (2, 0)]


def test_listed_scan_is_computed_once(spark):
    from veilmark.plans import extended

    plan = extended.sql_findings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and "Filter (size(" not in plan
