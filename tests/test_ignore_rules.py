"""Ignore rules as rows, against the predicates that are compiled for one set of files."""

import random

from pyspark.sql import functions as F

from veilmark.functions import paths as P
from veilmark.operators import ignore_rules

LINES = [
    "*.pem", "/docs/", "logs/", "!keep.pem", ".env", "secret-*", "a/b/c", "**/x.txt", "a/**", "a/*/c.txt", "src/**/gen?.py", "?", "*", "!*", "/*.md", "!a/b", "#comment", "", "  ", "/", "!", "  spaced ",
    "b+c(1)", "[x].txt", "é*", "*.tar.gz", "*.p?m", "a.b*", "x/", "!docs/readme.md", "/a", "*/c", "c.*", "**", ".*", "$a^",
]
NAMES = ["a", "b", "c", "x", "docs", "logs", "src", "readme.md", "keep.pem", "k.pem", ".env", "secret-1", "x.txt", "gen1.py", "c.txt", "b+c(1)", "[x].txt", "été", "spaced", "z.tar.gz", "$a^", "#comment"]


def test_equals_compiled_predicates(spark):
    rng = random.Random(7)
    paths = sorted({"/".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 5))) for _ in range(250)})
    rules = {f"r{i}": {f"f{j}": rng.sample(LINES, rng.randrange(1, 6)) for j in range(rng.randrange(1, 4))} for i in range(12)}
    df = spark.createDataFrame([(r, p) for r in rules for p in paths], "repo string, path string")
    lines = spark.createDataFrame([(r, f, x) for r, files in rules.items() for f, ls in files.items() for x in ls + ls[:1]], "repo string, file string, line string")
    got = {tuple(r) for r in ignore_rules.covered_by(df.union(df.limit(50)).repartition(3), lines).collect()}
    wanted = set()
    one = spark.createDataFrame([(p,) for p in paths], "path string")
    for r, files in rules.items():
        for f, ls in files.items():
            plain = [x for x in ls if not x.strip().startswith("#")]
            wanted |= {(r, row["path"], f) for row in one.filter(P.is_ignored(F.col("path"), plain)).collect()}
    assert got == wanted and len(got) > 500


def test_awkward_rows(spark):
    df = spark.createDataFrame([(None, "a", 1), ("r", None, 2), ("r", "", 3), ("r", "a//b", 4), ("r", "a", 5), ("r", "a", 5), ("q", "a", 6)], "repo string, path string, n_files int")
    lines = spark.createDataFrame([("r", "f", "a"), ("r", "g", "*"), ("r", "g", None), (None, "f", "a"), ("q", "f", "b")], "repo string, file string, line string")
    got = sorted(tuple(r) for r in ignore_rules.with_ignored(df, lines).select("repo", "path", "ignored", "n_files").na.fill("-").collect())
    assert got == [("-", "a", False, 0), ("q", "a", False, 0), ("r", "", True, 1), ("r", "-", False, 0), ("r", "a", True, 2), ("r", "a", True, 2), ("r", "a//b", True, 2)]
    assert ignore_rules.with_ignored(df, lines.filter("false")).filter("ignored").count() == 0 and ignore_rules.covered_by(df.filter("false"), lines).count() == 0


def test_joins_are_by_key(spark, monkeypatch):
    monkeypatch.setattr(ignore_rules, "BROADCAST_RULES", 0)
    df = spark.createDataFrame([("r", f"d{i}/x.txt") for i in range(100)], "repo string, path string")
    lines = spark.createDataFrame([("r", "f", "d7/"), ("r", "f", "*.txt"), ("r", "f", "!d8")], "repo string, file string, line string")
    found = ignore_rules.covered_by(df, lines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 99
