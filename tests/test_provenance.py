"""Provenance records and their ledgers."""

import hashlib
import json

from pyspark.sql import functions as F

from veilmark.sources import logs
from veilmark.streaming import events, provenance

SCHEMA = "ledger string, event_id bigint, ts timestamp, payload string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def changes(spark, payloads, files=None):
    rows = [("u", i, p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "ledger string, event_id bigint, payload string").withColumn("ts", F.timestamp_seconds(F.lit(100) + F.col("event_id")))
    return provenance.artifact_changes(df, files)


def test_paths_are_taken_from_the_folder_and_classed(spark):
    payloads = [
        {"cwd": "/w/a", "tool_input": {"file_path": ".git/hooks/pre-commit"}, "path": "/home/.zshrc"},
        {"cwd": "/w/a/", "toolInput": {"target_file": "x/../.vscode/./tasks.json"}},
        {"cwd": "/", "path": "etc/.ssh/config"},
        {"path": "b/.zshrc"},
        {"path": "/b/.zshrc"},
        {"cwd": "/w/a", "path": "../ab/.envrc"},
        {"cwd": "/w/a", "path": "src/main.rs"},
        {"cwd": "/w/a"},
    ]
    found = changes(spark, [*map(json.dumps, payloads), None, "", "[1]", "{broken"]).orderBy("event_id", "n").collect()
    got = [(r["event_id"], r["record"]["artifactKind"], r["record"]["relativePath"], r["record"]["pathHash"], r["record"]["repositoryID"], r["record"]["timestamp"]) for r in found]
    assert got == [
        (0, "gitHook", ".git/hooks/pre-commit", sha("/w/a/.git/hooks/pre-commit"), sha("/w/a"), "100"),
        (0, "shellStartupConfig", "<external>/shellStartupConfig/.zshrc", sha("/home/.zshrc"), sha("/w/a"), "100"),
        (1, "editorTaskConfig", ".vscode/tasks.json", sha("/w/a/.vscode/tasks.json"), sha("/w/a"), "101"),
        (2, "sshConfig", "etc/.ssh/config", sha("/etc/.ssh/config"), sha("/"), "102"),
        (3, "shellStartupConfig", "b/.zshrc", sha("b/.zshrc"), sha(""), "103"),
        (4, "shellStartupConfig", "<external>/shellStartupConfig/.zshrc", sha("/b/.zshrc"), sha(""), "104"),
        (5, "shellStartupConfig", "<external>/shellStartupConfig/.envrc", sha("/w/ab/.envrc"), sha("/w/a"), "105"),
    ]


def test_contents_are_hashed_up_to_a_size(spark):
    files = [("/a/.zshrc", "é"), ("/b/.zshrc", None), ("/c/.zshrc", "x" * (provenance.CONTENT_BYTES + 1)), ("/d/.zshrc", "1"), ("/d/.zshrc", "1"), ("/e/.zshrc", "")]
    payloads = [json.dumps({"path": f"/{c}/.zshrc"}) for c in "abcdez"] * 2
    rows = changes(spark, payloads, spark.createDataFrame(files, "path string, text string")).orderBy("event_id").collect()
    assert [r["record"]["contentHash"] for r in rows] == [sha("é"), None, None, sha("1"), sha(""), None] * 2


def test_ledger_is_chained_and_rotated(spark):
    payloads = [json.dumps({"cwd": "/w", "path": ".zshrc", "tool_input": {"path": f"é{i}/.envrc"}}) for i in range(5)]
    rows = changes(spark, payloads).unionByName(changes(spark, payloads[:2]).withColumn("ledger", F.lit(None).cast("string")))
    lines = provenance.artifact_ledger(rows)
    for ledger, n in (("u", 10), (None, 4)):
        own = lines.filter(F.col("ledger").eqNullSafe(F.lit(ledger))).orderBy("seq").collect()
        assert [r["seq"] for r in own] == list(range(n))
        previous = None
        for r in own:
            entry = json.loads(r["line"])
            assert entry["previousHash"] == previous and list(entry) == sorted(entry) and set(entry) == {*r["record"].asDict(), "previousHash"}
            previous = sha(r["line"])
    assert events.broken_links(lines, order="seq").count() == 0
    cut = lines.filter("ledger = 'u' and seq != 4")
    assert [r["seq"] for r in events.broken_links(cut, order="seq").collect()] == [5]
    sizes = {r["seq"]: len(r["line"].encode()) + 1 for r in lines.filter("ledger = 'u'").collect()}
    files = {r["seq"]: r["file_no"] for r in logs.rotated(lines.filter("ledger = 'u'"), "ledger", "seq", "line", most=max(sizes.values())).collect()}
    assert files == {i: i // 2 for i in range(10)}


def test_nothing_gives_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert provenance.artifact_ledger(provenance.artifact_changes(empty, spark.createDataFrame([], "path string, text string"))).count() == 0
