"""Gates that read files, the server lists in all combinations, and rules kept in the row."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veilmark.functions import paths
from veilmark.operators import file_gates, gates, rewrite

KEY = bytes(range(32))
LIVE = "AKIA" + "ABCDEFGHIJ234567"
MAIL = "ann@corp.example"
FILES = [
    ("/w/a.txt", f"key {LIVE} of {MAIL}"), ("/w/b/c.md", "nothing"), ("notes.md", MAIL), ("/w/big.txt", f"{LIVE} " + "x" * 70_000), ("/w/x/.env", "A=1"), ("/w/null.txt", None),
    ("/w/dup.txt", "b"), ("/w/dup.txt", f"a {MAIL}"), ("/tmp/veilmark-seal/sealed-1.txt", LIVE), ("/w/never.txt", LIVE),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def events(spark, payloads):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "event_id bigint, payload string").repartition(3)


def test_mentions(spark):
    texts = ["see @a/b.txt, and (@.env) [@_x/y] @@z.md mail me@corp.example @plain @-x.y @é.t @a.b;c", "@", None, "@a.@b.c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(file_gates.mentioned(F.col("t"))).collect()]
    assert got == [["a/b.txt", ".env", "_x/y", "z.md", "corp.example", "a.b"], [], None, ["a.@b.c"]]


def test_prompt_gate(spark, files):
    payloads = [
        {"prompt": "hello"}, {"prompt": f"mail {MAIL}"}, {"prompt": "read @a.txt please", "cwd": "/w"}, {"prompt": "@a.txt and @./b/../a.txt", "cwd": "/w"},
        {"prompt": "x", "attachments": [{"file_path": "/w/a.txt"}, {"filePath": "notes.md"}, {"file_path": ""}, {}]}, {"prompt": "@big.txt", "cwd": "/w"},
        {"prompt": "@gone.txt @null.txt @b/c.md", "cwd": "/w"}, "{broken", None, {"other": 1}, {"tool_info": {"user_prompt": f"{MAIL} @notes.md"}}, {"prompt": "@dup.txt", "cwd": "/w"}, {"prompt": "z" * (2 << 20)}, "[1]",
    ]
    df = events(spark, payloads)
    got = {r["event_id"]: tuple(r)[1:5] for r in file_gates.prompt_gate(df, files, "soft").collect()}
    assert got == {
        0: ("allow", "", 0, 0), 1: ("deny", "", 1, 0), 2: ("deny", "", 2, 1), 3: ("deny", "", 4, 2), 4: ("deny", "", 3, 2), 5: ("allow", "", 0, 0), 6: ("allow", "", 0, 2),
        7: ("allow", "invalid_json", 0, 0), 8: ("allow", "invalid_json", 0, 0), 9: ("allow", "missing_prompt", 0, 0), 10: ("deny", "", 2, 1), 11: ("deny", "", 1, 1), 12: ("allow", "stdin_too_large", 0, 0), 13: ("allow", "invalid_json", 0, 0),
    } | {6: ("allow", "", 0, 2)}
    only = {r["event_id"]: (r["decision"], r["n_findings"]) for r in file_gates.prompt_gate(df, files, "advise", secrets_only=True, excluded=("notes.md", "b/")).collect()}
    assert only[1] == ("allow", 0) and only[2] == ("advise", 1) and only[4] == ("advise", 1)


def test_prompt_gate_seals(spark, files):
    df = events(spark, [{"prompt": f"{MAIL} @a.txt @b/c.md @a.txt", "cwd": "/w"}, {"prompt": "fine @b/c.md", "cwd": "/w"}])
    rows = file_gates.prompt_gate(df.union(df), files, "block", key=KEY)
    assert rows.count() == 4
    opened = rewrite.unseal(rows.select("event_id", "sealed", F.col("sealed").alias("text")), KEY)
    for r in opened.collect():
        if r["event_id"] == 1:
            assert r["sealed"] is None
        else:
            assert LIVE not in r["sealed"] and MAIL not in r["sealed"]
            assert r["text"] == "\n".join([f"{MAIL} @a.txt @b/c.md @a.txt", FILES[0][1], "nothing", FILES[0][1]])


def test_read_gate(spark, files):
    payloads = [
        {"file_path": "/w/a.txt"}, {"path": "b/c.md", "cwd": "/w"}, {"file_path": "notes.md"}, {"file_path": "/w/x/.env"}, {"file_path": "/w/x/.env", "content": LIVE}, {"tool_input": {"file_path": "/w/b/../a.txt"}},
        {"file_path": "/tmp/veilmark-seal/sealed-1.txt"}, {"nothing": 1}, "{", None, {"file_path": "/gone.txt"}, {"file_path": "plain.txt", "content": f"k {LIVE}"}, {"file_path": "a.txt", "content": "fine", "cwd": "/w"}, {"file_path": "docs/a.txt", "content": LIVE}, {"file_path": "/w/null.txt"},
    ]
    df = events(spark, payloads)
    got = {r["event_id"]: tuple(r)[1:4] for r in file_gates.read_gate(df, files, excluded=("docs/**",)).collect()}
    assert got == {
        0: ("deny", "findings", 1), 1: ("allow", "", 0), 2: ("allow", "", 0), 3: ("deny", "path", 0), 4: ("deny", "path", 1), 5: ("deny", "findings", 1), 6: ("allow", "sealed-copy", None), 7: ("deny", "unreadable", None),
        8: ("deny", "unreadable", None), 9: ("deny", "unreadable", None), 10: ("allow", "", 0), 11: ("deny", "findings", 1), 12: ("allow", "", 0), 13: ("allow", "excluded", None), 14: ("allow", "", 0),
    }
    large = {r["event_id"]: tuple(r)[1:4] for r in file_gates.read_gate(df, files, limit=10).collect()}
    assert large[0] == ("deny", "too-large", None) and large[11] == ("deny", "too-large", None) and large[12] == ("allow", "", 0)
    rows = file_gates.read_gate(df, files, key=KEY)
    opened = {r["event_id"]: r for r in rewrite.unseal(rows.select("event_id", "decision", "sealed", F.col("sealed").alias("text")), KEY).collect()}
    assert opened[2]["decision"] == "deny" and opened[2]["text"] == MAIL and opened[0]["text"] == FILES[0][1] and LIVE not in opened[0]["sealed"]
    assert opened[4]["text"] == LIVE and opened[3]["sealed"] is None


def test_only_named_files_are_scanned(spark, files):
    plan = file_gates.read_gate(events(spark, [{"file_path": "/w/b/c.md"}]), files)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def refused(server, allow, deny):
    """The lists as decided by hand, case by case."""
    hit = lambda names: any(n == "*" or n.lower() == server.lower() for n in names)
    if not server:
        return False
    if hit(deny):
        return not hit(allow) if "*" in deny and allow else True
    return bool(allow) and not hit(allow)


def test_server_lists(spark):
    names = ["good", "evil", "GOOD", "", None]
    df = spark.createDataFrame([(n,) for n in names], "server string")
    lists = [(), ("good",), ("*",), ("*", "good"), ("Good", "evil")]
    columns, wanted = [], []
    for allow, deny in itertools.product(lists, lists):
        columns.append(F.coalesce(gates.server_refused(F.col("server"), allow, deny), F.lit(None)))
        wanted.append([refused(n or "", allow, deny) for n in names])
    got = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    assert [[r[i] for r in got] for i in range(len(columns))] == wanted
    assert refused("evil", ("good",), ()) and not refused("good", ("good",), ("*", "good"))  # what a single configuration hid


def test_rules_in_the_row(spark):
    rng = random.Random(1)
    parts = ["*", "post*", "postgres", "files", "f*s", "Files", "", None, "a.b", "*.b"]
    rules = [(i, rng.choice(parts), rng.choice(parts), {rng.choice("xyz"): rng.choice(["mask", "remove", "keep"])}) for i in range(40)]
    calls = [(i, rng.choice(["postgres", "FILES", "a.b", "acb", "q"]), rng.choice(["postgres", "files", "a.b", "other"])) for i in range(60)] + [(99, None, "files")]

    def fits(p, name):
        p = (p or "").strip() or "*"
        return name is not None and re.fullmatch(".*".join(map(re.escape, p.lower().split("*"))), name.lower()) is not None

    def score(p):
        p = (p or "").strip() or "*"
        return 0 if p == "*" else 1 if "*" in p else 2

    wanted, fields = {}, {}
    for c, s, t in calls:
        order = sorted((r for r in rules if fits(r[1], s) and fits(r[2], t)), key=lambda r: (-(4 * score(r[1]) + score(r[2])), r[0]))
        wanted[c] = order[0][0] if order else None
        for r in reversed(order):
            fields.setdefault(c, {}).update(r[3])
    df, table = spark.createDataFrame(calls, "call_id int, server string, tool string"), spark.createDataFrame(rules, "idx int, server string, tool string, fields map<string,string>")
    chosen = gates.choose_rule(df, table)
    assert "Join" not in chosen._jdf.queryExecution().optimizedPlan().toString()
    assert {r["call_id"]: r["idx"] for r in chosen.collect()} == wanted
    got = {}
    for r in gates.field_actions(df, table).collect():
        got.setdefault(r["call_id"], {})[r["field"]] = r["action"]
    assert got == fields


def test_fields_applied(spark):
    payload = '{"a":1,"b":{"c":[1,"x"]},"d":"t","e":null}'
    df = spark.createDataFrame([(payload,), ("[1]",), (None,), ("{oops",)], "p string")
    actions = F.create_map(F.lit("a"), F.lit("mask"), F.lit("d"), F.lit("remove"), F.lit("zz"), F.lit("mask"))
    got = [r[0] for r in df.select(gates.apply_fields(F.col("p"), actions)).collect()]
    assert json.loads(got[0]) == {"a": "***", "b": {"c": [1, "x"]}, "e": None} and got[1:] == ["[1]", None, "{oops"]


def test_search_says_what_was_not_read(spark, files):
    df = events(spark, [{"path": "/w/big.txt"}, {"path": "/w/a.txt"}, {"path": "/gone"}, None])
    got = {r["event_id"]: tuple(r)[1:] for r in gates.search_gate(df, files, limit=1000).collect()}
    assert got == {0: ("allow", None), 1: ("deny", 2), 2: ("allow", 0), 3: ("allow", 0)}
    assert {r["event_id"]: r["decision"] for r in gates.search_gate(df, files, limit=None).collect()}[0] == "deny"


def test_places_shuffle_without_payloads(spark, files):
    """What prompts name is dealt out as keys and places; equal rows and repeated places count as before."""
    df = events(spark, [{"prompt": "@a.txt @./a.txt @b//c.md", "cwd": "/w"}, {"prompt": "none"}])
    got = file_gates.prompt_gate(df.union(df), files, "soft")
    assert sorted((r["event_id"], r["n_findings"], r["n_files"]) for r in got.collect()) == [(0, 4, 3)] * 2 + [(1, 0, 0)] * 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[event_key#\d+, paths#\d+\]", plan) and not re.search(r"Aggregate \[event_key#\d+\], \[.*payload", plan)


def test_resolved_paths_are_left_alone(spark):
    names = ["/a/b", "a/b.c", "", "/", "a/", "//a", "./a", "a/./b", "a/../b", "..", "...", "a/...", ".a/b.", "a\\b", "/..", ".", None]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(paths.resolve_path(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["/a/b", "a/b.c", "", "/", "a", "/a", "a", "a/b", "b", "", "...", "a/...", ".a/b.", "a/b", "/", "", None]
    plan = spark.range(1).select(paths.resolve_path(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("aggregate(")  # the walk over segments comes behind a test
