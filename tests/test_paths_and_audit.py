import pytest
from pyspark.sql import functions as F

from veilmark.functions import path_tables, paths
from veilmark.operators import audit, blocks, policy


def check(spark, values, column):
    df = spark.createDataFrame([(v,) for v in values], "path string")
    return [r[0] for r in df.select(column(F.col("path"))).collect()]


@pytest.mark.parametrize(
    "glob,path,hit",
    [
        ("*.pem", "a.pem", True), ("*.pem", "x/a.pem", False), ("**/*.pem", "x/y/a.pem", True), ("**/*.pem", "a.pem", True), (".ssh/**", ".ssh/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False),
        ("logs/", "logs/", True), ("x.y+(z)", "x.y+(z)", True), ("x.y", "xzy", False), ("**", "any/thing", True), ("ü*", "über", True), ("", "a", False),
    ],
)
def test_globs(spark, glob, path, hit):
    assert check(spark, [path], lambda p: paths.matches_glob(p, glob)) == [hit]


@pytest.mark.parametrize(
    "lines,path,hit",
    [
        (["*.pem"], "a/b.pem", True), (["/docs"], "docs/x/y", True), (["/docs"], "a/docs/x", False), (["logs/"], "a/logs/x", True), (["a/b"], "a/b/c", True), (["a/*"], "a/b", True), (["a/*"], "a/b/c", False),
        (["*.pem", "!keep.pem"], "keep.pem", False), (["!keep.pem", "*.pem"], "keep.pem", False), (["/", "", "!"], "x", False), ([], "x", False),
    ],
)
def test_ignore_lines(spark, lines, path, hit):
    assert check(spark, [path], lambda p: paths.is_ignored(p, lines)) == [hit]


@pytest.mark.parametrize(
    "pattern,path,hit",
    [
        ("docs/**", "docs", True), ("docs/**", "docs/a/b", True), ("docs/**", "x/docs/a", False), ("**/vendor/**", "a/vendor/b", True), ("**/gen.py", "a/b/gen.py", True), ("**/a/b", "x/a/b", True),
        ("*.lock", "x/yarn.lock", True), ("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/b/a.ts", False), ("*.lock", "./yarn.lock", True), ("x", "", False), ("te*t/**", "a/test/b", True), ("a", "\\a", True),
    ],
)
def test_excludes(spark, pattern, path, hit):
    assert check(spark, [path], lambda p: paths.is_excluded(p, [pattern])) == [hit]


def test_table_sizes():
    assert len(path_tables.SENSITIVE_PATTERNS) == 49 and len(path_tables.privacy_rules()) == 18


def test_resolve_and_safety(spark):
    assert check(spark, ["a/./b/../c", "/x//y", "..", "a\\b"], paths.resolve_path) == ["a/c", "/x/y", "", "a/b"]
    assert check(spark, ["a/b", "/a", "~/a", "a/../b", "C:\\x", ""], paths.is_safe_relative) == [True, False, False, False, False, False]


def test_edit_owner(spark):
    df = spark.createDataFrame([('{"pythonPath": "a", "x": 1}', '"a"'), ('{"tabSize": 2}', "2"), ("abc", "zz")], "c string, o string")
    assert [r[0] for r in df.select(paths.edit_touches_executable(F.col("c"), F.col("o"))).collect()] == [True, False, False]


def listing(spark, *names):
    return spark.createDataFrame([(n, False) for n in names], "path string, is_dir boolean")


def test_walk_is_cut_by_path(spark):
    rows = audit.walk(listing(spark, "b", "a", "node_modules/x", "c", "a"), 2).orderBy("path").collect()
    assert [tuple(r) for r in rows] == [("a", False), ("b", False)]
    assert {r["complete"] for r in audit.walk(listing(spark, "b", "a"), 2).collect()} == {True}


def test_status_and_score(spark):
    def status(names, lines, complete=True):
        rows = listing(spark, *names)
        exposed = audit.exposures(rows, lines)
        return audit.audit_status(audit.pattern_findings(exposed), audit.rule_findings(rows), audit.tool_exposures(rows, lines), complete).first()[0]

    every = [g[0] for _, _, s, g, _ in path_tables.privacy_rules() if s != "informational"]
    assert status([".env"], {}) == "fail"
    assert status(["a.txt"], {}) == "warning"
    assert status(every, {}) == "pass" and status(every, {}, complete=False) == "warning"
    assert status([*every, ".npmrc"], {}) == "fail"  # a required rule's own ignore file leaves it open
    rows = listing(spark, *every, ".npmrc")
    assert audit.audit_status(audit.pattern_findings(audit.exposures(rows, {})), audit.rule_findings(rows)).first()[0] == "warning"
    found = audit.pattern_findings(audit.exposures(listing(spark, ".env", ".npmrc", "x.log"), {}))
    assert audit.privacy_score(found, audit.rule_findings(listing(spark, *every))).first()[0] == 100 - 25 - 10 - 4


def test_deltas_and_drift(spark):
    before = spark.createDataFrame([("x", True), ("y", False)], "id string, satisfied boolean")
    after = spark.createDataFrame([("x", False), ("z", True)], "id string, satisfied boolean")
    old, new = (spark.createDataFrame([("x", p) for p in names] + [("y", None)], "id string, path string") for names in ("pq", "qrr"))
    rows = {r["id"]: (r["change"], r["added"], r["removed"]) for r in audit.delta_counts(before, after, old, new).collect()}
    assert rows == {"x": ("lost", 1, 1), "y": ("same", 0, 0), "z": ("gained", 0, 0)}
    files = spark.createDataFrame([(".a", " *.pem\n# no\n\n.env\r\n"), (".b", "")], "file string, contents string")
    present = audit.parse_ignore_files(files)
    assert sorted((r["file"], r["line"]) for r in present.collect()) == [(".a", "*.pem"), (".a", ".env")]
    wanted = spark.createDataFrame([(".a", "*.pem"), (".a", "*.key"), (".b", "x"), (".c", "x")], "file string, line string")
    assert sorted(map(tuple, audit.drift(wanted, present).collect())) == [(".a", "*.key"), (".b", "x"), (".c", "x")]
    assert sorted((r["file"], r["plan"]) for r in audit.sync_plan(wanted, present, files).collect()) == [(".a", "update"), (".b", "update"), (".c", "create")]


def test_delta_of_snapshots_as_rows(spark):
    from veilmark.plans import registry

    states = [spark.createDataFrame(r, "id string, satisfied boolean") for r in ([("x", True), ("y", False)], [("x", False), ("z", True)])]
    paths = [spark.createDataFrame(r, "id string, path string") for r in ([("x", "p"), ("x", "q"), ("x", "q"), ("y", None)], [("x", "q"), ("x", "r"), ("x", "s"), ("z", "p")])]
    rows = {r["id"]: (r["was"], r["now"], r["change"], r["added"], r["removed"]) for r in audit.delta_counts(*states, *paths).collect()}
    assert rows == {"x": (True, False, "lost", 2, 1), "y": (False, False, "same", 0, 0), "z": (False, True, "gained", 1, 0)}
    plan = registry.audit_delta(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array" not in plan  # no row holds all of an id's paths


def test_index_takes_the_last_change(spark):
    index = spark.createDataFrame([(".env",), ("a.pem",)], "path string")
    changes = spark.createDataFrame([(".env", 1, True), ("b.pem", 1, False), ("b.pem", 2, True), ("c.pem", 1, True), ("c.pem", 3, False), ("d.txt", 1, False)], "path string, ts int, removed boolean")
    assert sorted(r["path"] for r in audit.update_index(index, changes, {}).collect()) == ["a.pem", "c.pem"]


def test_blocks():
    text, result = blocks.upsert(None, [" a ", "a", "#x", "b"])
    assert result == "created" and text.splitlines()[1:-1] == ["a", "b"]
    assert blocks.upsert(text, ["a", "b"]) == (text, "unchanged")
    longer, result = blocks.upsert("mine\n" + text + "\nend\n", ["c"])
    assert result == "updated" and longer.startswith("mine\n") and longer.endswith("\nend\n") and "\nc\n" in longer
    start, end = blocks.markers()
    assert blocks.upsert(f"{start}\nx\n", ["c"])[1] == "malformed" and blocks.upsert(f"{end}\n", ["c"])[1] == "malformed"
    assert blocks.remove("mine\n" + text) == "mine\n" and blocks.remove("mine\n") is None and blocks.remove(text) == ""


def test_block_columns(spark):
    text, _ = blocks.upsert("mine\n", ["a", "b"])
    df = spark.createDataFrame([(text, ["a", "b"]), (None, ["z"]), ("x\n", None)], "contents string, wanted array<string>")
    rows = df.select(blocks.upsert_column(F.col("contents"), F.col("wanted"))["result"].alias("r"), blocks.block_patterns(F.col("contents")).alias("p")).collect()
    assert [r["r"] for r in rows] == ["unchanged", "created", "updated"] and rows[0]["p"] == ["a", "b"] and rows[2]["p"] is None


def test_ignore_settings(spark):
    files = [
        ("ignore:\n  commit: true\n  tools:\n    - Cursor\n    - 'claude' # note\nother:\n  commit: false\n", (True, ["cursor", "claude"])),
        ("ignore: # all\n  tools: [a, \"b\", ]\n", (False, ["a", "b"])),
        ("# ignore:\nother:\n  tools: [a]\n", (False, None)),
        ("ignore:\n  tools:\n  commit: TRUE\n    - x\n", (True, None)),
        ("", (False, None)),
    ]
    rows = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(files)], "i int, f string").select("i", policy.ignore_settings(F.col("f")).alias("s")).orderBy("i").collect()
    assert [(r["s"]["commit"], r["s"]["tools"]) for r in rows] == [w for _, w in files]


def test_selection(spark):
    picks = spark.createDataFrame([(1, 0, "a.TXT", False), (1, 1, "b.exe", False), (1, 2, "a.TXT", False), (2, 0, "a.txt", False), (2, 1, "d", True), (3, 0, "x.bin", False)], "pick int, n int, path string, is_dir boolean")
    assert sorted(map(tuple, policy.selection(picks, ["txt"]).collect())) == [(1, "documents", ["a.TXT"]), (2, "directory", ["d"])]


def test_resolve_configuration():
    rules, skipped = policy.resolve_configuration(path_tables.privacy_rules(), ["cursor-ignore", "llm-ignore"], [" build ", "", "build"])
    assert skipped == ["build"] and len(rules) == 17 and "cursor-ignore" in [r[0] for r in rules]
    assert policy.missing_lines({"a": ["x"], "b": []}, ["x", "y", "x"]) == {"a": ["y"], "b": ["x", "y"]}


def test_config_lookup(spark):
    tree = '{"a": {"s": "x", "n": 1, "l": ["p", 2, "q"], "b": true}}'
    df = spark.createDataFrame([(tree,), (None,)], "t string")
    got = [df.select(*[c.alias(f"c{i}") for i, c in enumerate(policy.config_lookup(F.col("t"), "a", k))]).collect() for k in ("s", "n", "l", "b", "none")]
    assert [tuple(g[0]) for g in got] == [("x", [], None), (None, [], None), (None, ["p", "q"], None), (None, [], True), (None, [], None)]
    assert all(tuple(g[1]) == (None, [], None) for g in got)


def test_skipped_directories(spark):
    assert check(spark, [".git", "a/.git", "docs/x", "src", ""], lambda p: paths.skips_directory(p, ["docs/**"])) == [True, True, True, False, False]


def test_roots_agree_with_single_listings(spark):
    every = [r[3][0] for r in path_tables.privacy_rules()]
    lists = {"a": [*every, ".env"], "b": every, "c": ["x.rs", "x.rs", "k/id.pem", "log/a.log"], "d": [None], None: [".env"]}
    df = spark.createDataFrame([(r, p) for r, ps in lists.items() for p in ps], "root string, path string")
    got = {r["root"]: (r["score"], r["status"]) for r in audit.audit_roots(df, {"f": ["*.pem"]}).collect()}
    assert set(got) == set(lists)
    for root, ps in lists.items():
        one = spark.createDataFrame([(p,) for p in ps], "path string")
        found, rules = audit.pattern_findings(audit.exposures(one, {"f": ["*.pem"]})), audit.rule_findings(one)
        assert got[root] == (audit.privacy_score(found, rules).first()[0], audit.audit_status(found, rules).first()[0])


def test_roots_are_summed_without_their_harmless_paths(spark):
    rules = [(f"r{i}", None, "required" if i % 2 else "recommended", [f"f{i}", f"g{i}"], True) for i in range(130)]
    rows = [(1, f"f{i}") for i in range(130)] + [(1, f"f{i}") for i in range(130)] + [(2, "g129"), (2, "f129"), (2, "a/.env"), (2, "a/.env"), (2, "b/.env"), (None, None), (None, "f0")]
    df = spark.createDataFrame(rows, "root int, path string")
    audited = audit.audit_roots(df, {}, rules)
    got = {r["root"]: (r["n_exposed"], r["n_rules"], r["score"], r["status"]) for r in audited.collect()}
    assert got == {1: (0, 130, 100, "pass"), 2: (2, 1, 0, "fail"), None: (0, 1, 0, "warning")}
    plan = audited._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 2
