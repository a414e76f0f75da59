import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veilmark.functions import text
from veilmark.operators import entities, gates
from veilmark.sources import files
from veilmark.streaming import events, ordered

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_debounce_and_boundary(spark):
    df = spark.createDataFrame([("r", at(s), f"p{s}") for s in (0, 1, 2.5, 4.5, 10)], "root string, ts timestamp, path string")
    rows = events.debounce(df).orderBy("fires").collect()
    assert [(r["n"], r["paths"]) for r in rows] == [(3, ["p0", "p1", "p2.5"]), (1, ["p4.5"]), (1, ["p10"])]


def test_throttle(spark):
    df = spark.createDataFrame([("r", at(s), now) for s, now in ((0, False), (10, False), (20, False), (35, True), (40, False))], "root string, fires timestamp, immediate boolean")
    rows = events.throttle(df).orderBy("fires").collect()
    assert [(r["fired_at"] - T0).total_seconds() for r in rows] == [0, 30, 30, 35, 65]


def test_rate_limit_ignores_refused(spark):
    times = [0, 1, 2, 3, 4, 5, 59, 60.5, 61.5]
    df = spark.createDataFrame([("c", at(s), i) for i, s in enumerate(times)], "client string, ts timestamp, id int")
    kept, wanted = [], []
    for t in times:
        wanted.append(len([k for k in kept if k >= t - 60]) < 5)
        kept += [t] if wanted[-1] else []
    assert [r["admitted"] for r in events.rate_limit(df).orderBy("id").collect()] == wanted


def test_debounce_stream(spark, tmp_path):
    df = spark.createDataFrame([("r", at(s), "p") for s in (0, 1, 10, 1000)], "root string, ts timestamp, path string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "5 seconds")
    query = events.debounce(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["n"] for r in spark.sql("select n from bursts").collect()) == [1, 2]


def test_jobs(spark):
    rows = [("a", "u", "queued", at(0)), ("a", "u", "completed", at(10)), ("b", "u", "queued", at(5)), ("c", "v", "failed", at(5)), ("d", "w", "completed", at(-2000))]
    jobs = ordered.job_states(spark.createDataFrame(rows, "job_id string, repo_url string, status string, ts timestamp"))
    now = F.lit(at(60))
    assert sorted(map(tuple, events.reusable_jobs(jobs, now).collect())) == [("u", "b")]
    assert events.pending_jobs(jobs, now).first()[0] == 1 and events.live_jobs(jobs, F.lit(at(90_000))).count() == 0
    assert {r["job_id"]: r["status"] for r in events.recover_jobs(jobs).collect()}["b"] == "failed"


def test_chain(spark):
    df = spark.createDataFrame([("l", i, f"e{i}") for i in range(5)], "ledger string, seq int, entry string")
    rows = events.hash_chain(df).orderBy("seq").collect()
    before = None
    for r in rows:
        assert json.loads(r["line"])["previousHash"] == before == r["previous_hash"]
        before = hashlib.sha256(r["line"].encode()).hexdigest()
    lines = events.hash_chain(df)
    assert events.broken_links(lines).count() == 0
    assert events.broken_links(lines.withColumn("line", F.when(F.col("seq") == 2, "{}").otherwise(F.col("line")))).count() == 2


def test_label_spans_and_words(spark):
    tokens = [(0, "B-PER", 0.9), (1, "I-PER", 0.6), (2, "O", 1.0), (3, "I-LOC", 0.8), (4, "E-LOC", 0.7), (5, "E-LOC", 0.9), (6, "S-ORG", 0.9), (7, "I-ORG", 0.9)]
    df = spark.createDataFrame([(0, p, p * 10, p * 10 + 5, label, c) for p, label, c in tokens], "doc int, pos int, start int, end int, label string, confidence double")
    rows = [tuple(r) for r in entities.decode_labels(df).orderBy("start").collect()]
    assert rows == [(0, 0, 15, "PER", 0.6), (0, 30, 45, "LOC", 0.7), (0, 50, 55, "LOC", 0.9), (0, 60, 65, "ORG", 0.9), (0, 70, 75, "ORG", 0.9)]
    logits = [([0.0, 5.0, 0.0], False, False), ([9.0, 0.0, 0.0], True, False), ([9.0, 0.0, 0.0], False, True), ([0.0, 0.1, 0.0], False, False)]
    df = spark.createDataFrame([(0, i, i * 2, i * 2 + 2, x, cont, special) for i, (x, cont, special) in enumerate(logits)], "doc int, pos int, start int, end int, logits array<double>, is_continuation boolean, is_special boolean")
    rows = entities.decode_entities(df, ["O", "B-PER", "I-PER"]).collect()
    assert [(r["start"], r["end"], r["entity_type"]) for r in rows] == [(0, 4, "personName")]


def test_tokenizers(spark):
    assert entities.longest_pieces("unaffable", {"un", "##aff", "##able"}) == ["un", "##aff", "##able"]
    assert entities.longest_pieces("xyz", {"x"}) == ["[UNK]"]
    assert entities.merged_pieces("lower", {("l", "o"): 0, ("lo", "w"): 1, ("e", "r"): 2}) == ["low", "er"]
    assert entities.likeliest_pieces("abc", {"a": -1.0, "b": -1.0, "ab": -1.5, "c": -1.0}, -10.0) == ["ab", "c"]
    assert entities.likeliest_pieces("axb", {"a": -1.0, "b": -1.0}, -10.0) == ["a", "<unk>", "b"]
    df = spark.createDataFrame([(0, "low, er"), (1, None)], "doc_id int, text string")
    rows = entities.tokenize(df, "doc_id", "text", lambda w: list(w)).orderBy("doc_id").collect()
    assert [(t["piece"], t["start"], t["is_continuation"]) for t in rows[0]["tokens"]][:4] == [("l", 0, False), ("o", 0, True), ("w", 0, True), (",", 3, False)] and rows[1]["tokens"] == []


def test_windows_and_chunks(spark):
    df = spark.createDataFrame([(0, "x" * 9000, list(range(10))), (1, "", [])], "id int, text string, tokens array<int>")
    assert [(r["start"], len(r["chunk"])) for r in entities.chunks(df, "id", "text").orderBy("doc_id", "n").collect()] == [(0, 4000), (3800, 4000), (7600, 1400), (0, 0)]
    rows = entities.token_windows(df, "id", "tokens", 6, 2, 101, 102).orderBy("doc_id", "n").collect()
    assert [r["tokens"] for r in rows] == [[101, 0, 1, 2, 3, 102], [101, 2, 3, 4, 5, 102], [101, 4, 5, 6, 7, 102], [101, 6, 7, 8, 9, 102], [101, 102]]


def test_answers(spark):
    answer = json.dumps({"entities": [{"type": "person", "text": "Ann"}, {"type": "PER", "text": "Ann"}, {"type": "zzz", "text": "x"}, {"type": "ORG", "text": " Bo "}]})
    df = spark.createDataFrame([(0, "Ann saw Ann at Bo", f"sure: {answer}"), (1, "x", "no json"), (2, None, None)], "id int, text string, answer string")
    rows = entities.answer_entities(df, "id", "text", "answer").orderBy("start").collect()
    assert [(r["start"], r["end"], r["entity_type"]) for r in rows] == [(0, 3, "personName"), (8, 11, "personName"), (15, 17, "customCompany")]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.path_mentions(F.lit("see @src/a.py, @b and @c.txt)"))) == ["src/a.py", "c.txt"]
    assert one(text.shell_tokens(F.lit("a && b;c | d;"))) == ["a", "b;c", "d"]
    assert one(text.joined_literals(F.lit("x 'f'+\"ix\" 'y'"))) == ["fix"]
    assert one(text.json_strings(F.lit('{"a": "x", "b": {"c": ["y\\n", 1], "d": "z"}}'))) == ["x", "y\n", "z"]
    assert one(text.mask_arguments(F.array(*map(F.lit, ["--token", "t", "K_SECRET=1", "https://u:p@h/x", "z"])))) == ["--token", "***", "K_SECRET=***", "https://***@h/x", "z"]
    assert one(text.decoded_text(F.lit(b"\xe9t\xe9"))) == "été" and one(text.decoded_text(F.lit("é".encode()))) == "é"
    assert [one(text.likely_text(F.lit(x))) for x in (b"abc", b"a\x00b", "é".encode() * 4096 + b"x", bytes([1, 2, 3, 4, 200]) * 9)] == [True, False, True, False]
    assert one(text.iso_time(F.lit(0))) == "1970-01-01T00:00:00Z" and text.ruleset_hash(["a"]) == f"{5381 * 33 + 97:x}"


@pytest.mark.parametrize("command,decision", [("PATH=/x ls", "deny"), ("git commit -m x", "allow"), ("docker ps", "allow"), ("curl --unix-socket /var/run/docker.sock", "deny"), ("cat a/b.txt", "allow"), ("", "allow")])
def test_shell_gate(spark, command, decision):
    df = spark.createDataFrame([(json.dumps({"tool_input": {"command": command}}),)], "payload string")
    assert df.select(gates.shell_gate(F.col("payload"))["decision"]).first()[0] == decision


def test_calls_and_fields(spark):
    calls = spark.createDataFrame([(1, "DB", "q", "{}"), (2, "fs", "q", json.dumps({"p": "a/.ssh/id_rsa"})), (3, "x", "q", "{}")], "call_id int, server string, tool string, payload string")
    assert [r["decision"] for r in gates.call_gate(calls, allow=("db", "fs"), deny=("*",), mode="deny").orderBy("call_id").collect()] == ["allow", "deny", "deny"]
    assert [r["decision"] for r in gates.call_gate(calls, deny=("X",)).orderBy("call_id").collect()] == ["allow", "ask", "ask"]  # the mode decides what a refused server comes to
    rules = spark.createDataFrame([(0, "*", None, {"a": "mask", "b": "drop"}), (1, "db", "*", {"a": "keep"}), (2, "db", "*", {"a": "drop"})], "idx int, server string, tool string, fields map<string,string>")
    assert sorted(map(tuple, gates.field_actions(calls, rules).filter("call_id = 1").collect())) == [(1, "a", "keep"), (1, "b", "drop")]


def test_sources(spark, tmp_path):
    for name, body in (("a.txt", b"mail joe@x.org"), ("node_modules/b.txt", b"no"), ("c.bin", b"\xff\xfe\x00"), ("d/e.txt", "ü".encode()), ("f.jsonl", b"{}")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    assert sorted(r["path"] for r in files.read_files(spark, str(tmp_path), ["d/**"]).collect()) == ["a.txt", "f.jsonl"]
    assert files.read_documents(spark, str(tmp_path)).count() == 4 and files.read_transcripts(spark, str(tmp_path)).count() == 4
    key = bytes(32)
    maps = spark.createDataFrame([(1, at(0), {"{{A_1}}": "old"}), (2, at(10), {"{{A_1}}": "new"}), (3, at(20), {"{{B_1}}": "b"})], "mapping_id int, created_at timestamp, mapping map<string,string>")
    stored = files.store_mapping(maps, key)
    assert tuple(files.find_mapping(stored, "{{A_1}}", key, F.lit(at(30))).first()) == (2, "new")
    assert files.find_mapping(stored, "{{A_1}}", key, F.lit(at(90_000))).first()[0] is None


def test_staged_blobs(spark):
    df = spark.createDataFrame([("a", b"plain"), ("b", b"\xff\xfe\x00"), ("c", b"x" * (files.INPUT_LIMIT + 1)), ("d", None)], "path string, blob binary")
    assert [tuple(r) for r in files.blobs_to_texts(df).collect()] == [("a", "plain")]


def test_report_and_log_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "n int, v string")
    for _ in range(2):
        files.write_findings(rows, str(tmp_path / "report"))
        files.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1 and spark.read.json(str(tmp_path / "log")).count() == 2


def test_server_inventory(spark):
    body = {"mcpServers": {"Shell-x": {"command": "run", "args": ["--token", "abc", "y"]}, "web": {"url": "https://u:p@h/x"}}}
    df = spark.createDataFrame([("f", json.dumps(body)), ("g", '{"servers": {"a": {"command": "c"}}}'), ("h", "no json"), ("i", None)], "source string, payload string")
    rows = {(r["source"], r["name"]): (r["command"], r["args"], r["high_risk"]) for r in gates.server_inventory(df).collect()}
    assert rows == {("f", "Shell-x"): ("run", ["--token", "***", "y"], True), ("f", "web"): ("https://***@h/x", [], False), ("g", "a"): ("c", [], False)}


def test_gates_on_awkward_payloads(spark):
    calls = spark.createDataFrame([(1, "db", "{oops"), (2, None, None), (3, "db", "{}")], "call_id int, server string, payload string")
    decided = lambda **o: [r["decision"] for r in gates.call_gate(calls, **o).orderBy("call_id").collect()]
    assert decided(mode="deny") == ["deny", "allow", "allow"] and decided(mode="ask") == ["allow", "allow", "allow"]
    assert decided(mode="observe", deny=("*",)) == ["allow"] * 3
    responses = spark.createDataFrame([("mail a@b.co",), (None,), ("plain",)], "text string")
    assert sorted((r["action"], str(r["text"])) for r in gates.response_gate(responses, "seal").collect()) == [("pass", "None"), ("pass", "plain"), ("withhold", "None")]
    assert sorted(r["action"] for r in gates.response_gate(responses, "warn").collect()) == ["pass", "pass", "warn"]


def test_search_gate_refuses(spark):
    texts = spark.createDataFrame([("p", "mail a@b.co"), ("q", "plain"), ("q", None)], "path string, text string")
    asked = spark.createDataFrame([(1, '{"path": "p"}'), (2, '{"path": "q"}'), (3, "{}"), (4, None)], "event_id int, payload string")
    decided = lambda **o: [r["decision"] for r in gates.search_gate(asked, texts, **o).orderBy("event_id").collect()]
    assert decided() == ["deny", "allow", "allow", "allow"] and decided(refuse_all=True) == ["deny"] * 4


def test_extractors(spark):
    rows = [("a.UP", b"shout"), ("b.up", None), ("c.txt", "grün".encode()), ("d.bin", bytes(range(30))), ("e.bad", b"x")]
    df = spark.createDataFrame(rows, "path string, content binary")
    found = files.extract_documents(df, {"up": lambda b: b.decode().upper(), "bad": lambda b: 1 / 0})
    assert dict(map(tuple, found.collect())) == {"a.UP": "SHOUT", "b.up": None, "c.txt": "grün", "e.bad": None}
