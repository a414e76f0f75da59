"""Decisions on editor and agent events: allow, ask or deny, as columns over JSON payloads; and server rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from veilmark.functions import text as X
from veilmark.functions.paths import any_of, artifact_class, is_excluded, is_suspicious, looks_executable
from veilmark.operators.rewrite import redact_values, seal_findings
from veilmark.operators.spans import with_findings

_COMMAND = ("$.command", "$.tool_input.command")
_PATH = ("$.file_path", "$.path", "$.tool_input.file_path", "$.tool_input.path", "$.tool_input.notebook_path")
_CONTENT = ("$.content", "$.tool_input.content", "$.tool_input.new_string", "$.edits[0].new_string")
_PROMPT = ("$.prompt", "$.tool_input.prompt", "$.task", "$.text")


def _decision(deny: dict[str, Column], ask: dict[str, Column]) -> Column:
    """struct<decision, reasons>: deny beats ask beats allow; reasons of the level that decides."""
    found = {n: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in level.items()])) if level else F.array().cast("array<string>") for n, level in (("deny", deny), ("ask", ask))}
    decision = F.when(F.size(found["deny"]) > 0, "deny").when(F.size(found["ask"]) > 0, "ask").otherwise("allow")
    reasons = F.when(F.size(found["deny"]) > 0, found["deny"]).otherwise(found["ask"])
    return F.struct(decision.alias("decision"), F.array_join(reasons, " ").alias("reasons"))


def shell_gate(payload: Column, ignored: tuple[str, ...] = (), program: str = "veilmark") -> Column:
    """A command: it may not change the policy, unseal, configure git, poison the environment, reach containers or touch guarded files."""
    command = F.coalesce(X.json_field(payload, *_COMMAND), F.lit(""))
    covered = [p if not p.endswith("/") else f"{p}**" for p in ignored]

    def judged(path: Column) -> Column:
        return F.struct(
            (artifact_class(path)["enforcement"] == "deny").alias("artifact"), is_suspicious(path).alias("suspicious"),
            ((is_excluded(path, covered) | is_excluded(F.concat(path, F.lit("/x")), covered)) if covered else F.lit(False)).alias("ignored"),
        )

    def decided(pair: Column) -> Column:
        c, paths = pair["command"], pair["paths"]
        deny = {
            "policy": c.rlike(rf"(?:^|[\s;&|/]){program}\s+policy\s+(?:trust|forget)\b"),
            "unseal": c.rlike(rf"(?:^|[\s;&|/]){program}\s+unseal\b"),
            "git-config": X.git_config_mutation(c),
            "environment": X.environment_poisoning(c).isNotNull(),
            "container": X.container_access(c),
            "artifact": F.exists(paths, lambda p: F.coalesce(p["artifact"], F.lit(False))),
            "ignored": F.exists(paths, lambda p: p["ignored"]),
        }
        return _decision(deny, {"sensitive-path": F.exists(paths, lambda p: p["suspicious"])})

    # each candidate path is found and judged once
    pair = F.transform(F.array(command), lambda c: F.struct(c.alias("command"), F.transform(X.path_candidates(c), judged).alias("paths")))
    return F.get(F.transform(pair, decided), F.lit(0))


def read_gate(payload: Column, excluded: tuple[str, ...] = ()) -> Column:
    """A file read: excluded paths pass, suspicious ones are denied."""
    path = F.coalesce(X.json_field(payload, *_PATH), F.lit(""))
    return _decision({"sensitive-path": is_suspicious(path) & ~is_excluded(path, excluded)}, {})


def write_gate(payload: Column) -> Column:
    """A file write: files that run programs are denied, settings only with content that starts one, interpreters asked."""
    path, content = F.coalesce(X.json_field(payload, *_PATH), F.lit("")), F.coalesce(X.json_field(payload, *_CONTENT), F.lit(""))
    enforcement = artifact_class(path)["enforcement"]
    return _decision(
        {"artifact": enforcement == "deny", "executable-setting": (enforcement == "denyWhenContentExecutable") & looks_executable(content)}, {"observed-artifact": enforcement == "observe"}
    )


def text_gate(events: DataFrame, id_col: str = "event_id", payload_col: str = "payload", mode: str = "deny") -> DataFrame:
    """Prompts, subagent tasks, searches and responses: (event_id, decision, reasons) by what a scan finds in their strings.

    A critical secret denies (mode deny), asks (ask) or is observed (observe); other findings ask at most.
    """
    text = F.coalesce(X.json_field(F.col(payload_col), *_PROMPT), F.array_join(X.json_strings(F.col(payload_col)), "\n"))
    rows = with_findings(events.select(F.col(id_col), text.alias("text")))
    found = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["entity_type"]))), " ")
    secret = F.exists("findings", lambda f: f["source"] == "secret")
    decision = F.when((F.size("findings") == 0) | F.lit(mode == "observe"), "allow").when(secret, mode).otherwise("ask")
    return rows.select(id_col, decision.alias("decision"), found.alias("reasons"))


def server_refused(server: Column, allow: tuple[str, ...], deny: tuple[str, ...]) -> Column:
    """Whether the lists refuse a server (ASCII case set aside, `*` any). A denied one is refused, but where `*` is denied beside
    an allow list, that list decides alone; it also does where nothing denies. A server without a name passes."""
    name = F.lower(F.coalesce(server, F.lit("")))

    def listed(names: tuple[str, ...]) -> Column:
        return F.lit(True) if "*" in names else any_of(name == x.lower() for x in names)

    if allow and (not deny or "*" in deny):
        refused = ~listed(allow)
    else:
        refused = listed(deny) | (~listed(allow) if allow else F.lit(False))
    return (name != "") & refused


def call_gate(calls: DataFrame, allow: tuple[str, ...] = (), deny: tuple[str, ...] = (), mode: str = "ask", secrets_only: bool = False) -> DataFrame:
    """Calls (server, payload: the arguments) with decision, reason and n_findings.

    A guarded path in the arguments, else a refused server, else what a scan of the whole arguments finds is the reason; the
    mode (observe, ask or deny) says what comes of it. A payload that is no JSON is denied in mode deny, else let by.
    """
    rows = with_findings(calls, "payload", secrets_only=secrets_only)
    n = F.size("findings")
    valid = F.col("payload").isNull() | F.get_json_object(F.concat(F.lit('{"v":'), "payload", F.lit("}")), "$").isNotNull()
    reason = (
        F.when(~valid, F.when(F.lit(mode == "deny"), "unreadable"))
        .when(F.coalesce(F.exists(X.json_strings(F.col("payload")), is_suspicious), F.lit(False)), "path")
        .when(server_refused(F.col("server"), allow, deny), "server")
        .when(n > 0, "findings")
    )
    decided = F.when(F.col("reason").isNull() | F.lit(mode == "observe"), "allow").otherwise(mode)
    return rows.select("*", n.alias("n_findings"), reason.alias("reason")).withColumn("decision", decided).drop("findings")


def response_gate(responses: DataFrame, mode: str = "observe", key: bytes | None = None, text_col: str = "text", secrets_only: bool = False) -> DataFrame:
    """Responses with n_findings, action and their text: pass without findings or in mode observe; warn; seal with the text sealed under
    `key`, or withhold (text null) where that can't be done or there is no key."""
    rows = with_findings(responses, text_col, secrets_only=secrets_only)
    n = F.size("findings")
    rows = rows.withColumn("n_findings", n)
    if mode == "seal" and key is not None:
        rows = seal_findings(rows, key, text_col)
    elif mode == "seal":
        rows = rows.withColumn(text_col, F.when(n == 0, F.col(text_col)))
    action = F.when((F.col("n_findings") == 0) | F.lit(mode == "observe"), "pass").when(F.lit(mode == "warn"), "warn").when(F.col(text_col).isNull(), "withhold").otherwise("seal")
    return rows.withColumn("action", action).drop("findings")


def search_gate(events: DataFrame, files: DataFrame, refuse_all: bool = False, limit: int | None = 2 << 20, secrets_only: bool = False) -> DataFrame:
    """Searches (event_id, payload) with decision and n_findings: denied where the file (path, text) they look into has findings, or always
    with `refuse_all` (a search's hits can't be sealed). Files are scanned once, then joined by path. One of over `limit` bytes
    (None: no limit) isn't read: it is let by, and n_findings is null."""
    large = F.coalesce(F.octet_length("text") > limit, F.lit(False)) if limit is not None else F.lit(False)
    rows = with_findings(files.select("path", large.alias("large"), F.when(~large, F.col("text")).alias("text")), secrets_only=secrets_only)
    scanned = rows.groupBy("path").agg(F.sum(F.size("findings")).alias("n_findings"), F.bool_or("large").alias("large"))
    path = X.json_field(F.col("payload"), "$.tool_input.path", "$.tool_input.file_path", "$.path", "$.file_path")
    rows = events.select("event_id", path.alias("path")).join(scanned, "path", "left")
    n = F.coalesce("n_findings", F.lit(0))
    unread = F.coalesce("large", F.lit(False)) & (n == 0)
    return rows.select("event_id", F.when((n > 0) | F.lit(refuse_all), "deny").otherwise("allow").alias("decision"), F.when(~unread, n).alias("n_findings"))


def task_gate(events: DataFrame, mode: str = "deny", id_col: str = "event_id", payload_col: str = "payload", secrets_only: bool = False) -> DataFrame:
    """Tasks handed to another agent, with decision and n_findings: findings deny in the modes ask and deny (nobody can be asked there)."""
    task = F.coalesce(*[F.nullif(X.json_field(F.col(payload_col), p), F.lit("")) for p in ("$.task", "$.prompt", "$.description", "$.tool_input.task", "$.tool_input.prompt", "$.tool_input.description")])
    rows = with_findings(events.select(F.col(id_col), task.alias("text")), secrets_only=secrets_only)
    n = F.size("findings")
    return rows.select(id_col, F.when((n > 0) & F.lit(mode != "observe"), "deny").otherwise("allow").alias("decision"), n.alias("n_findings"))


def _name_matches(pattern: Column, name: Column) -> Column:
    """A name pattern in which * stands for anything, case set aside."""
    quoted = F.regexp_replace(F.lower(pattern), r"([^a-z0-9_*-])", r"\\$1")
    return F.rlike(F.lower(name), F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("$")))


#: Most rules that a plan takes in.
RULE_LIMIT = 5_000


def _ordered_rules(rules: DataFrame) -> list[Row]:
    """A configuration's rules, the most specific first, ties to the earlier: the server weighs four times the tool, and exact
    names beat patterns, which beat `*`."""
    star = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", "*").otherwise(F.trim(c)).alias(c)
    rows = rules.select(star("server"), star("tool"), *[c for c in rules.columns if c not in ("server", "tool")]).limit(RULE_LIMIT + 1).collect()
    if len(rows) > RULE_LIMIT:
        raise ValueError(f"a configuration has at most {RULE_LIMIT} rules")
    weight = lambda p: 0 if p == "*" else 1 if "*" in p else 2
    return sorted(rows, key=lambda r: (-(4 * weight(r["server"]) + weight(r["tool"])), r["idx"]))


def _fits(rule: Row, server: Column, tool: Column) -> Column:
    """Whether a rule fits, as one expression over the call; ASCII case set aside, `*` stands for anything."""

    def one(pattern: str, name: Column) -> Column:
        if pattern == "*":
            return name.isNotNull()
        if "*" not in pattern:
            return F.lower(name) == pattern.lower()
        return F.lower(name).rlike("^" + ".*".join(re.sub(r"([^a-z0-9_-])", r"\\\1", part) for part in pattern.lower().split("*")) + "$")

    return one(rule["server"], server) & one(rule["tool"], tool)


def chosen_rule(rules: DataFrame, server: Column, tool: Column) -> Column:
    """The idx of the most specific rule that fits a call, null if none does: a column, so calls are neither joined nor shuffled.

    Rules that name a server and a tool are looked up in one map; the others are tried in order, and only until one fits.
    """
    ordered = _ordered_rules(rules)
    exact: dict[str, int] = {}
    for r in ordered:
        if "*" not in r["server"] and "*" not in r["tool"]:
            exact.setdefault(f"{r['server'].lower()}\n{r['tool'].lower()}", r["idx"])
    rest = [r for r in ordered if "*" in r["server"] or "*" in r["tool"]]
    found = [F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])[F.concat(F.lower(server), F.lit("\n"), F.lower(tool))]] if exact else []
    found += [F.when(_fits(r, server, tool), F.lit(r["idx"])) for r in rest]
    return F.coalesce(*found, F.lit(None).cast("int"))


def choose_rule(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls (server, tool, ...) with the idx of their most specific rule (idx, server, tool), ties to the earlier one; null without one."""
    return calls.withColumn("idx", chosen_rule(rules, F.col("server"), F.col("tool")))


def field_rules(rules: DataFrame, server: Column, tool: Column) -> Column:
    """map<field, action> from all rules (fields map<string,string>) that fit a call: the more specific wins, then the earlier."""
    by_field: dict[str, list[Column]] = {}
    for r in _ordered_rules(rules):
        for field, action in (r["fields"] or {}).items():
            if field.strip():
                by_field.setdefault(field.strip(), []).append(F.when(_fits(r, server, tool), F.lit((action or "").strip())))
    pairs = [F.struct(F.lit(field).alias("key"), F.coalesce(*actions).alias("value")) for field, actions in by_field.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")


def field_actions(calls: DataFrame, rules: DataFrame, key: str = "call_id") -> DataFrame:
    """(call, field, action) from all fitting rules; row by row."""
    return calls.select(key, F.explode(field_rules(rules, F.col("server"), F.col("tool"))).alias("field", "action"))


def apply_fields(payload: Column, actions: Column) -> Column:
    """A JSON object with the top-level fields of `actions` (map) handled: `remove` takes one out, `mask` and `redact` put ***
    for its value, others leave it. What is no JSON object stays as it is. Values keep their types, as they are read as VARIANT."""
    object_of = F.try_parse_json(payload).try_cast("map<string,variant>")
    act = lambda k: F.coalesce(F.try_element_at(actions, k), F.lit(""))
    kept = F.map_filter(object_of, lambda k, v: act(k) != "remove")
    done = F.transform_values(kept, lambda k, v: F.when(act(k).isin("mask", "redact"), F.parse_json(F.lit('"***"'))).otherwise(v))
    return F.coalesce(F.to_json(done), payload)


def server_inventory(configs: DataFrame, risky: tuple[str, ...] = ("*shell*", "*filesystem*", "*exec*")) -> DataFrame:
    """Servers of JSON configurations (source, payload): source, name, command, args with secrets hidden, high_risk; once a source and name."""
    servers = F.from_json(F.coalesce(F.get_json_object("payload", "$.mcpServers"), F.get_json_object("payload", "$.servers")), "map<string, struct<command: string, args: array<string>, url: string>>")
    rows = configs.select("source", F.explode(servers).alias("name", "s"))
    rows = rows.withColumn("key", F.lower("name")).groupBy("source", "key").agg(F.min_by(F.struct("name", "s"), "name").alias("r")).select("source", "r.name", "r.s")
    risk = any_of(_name_matches(F.lit(g), F.col("name")) for g in risky)
    return rows.select("source", "name", F.coalesce("s.command", X.mask_url_user(F.col("s.url"))).alias("command"), X.mask_arguments(F.coalesce("s.args", F.array().cast("array<string>"))).alias("args"), risk.alias("high_risk"))


def shell_audit(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Commands (doc_id, command) whose output had findings, with the found values hidden: doc_id, command, types."""
    found = findings.groupBy("doc_id").agg(F.collect_set("value").alias("values"), F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("types"))
    return events.join(found, "doc_id").select("doc_id", redact_values(F.col("command"), F.col("values")).alias("command"), "types")
