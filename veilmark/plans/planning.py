"""Queries on fixes, reports, gates, spans of models and event folds, each beside the DuckDB SQL that was written on its own for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.functions import checks, path_tables, text
from veilmark.operators import audit, gates, policy, rewrite, risk, spans
from veilmark.plans import oracle
from veilmark.plans import samples as S
from veilmark.plans.registry import KEY, dealt, documents, listing, scanned
from veilmark.session import spread, table

_RULES = path_tables.privacy_rules()
#: Rules that the fixes below select.
_SELECTED = ["cursor-ignore", "claude-ignore", "agents-md", "claude-project-rules"]
_DISABLED = ["llm-ignore", "cursor-ignore", "zed-ignore"]


def _exposed(spark, sf_dir):
    return audit.exposures(listing(spark, sf_dir), S.IGNORE_LINES)


def _selected(spark):
    return spark.createDataFrame([(r,) for r in _SELECTED], "rule string")


def listed_paths(spark, sf_dir):
    return audit.with_directories(listing(spark, sf_dir))


def planned_paths(spark, sf_dir):
    rules, matched = policy.rule_table(spark), policy.matched_files(listing(spark, sf_dir))
    return policy.planned_paths(rules, matched, _selected(spark), True)


def pattern_targets(spark, sf_dir):
    """Where patterns go by the rules that suppliers in debt select: the rule of their nation's number."""
    picked = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.get(F.array(*[F.lit(r[0]) for r in _RULES]), F.col("s_nationkey").cast("int")).alias("rule"))
    return policy.pattern_targets(policy.rule_table(spark), policy.matched_files(listing(spark, sf_dir)), picked)


def fix_files(spark, sf_dir):
    return policy.fix_files(policy.rule_table(spark), policy.matched_files(listing(spark, sf_dir)), _exposed(spark, sf_dir))


def fix_scenario(spark, sf_dir):
    return policy.fix_scenario(policy.rule_table(spark), policy.matched_files(listing(spark, sf_dir)))


def fix_items(spark, sf_dir):
    rows = listing(spark, sf_dir)
    return audit.fix_items(audit.pattern_findings(_exposed(spark, sf_dir)), audit.rule_findings(rows), audit.tool_exposures(rows, S.IGNORE_LINES))


def selected_fixes(spark, sf_dir):
    ids = spark.createDataFrame([("env-files",), ("cursor-ignore",), ("claude-ignore",), ("nothing",)], "id string")
    return audit.select_fixes(fix_items(spark, sf_dir), ids).select("kind", "id")


def finding_paths(spark, sf_dir):
    found = _exposed(spark, sf_dir)
    wanted = found.filter("pattern in ('env-files', 'key-files')").select(F.substring(F.sha2(F.concat_ws("\n", "pattern", "path"), 256), 1, 12).alias("id"))
    return policy.file_of_finding(found, wanted)


def check_report(spark, sf_dir):
    found = _exposed(spark, sf_dir)
    return policy.check_report(policy.rule_table(spark), policy.matched_files(listing(spark, sf_dir)), audit.pattern_findings(found), found)


def protect_lines(spark, sf_dir):
    return audit.protect_lines(_exposed(spark, sf_dir), with_recommended=True)


def check_totals(spark, sf_dir):
    return audit.check_totals(_exposed(spark, sf_dir))


def severity_counts(spark, sf_dir):
    return audit.severity_counts(audit.pattern_findings(_exposed(spark, sf_dir)))


def tracked_and_ignored(spark, sf_dir):
    return audit.tracked_and_ignored(listing(spark, sf_dir), S.IGNORE_LINES).select("n", F.array_join("first", "|").alias("first"))


def filtered_rules(spark, sf_dir):
    rules = audit.filter_rules(_RULES, ["cursor", "claude", "llm"], _DISABLED)
    return audit.rule_findings(listing(spark, sf_dir), rules).select("rule", "n_files", "satisfied")


def worst_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "warning").otherwise("pass").alias("status"))
    return audit.worst_status(rows)


def degraded_audits(spark, sf_dir):
    """Orders of a customer as the audits of a root: their status by order status, an exposed path by priority."""
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "warning").otherwise("pass")
    stamp = F.coalesce("o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz")) + F.make_dt_interval(secs=F.col("o_orderkey").cast("decimal(18,6)") / 1_000_000)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("root"), stamp.alias("ts"), status.alias("status"), F.array("o_orderpriority").alias("exposed"))
    return audit.degraded(rows).select("o_orderkey", "degraded")


def due_audits(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("root"), (F.col("ts") + F.make_dt_interval(secs=F.col("event_id").cast("decimal(18,6)") / 1_000_000)).cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("force"))
    return audit.should_audit(rows, 7200).select("event_id", "due")


def same_type_spans(spark, sf_dir):
    """Line items of an order as spans of types by line status, confidences by discount."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("entity_type"), (F.col("l_partkey") % 40).cast("int").alias("start"),
        (F.col("l_partkey") % 40 + 1 + F.rint("l_quantity").cast("int") % 12).cast("int").alias("end"), F.col("l_discount").alias("confidence"),
    )
    return spans.merge_same_type(rows).select("doc_id", "entity_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "confidence")


def first_fit_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 40).cast("int").alias("start"), (F.col("l_partkey") % 40 + 1 + F.rint("l_quantity").cast("int") % 12).cast("int").alias("end"),
        "l_linenumber", F.lit("t").alias("entity_type"), F.lit("v").alias("value"),
    ).withColumnRenamed("l_linenumber", "rule_ord")
    return spans.first_fit(rows).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def outermost_regions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.rint("l_quantity").cast("int")).alias("end"), "l_orderkey", "l_linenumber",
    )
    return spans.outermost(rows, "page").select("l_orderkey", "l_linenumber")


def type_counts(spark, sf_dir):
    return risk.findings_by_type(spans.detect(documents(spark, sf_dir)))


def failing_docs(spark, sf_dir):
    return risk.fails(spans.detect(documents(spark, sf_dir)), "block")


def scrub_summary(spark, sf_dir):
    return rewrite.scrub_summary(scanned(spark, sf_dir))


def findings_of_some(spark, sf_dir):
    return spans.detect(documents(spark, sf_dir), disabled=["email", "apiKeyGeneric", "jwt"]).groupBy("entity_type").agg(F.count("*").alias("n"))


def _prompts(spark, sf_dir, *names: str):
    """Every event with one of the sample texts in its payload."""
    events = spread(table(spark, sf_dir, "events").select("event_id"))
    body = dealt(S.FINDINGS, F.col("event_id")).alias(names[-1])
    body = F.struct(F.struct(body).alias(names[0])) if len(names) > 1 else F.struct(body)
    return events.select("event_id", F.to_json(body).alias("payload"))


def task_gate(spark, sf_dir):
    return gates.task_gate(_prompts(spark, sf_dir, "tool_input", "task"))


def response_gate(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "events").select("event_id")).select("event_id", dealt(S.FINDINGS, F.col("event_id")).alias("text"))
    answered = rewrite.unseal(gates.response_gate(rows, "seal", KEY), KEY)
    return answered.select("event_id", "action", "n_findings", F.sha2("text", 256).alias("opened"))


def mcp_call_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", dealt(S.SERVERS, F.col("event_id")).alias("server"), F.to_json(F.struct(dealt(S.ARGUMENTS, F.col("event_id")).alias("q"))).alias("payload"))
    return gates.call_gate(rows, allow=("postgres", "files"), deny=("*",)).select("event_id", "decision", F.coalesce("reason", F.lit("")).alias("reason"))


def search_gate(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), dealt(S.FINDINGS, F.col("doc_id")).alias("text"))
    events = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.struct(F.concat(F.lit("d/"), (F.col("event_id") % 300).cast("string")).alias("path")).alias("tool_input"))).alias("payload"))
    return gates.search_gate(events, files)


def shell_findings(spark, sf_dir):
    """Commands whose output had findings, with the found values hidden."""
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("run "), dealt(S.FINDINGS, F.col("doc_id"))).alias("command"))
    found = spans.detect(rows, text_col="command")
    return gates.shell_audit(rows, found).select("doc_id", F.contains("command", F.lit("***")).alias("hidden"), "types")


def masked_arguments(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.split(dealt([a[0] for a in S.SECRET_COMMANDS], F.col("event_id")), " ").alias("a"))
    return rows.select("event_id", F.array_join(text.mask_arguments(F.col("a")), " ").alias("command"))


def value_ranks(spark, sf_dir):
    found = audit.pattern_findings(_exposed(spark, sf_dir))
    return found.groupBy("severity").agg(F.max(checks.severity_rank(F.col("severity"))).alias("rank"), F.sum("n_exposed").alias("n_exposed"))


def active_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("added_at"))
    return policy.active_entries(rows, 3).select("owner", "id")


def attention_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/w/"), "s_name").alias("path"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    statuses = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 2000, "fail").otherwise("pass").alias("status"))
    return policy.attention_entries(rows, statuses)


def exposure_summaries(spark, sf_dir):
    rows = _exposed(spark, sf_dir).groupBy("pattern").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return rows.select("pattern", policy.summary_text(F.col("paths"), 1).alias("summary"))


def trust_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), F.col("s_suppkey").cast("string").alias("contents"), "s_suppkey")
    old = rows.filter("s_suppkey % 5 != 0").select("path", F.sha2(F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise(F.col("contents")), 256).alias("sha256"))
    return policy.trust_drift(old, rows.filter("s_suppkey % 7 != 0").select("path", "contents"))


_QUERIES = [
    listed_paths, planned_paths, pattern_targets, fix_files, fix_scenario, fix_items, selected_fixes, finding_paths, check_report, protect_lines, check_totals, severity_counts, tracked_and_ignored,
    filtered_rules, worst_status, degraded_audits, due_audits, same_type_spans, first_fit_spans, outermost_regions, type_counts, failing_docs, scrub_summary, findings_of_some,
    task_gate, response_gate, mcp_call_gate, search_gate, shell_findings, masked_arguments, value_ranks, active_entries, attention_entries, exposure_summaries, trust_drift,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def _sql_of_files() -> dict[str, str]:
    q = oracle.quote
    labelled, patterns, exposed = oracle.labelled(), oracle.patterns(), oracle.EXPOSED
    rules = "rules AS (SELECT * FROM (VALUES " + oracle.values([(r[0], r[1], r[2], r[4], r[3][0]) for r in _RULES]) + ") v(rule, tool, severity, scans, fix_path))"
    present = "present AS (SELECT DISTINCT rule, path FROM labelled JOIN rules ON path = fix_path)"
    files = f"WITH {labelled}, {rules}, {present}"
    chosen = oracle.listed(_SELECTED)
    exposures = f"WITH {labelled}, {patterns}, {exposed}"
    first = "(SELECT string_agg(path, '|' ORDER BY path) FROM (SELECT DISTINCT path FROM labelled WHERE ignored ORDER BY path LIMIT 8))"
    lines = oracle.values([(p, line) for p, line in S.CANONICAL_LINES])
    kept = [r[0] for r in _RULES if (r[1] is None or r[1] in ("cursor", "claude", "llm")) and r[0] not in ("llm-ignore", "zed-ignore")]
    items = f"""{files}, {patterns}, {exposed}, items AS (
        SELECT 'pattern' AS kind, pattern AS id, severity, true AS selected FROM (SELECT DISTINCT pattern FROM exposed) JOIN patterns USING (pattern)
        UNION ALL SELECT 'rule', rule, severity, true FROM rules WHERE scans
        UNION ALL SELECT 'rule', rule, severity, false FROM rules WHERE NOT scans AND severity != 'informational')"""
    return {
        "listed_paths": f"WITH {labelled}, seen AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM labelled WHERE NOT list_has_any(string_split(path, '/')[:-2], {oracle.listed(path_tables.SKIPPED_DIRECTORIES)})), above AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path FROM seen, LATERAL (SELECT unnest(range(1, len(parts))) AS i)) SELECT path, true AS is_dir FROM above UNION ALL SELECT path, false FROM seen",
        "planned_paths": f"{files} SELECT DISTINCT fix_path AS path FROM rules WHERE list_contains({chosen}, rule) AND (scans OR (severity != 'informational' AND rule NOT IN (SELECT rule FROM present)))",
        "pattern_targets": f"WITH {rules}, picked AS (SELECT {oracle.listed([r[0] for r in _RULES])}[s_nationkey + 1] AS rule FROM supplier WHERE s_acctbal < 0) SELECT DISTINCT fix_path AS path FROM rules WHERE scans AND rule IN (SELECT rule FROM picked)",
        "fix_files": f"{files} SELECT fix_path AS path, CASE WHEN rule IN (SELECT rule FROM present) THEN 'refreshed' ELSE 'missing' END AS state FROM rules WHERE scans AND severity != 'informational'",
        "fix_scenario": f"{files} SELECT CASE WHEN count(*) > 0 THEN 'existing-files' ELSE 'no-files' END AS scenario FROM present JOIN rules USING (rule) WHERE scans",
        "fix_items": f"{items} SELECT * FROM items",
        "selected_fixes": f"{items} SELECT kind, id FROM items WHERE id IN ('env-files', 'cursor-ignore', 'claude-ignore')",
        "finding_paths": f"{exposures} SELECT left(sha256(pattern || chr(10) || path), 12) AS id, path FROM exposed WHERE pattern IN ('env-files', 'key-files')",
        "check_report": f"""{files}, {patterns}, {exposed}, categories AS (SELECT * FROM (VALUES {oracle.values([(i, c) for i, _, c, _ in path_tables.SENSITIVE_PATTERNS])}) v(pattern, category)),
            listed AS (SELECT pattern AS id, severity, category, count(*) AS n FROM exposed JOIN patterns USING (pattern) JOIN categories USING (pattern) GROUP BY ALL),
            offered AS (SELECT fix_path AS path, CASE WHEN rule IN (SELECT rule FROM present) THEN 'refreshed' ELSE 'missing' END AS state FROM rules WHERE scans AND severity != 'informational')
            SELECT '{{"schemaVersion":1,"toolVersion":"1","scanComplete":true,"ignoreFilesPresent":{{' || (SELECT string_agg('"' || rule || '":' || (rule IN (SELECT rule FROM present))::VARCHAR, ',' ORDER BY rule) FROM rules)
            || '}},"totals":{{"exposedFiles":' || (SELECT count(DISTINCT path) FROM exposed) || ',"exposedPatternTypes":' || (SELECT count(DISTINCT pattern) FROM exposed) || '}},"exposedPatterns":['
            || (SELECT string_agg('{{"id":"' || id || '","severity":"' || severity || '","category":"' || category || '","count":' || n || '}}', ',' ORDER BY CASE severity WHEN 'required' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END, id) FROM listed)
            || '],"fixFiles":[' || (SELECT string_agg('{{"path":"' || path || '","state":"' || state || '"}}', ',' ORDER BY path) FROM offered) || ']}}' AS report""",
        "protect_lines": f"{exposures} SELECT DISTINCT pattern, line FROM exposed JOIN patterns USING (pattern) JOIN (VALUES {lines}) l(pattern, line) USING (pattern) WHERE severity != 'informational'",
        "check_totals": f"{exposures} SELECT count(DISTINCT path) AS files, count(DISTINCT pattern) AS patterns FROM exposed",
        "severity_counts": f"{exposures} SELECT severity, count(DISTINCT e.pattern) AS n_patterns, count(path)::BIGINT AS n_exposed FROM patterns p LEFT JOIN exposed e ON e.pattern = p.pattern GROUP BY severity",
        "tracked_and_ignored": f"WITH {labelled} SELECT count(DISTINCT path) AS n, {first} AS first FROM labelled WHERE ignored",
        "filtered_rules": f"{files} SELECT r.rule, count(path) AS n_files, count(path) > 0 AS satisfied FROM rules r LEFT JOIN present p ON p.rule = r.rule WHERE list_contains({oracle.listed(kept)}, r.rule) GROUP BY r.rule",
        "value_ranks": f"{exposures} SELECT severity, max(CASE severity WHEN 'required' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END)::INT AS rank, count(path)::BIGINT AS n_exposed FROM patterns p LEFT JOIN exposed e ON e.pattern = p.pattern GROUP BY severity",
        "exposure_summaries": f"{exposures} SELECT pattern, CASE WHEN count(*) = 1 THEN min(path) ELSE min(path) || ' +' || (count(*) - 1) || ' more' END AS summary FROM exposed GROUP BY pattern",
        "worst_status": f"SELECT CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN {q('warning')} ELSE 'pass' END AS status FROM orders",
    }


def _sql_of_rows() -> dict[str, str]:
    status = "CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END"
    part = "l_orderkey AS doc_id, l_linestatus AS entity_type, l_partkey % 40 AS s, l_partkey % 40 + 1 + l_quantity::INT % 12 AS e, l_discount AS confidence, l_linenumber"
    commands = oracle.listed([a[1] for a in S.SECRET_COMMANDS])
    return {
        "degraded_audits": f"SELECT o_orderkey, coalesce({status} > lag({status}) OVER w OR o_orderpriority != lag(o_orderpriority) OVER w, false) AS degraded FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY coalesce(o_orderdate, TIMESTAMP '1970-01-01') + to_microseconds(o_orderkey))",
        "due_audits": "WITH e AS (SELECT *, ts + to_microseconds(event_id) AS t FROM events) SELECT event_id, event_type = 'error' OR coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= INTERVAL 2 HOUR, true) AS due FROM e",
        "same_type_spans": f"WITH l AS (SELECT {part} FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY doc_id, entity_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM l), i AS (SELECT *, sum(CASE WHEN reached IS NULL OR s >= reached THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, entity_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT doc_id, entity_type, min(s)::INT AS span_start, max(e)::INT AS span_end, max(confidence) AS confidence FROM i GROUP BY doc_id, entity_type, island",
        "first_fit_spans": f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, l_linenumber) AS n FROM (SELECT {part} FROM lineitem)),
            f(doc_id, n, s, e, reach, kept) AS (SELECT doc_id, n, s, e, e, true FROM l WHERE n = 1
                UNION ALL SELECT l.doc_id, l.n, l.s, l.e, CASE WHEN l.s >= f.reach THEN l.e ELSE f.reach END, l.s >= f.reach FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1)
            SELECT doc_id, s::INT AS span_start, e::INT AS span_end FROM f WHERE kept""",
        "outermost_regions": "WITH l AS (SELECT *, l_partkey AS s, l_partkey + l_quantity::INT AS e FROM lineitem) SELECT l_orderkey, l_linenumber FROM l QUALIFY coalesce(e > max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e DESC, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)",
        "masked_arguments": f"SELECT event_id, ({commands})[event_id % {len(S.SECRET_COMMANDS)} + 1] AS command FROM events",
        "active_entries": "SELECT c_nationkey AS owner, c_custkey AS id FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) <= 3",
        "attention_entries": "SELECT s_suppkey AS id, '/w/' || s_name AS path, s_name AS name, 'fail' AS status FROM supplier WHERE s_acctbal < 2000",
        "trust_drift": "SELECT s_name AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'added' WHEN s_suppkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM supplier WHERE (s_suppkey % 5 = 0) != (s_suppkey % 7 = 0) OR (s_suppkey % 5 != 0 AND s_suppkey % 7 != 0 AND s_suppkey % 3 = 0)",
        "event_rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id AS client, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
            r(client, n, event_id, times, admitted) AS (SELECT client, n, event_id, [ts], true FROM e WHERE n = 1
                UNION ALL SELECT client, n, event_id, CASE WHEN len(kept) < 5 THEN list_append(kept, ts) ELSE kept END, len(kept) < 5
                FROM (SELECT e.*, list_filter(r.times, lambda t: t >= e.ts - INTERVAL 1 DAY) AS kept FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1))
            SELECT event_id, client, admitted FROM r""",
        "event_throttle": """WITH RECURSIVE e AS (SELECT user_id AS root, ts, event_type = 'error' AS immediate, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
            r(root, n, last, waiting, fired) AS (SELECT root, n, ts, NULL::TIMESTAMP, ts FROM e WHERE n = 1
                UNION ALL SELECT root, n, CASE WHEN due = ts THEN ts ELSE last END, CASE WHEN due = ts THEN NULL ELSE due END, due FROM (
                    SELECT *, CASE WHEN immediate OR ts >= last + INTERVAL 2 HOUR THEN ts ELSE last + INTERVAL 2 HOUR END AS due FROM (
                        SELECT e.root, e.n, e.ts, e.immediate, CASE WHEN e.ts >= r.waiting THEN r.waiting ELSE r.last END AS last FROM r JOIN e ON e.root = r.root AND e.n = r.n + 1)))
            SELECT root, count(*) AS n, count(DISTINCT fired) AS audits FROM r GROUP BY root""",
        "ledger_chain": """WITH RECURSIVE e AS (SELECT user_id AS ledger, coalesce(to_json(props)::VARCHAR, 'null') AS entry, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
            r(ledger, n, head) AS (SELECT ledger, n, sha256('{"entry":' || entry || ',"previousHash":null}') FROM e WHERE n = 1
                UNION ALL SELECT e.ledger, e.n, sha256('{"entry":' || entry || ',"previousHash":"' || r.head || '"}') FROM r JOIN e ON e.ledger = r.ledger AND e.n = r.n + 1)
            SELECT ledger, count(*) AS n, arg_max(head, n) AS head FROM r GROUP BY ledger""",
    }


def _sql_of_texts() -> dict[str, str]:
    found = oracle.found()
    sample = oracle.found(f"docs AS (SELECT event_id AS doc_id, {oracle.dealt(S.FINDINGS, 'event_id')} AS text FROM events)")
    called = oracle.found(f"docs AS (SELECT event_id AS doc_id, {oracle.dealt(S.ARGUMENTS, 'event_id')} AS text FROM events)")
    files = oracle.found(f"docs AS (SELECT doc_id, {oracle.dealt(S.FINDINGS, 'doc_id')} AS text FROM documents)")
    commands = oracle.found(f"docs AS (SELECT doc_id, 'run ' || {oracle.dealt(S.FINDINGS, 'doc_id')} AS text FROM documents)")
    counted = "counted AS (SELECT d.doc_id, d.text, count(f.doc_id)::INT AS n FROM docs d LEFT JOIN found f USING (doc_id) GROUP BY ALL)"
    rest = oracle.found(without=("email", "apiKeyGeneric", "jwt"))
    return {
        "type_counts": f"{found} SELECT doc_id, entity_type, count(*) AS n FROM found GROUP BY ALL UNION ALL SELECT doc_id, NULL, count(*) FROM found GROUP BY doc_id",
        "failing_docs": f"{found} SELECT doc_id, bool_or(list_contains({oracle.CRITICAL}, entity_type)) AS failed FROM found GROUP BY doc_id",
        "scrub_summary": f"{found}, {counted} SELECT count(*) FILTER (n > 0 AND strlen(text) <= 2097152) AS touched, coalesce(sum(n) FILTER (strlen(text) <= 2097152), 0)::BIGINT AS redactions, count(*) FILTER (strlen(text) > 2097152) AS errors FROM counted",
        "findings_of_some": f"{rest} SELECT entity_type, count(*) AS n FROM found GROUP BY 1",
        "task_gate": f"{sample}, {counted} SELECT doc_id AS event_id, CASE WHEN n > 0 THEN 'deny' ELSE 'allow' END AS decision, n AS n_findings FROM counted",
        "response_gate": f"{sample}, {counted} SELECT doc_id AS event_id, CASE WHEN n > 0 THEN 'seal' ELSE 'pass' END AS action, n AS n_findings, sha256(text) AS opened FROM counted",
        "mcp_call_gate": f"{called}, {counted} SELECT doc_id AS event_id, CASE WHEN text LIKE '%.env%' OR doc_id % 3 = 2 OR n > 0 THEN 'ask' ELSE 'allow' END AS decision, CASE WHEN text LIKE '%.env%' THEN 'path' WHEN doc_id % 3 = 2 THEN 'server' WHEN n > 0 THEN 'findings' ELSE '' END AS reason FROM counted",
        "search_gate": f"{files}, {counted} SELECT event_id, CASE WHEN coalesce(n, 0) > 0 THEN 'deny' ELSE 'allow' END AS decision, coalesce(n, 0)::BIGINT AS n_findings FROM events LEFT JOIN counted ON doc_id = event_id % 300",
        "shell_findings": f"{commands} SELECT doc_id, true AS hidden, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types FROM found GROUP BY doc_id",
    }


def oracle_sql() -> dict[str, str]:
    return _sql_of_files() | _sql_of_rows() | _sql_of_texts()
