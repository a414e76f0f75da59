"""Queries on the tables' own columns (addresses, payloads, whole texts), and on operators that no other query has, with the DuckDB SQL written for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.functions import paths, path_tables, text
from veilmark.operators import audit, entities, gates, policy
from veilmark.plans import oracle
from veilmark.plans import samples as S
from veilmark.plans.registry import dealt, documents
from veilmark.session import spread, table
from veilmark.streaming import events as stream
from veilmark.streaming import provenance

_HOST, _PATH = r"^[a-z]+://([^/]+)", r"^[a-z]+://[^/]+/([^?#]*)"
_SAMPLES = [p[0] for p in S.PATHS]


def artifact_ledger(spark, sf_dir):
    """Events as edits of a user's files, documents as the files; the heads of the users' ledgers."""
    e = F.col("event_id")
    root = F.concat(F.lit("/w/u"), F.col("user_id").cast("string"))
    payload = F.to_json(F.struct(root.alias("cwd"), F.struct(dealt(_SAMPLES, e).alias("file_path")).alias("tool_input")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger"), "event_id", "ts", payload.alias("payload"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/w/u"), F.col("doc_id").cast("string"), F.lit("/"), dealt(_SAMPLES, F.col("doc_id"))).alias("path"), "text")
    lines = provenance.artifact_ledger(provenance.artifact_changes(rows, files))
    return lines.groupBy("ledger").agg(F.count("*").alias("n"), F.max_by(F.sha2("line", 256), "seq").alias("head"))


def _site_files(spark, sf_dir):
    """A file below the address of every page."""
    host, path = F.regexp_extract("url", _HOST, 1), F.regexp_replace(F.regexp_extract("url", _PATH, 1), "/$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", host, path, dealt(_SAMPLES, F.col("page_id"))).alias("path"))


def site_exposures(spark, sf_dir):
    """Exposed files of every host, by pattern."""
    exposed = audit.exposures(_site_files(spark, sf_dir).select("path").distinct(), {})  # distinct first: each path is put together once
    return exposed.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("host"), "pattern").agg(F.count("*").alias("n"))


def walked_files(spark, sf_dir):
    """What a walk over the hosts sees, up to its own limit."""
    return audit.walk(_site_files(spark, sf_dir))


def document_responses(spark, sf_dir):
    """Whole documents as responses."""
    return gates.response_gate(documents(spark, sf_dir), "warn").select("doc_id", "action", "n_findings")


def document_searches(spark, sf_dir):
    """Events as searches, each in one of all documents."""
    files = documents(spark, sf_dir).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")
    path = F.concat(F.lit("d/"), F.floor(F.col("event_id") / 10).cast("string"))
    searches = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.struct(path.alias("path")).alias("tool_input"))).alias("payload"))
    return gates.search_gate(searches, files)


#: idx, server, tool, what becomes of the fields.
FIELD_RULES = [(0, "*", "*", {"k": "keep"}), (1, "postgres", "*", {"k": "mask"}), (2, "*", "click", {"k": "remove"}), (3, "files", "view", {"k": "redact"}), (4, "files", "view", {"k": "remove", "z": "mask"})]


def payload_fields(spark, sf_dir):
    """The payloads of events, as calls of a tool named as their type, with their fields handled by all fitting rules."""
    rules = spark.createDataFrame(FIELD_RULES, "idx int, server string, tool string, fields map<string,string>")
    calls = table(spark, sf_dir, "events").select("event_id", dealt(S.SERVERS, F.col("event_id")).alias("server"), F.col("event_type").alias("tool"), "props")
    actions = gates.field_rules(rules, F.col("server"), F.col("tool"))
    return calls.select("event_id", gates.apply_fields(F.col("props"), actions).alias("payload"))


def parsed_lines(spark, sf_dir):
    """Whole documents as ignore files."""
    rows = audit.parse_ignore_files(documents(spark, sf_dir).select(F.col("doc_id").alias("file"), F.col("text").alias("contents")))
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.max("n").alias("last"), F.sum(F.length("line")).alias("chars"))


def sync_plans(spark, sf_dir):
    """Orders' priorities as the lines that a customer's file should have; finished orders' are there, and so are most files."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    wanted = orders.select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("line"), "o_orderstatus")
    return audit.sync_plan(wanted, wanted.filter("o_orderstatus = 'F'"), customers.filter("c_custkey % 5 != 0").select(F.col("c_custkey").alias("file")))


def picked_pages(spark, sf_dir):
    """Ten pages each as what somebody picked: addresses that end in a slash are directories."""
    path = F.regexp_extract("url", _PATH, 1)
    rows = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).alias("pick"), F.col("page_id").alias("n"), path.alias("path"), path.endswith("/").alias("is_dir"))
    return policy.selection(rows, ("html", "pdf")).select("pick", "kind", F.array_join("paths", "|").alias("paths"))


def resolved_paths(spark, sf_dir):
    """Addresses with detours, resolved."""
    path, host = F.regexp_extract("url", _PATH, 1), F.regexp_extract("url", _HOST, 1)
    detour = F.concat(F.lit("/x/./"), path, F.lit("/q/.././/"), host, F.lit("\\z\\..//y"))
    relative = F.element_at(F.array(path, F.concat(F.lit("../"), path), F.concat(host, F.lit("..")), F.concat(path, F.lit("/..")), F.concat(F.lit("~"), path)), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", paths.resolve_path(detour).alias("path"), paths.is_safe_relative(relative).alias("safe"))


def mentioned_paths(spark, sf_dir):
    """Paths that whole documents name with @."""
    rows = documents(spark, sf_dir).select("doc_id", text.path_mentions(F.col("text")).alias("m"))
    return rows.filter(F.size("m") > 0).select("doc_id", F.size("m").alias("n"), F.sha2(F.array_join("m", "\n"), 256).alias("named"))


def server_inventory(spark, sf_dir):
    """Suppliers as configurations of two servers each."""
    key = F.col("s_suppkey")
    args = F.array(F.lit("--token"), key.cast("string"), F.concat(F.lit("--api-key="), "s_name"), F.lit("-v"))
    one = F.struct(F.when(key % 3 == 0, F.lit("web-exec")).otherwise(F.concat(F.lit("db-"), key.cast("string"))).alias("key"), F.struct(F.col("s_name").alias("command"), args.alias("args"), F.lit(None).cast("string").alias("url")).alias("value"))
    other = F.struct(F.lit("Shell-1").alias("key"), F.struct(F.lit(None).cast("string").alias("command"), F.lit(None).cast("array<string>").alias("args"), F.concat(F.lit("https://u:"), "s_name", F.lit("@h/x")).alias("url")).alias("value"))
    rows = table(spark, sf_dir, "supplier").select(key.alias("source"), F.to_json(F.struct(F.map_from_entries(F.array(one, other)).alias("mcpServers"))).alias("payload"))
    return gates.server_inventory(rows).select("source", "name", "command", F.array_join("args", " ").alias("args"), "high_risk")


def ignore_sections(spark, sf_dir):
    """Events as settings files of four forms that name their type as a tool."""
    kind, e = F.upper("event_type"), F.col("event_id")
    forms = [
        F.concat(F.lit("a: 1\nignore:\n  commit: true\n  tools: ["), kind, F.lit(", 'Two', two]\n")),
        F.concat(F.lit("ignore:\n  tools:\n    - "), kind, F.lit(" # own\n    - \"b\"\n  commit: no\nother:\n  commit: true\n")),
        F.concat(F.lit("ignore:\n  commit: 'TRUE'\r\n# tools: [x]\n  extra: "), kind),
        F.concat(F.lit("other:\n  tools: ["), kind, F.lit("]\n")),
    ]
    found = policy.ignore_settings(F.element_at(F.array(*forms), (e % 4 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", found.alias("s")).select("event_id", "s.commit", F.array_join("s.tools", "|").alias("tools"))


def config_values(spark, sf_dir):
    """Events as settings trees whose value is a string, a list with a number in it, a boolean, or the event's own payload."""
    e, kind = F.col("event_id"), F.col("event_type")
    value = (
        F.when(e % 4 == 0, F.to_json(F.array(kind)).substr(F.lit(2), F.length(kind) + 2))
        .when(e % 4 == 1, F.concat(F.lit('["'), kind, F.lit('", 7, "x"]'))).when(e % 4 == 2, F.when(F.col("value") > 10, "true").otherwise("false")).otherwise(F.col("props"))
    )
    tree = F.concat(F.lit('{"a":{"b":'), value, F.lit("}}"))
    string, strings, flag = policy.config_lookup(tree, "a", "b")
    return table(spark, sf_dir, "events").select("event_id", string.alias("as_string"), F.array_join(strings, "|").alias("as_list"), flag.alias("as_flag"))


def _jobs(spark, sf_dir):
    """Events as jobs of their user's repository; now is the end of the day with the last of them."""
    e = table(spark, sf_dir, "events")
    status = dealt(["queued", "completed", "failed", "completed", "running"], F.col("event_id"))
    jobs = e.select(F.concat(F.lit("j"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("job_id"), F.col("user_id").alias("repo_url"), status.alias("status"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.col("event_id") % 30)).alias("updated_at"))
    now = e.agg(F.date_trunc("day", F.max("ts").cast("timestamp")).alias("now")).first()["now"]
    return jobs, F.lit(now)


def joinable_jobs(spark, sf_dir):
    jobs, now = _jobs(spark, sf_dir)
    return stream.reusable_jobs(jobs, now, reuse=43_200, keep=172_800)


def waiting_jobs(spark, sf_dir):
    """Waiting jobs, and failed ones after a restart."""
    jobs, now = _jobs(spark, sf_dir)
    failed = stream.recover_jobs(jobs).agg(F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))
    return stream.pending_jobs(jobs, now, keep=172_800).crossJoin(failed)  # one row each


def word_windows(spark, sf_dir):
    """Words of whole documents in windows of 128 with 32 in common, and marks around them."""
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("words"))
    rows = rows.select("doc_id", F.transform("words", lambda w: F.length(w)).alias("words"))
    return entities.token_windows(rows, "doc_id", "words", 130, 32, -1, -2).select("doc_id", "n", "start", F.size("tokens").alias("size"), F.sha2(F.array_join("tokens", ","), 256).alias("tokens"))


_QUERIES = [
    artifact_ledger, site_exposures, walked_files, document_responses, document_searches, payload_fields, parsed_lines, sync_plans, picked_pages, resolved_paths,
    mentioned_paths, server_inventory, ignore_sections, config_values, joinable_jobs, waiting_jobs, word_windows,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_LEDGER = """
    WITH RECURSIVE p AS (SELECT row_number() OVER () - 1 AS k, path, kind FROM (VALUES {paths}) v(path, kind)),
    f AS (SELECT doc_id, path, CASE WHEN strlen(text) <= 2097152 THEN sha256(text) END AS content FROM documents JOIN p ON k = doc_id % {n}),
    e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
            '{{"adapter":"editor","artifactKind":"' || kind || '","contentHash":' || coalesce('"' || content || '"', 'null') || ',"outcome":"changed","pathHash":"' || sha256('/w/u' || user_id || '/' || p.path) || '","previousHash":' AS head,
            ',"relativePath":"' || p.path || '","repositoryID":"' || sha256('/w/u' || user_id) || '","timestamp":"' || floor(epoch(ts))::BIGINT || '","toolName":"edit"}}' AS tail
        FROM events JOIN p ON k = event_id % {n} LEFT JOIN f ON f.doc_id = user_id AND f.path = p.path WHERE kind IS NOT NULL),
    r(u, n, hash) AS (SELECT u, n, sha256(head || 'null' || tail) FROM e WHERE n = 1
        UNION ALL SELECT e.u, e.n, sha256(e.head || '"' || r.hash || '"' || e.tail) FROM r JOIN e ON e.u = r.u AND e.n = r.n + 1)
    SELECT u AS ledger, count(*) AS n, arg_max(hash, n) AS head FROM r GROUP BY u"""


def oracle_sql() -> dict[str, str]:
    n = len(S.PATHS)
    docs = f"docs AS (SELECT doc_id, coalesce(text, '') || chr(10) || {oracle.dealt(S.FINDINGS, 'doc_id')} AS text FROM documents)"
    counted = "counted AS (SELECT d.doc_id, count(f.doc_id)::INT AS n FROM docs d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id)"
    host, path = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)", "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"
    site = f"""p AS (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {oracle.values([(p[0], p[1], p[2]) for p in S.PATHS])}) v(sample, pattern, allowlisted)),
        s AS (SELECT {host} AS host, {host} || '/' || rtrim({path}, '/') || '/' || sample AS path, pattern, allowlisted FROM pages JOIN p ON k = page_id % {n})"""
    server = f"{oracle.listed(S.SERVERS)}[event_id % {len(S.SERVERS)} + 1]"
    jobs = """j AS (SELECT 'j' || lpad(event_id::VARCHAR, 12, '0') AS job_id, user_id AS repo_url, ['queued', 'completed', 'failed', 'completed', 'running'][event_id % 5 + 1] AS status, ts AS created, ts + to_hours((event_id % 30)::INT) AS updated,
        (SELECT date_trunc('day', max(ts)) FROM events) AS now FROM events)"""
    first = "CASE WHEN s_suppkey % 3 = 0 THEN 'web-exec' ELSE 'db-' || s_suppkey END"
    return {
        "artifact_ledger": _LEDGER.format(paths=oracle.values([(p[0], p[7]) for p in S.PATHS]), n=n),
        "site_exposures": f"WITH {site} SELECT host, pattern, count(DISTINCT path) AS n FROM s WHERE pattern IS NOT NULL AND NOT allowlisted GROUP BY ALL",
        "walked_files": f"WITH {site}, seen AS (SELECT DISTINCT path FROM s WHERE NOT list_has_any(string_split(path, '/')[:-2], {oracle.listed(path_tables.SKIPPED_DIRECTORIES)})) SELECT path, (SELECT count(*) FROM seen) <= 100000 AS complete FROM seen ORDER BY path LIMIT 100000",
        "document_responses": f"{oracle.found(docs)}, {counted} SELECT doc_id, CASE WHEN n > 0 THEN 'warn' ELSE 'pass' END AS action, n AS n_findings FROM counted",
        "document_searches": f"""{oracle.found(docs)}, {counted}, sized AS (SELECT doc_id, n, strlen(text) > 2097152 AS large FROM counted JOIN docs USING (doc_id))
            SELECT event_id, CASE WHEN coalesce(n, 0) > 0 AND NOT large THEN 'deny' ELSE 'allow' END AS decision, CASE WHEN NOT coalesce(large, false) THEN coalesce(n, 0)::BIGINT END AS n_findings FROM events LEFT JOIN sized ON doc_id = event_id // 10""",
        "payload_fields": f"""SELECT event_id, CASE WHEN props IS NULL THEN NULL WHEN s = 'postgres' OR (s = 'files' AND event_type = 'view') THEN '{{"k":"***"}}' WHEN event_type = 'click' THEN '{{}}' ELSE replace(props, ' ', '') END AS payload
            FROM (SELECT *, {server} AS s FROM events)""",
        "parsed_lines": f"WITH {docs}, l AS (SELECT doc_id AS file, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS k FROM (SELECT doc_id, list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x)) AS lines FROM docs)) SELECT file, count(*) AS n, max(k)::INT AS last, sum(length(line))::BIGINT AS chars FROM l WHERE line != '' AND NOT starts_with(line, '#') GROUP BY file",
        "sync_plans": """WITH w AS (SELECT o_custkey AS file, trim(o_orderpriority) AS line, bool_or(o_orderstatus = 'F') AS there FROM orders GROUP BY ALL), c AS (SELECT file, count(*) FILTER (NOT there) AS lacking FROM w GROUP BY file)
            SELECT file, CASE WHEN c_custkey IS NULL THEN 'create' WHEN lacking > 0 THEN 'update' ELSE 'unchanged' END AS plan, lacking FROM c LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 != 0) ON c_custkey = file""",
        "picked_pages": f"""WITH p AS (SELECT page_id // 10 AS pick, min(page_id) AS n, {path} AS path FROM pages WHERE ends_with({path}, '/') OR regexp_matches({path}, '\\.(html|pdf)$') GROUP BY ALL)
            SELECT pick, CASE WHEN bool_or(ends_with(path, '/')) THEN 'directory' ELSE 'documents' END AS kind, CASE WHEN bool_or(ends_with(path, '/')) THEN arg_min(path, n) FILTER (ends_with(path, '/')) ELSE string_agg(path, '|' ORDER BY n) END AS paths FROM p GROUP BY pick""",
        "resolved_paths": f"SELECT page_id, '/x/' || CASE WHEN {path} = '' THEN '' ELSE rtrim({path}, '/') || '/' END || {host} || '/y' AS path, CASE page_id % 5 WHEN 0 THEN {path} != '' ELSE page_id % 5 = 2 END AS safe FROM pages",
        "mentioned_paths": f"WITH {docs}, m AS (SELECT doc_id, list_filter(regexp_extract_all(text, '@([^\\s,;)\\]]+)', 1), lambda x: regexp_matches(x, '[/.]')) AS m FROM docs) SELECT doc_id, len(m)::INT AS n, sha256(array_to_string(m, chr(10))) AS named FROM m WHERE len(m) > 0",
        "server_inventory": f"SELECT s_suppkey AS source, {first} AS name, s_name AS command, '--token *** --api-key=*** -v' AS args, s_suppkey % 3 = 0 AS high_risk FROM supplier UNION ALL SELECT s_suppkey, 'Shell-1', 'https://***@h/x', '', true FROM supplier",
        "ignore_sections": "SELECT event_id, event_id % 4 IN (0, 2) AS commit, [lower(event_type) || '|two', lower(event_type) || '|b', NULL, NULL][event_id % 4 + 1] AS tools FROM events",
        "config_values": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type END AS as_string, CASE WHEN event_id % 4 = 1 THEN event_type || '|x' ELSE '' END AS as_list, CASE WHEN event_id % 4 = 2 THEN coalesce(value > 10, false) END AS as_flag FROM events""",
        "joinable_jobs": f"WITH {jobs} SELECT repo_url, arg_max(job_id, (created, job_id)) AS job_id FROM j WHERE updated >= now - INTERVAL 2 DAY AND (status IN ('queued', 'running') OR (status = 'completed' AND created >= now - INTERVAL 12 HOUR)) GROUP BY repo_url",
        "waiting_jobs": f"WITH {jobs} SELECT count(*) FILTER (status IN ('queued', 'running') AND updated >= now - INTERVAL 2 DAY) AS pending, count(*) FILTER (status != 'completed') AS failed FROM j",
        "word_windows": """WITH d AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)) AS w FROM documents), s AS (SELECT *, unnest(range(0, greatest(len(w) - 32, 1), 96)) AS start FROM d)
            SELECT doc_id, (start // 96)::INT AS n, start::INT AS start, (2 + len(w[start + 1:start + 128]))::INT AS size, sha256('-1,' || coalesce(nullif(array_to_string(w[start + 1:start + 128], ','), '') || ',', '') || '-2') AS tokens FROM s""",
    }
