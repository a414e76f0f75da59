"""Queries on audits of changes, ignore rules as data, gates that read files, restored texts and regions, with the DuckDB SQL written for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.functions.path_tables import privacy_rules
from veilmark.functions.template_tables import TEMPLATES
from veilmark.operators import audit, file_gates, gates, ignore_rules, regions, restores, sql_functions, templates, windows
from veilmark.plans import oracle
from veilmark.plans import samples as S
from veilmark.plans.registry import dealt, documents
from veilmark.session import spread, table
from veilmark.sources import logs
from veilmark.streaming import ordered


def event_audits(spark, sf_dir):
    """Events of a user as changes below a root: errors are immediate."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), "ts", F.col("props").alias("path"), (F.col("event_type") == "error").alias("immediate"))
    return ordered.audits(rows, quiet=3600, spacing=28_800).select("root", "fired_at", "n", "immediate", F.array_join("paths", "|").alias("paths"))


def repository_ignores(spark, sf_dir):
    """Pages as files of their hosts' repositories; each page adds a line to one of three ignore files of its host."""
    path, host = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("repo"), path.alias("path"))
    p, name = F.col("path"), F.regexp_extract("path", "([^/]+)/?$", 1)
    forms = [F.concat(F.lit("/"), p), name, F.concat(F.lit("!/"), p), F.concat(F.lit("*"), F.right(name, F.lit(1))), F.concat(F.left(p, F.lit(2)), F.lit("/*5*")), F.lit("**/1*"), F.lit("!*7"), F.concat(F.lit("# "), p)]
    line = F.element_at(F.array(*forms), (F.col("page_id") % 8 + 1).cast("int"))
    lines = rows.select("repo", F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string")).alias("file"), line.alias("line"))
    return ignore_rules.with_ignored(rows, lines).select("page_id", "ignored", "n_files")


def _files(spark, sf_dir):
    return documents(spark, sf_dir).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


def _document():
    """The path of the document that an event names: every document is named by ten events."""
    return F.concat(F.lit("d/"), F.floor(F.col("event_id") / 10).cast("string"), F.lit(".txt"))


def prompt_files(spark, sf_dir):
    """Events as prompts that mention one document and attach another, which those of a user share."""
    prompt = F.concat(dealt(S.FINDINGS, F.col("event_id")), F.lit(" @"), _document())
    attachments = F.array(F.struct(F.concat(F.lit("d/"), F.col("user_id").cast("string"), F.lit(".txt")).alias("file_path")))
    events = spread(table(spark, sf_dir, "events")).select("event_id", F.to_json(F.struct(prompt.alias("prompt"), attachments.alias("attachments"))).alias("payload"))
    return file_gates.prompt_gate(events, _files(spark, sf_dir), "soft").select("event_id", "decision", "n_findings", "n_files")


def read_files(spark, sf_dir):
    """Events as reads: of a document, of a labelled path, and of a note whose content comes with the event."""
    event = F.col("event_id")
    path = F.when(event % 4 < 2, _document()).when(event % 4 == 2, dealt([p[0] for p in S.PATHS], event)).otherwise("notes.txt")
    content = F.when(event % 4 == 3, dealt(S.FINDINGS, event))
    events = spread(table(spark, sf_dir, "events")).select("event_id", F.to_json(F.struct(path.alias("file_path"), content.alias("content"))).alias("payload"))
    return file_gates.read_gate(events, _files(spark, sf_dir)).select("event_id", "decision", "reason", "n_findings")


#: name, allow list, deny list of servers.
POLICIES = [("open", (), ()), ("allow-only", ("Postgres", "files"), ()), ("deny-only", (), ("shell",)), ("deny-all", (), ("*",)), ("allowlist", ("files",), ("*", "postgres")), ("both", ("files", "shell"), ("shell",)), ("any", ("*",), ("files",))]


def server_policies(spark, sf_dir):
    """Every event as a call of a server, under each policy."""
    calls = table(spark, sf_dir, "events").select("event_id", dealt([*S.SERVERS, ""], F.col("event_id")).alias("server"))
    rows = F.array(*[F.struct(F.lit(name).alias("policy"), gates.server_refused(F.col("server"), allow, deny).alias("refused")) for name, allow, deny in POLICIES])
    return calls.select("event_id", F.inline(rows)).filter("refused").groupBy("policy").agg(F.count("*").alias("n"), F.sum("event_id").alias("events"))


def restored_as_of(spark, sf_dir):
    """A seventh of the events as mappings of addresses and names, with or without an end; the others as masked texts."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    event = F.col("event_id")

    def pairs(kind: str, value: str, n):
        numbers = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda k: k > 0)
        return F.transform(numbers, lambda k: F.struct(F.concat(F.lit("{{" + kind + "_"), k.cast("string"), F.lit("}}")).alias("key"), F.concat(F.lit(value), event.cast("string"), F.lit("-"), k.cast("string")).alias("value")))

    mapping = F.map_from_entries(F.concat(pairs("EMAIL", "e", event % 5 + 1), pairs("PERSON", "p", event % 3)))
    ends = F.when(event % 21 != 0, F.timestamp_add("HOUR", (1 + event % 40).cast("int"), F.col("ts")))
    mappings = e.filter(event % 7 == 0).select(event.cast("string").alias("mapping_id"), F.col("ts").alias("created_at"), ends.alias("expires_at"), mapping.alias("mapping"))
    person = F.when(event % 4 > 0, F.concat(F.lit(" from {{PERSON_"), (event % 4).cast("string"), F.lit("}}"))).otherwise("")
    texts = e.filter(event % 7 != 0).select("event_id", "ts", F.concat(F.lit("to {{EMAIL_"), (event % 6 + 1).cast("string"), F.lit("}}"), person).alias("text"))
    return restores.restore_as_of(texts, mappings, bucket_seconds=86_400).select("event_id", "text", F.coalesce("mapping_id", F.lit("")).alias("mapping_id"))


def _wanted(spark, sf_dir):
    """Values looked for in every page: a word of its host, an article, an accent, and one that stands nowhere."""
    host = F.upper(F.regexp_extract("url", r"^[a-z]+://(?:[a-z]+\.)?([a-z]+)\.", 1))
    values = F.array(*[F.struct(F.lit(i).alias("value_id"), v.alias("value")) for i, v in ((1, host), (2, F.lit("THE")), (3, F.lit("é")), (4, F.lit("the")), (5, F.lit("#nowhere#")))])
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page"), F.col("html").alias("text")), pages.select(F.col("page_id").alias("doc_id"), F.inline(values))


def value_regions(spark, sf_dir):
    found = regions.find_regions(*_wanted(spark, sf_dir))
    return found.groupBy("doc_id", "value_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def redaction_plan(spark, sf_dir):
    return regions.redaction_plan(*_wanted(spark, sf_dir)).select("doc_id", "value_id", "n_regions", "resolved")


def windowed_findings(spark, sf_dir):
    """The whole scan by windows of 2000 characters: what the scan in one piece finds."""
    found = windows.window_scan(documents(spark, sf_dir), window=2000, overlap=600)
    return found.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "entity_type", F.sha2("value", 256).alias("value"))


def updated_index(spark, sf_dir):
    """Every second customer's settings file is indexed; orders change them, finished ones remove them."""
    file_of = lambda c: F.concat(F.lit("c/"), F.col(c).cast("string"), F.lit("/.env")).alias("path")
    index = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(file_of("c_custkey"))
    changes = table(spark, sf_dir, "orders").filter("o_orderdate is not null").select(file_of("o_custkey"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").alias("removed"))
    return audit.update_index(index, changes, {}).select("path", "pattern")


def log_files(spark, sf_dir):
    """Events as the log of their user, in files of little over 100 bytes."""
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("seq"), F.col("props").alias("line"))
    return logs.rotated(entries, most=100).groupBy("log", "file_no").agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.min("seq").alias("first"))


def sql_findings(spark, sf_dir):
    """The scan from SQL, by the function that gives an array."""
    sql_functions.register(spark)
    documents(spark, sf_dir).createOrReplaceTempView("scanned_documents")
    return spark.sql("SELECT entity_type, source, count(*) AS n, sum(s.`start`) AS starts FROM (SELECT find_spans(text) AS found FROM scanned_documents) d, LATERAL inline_outer(found) s WHERE s.`start` IS NOT NULL GROUP BY ALL")


def sql_table_findings(spark, sf_dir):
    """The same by the table function, of conversations: users' and others' turns."""
    sql_functions.register(spark)
    turns = spread(table(spark, sf_dir, "conversations")).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), dealt(S.FINDINGS, F.col("conv_id") + F.col("turn"))))
    turns.createOrReplaceTempView("scanned_turns")
    return spark.sql("SELECT conv_id, turn, count(*) AS n FROM scanned_turns c, LATERAL detect_spans(c.text) s GROUP BY ALL")


#: What repositories ask for, and what that means. By hand.
CHOICES = [("node,swift", ["common", "node", "swift"]), ("JS, python", ["common", "node", "python"]), ("", ["common"]), ("ios,common,ts,cobol", ["common", "swift", "node"]), ("rust,java,Android", ["common", "rust", "java", "android"]), ("tuist,go,ruby", ["common", "tuist", "go", "ruby"])]
_OWN = ["*.lock", "own/**", "**/venv/**", "*.jar", "own/**"]


def merged_excludes(spark, sf_dir):
    """Suppliers as repositories that ask for templates; parts add to their own lists."""
    suppliers, parts = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    asked = suppliers.select(F.col("s_suppkey").alias("repo"), F.lit(0).alias("n"), dealt([c[0] for c in CHOICES], F.col("s_suppkey")).alias("raw"))
    own = parts.select((F.col("p_partkey") % 97).alias("repo"), F.col("p_partkey").alias("n"), dealt(_OWN, F.col("p_partkey")).alias("pattern"))
    return templates.merge_excludes(own, templates.template_patterns(asked))


def root_scores(spark, sf_dir):
    """Customers as roots of six kinds, from spotless to bare; one kind has as many settings files more as its nation says."""
    asked = [r[3][0] for r in privacy_rules() if r[2] in ("required", "recommended")]
    kinds = [asked, [*asked, "var/app.log"], [*asked, "infra/prod.tfstate"], [*(p for p in asked if p != ".zedignore"), "ops/master.key"], ["src/main.rs", *(f"a{i}/.env" for i in range(6))], [".cursorignore"]]
    files = F.element_at(F.array(*[F.array(*map(F.lit, k)) for k in kinds]), (F.col("c_custkey") % 6 + 1).cast("int"))
    more = F.when((F.col("c_custkey") % 6 == 3) & (F.col("c_nationkey") % 4 > 0), F.transform(F.sequence(F.lit(1), F.col("c_nationkey") % 4), lambda i: F.concat(F.lit("n"), i.cast("string"), F.lit("/.env"))))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).select(F.col("c_custkey").alias("root"), F.explode(F.concat(files, F.coalesce(more, F.array().cast("array<string>")))).alias("path"))
    return audit.audit_roots(rows, {}).select("root", "n_exposed", "score", "status")


_QUERIES = [event_audits, repository_ignores, prompt_files, read_files, server_policies, restored_as_of, value_regions, redaction_plan, windowed_findings, updated_index, log_files, sql_findings, sql_table_findings, merged_excludes, root_scores]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_AUDITS = """
    WITH RECURSIVE e AS (SELECT user_id AS root, ts AS t, props AS path, event_type = 'error' AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f(root, n, path, last, quiet, burst, paths, now, fired, fired_n, fired_paths, fired_now) AS (
        SELECT root, n, path, NULL::TIMESTAMP, t + INTERVAL 1 HOUR, 1, [path], now, NULL::TIMESTAMP, 0, NULL::VARCHAR[], false FROM e WHERE n = 1
        UNION ALL SELECT root, n, path, CASE WHEN fires THEN due ELSE last END, t + INTERVAL 1 HOUR, CASE WHEN fires THEN 1 ELSE burst + 1 END, CASE WHEN fires THEN [path] ELSE list_append(paths, path) END,
            CASE WHEN fires THEN now ELSE now OR was_now END, CASE WHEN fires THEN due END, burst, paths, was_now
        FROM (SELECT e.*, f.last, f.burst, f.paths, f.now AS was_now, CASE WHEN f.now OR f.last IS NULL THEN f.quiet ELSE greatest(f.quiet, f.last + INTERVAL 8 HOUR) END AS due, due <= t AS fires
              FROM f JOIN e ON e.root = f.root AND e.n = f.n + 1)),
    done AS (
        SELECT root, fired AS fired_at, fired_n AS n, fired_now AS immediate, fired_paths AS paths FROM f WHERE fired IS NOT NULL
        UNION ALL SELECT root, CASE WHEN now OR last IS NULL THEN quiet ELSE greatest(quiet, last + INTERVAL 8 HOUR) END, burst, now, paths FROM f QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC) = 1)
    SELECT root, fired_at, n::BIGINT AS n, immediate, array_to_string(list_sort(list_distinct(paths)), '|') AS paths FROM done"""


_IGNORES = r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS repo, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages),
    l AS (SELECT DISTINCT repo, page_id % 3 AS file, page_id % 8 AS form, path AS line, regexp_extract(path, '([^/]+)/?$', 1) AS name FROM p),
    hits AS (
        SELECT p.page_id, file, form IN (2, 6) AS negated FROM p JOIN l USING (repo) WHERE CASE form
            WHEN 0 THEN path = rtrim(line, '/') OR starts_with(path, rtrim(line, '/') || '/')
            WHEN 1 THEN list_contains(string_split(path, '/'), name)
            WHEN 2 THEN path = rtrim(line, '/') OR starts_with(path, rtrim(line, '/') || '/')
            WHEN 3 THEN len(list_filter(string_split(path, '/'), lambda s: s != '' AND ends_with(s, right(name, 1)))) > 0
            WHEN 4 THEN starts_with(path, left(line, 2) || '/') AND regexp_full_match(substr(path, 4), '[^/]*5[^/]*')
            WHEN 5 THEN regexp_full_match(path, '(.*/)?1[^/]*')
            WHEN 6 THEN len(list_filter(string_split(path, '/'), lambda s: ends_with(s, '7'))) > 0
            ELSE false END),
    files AS (SELECT page_id, file FROM hits GROUP BY ALL HAVING bool_or(NOT negated) AND NOT bool_or(negated))
    SELECT page_id, count(file) > 0 AS ignored, count(file) AS n_files FROM p LEFT JOIN files USING (page_id) GROUP BY page_id"""


_RESTORED = """
    WITH m AS (SELECT event_id AS id, event_id % 5 + 1 AS emails, event_id % 3 AS persons, ts AS created, CASE WHEN event_id % 21 != 0 THEN ts + to_hours((1 + event_id % 40)::INT) END AS ends FROM events WHERE event_id % 7 = 0),
    t AS (SELECT event_id, ts, event_id % 6 + 1 AS i, event_id % 4 AS j FROM events WHERE event_id % 7 != 0),
    best AS (SELECT event_id, arg_max(id, (created, id::VARCHAR)) AS id FROM t JOIN m ON emails >= i AND persons >= j AND created <= ts AND (ends IS NULL OR ts < ends) GROUP BY event_id)
    SELECT event_id, 'to ' || coalesce('e' || id || '-' || i, '{{EMAIL_' || i || '}}') || CASE WHEN j > 0 THEN ' from ' || coalesce('p' || id || '-' || j, '{{PERSON_' || j || '}}') ELSE '' END AS text,
        coalesce(id::VARCHAR, '') AS mapping_id FROM t LEFT JOIN best USING (event_id)"""

_PLACES = r"""
    WITH v AS (SELECT page_id AS doc_id, strip_accents(lower(html)) AS low, unnest([1, 2, 3, 5]) AS value_id, unnest([regexp_extract(url, '^[a-z]+://(?:[a-z]+\.)?([a-z]+)\.', 1), 'the', 'e', '#nowhere#']) AS value FROM pages),
    p AS (SELECT doc_id, value_id, value, string_split(low, value) AS parts FROM v WHERE contains(low, value) AND value != ''),
    s AS (SELECT doc_id, value_id, length(value) AS width, unnest(range(1, len(parts))) AS k, unnest(list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x))))) AS before FROM p),
    places AS (SELECT doc_id, value_id, (before + (k - 1) * width)::BIGINT AS start, (before + k * width)::BIGINT AS stop FROM s)"""


def oracle_sql() -> dict[str, str]:
    files = f"SELECT 'd/' || doc_id || '.txt' AS doc_id, coalesce(text, '') || chr(10) || {oracle.dealt(S.FINDINGS, 'doc_id')} AS text FROM documents"
    sample, mention = oracle.dealt(S.FINDINGS, "event_id"), "'d/' || (event_id // 10) || '.txt'"
    prompts = oracle.found(f"docs AS ({files} UNION ALL SELECT 'e' || event_id, {sample} || ' @' || {mention} FROM events)")
    reads = oracle.found(f"docs AS ({files} UNION ALL SELECT 'e' || event_id, {sample} FROM events WHERE event_id % 4 = 3)")
    turns = oracle.found(f"docs AS (SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') || chr(10) || {oracle.dealt(S.FINDINGS, '(conv_id + turn)')} AS text FROM conversations)")
    suspicious = oracle.listed([p[6] for p in S.PATHS])
    refused = {"open": "false", "allow-only": "s NOT IN ('postgres', 'files')", "deny-only": "s = 'shell'", "deny-all": "true", "allowlist": "s != 'files'", "both": "s NOT IN ('files')", "any": "s = 'files'"}
    servers = " UNION ALL ".join(f"SELECT '{name}' AS policy, event_id FROM e WHERE s != '' AND {test}" for name, test in refused.items())
    return {
        "event_audits": _AUDITS,
        "repository_ignores": _IGNORES,
        "prompt_files": f"""{prompts}, counted AS (SELECT d.doc_id, count(f.doc_id) AS n FROM docs d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id),
            readable AS (SELECT doc_id, n FROM docs JOIN counted USING (doc_id) WHERE strlen(text) <= 65536),
            named AS (SELECT event_id, {mention} AS path FROM events UNION ALL SELECT event_id, 'd/' || user_id || '.txt' FROM events),
            inside AS (SELECT event_id, count(*) AS n_files, sum(n) AS n FROM named JOIN readable ON doc_id = path GROUP BY event_id)
            SELECT e.event_id, CASE WHEN c.n + coalesce(i.n, 0) > 0 THEN 'deny' ELSE 'allow' END AS decision, (c.n + coalesce(i.n, 0))::BIGINT AS n_findings, coalesce(n_files, 0) AS n_files
            FROM events e JOIN counted c ON c.doc_id = 'e' || e.event_id LEFT JOIN inside i ON i.event_id = e.event_id""",
        "read_files": f"""{reads}, counted AS (SELECT doc_id, count(*) FILTER (list_contains({oracle.CRITICAL}, entity_type)) AS n FROM found GROUP BY doc_id)
            SELECT e.event_id, CASE WHEN reason = '' THEN 'allow' ELSE 'deny' END AS decision, reason, n_findings FROM (
                SELECT e.event_id, coalesce(n, 0) AS n_findings, CASE WHEN event_id % 4 = 2 AND {suspicious}[event_id % {len(S.PATHS)} + 1] THEN 'path' WHEN coalesce(n, 0) > 0 THEN 'findings' ELSE '' END AS reason
                FROM events e LEFT JOIN counted c ON c.doc_id = CASE WHEN event_id % 4 < 2 THEN {mention} WHEN event_id % 4 = 3 THEN 'e' || event_id END) e""",
        "restored_as_of": _RESTORED,
        "root_scores": """SELECT c_custkey AS root, [0, 1, 1, 1 + c_nationkey % 4, 6, 0][c_custkey % 6 + 1]::BIGINT AS n_exposed, [100, 96, 90, greatest(0, 72 - 25 * (c_nationkey % 4)), 0, 64][c_custkey % 6 + 1]::BIGINT AS score,
            ['pass', 'pass', 'warning', 'fail', 'fail', 'warning'][c_custkey % 6 + 1] AS status FROM customer""",
        "merged_excludes": f"""WITH t(choice, place, k, pattern) AS (VALUES {oracle.values([(c, i, k, p) for c, (_, names) in enumerate(CHOICES) for i, t in enumerate(names) for k, p in enumerate(TEMPLATES[t])])}),
            own AS (SELECT p_partkey % 97 AS repo, p_partkey AS n, {oracle.dealt(_OWN, 'p_partkey')} AS pattern FROM part),
            more AS (SELECT s_suppkey AS repo, pattern, min(place * 1000 + k) AS n FROM supplier JOIN t ON choice = s_suppkey % {len(CHOICES)} GROUP BY ALL),
            every AS (SELECT repo, 0 AS later, n, pattern FROM own UNION ALL SELECT repo, 1, n, pattern FROM more m WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.repo = m.repo AND o.pattern = m.pattern))
            SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY later, n)::INT AS n, pattern, later = 1 AS added FROM every""",
        "sql_findings": f"{oracle.found()} SELECT entity_type, kind AS source, count(*) AS n, sum(start)::BIGINT AS starts FROM found GROUP BY ALL",
        "sql_table_findings": f"{turns} SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, count(*) AS n FROM found GROUP BY ALL",
        "windowed_findings": f"{oracle.found()} SELECT doc_id, start AS span_start, \"end\" AS span_end, entity_type, sha256(value) AS value FROM found",
        "updated_index": """WITH c AS (SELECT o_custkey AS k, max(o_orderdate) AS ts FROM orders GROUP BY 1), l AS (SELECT k, bool_or(o_orderstatus = 'F') AS removed FROM c JOIN orders ON o_custkey = k AND o_orderdate = ts GROUP BY k)
            SELECT 'c/' || k || '/.env' AS path, 'env-files' AS pattern FROM (SELECT k FROM l WHERE NOT removed UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT k FROM l))""",
        "log_files": """WITH RECURSIVE e AS (SELECT user_id AS log, event_id AS seq, strlen(coalesce(props, '')) + 1 AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
            f(log, n, seq, b, file_no, size) AS (SELECT log, n, seq, b, 0, b FROM e WHERE n = 1
                UNION ALL SELECT e.log, e.n, e.seq, e.b, CASE WHEN f.size > 100 THEN f.file_no + 1 ELSE f.file_no END, CASE WHEN f.size > 100 THEN e.b ELSE f.size + e.b END FROM f JOIN e ON e.log = f.log AND e.n = f.n + 1)
            SELECT log, file_no::BIGINT AS file_no, count(*) AS n, sum(b)::BIGINT AS bytes, min(seq) AS first FROM f GROUP BY log, file_no""",
        "value_regions": f"{_PLACES} SELECT doc_id, value_id, count(*) AS n, sum(start)::BIGINT AS starts, sum(stop)::BIGINT AS ends FROM places GROUP BY ALL",
        "redaction_plan": f"{_PLACES}, n AS (SELECT doc_id, value_id, count(*) AS n FROM places GROUP BY ALL), every AS (SELECT page_id AS doc_id, unnest([1, 2, 3, 4, 5]) AS value_id, unnest([1, 2, 3, 2, 5]) AS as_id FROM pages) SELECT e.doc_id, e.value_id, coalesce(n, 0) AS n_regions, n IS NOT NULL AS resolved FROM every e LEFT JOIN n ON n.doc_id = e.doc_id AND n.value_id = as_id",
        "server_policies": f"WITH e AS (SELECT event_id, {oracle.listed([*S.SERVERS, ''])}[event_id % {len(S.SERVERS) + 1} + 1] AS s FROM events) SELECT policy, count(*) AS n, sum(event_id)::BIGINT AS events FROM ({servers}) GROUP BY policy",
    }
