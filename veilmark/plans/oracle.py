"""DuckDB SQL for the registered queries, written on its own: windows over RE2 matches, and tables labelled by hand."""

from __future__ import annotations

from veilmark.functions.catalog import ENTITY_TYPES, PLACEHOLDER_WORDS, RULES
from veilmark.functions.checks import NO_PHONE
from veilmark.functions.path_tables import SENSITIVE_PATTERNS, privacy_rules
from veilmark.plans import samples as S


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int | float) else "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_DOCS = f"docs AS (SELECT doc_id, source, coalesce(text, '') || chr(10) || {listed(S.FINDINGS)}[doc_id % {len(S.FINDINGS)} + 1] AS text FROM documents)"
_SECRET = listed([t for t, _, s, _, _, _ in ENTITY_TYPES if s])
CRITICAL = listed([t for t, _, _, c, _, _ in ENTITY_TYPES if c])
_TYPES = f"types AS (SELECT * FROM (VALUES {values([(t, p, w, label) for t, p, _, _, w, label in ENTITY_TYPES])}) v(entity_type, prefix, weight, label))"


#: DuckDB's regexes have no look-around. A mark behind every character that is no ASCII letter or digit stands for "no
#: such character before"; the character behind a match is matched too, and its own mark is left for the next match.
_MARK = ""
_PHONE = (
    r"(?:^|M)((?:\+M\d{1,3}(?:(?:[ \t\-.]M)*(?:\(M)?\d{1,4}(?:\)M)?){2,6}|8[ \t\-]M(?:\(M)?\d{3}(?:\)M)?(?:[ \t\-]M\d{2,4}){3}"
    r"|(?:\(M)?\d{2,4}(?:\)M)?[ \t\-.]M\d{2,4}(?:[ \t\-.]M\d{2,4}){1,3}))(?:[^0-9]|$)"
).replace("M", _MARK)


def _raw(rules, name: str, id_col: str, text_col: str) -> str:
    """CTE raw(doc_id, rule_ord, entity_type, source, start, end, value) of matches with their offsets."""
    parts = []
    for ord_, entity, source, pattern in rules:
        p = quote(pattern)
        head = f"SELECT {id_col} AS doc_id, {ord_} AS rule_ord, '{entity}' AS entity_type, '{source}' AS kind, generate_subscripts(m, 1) AS n, "
        if entity == "phone":
            marked = f"regexp_replace({text_col}, '([^A-Za-z0-9])', '\\1{_MARK}', 'g')"
            bare = "replace({}, '" + _MARK + "', '')"
            parts.append(
                head + f"{bare.format('unnest(v)')} AS value, {bare.format('unnest(m)')} AS whole, {bare.format('unnest(g[1:len(m)])')} AS gap "
                f"FROM (SELECT {id_col}, regexp_extract_all(t, {p}, 1) AS v, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM (SELECT {id_col}, {marked} AS t FROM {name}) WHERE regexp_matches(t, {p}))"
            )
        else:
            parts.append(
                head + f"unnest(m) AS value, unnest(m) AS whole, unnest(g[1:len(m)]) AS gap "
                f"FROM (SELECT {id_col}, regexp_extract_all({text_col}, {p}) AS m, string_split_regex({text_col}, {p}) AS g FROM {name} WHERE regexp_matches({text_col}, {p}))"
            )
    matches = " UNION ALL ".join(parts)
    return f"""matches AS ({matches}), raw AS (
        SELECT doc_id, rule_ord, entity_type, kind, value, e - length(whole) AS start, e - length(whole) + length(value) AS "end" FROM (
            SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, rule_ord ORDER BY n) AS e FROM matches))"""


def _rules(types=None) -> list[tuple]:
    instead = {"highEntropyString": r"(?i)[A-Za-z0-9+/=_-]{40,}", "phone": _PHONE}  # maximal runs: the first one's look-around adds nothing
    return [(r.ord, r.type, r.source, instead.get(r.type, r.pattern)) for r in RULES if types is None or r.type in types]


def _resolved(name: str, id_col: str, text_col: str) -> str:
    return f"""weighed AS (SELECT *, CASE WHEN entity_type = 'highEntropyString' THEN 95 WHEN list_contains({_SECRET}, entity_type) THEN 1000 WHEN entity_type = 'creditCardLike' THEN 120
            WHEN entity_type = 'ipAddress' THEN 115 WHEN entity_type = 'phone' THEN 85 WHEN kind = 'customDictionary' THEN 500 ELSE 100 END AS priority FROM raw),
        ordered AS (SELECT *, max("end") OVER w AS reached, row_number() OVER (PARTITION BY doc_id ORDER BY start, priority DESC, rule_ord, "end") AS place FROM weighed
            WINDOW w AS (PARTITION BY doc_id ORDER BY start, priority DESC, rule_ord, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        islands AS (SELECT *, sum(CASE WHEN reached IS NULL OR start >= reached THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM ordered),
        merged AS (SELECT doc_id, min(start) AS start, max("end") AS "end", arg_max(entity_type, priority * 1000000 - place) AS entity_type, arg_max(kind, priority * 1000000 - place) AS kind FROM islands GROUP BY doc_id, island),
        resolved AS (SELECT m.doc_id, m.start::INT AS start, m."end"::INT AS "end", m.entity_type, m.kind, substring(t.{text_col}, m.start::INT + 1, (m."end" - m.start)::INT) AS value FROM merged m JOIN {name} t ON t.{id_col} = m.doc_id)"""


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substring(reverse({d}), i::INT, 1)::INT
    WHEN substring(reverse({d}), i::INT, 1)::INT > 4 THEN substring(reverse({d}), i::INT, 1)::INT * 2 - 9 ELSE substring(reverse({d}), i::INT, 1)::INT * 2 END)) % 10 = 0"""


def _iban(v: str) -> str:
    letters = "list_aggregate(list_transform(string_split(substring({v}, 5) || left({v}, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN (ascii(c) - 55)::VARCHAR ELSE c END), 'string_agg', '')".format(v=v)
    # a long number by parts of nine digits
    return f"length({v}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split({letters}, ''), lambda c: c::BIGINT)), lambda r, d: (r * 10 + d) % 97) = 1"


def _found(name="docs", id_col="doc_id", text_col="text") -> str:
    words = "|".join(PLACEHOLDER_WORDS)
    return f"""found AS (SELECT * FROM resolved WHERE CASE entity_type
            WHEN 'money' THEN NOT regexp_matches(value, '^\\$\\d$')
            WHEN 'phone' THEN NOT regexp_full_match(trim(value), '{NO_PHONE}') AND length({_DIGITS}) BETWEEN 8 AND 15 AND length(value) - length(replace(value, '.', '')) < 3
            WHEN 'jwt' THEN len(string_split(value, '.')) = 3 AND coalesce(list_contains(TRY(json_keys(TRY(decode(from_base64(rpad(translate(split_part(value, '.', 1), '-_', '+/'), ((length(split_part(value, '.', 1)) + 3) // 4 * 4)::INT, '=')))))), 'alg'), false)
            WHEN 'creditCardLike' THEN length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN.format(d=_DIGITS)}
            WHEN 'iban' THEN {_iban("upper(value)")}
            WHEN 'highEntropyString' THEN NOT regexp_matches(value, '^[A-Za-z_][A-Za-z0-9_]*$') AND NOT (contains(value, '/') AND NOT regexp_matches(value, '[+=]')) AND regexp_matches(value, '[0-9+=]')
            ELSE NOT list_contains({_SECRET}, entity_type) OR NOT (regexp_matches(value, '[<>]|\\{{\\{{|\\$\\{{|%\\(|\\*\\*\\*\\*|\\.\\.\\.\\.') OR regexp_matches(lower(value), '{words}')) END)"""


def labelled() -> str:
    """CTE labelled: a path for every document with what was labelled by hand."""
    return f"labelled AS (SELECT doc_id, p.* FROM documents, (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {values(S.PATHS)}) v(path, pattern, allowlisted, ignored, excluded, tier, suspicious, artifact)) p WHERE p.k = doc_id % {len(S.PATHS)})"


def patterns() -> str:
    return f"patterns AS (SELECT * FROM (VALUES {values([(i, s) for i, s, _, _ in SENSITIVE_PATTERNS])}) v(pattern, severity))"


EXPOSED = "exposed AS (SELECT DISTINCT path, pattern FROM labelled WHERE pattern IS NOT NULL AND NOT allowlisted AND NOT ignored)"


def dealt(texts, column: str) -> str:
    return f"({listed(texts)})[{column} % {len(texts)} + 1]"


def found(docs: str = _DOCS, without=()) -> str:
    """WITH ... found: the findings of the texts of a CTE docs(doc_id, text), by all rules but those of some types."""
    rules = [r for r in _rules() if r[1] not in without]
    return f"WITH {docs}, {_TYPES}, {_raw(rules, 'docs', 'doc_id', 'text')}, {_resolved('docs', 'doc_id', 'text')}, {_found()}"


def sql() -> dict[str, str]:
    rules = _rules()
    raw = f"WITH {_DOCS}, {_TYPES}, {_raw(rules, 'docs', 'doc_id', 'text')}"
    resolved = f"{raw}, {_resolved('docs', 'doc_id', 'text')}"
    found = f"{resolved}, {_found()}"
    level = "CASE WHEN critical THEN 3 WHEN s < 20 THEN 0 WHEN s < 50 THEN 1 ELSE 2 END"
    sums = f"""sums AS (SELECT d.doc_id, d.source, coalesce(sum(weight), 0) AS total, coalesce(bool_or(list_contains({CRITICAL}, f.entity_type)), false) AS critical
        FROM docs d LEFT JOIN found f USING (doc_id) LEFT JOIN types t ON t.entity_type = f.entity_type GROUP BY d.doc_id, d.source)"""
    names = "['low', 'medium', 'high', 'critical']", "['allow', 'warn', 'mask', 'block']"
    risk = f"risk AS (SELECT *, ({names[0]})[{level} + 1] AS level, ({names[1]})[{level} + 1] AS action, CASE WHEN critical THEN greatest(total, 100) ELSE s END AS score FROM (SELECT *, least(total, 75) AS s FROM sums))"
    gaps = """pieces AS (SELECT doc_id, start, replacement, "end", coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM named),
        built AS (SELECT p.doc_id, string_agg(substring(d.text, before + 1, start - before) || replacement, '' ORDER BY start) AS head, max("end") AS last FROM pieces p JOIN docs d USING (doc_id) GROUP BY p.doc_id),
        rebuilt AS (SELECT d.doc_id, CASE WHEN head IS NULL THEN text ELSE head || substring(text, last + 1) END AS text FROM docs d LEFT JOIN built USING (doc_id))"""
    masks = """firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY start, "end") AS nth FROM found),
        numbered AS (SELECT f.doc_id, value, '{{' || prefix || '_' || row_number() OVER (PARTITION BY doc_id, prefix ORDER BY start, "end") || '}}' AS replacement FROM firsts f JOIN types USING (entity_type) WHERE nth = 1),
        named AS (SELECT f.doc_id, f.start, f."end", replacement FROM found f JOIN numbered n ON n.doc_id = f.doc_id AND n.value = f.value)"""
    labels, exposed = labelled(), EXPOSED
    pattern_rows = patterns()
    words = [(1000 + i, {"client": "customClient", "company": "customCompany", "sensitiveTerm": "customSensitiveTerm", "internalDomain": "customInternalDomain"}[k], v) for i, (k, v) in enumerate(S.TERMS)]
    terms = [(n, t, "customDictionary", rf"\b{v}\b") for n, t, v in words if t != "customInternalDomain"]
    substrings = [(n, t, "customDictionary", "(?i)" + v.replace(".", r"\.")) for n, t, v in words]
    page_rules = _rules(["email", "ipAddress", "apiKeyGeneric", "creditCardLike"])
    key_rules = _rules(["apiKeyGeneric"])
    tiers = "CASE WHEN tier = 'secretsConfig' THEN total ELSE least(total, 75) END"
    step = "CASE WHEN critical THEN 3 WHEN tier = 'secretsConfig' THEN base + 1 WHEN tier = 'docsOrTests' THEN least(base, 1) ELSE base END"
    servers = f"({listed(S.SERVERS)})[event_id % {len(S.SERVERS)} + 1]"
    tools = f"({listed(S.TOOLS)})[user_id % {len(S.TOOLS)} + 1]"
    snapshot = "SELECT o_orderpriority AS id, count(*) FILTER (o_orderstatus = 'O') > 2 AS satisfied, list(DISTINCT o_custkey) AS paths FROM orders WHERE o_orderkey % 3 != {} GROUP BY 1"
    return {
        "spans_by_rule": f"{raw} SELECT rule_ord, entity_type, count(*) AS n, sum(start)::BIGINT AS starts, sum(length(value))::BIGINT AS chars FROM raw GROUP BY ALL",
        "spans_resolved": f"{resolved} SELECT doc_id, start AS span_start, \"end\" AS span_end, entity_type, value FROM resolved",
        "findings_all": f"{found} SELECT doc_id, start AS span_start, \"end\" AS span_end, entity_type, CASE WHEN length(value) > 48 THEN left(value, 48) || '…' ELSE value END AS preview FROM found",
        "findings_every_type": f"{found} SELECT entity_type, count(*) AS n FROM found GROUP BY 1",
        "text_gate": f"{found}, gated AS (SELECT d.doc_id, CASE WHEN count(f.doc_id) = 0 THEN 'allow' WHEN bool_or(f.kind = 'secret') THEN 'deny' ELSE 'ask' END AS decision FROM docs d LEFT JOIN found f USING (doc_id) GROUP BY 1) SELECT decision, count(*) AS n FROM gated GROUP BY 1",
        "findings_by_type": f"{found} SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM found GROUP BY 1",
        "findings_unique": f"{found} SELECT doc_id, start AS span_start, \"end\" AS span_end, entity_type FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, value ORDER BY start, \"end\") = 1",
        "findings_not_ignored": f"WITH {_DOCS}, {_TYPES}, {_raw(key_rules, 'docs', 'doc_id', 'text')}, {_resolved('docs', 'doc_id', 'text')}, {_found()} SELECT f.doc_id, start AS span_start, \"end\" AS span_end FROM found f JOIN docs d USING (doc_id) WHERE NOT contains(string_split(text, chr(10))[len(string_split(left(text, start), chr(10)))], '{S.IGNORE_MARK}')",
        "critical_docs": f"{found} SELECT doc_id, count(*) AS n FROM found WHERE list_contains({CRITICAL}, entity_type) GROUP BY 1",
        "gate_summary": f"{found} SELECT doc_id, count(*) AS n, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types, bool_or(list_contains({CRITICAL}, entity_type)) AS has_secrets FROM found GROUP BY 1",
        "scan_summary": f"{found} SELECT (SELECT count(*) FROM docs) AS scanned, count(DISTINCT doc_id) AS with_findings, count(*) AS findings FROM found",
        "risk_by_source": f"{found}, {sums}, {risk} SELECT source, level, action, count(*) AS n, sum(score)::BIGINT AS score FROM risk GROUP BY ALL",
        "risk_tiered": f"{found}, {sums}, {labels}, tiered AS (SELECT s.doc_id, total, critical, tier, {tiers} AS s FROM sums s JOIN labelled USING (doc_id)), stepped AS (SELECT *, CASE WHEN s < 20 THEN 0 WHEN s < 50 THEN 1 ELSE 2 END AS base FROM tiered) SELECT doc_id, (CASE WHEN critical THEN greatest(total, 100) ELSE s END)::INT AS score, ({names[0]})[{step} + 1] AS level, ({names[1]})[{step} + 1] AS action FROM stepped",
        "label_quality_vs_risk": f"{found}, {sums}, {risk} SELECT quality, toxic, level, count(*) AS n FROM risk JOIN labels USING (doc_id) GROUP BY ALL",
        "masked_docs": f"{found}, {masks}, {gaps} SELECT doc_id, sha256(text) AS masked, coalesce((SELECT count(DISTINCT replacement) FROM named n WHERE n.doc_id = r.doc_id), 0)::INT AS placeholders FROM rebuilt r",
        "restored_docs": f"WITH {_DOCS} SELECT doc_id, sha256(text) AS restored FROM docs",
        "redacted_docs": f"{found}, named AS (SELECT doc_id, start, \"end\", 'VEIL_REDACTED_' || label AS replacement FROM found JOIN types USING (entity_type)), {gaps} SELECT doc_id, sha256(text) AS redacted FROM rebuilt",
        "seal_roundtrip": f"WITH {_DOCS} SELECT doc_id, sha256(text) AS opened FROM docs",
        "dictionary_hits": f"WITH {_DOCS}, {_raw(terms, 'docs', 'doc_id', 'text')}, {_resolved('docs', 'doc_id', 'text')} SELECT doc_id, start AS span_start, \"end\" AS span_end, entity_type FROM resolved",
        "dictionary_substrings": f"WITH {_DOCS}, {_raw(substrings, 'docs', 'doc_id', 'text')} SELECT doc_id, start::INT AS span_start, \"end\"::INT AS span_end, entity_type FROM raw",
        "page_findings": f"WITH {_TYPES}, {_raw(page_rules, 'pages', 'page_id', 'html')}, {_resolved('pages', 'page_id', 'html')}, {_found()} SELECT doc_id AS page_id, start AS span_start, \"end\" AS span_end, entity_type FROM found",
        "luhn_valid_cards": f"SELECT o_orderkey, value AS card FROM (SELECT o_orderkey, '4' || lpad((o_orderkey * 7919 + o_custkey)::VARCHAR, 15, '0') AS value FROM orders) WHERE {_LUHN.format(d='value')}",
        "iban_valid": "SELECT o_orderkey, iban FROM (SELECT o_orderkey, 'DE' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || lpad((o_orderkey * 104729 + o_custkey * 31)::VARCHAR, 18, '0') AS iban FROM orders) WHERE (substring(iban, 5) || '1314' || substring(iban, 3, 2))::HUGEINT % 97 = 1",
        "path_classes": f"WITH {labels} SELECT doc_id, path, pattern, allowlisted, ignored, excluded, tier, suspicious, artifact FROM labelled",
        "path_exposure": f"WITH {labels}, {exposed} SELECT * FROM exposed",
        "pattern_findings": f"WITH {labels}, {exposed}, {pattern_rows} SELECT p.pattern, severity, count(path) AS n_exposed FROM patterns p LEFT JOIN exposed e ON e.pattern = p.pattern GROUP BY ALL",
        "rule_findings": f"WITH {labels} SELECT CASE path WHEN '.cursorignore' THEN 'cursor-ignore' ELSE 'agents-md' END AS rule, count(DISTINCT path) AS n_files FROM labelled WHERE path IN ('.cursorignore', 'AGENTS.md') GROUP BY 1",
        "tool_exposures": f"WITH {labels}, sensitive AS (SELECT DISTINCT path, pattern FROM labelled WHERE pattern IS NOT NULL AND NOT allowlisted), scans AS (SELECT * FROM (VALUES {values([(r[0], r[3][0]) for r in privacy_rules() if r[4]])}) v(rule, file)) SELECT rule, count(*) AS n FROM scans, sensitive WHERE NOT (file = '.cursorignore' AND (path LIKE 'logs/%' OR (path LIKE '%.pem' AND path != 'keep.pem'))) AND NOT (file = '.aiexclude' AND path = '.env') GROUP BY 1",
        "audit_status": f"WITH {labels}, {exposed}, {pattern_rows} SELECT CASE WHEN count(*) FILTER (severity = 'required') > 0 THEN 'fail' ELSE 'warning' END AS status FROM exposed JOIN patterns USING (pattern)",
        "privacy_score": f"WITH {labels}, {pattern_rows}, lost AS (SELECT DISTINCT path, pattern FROM labelled WHERE pattern IS NOT NULL AND NOT allowlisted) SELECT greatest(0, 100 - coalesce(sum(CASE severity WHEN 'required' THEN 25 WHEN 'recommended' THEN 10 ELSE 4 END), 0) - 12 * 3)::BIGINT AS score FROM lost JOIN patterns USING (pattern)",
        "audit_delta": f"WITH a AS ({snapshot.format(0)}), b AS ({snapshot.format(1)}) SELECT id, coalesce(a.satisfied, false) AS was, coalesce(b.satisfied, false) AS now, CASE WHEN coalesce(a.satisfied, false) = coalesce(b.satisfied, false) THEN 'same' WHEN b.satisfied THEN 'gained' ELSE 'lost' END AS change, len(list_filter(coalesce(b.paths, []), lambda x: NOT list_contains(coalesce(a.paths, []), x)))::INT AS added, len(list_filter(coalesce(a.paths, []), lambda x: NOT list_contains(coalesce(b.paths, []), x)))::INT AS removed FROM a FULL JOIN b USING (id)",
        "drift": "SELECT DISTINCT n_regionkey::VARCHAR AS file, n_name AS line FROM nation WHERE n_nationkey % 3 != 0",
        "repository_urls": f"SELECT page_id, ({listed([r[1] for r in S.REPOSITORIES])})[page_id % {len(S.REPOSITORIES)} + 1] AS url FROM pages",
        "shell_gate": f"SELECT event_id, ({listed([c[1] for c in S.COMMANDS])})[event_id % {len(S.COMMANDS)} + 1] AS decision, ({listed([c[2] for c in S.COMMANDS])})[event_id % {len(S.COMMANDS)} + 1] AS reasons FROM events",
        "read_gate": f"WITH {labels} SELECT doc_id, CASE WHEN suspicious AND NOT excluded THEN 'deny' ELSE 'allow' END AS decision FROM labelled",
        "write_gate": f"WITH {labels} SELECT doc_id, CASE WHEN artifact IS NULL THEN 'allow' WHEN artifact = 'editorSettings' THEN CASE WHEN doc_id % 2 = 0 THEN 'deny' ELSE 'allow' END ELSE 'deny' END AS decision FROM labelled",
        "mcp_rule_choice": f"SELECT event_id AS call_id, (CASE WHEN {servers} = 'postgres' AND {tools} = 'query' THEN 1 WHEN {servers} = 'postgres' THEN 1 WHEN {servers} = 'files' AND {tools} LIKE 'read%' THEN 3 WHEN {tools} = 'query' THEN 2 ELSE 0 END)::INT AS idx FROM events",
        "event_debounce": "WITH gaps AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), bursts AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM gaps) SELECT user_id AS root, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS fires, count(*) AS n FROM bursts GROUP BY user_id, burst",
        "event_relevance": f"WITH {labels} SELECT doc_id, pattern IS NOT NULL AS immediate FROM labelled WHERE (pattern IS NOT NULL OR path IN ('.cursorignore', 'AGENTS.md')) AND path NOT LIKE '.git/%'",
        "job_latest_state": """WITH RECURSIVE e AS (SELECT 'job-' || (event_id % 997)::VARCHAR AS job_id, user_id::VARCHAR AS repo_url, event_id % 4 AS s, ts + to_microseconds(event_id) AS t, row_number() OVER (PARTITION BY event_id % 997 ORDER BY ts + to_microseconds(event_id)) AS n FROM events),
            f(job_id, n, step, repo, updated, accepted) AS (SELECT job_id, n, CASE WHEN s = 0 THEN 0 END, CASE WHEN s = 0 THEN repo_url END, CASE WHEN s = 0 THEN t END, s = 0 FROM e WHERE n = 1
                UNION ALL SELECT job_id, n, CASE WHEN fresh THEN 0 WHEN up THEN s WHEN alive THEN step END, CASE WHEN fresh THEN repo_url WHEN alive THEN repo END, CASE WHEN fresh OR up THEN t WHEN alive THEN updated END, fresh OR up
                FROM (SELECT e.*, f.step, f.repo, f.updated, coalesce(t <= f.updated + INTERVAL 1 DAY, false) AS alive, NOT alive AND s = 0 AS fresh, alive AND f.step < 2 AND s > f.step AS up FROM f JOIN e ON e.job_id = f.job_id AND e.n = f.n + 1))
            SELECT job_id, arg_max(repo, n) AS repo_url, (['queued', 'running', 'completed', 'failed'])[arg_max(step, n) + 1] AS status, max(updated) AS updated_at FROM f WHERE accepted GROUP BY job_id""",
        "blob_probe": rf"WITH {_DOCS}, whole AS (SELECT doc_id, text AS decoded FROM docs WHERE strlen(text) BETWEEN 16 AND 64000 AND length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')) * 4 >= length(text) * 3) SELECT doc_id, 'base64' AS kind, sha256(decoded) AS decoded, true AS accepted FROM whole",
        "text_chunks": "SELECT doc_id, n::INT AS n, (n * 3800)::INT AS span_start, length(substring(text, (n * 3800 + 1)::INT, 4000))::INT AS chars FROM documents, LATERAL (SELECT unnest(range(0, greatest(length(text) - 201, 0) // 3800 + 1)) AS n) WHERE text IS NOT NULL",
        "label_spans": f"WITH t AS (SELECT user_id AS doc, event_id AS pos, ({listed(S.TOKEN_LABELS)})[floor(value)::BIGINT % {len(S.TOKEN_LABELS)} + 1] AS label, (event_id % 100) / 100 AS confidence FROM events), e AS (SELECT *, CASE WHEN label != 'O' THEN substring(label, 3) END AS entity FROM t), b AS (SELECT *, CASE WHEN left(label, 1) IN ('I', 'E') AND lag(entity) OVER w = entity AND left(lag(label) OVER w, 1) NOT IN ('E', 'S') THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY doc ORDER BY pos)), s AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM b) SELECT doc, min(pos) * 10 AS span_start, max(pos) * 10 + 5 AS span_end, first(entity) AS label, min(confidence) AS confidence FROM s WHERE entity IS NOT NULL GROUP BY doc, span",
        "best_labels": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS label, round(1 / list_sum(list_transform(embedding, lambda x: exp((x - list_max(embedding))::DOUBLE))), 5) AS confidence FROM embeddings",
    }
