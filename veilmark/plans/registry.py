"""All registered queries of the library outside the training-data package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import checks, paths, text
from veilmark.operators import audit, blobs, entities, gates, rewrite, risk, spans
from veilmark.plans import oracle
from veilmark.plans import samples as S
from veilmark.session import spread, table
from veilmark.streaming import events as stream
from veilmark.streaming import ordered

KEY = bytes(range(32))


def dealt(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with one of the sample texts behind its own."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), dealt(S.FINDINGS, F.col("doc_id"))).alias("text"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their findings in an array."""
    return spans.with_findings(documents(spark, sf_dir))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.detect(documents(spark, sf_dir))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for every document: one of the labelled ones below a folder that nothing matches."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    return ids.select("doc_id", dealt([p[0] for p in S.PATHS], F.col("doc_id")).alias("path"))


def spans_by_rule(spark, sf_dir):
    found = spans.extract_spans(documents(spark, sf_dir), "doc_id", "text")
    return found.groupBy("rule_ord", "entity_type").agg(F.count("*").alias("n"), F.sum("start").cast("bigint").alias("starts"), F.sum(F.length("value")).cast("bigint").alias("chars"))


def spans_resolved(spark, sf_dir):
    found = spans.resolve_overlaps(spans.extract_spans(documents(spark, sf_dir), "doc_id", "text"))
    return found.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "entity_type", "value")


def findings_all(spark, sf_dir):
    return findings(spark, sf_dir).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "entity_type", checks.value_preview(F.col("value")).alias("preview"))


def findings_every_type(spark, sf_dir):
    return spans.detect(documents(spark, sf_dir)).groupBy("entity_type").agg(F.count("*").alias("n"))


def findings_by_type(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def findings_unique(spark, sf_dir):
    return risk.unique_values(findings(spark, sf_dir)).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "entity_type")


def findings_not_ignored(spark, sf_dir):
    found = spans.detect(documents(spark, sf_dir), enabled=["apiKeyGeneric"], ignore_marker=S.IGNORE_MARK)
    return found.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def critical_docs(spark, sf_dir):
    return spans.detect(documents(spark, sf_dir), secrets_only=True).groupBy("doc_id").agg(F.count("*").alias("n"))


def gate_summary(spark, sf_dir):
    return risk.gate_summary(findings(spark, sf_dir))


def scan_summary(spark, sf_dir):
    return risk.scan_summary(scanned(spark, sf_dir))


def risk_by_source(spark, sf_dir):
    scored = risk.with_risk(scanned(spark, sf_dir))
    return scored.groupBy("source", "level", "action").agg(F.count("*").alias("n"), F.sum("score").cast("bigint").alias("score"))


def risk_tiered(spark, sf_dir):
    rows = scanned(spark, sf_dir)
    return risk.with_risk(rows, tier=paths.sensitivity_tier(dealt([p[0] for p in S.PATHS], F.col("doc_id")))).select("doc_id", "score", "level", "action")


def label_quality_vs_risk(spark, sf_dir):
    scored = risk.with_risk(scanned(spark, sf_dir)).select("doc_id", "level")
    return scored.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "level").agg(F.count("*").alias("n"))


def masked_docs(spark, sf_dir):
    return rewrite.mask(scanned(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("masked"), F.size("mapping").alias("placeholders"))


def restored_docs(spark, sf_dir):
    return rewrite.mask(scanned(spark, sf_dir)).select("doc_id", F.sha2(rewrite.restore(F.col("text"), F.col("mapping")), 256).alias("restored"))


def redacted_docs(spark, sf_dir):
    return rewrite.redact(scanned(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("redacted"))


def seal_roundtrip(spark, sf_dir):
    return rewrite.unseal(rewrite.seal_findings(scanned(spark, sf_dir), KEY), KEY).select("doc_id", F.sha2("text", 256).alias("opened"))


def dictionary_hits(spark, sf_dir):
    entries = [spans.DictionaryEntry(*t) for t in S.TERMS]
    found = spans.detect(documents(spark, sf_dir), enabled=["customClient", "customCompany", "customSensitiveTerm"], dictionary=entries)
    return found.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "entity_type")


def dictionary_substrings(spark, sf_dir):
    entries = [spans.DictionaryEntry(*t) for t in S.TERMS]
    return spans.dictionary_substrings(documents(spark, sf_dir), "doc_id", "text", entries).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "entity_type")


def page_findings(spark, sf_dir):
    found = spans.detect(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "page_id", "html", enabled=["email", "ipAddress", "apiKeyGeneric", "creditCardLike"])
    return found.select(F.col("doc_id").alias("page_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), "entity_type")


def luhn_valid_cards(spark, sf_dir):
    number = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 15, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", number.alias("card")).filter(checks.luhn_valid(F.col("card")))


def iban_valid(spark, sf_dir):
    digits = F.lpad((F.col("o_orderkey") * 104729 + F.col("o_custkey") * 31).cast("string"), 18, "0")
    iban = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), digits)
    return table(spark, sf_dir, "orders").select("o_orderkey", iban.alias("iban")).filter(checks.iban_valid(F.col("iban")))


def path_classes(spark, sf_dir):
    p = F.col("path")
    rows = listing(spark, sf_dir)
    return rows.select(
        "doc_id", "path", paths.sensitive_pattern(p).alias("pattern"), paths.is_allowlisted(p).alias("allowlisted"), audit.ignored_by_any(p, S.IGNORE_LINES).alias("ignored"),
        paths.is_excluded(p, S.EXCLUDES).alias("excluded"), paths.sensitivity_tier(p).alias("tier"), paths.is_suspicious(p).alias("suspicious"), paths.artifact_class(p)["kind"].alias("artifact"),
    )


def path_exposure(spark, sf_dir):
    return audit.exposures(listing(spark, sf_dir), S.IGNORE_LINES)


def pattern_findings(spark, sf_dir):
    return audit.pattern_findings(audit.exposures(listing(spark, sf_dir), S.IGNORE_LINES)).select("pattern", "severity", "n_exposed")


def rule_findings(spark, sf_dir):
    return audit.rule_findings(listing(spark, sf_dir)).filter("satisfied").select("rule", "n_files")


def tool_exposures(spark, sf_dir):
    return audit.tool_exposures(listing(spark, sf_dir), S.IGNORE_LINES).groupBy("rule").agg(F.count("*").alias("n"))


def audit_status(spark, sf_dir):
    rows = listing(spark, sf_dir)
    exposed = audit.exposures(rows, S.IGNORE_LINES)
    return audit.audit_status(audit.pattern_findings(exposed), audit.rule_findings(rows), audit.tool_exposures(rows, S.IGNORE_LINES))


def privacy_score(spark, sf_dir):
    exposed = audit.exposures(listing(spark, sf_dir), {})
    return audit.privacy_score(audit.pattern_findings(exposed), audit.rule_findings(listing(spark, sf_dir)))


def _snapshot(rows: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """States (id, satisfied) and paths (id, path) of the rows to keep."""
    kept = rows.filter(keep).withColumnRenamed("o_orderpriority", "id")
    states = kept.groupBy("id").agg((F.count(F.when(F.col("o_orderstatus") == "O", 1)) > 2).alias("satisfied"))
    return states, kept.select("id", F.col("o_custkey").cast("string").alias("path"))


def audit_delta(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    before, old = _snapshot(orders, F.col("o_orderkey") % 3 != 0)
    after, new = _snapshot(orders, F.col("o_orderkey") % 3 != 1)
    delta = audit.delta_counts(before, after, old, new)
    return delta.select("id", "was", "now", "change", F.col("added").cast("int").alias("added"), F.col("removed").cast("int").alias("removed"))


def drift(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("file"), F.concat(F.lit(" "), "n_name").alias("line"), "n_nationkey")
    return audit.drift(rows.select("file", "line"), rows.filter("n_nationkey % 3 = 0").select("file", "line"))


def repository_urls(spark, sf_dir):
    raw = dealt([r[0] for r in S.REPOSITORIES], F.col("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", text.repository_url(raw).alias("url"))


def shell_gate(spark, sf_dir):
    command = dealt([c[0] for c in S.COMMANDS], F.col("event_id"))
    rows = spread(table(spark, sf_dir, "events").select("event_id")).select("event_id", F.to_json(F.struct(command.alias("command"))).alias("payload"))
    return rows.select("event_id", gates.shell_gate(F.col("payload"), ("fixtures/",)).alias("g")).select("event_id", "g.*")


def read_gate(spark, sf_dir):
    rows = listing(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("path").alias("file_path"))).alias("payload"))
    return rows.select("doc_id", gates.read_gate(F.col("payload"), tuple(S.EXCLUDES))["decision"].alias("decision"))


def write_gate(spark, sf_dir):
    body = F.when(F.col("doc_id") % 2 == 0, F.lit('{"pythonPath": "x"}')).otherwise("{}")
    rows = listing(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("path").alias("file_path"), body.alias("content"))).alias("payload"))
    return rows.select("doc_id", gates.write_gate(F.col("payload"))["decision"].alias("decision"))


def text_gate(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("event_id"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("payload"))
    return gates.text_gate(rows).groupBy("decision").agg(F.count("*").alias("n"))


def mcp_rule_choice(spark, sf_dir):
    rules = spark.createDataFrame(S.SERVER_RULES, "idx int, server string, tool string, mode string")
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), dealt(S.SERVERS, F.col("event_id")).alias("server"), dealt(S.TOOLS, F.col("user_id")).alias("tool"))
    return gates.choose_rule(calls, rules).select("call_id", "idx")


def event_debounce(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), "ts")
    return stream.debounce(rows, quiet=3600).select("root", "started", "fires", "n")


def event_throttle(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), F.col("ts").alias("fires"), (F.col("event_type") == "error").alias("immediate"))
    fired = stream.throttle(rows, spacing=7200)
    return fired.groupBy("root").agg(F.count("*").alias("n"), F.count_distinct("fired_at").alias("audits"))


def event_rate_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client"), "ts")
    return stream.rate_limit(rows, seconds=86_400, tie="event_id").select("event_id", "client", "admitted")


def event_relevance(spark, sf_dir):
    changes = listing(spark, sf_dir).select(F.lit(None).cast("timestamp").alias("ts"), F.lit("r").alias("root"), "path", "doc_id")
    kept = stream.relevant_changes(changes, [".cursorignore", "AGENTS.md"])
    return kept.select("doc_id", "immediate")


def job_latest_state(spark, sf_dir):
    status = dealt(["queued", "running", "completed", "failed"], F.col("event_id"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("job-"), (F.col("event_id") % 997).cast("string")).alias("job_id"), F.col("user_id").cast("string").alias("repo_url"), status.alias("status"), (F.col("ts") + F.make_dt_interval(secs=F.col("event_id").cast("decimal(18,6)") / 1_000_000)).alias("ts"))
    return ordered.job_states(rows).select("job_id", "repo_url", "status", "updated_at")


def ledger_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), F.col("props").alias("entry"))
    return stream.hash_chain(rows).groupBy("ledger").agg(F.count("*").alias("n"), F.max_by(F.sha2("line", 256), "seq").alias("head"))


def blob_probe(spark, sf_dir):
    """Every whole text, encoded: those beyond a blob's most bytes are none."""
    encoded = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\r?\n", "")
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("x "), encoded, F.lit(" y")).alias("text"))
    return blobs.decode_blobs(rows).select("doc_id", "kind", F.sha2("decoded", 256).alias("decoded"), "accepted")


def text_chunks(spark, sf_dir):
    return entities.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n", F.col("start").alias("span_start"), F.length("chunk").alias("chars"))


def label_spans(spark, sf_dir):
    """Events of a user as the tokens of a text."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 5).alias("end"),
        dealt(S.TOKEN_LABELS, F.floor(F.col("value"))).alias("label"), ((F.col("event_id") % 100) / 100).alias("confidence"),
    )
    return entities.decode_labels(rows).select("doc", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "label", "confidence")


def best_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", entities.best_label(F.col("embedding")).alias("b"))
    return rows.select("vec_id", "b.label", F.round("b.confidence", 5).alias("confidence"))


_QUERIES = [
    risk_by_source, spans_by_rule, spans_resolved, findings_all, findings_every_type, findings_by_type, findings_unique, findings_not_ignored, critical_docs, gate_summary,
    scan_summary, risk_tiered, label_quality_vs_risk, masked_docs, restored_docs, redacted_docs, seal_roundtrip, dictionary_hits, dictionary_substrings, page_findings,
    luhn_valid_cards, iban_valid, path_classes, path_exposure, pattern_findings, rule_findings, tool_exposures, audit_status, privacy_score, audit_delta, drift,
    repository_urls, shell_gate, read_gate, write_gate, text_gate, mcp_rule_choice, event_debounce, event_throttle, event_rate_limit, event_relevance, job_latest_state,
    ledger_chain, blob_probe, text_chunks, label_spans, best_labels,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return oracle.sql()
