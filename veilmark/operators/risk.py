"""Risk of documents from their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.catalog import CRITICAL, ENTITY_TYPES

_CAP = 75


def weight(entity_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for t, _, _, _, w, _ in ENTITY_TYPES for x in (t, w)])[entity_type]


def assess(total: Column, critical: Column, tier: Column) -> Column:
    """struct<score, level, action, has_critical> from the sum of weights; a tier is neutral, secretsConfig or docsOrTests."""
    score = F.when(tier == "secretsConfig", total).otherwise(F.least(total, F.lit(_CAP)))
    step = F.when(score < 20, 0).when(score < 50, 1).otherwise(2)
    step = F.when(tier == "secretsConfig", step + 1).when(tier == "docsOrTests", F.least(step, F.lit(1))).otherwise(step)
    step = F.when(critical, 3).otherwise(step)
    level = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), step + 1)
    action = F.element_at(F.array(*map(F.lit, ("allow", "warn", "mask", "block"))), step + 1)
    score = F.when(critical, F.greatest(total, F.lit(100))).otherwise(score)
    return F.struct(score.cast("int").alias("score"), level.alias("level"), action.alias("action"), critical.alias("has_critical"))


def with_risk(df: DataFrame, findings_col: str = "findings", tier: Column | None = None) -> DataFrame:
    """Rows with their findings in an array, with score, level, action, has_critical and n_findings; without findings low and allow."""
    total = F.aggregate(F.col(findings_col), F.lit(0), lambda a, f: a + F.coalesce(weight(f["entity_type"]), F.lit(0)))
    critical = F.exists(F.col(findings_col), lambda f: f["entity_type"].isin(*CRITICAL))
    names = ("score", "level", "action", "has_critical", "n_findings")
    kept = [c for c in df.columns if c not in names]
    rows = df.select(*kept, total.alias("total"), critical.alias("critical"), (tier if tier is not None else F.lit("neutral")).alias("tier"))
    risk = assess(F.col("total"), F.col("critical"), F.col("tier"))
    return rows.select(*kept, risk.alias("risk")).select(*kept, "risk.*", F.size(findings_col).cast("bigint").alias("n_findings"))


def findings_by_type(findings: DataFrame) -> DataFrame:
    """(doc_id, entity_type, n) with a total row a document (entity_type null)."""
    return findings.rollup("doc_id", "entity_type").agg(F.count("*").alias("n")).filter("doc_id is not null")


def gate_summary(findings: DataFrame) -> DataFrame:
    """What a gate reports: doc_id, n, types (distinct, sorted), has_secrets."""
    return findings.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("types"), F.bool_or(F.col("entity_type").isin(*CRITICAL)).alias("has_secrets")
    )


def scan_summary(df: DataFrame, findings_col: str = "findings") -> DataFrame:
    """One row on rows with their findings: texts scanned, texts with findings, findings."""
    n = F.size(findings_col)
    return df.agg(F.count("*").alias("scanned"), F.count(F.when(n > 0, 1)).alias("with_findings"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("findings"))


def fails(findings: DataFrame, fail_on: str = "block") -> DataFrame:
    """(doc_id, failed): block fails on a critical secret, warn on any finding, none never."""
    hit = {"block": F.bool_or(F.col("entity_type").isin(*CRITICAL)), "warn": F.count("*") > 0, "none": F.lit(False)}[fail_on]
    return findings.groupBy("doc_id").agg(hit.alias("failed"))


def unique_values(findings: DataFrame) -> DataFrame:
    """The first finding of each value of a document."""
    return findings.groupBy("doc_id", "value").agg(F.min_by(F.struct("start", "end", "entity_type"), F.struct("start", "end")).alias("f")).select("doc_id", "value", "f.*")
