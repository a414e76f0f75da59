"""The path audit: exposures, ignore files, rule and pattern findings, status, score, deltas and fixes."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.functions import path_tables as T
from veilmark.functions.paths import any_of, canonical_ignore_line, is_allowlisted, is_ignored, matches_glob, sensitive_pattern, under_skipped

#: Rules that share a number, a bit each.
_BITS = 60


def parse_ignore_files(files: DataFrame) -> DataFrame:
    """(file, n, line) of ignore files (file, contents): trimmed lines that are neither empty nor comments."""
    lines = files.select("file", F.posexplode(F.split(F.col("contents"), r"\r?\n")).alias("n", "raw"))
    return lines.select("file", "n", F.trim("raw").alias("line")).filter(~F.col("line").rlike("^(?:#|$)"))


def ignored_by_any(path: Column, lines_by_file: Mapping[str, Sequence[str]]) -> Column:
    return any_of(is_ignored(path, lines) for lines in lines_by_file.values())


def walk(paths: DataFrame, max_files: int | None = 100_000, skipped: Sequence[str] = T.SKIPPED_DIRECTORIES) -> DataFrame:
    """The files a walk sees: (path, complete). Directories named in `skipped` aren't entered; the first `max_files`
    in the order of paths are seen (None: all), and complete says whether that is all of them."""
    seen = paths.filter(~F.col("is_dir") if "is_dir" in paths.columns else F.lit(True)).filter(~under_skipped(F.col("path"), skipped)).select("path").distinct()
    if max_files is None:
        return seen.withColumn("complete", F.lit(True))
    limited = seen.orderBy("path").limit(max_files + 1)
    total = limited.agg((F.count("*") <= max_files).alias("complete"))
    return limited.orderBy("path").limit(max_files).crossJoin(F.broadcast(total))


def with_directories(paths: DataFrame, skipped: Sequence[str] = T.SKIPPED_DIRECTORIES) -> DataFrame:
    """(path, is_dir): the files of a listing and every directory above them, each once, without what a walk doesn't enter: what globs of rules look at."""
    seen = paths.filter(~under_skipped(F.col("path"), skipped)).select("path")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    folders = seen.filter(F.contains("path", F.lit("/"))).select(F.explode(above).alias("path")).distinct()
    return folders.select("path", F.lit(True).alias("is_dir")).unionByName(seen.distinct().select("path", F.lit(False).alias("is_dir")))


def exposures(paths: DataFrame, lines_by_file: Mapping[str, Sequence[str]]) -> DataFrame:
    """(path, pattern): sensitive paths that are neither allowlisted nor covered by an ignore file, each once.

    The patterns are one CASE over the path, so nothing is joined and only the distinct shuffles."""
    p = F.col("path")
    return paths.select("path", sensitive_pattern(p).alias("pattern")).filter(F.col("pattern").isNotNull() & ~is_allowlisted(p) & ~ignored_by_any(p, lines_by_file)).distinct()


def pattern_table(spark: SparkSession) -> DataFrame:
    rows = [(n, i, severity, category, canonical_ignore_line(globs)) for n, (i, severity, category, globs) in enumerate(T.SENSITIVE_PATTERNS)]
    return spark.createDataFrame(rows, "ord int, pattern string, severity string, category string, ignore_line string")


def pattern_findings(exposed: DataFrame) -> DataFrame:
    """Every pattern with its exposed paths, none included: pattern, severity, category, n_exposed, satisfied."""
    counts = exposed.groupBy("pattern").agg(F.count("*").alias("n_exposed"))
    table = pattern_table(exposed.sparkSession)
    return table.join(counts, "pattern", "left").select("pattern", "severity", "category", F.coalesce("n_exposed", F.lit(0)).alias("n_exposed"), F.col("n_exposed").isNull().alias("satisfied"))


def rule_findings(paths: DataFrame, rules: Sequence[tuple] | None = None) -> DataFrame:
    """Every privacy rule with the number of files that satisfy it: rule, tool, severity, n_files, satisfied."""
    rules = rules if rules is not None else T.privacy_rules()
    table = paths.sparkSession.createDataFrame([(r[0], r[1], r[2]) for r in rules], "rule string, tool string, severity string")
    hits = F.filter(F.array(*[F.when(matches_glob(F.col("path"), *r[3]), F.lit(r[0])) for r in rules]), lambda r: r.isNotNull())
    found = paths.select("path", F.explode(hits).alias("rule")).distinct().groupBy("rule").agg(F.count("*").alias("n_files"))
    return table.join(found, "rule", "left").select("rule", "tool", "severity", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.col("n_files").isNotNull().alias("satisfied"))


def tool_exposures(paths: DataFrame, lines_by_file: Mapping[str, Sequence[str]], rules: Sequence[tuple] | None = None) -> DataFrame:
    """(rule, path, pattern): what each tool would see with its own ignore files alone."""
    rules = [r for r in (rules if rules is not None else T.privacy_rules()) if r[4]]
    p = F.col("path")
    sensitive = paths.select("path", sensitive_pattern(p).alias("pattern")).filter(F.col("pattern").isNotNull() & ~is_allowlisted(p)).distinct()
    open_to = F.array(*[F.when(~ignored_by_any(p, {f: lines_by_file.get(f, []) for f in r[3]}), F.lit(r[0])) for r in rules])
    return sensitive.select(F.explode(F.filter(open_to, lambda r: r.isNotNull())).alias("rule"), "path", "pattern")


def filter_rules(rules: Sequence[tuple], tools: Iterable[str] = (), disabled: Iterable[str] = ()) -> list[tuple]:
    """Rules of the given tools and of none; disabled ones go unless they are required."""
    tools, disabled = set(tools), set(disabled)
    return [r for r in rules if (not tools or r[1] is None or r[1] in tools) and not (r[0] in disabled and r[2] != "required")]


def audit_status(pattern_found: DataFrame, rule_found: DataFrame, tool_found: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """One row with status fail, warning or pass: an exposure of required weight fails; a missing required or
    recommended rule, a recommended exposure, or a walk cut short warns."""
    weights = pattern_found.agg(
        F.bool_or(~F.col("satisfied") & (F.col("severity") == "required")).alias("fail"),
        F.bool_or(~F.col("satisfied") & (F.col("severity") == "recommended")).alias("exposed"),
    )
    missing = rule_found.agg(F.bool_or(~F.col("satisfied") & F.col("severity").isin("required", "recommended")).alias("missing"))
    if tool_found is not None:
        required = tool_found.join(rule_found.filter("severity = 'required'").select("rule"), "rule", "left_semi")
        missing = missing.crossJoin(required.agg((F.count("*") > 0).alias("tool_fail")))
    else:
        missing = missing.withColumn("tool_fail", F.lit(False))
    false = F.lit(False)
    status = F.when(F.coalesce("fail", false) | F.coalesce("tool_fail", false), "fail").when(F.coalesce("missing", false) | F.coalesce("exposed", false) | F.lit(not complete), "warning").otherwise("pass")
    return weights.crossJoin(missing).select(status.alias("status"))


def privacy_score(pattern_found: DataFrame, rule_found: DataFrame, scanning: Iterable[str] | None = None) -> DataFrame:
    """One row with score: 100 less 25, 10 or 4 for each exposed path by weight, and 15 or 3 for each missing rule that scans."""
    scans = list(scanning) if scanning is not None else [r[0] for r in T.privacy_rules() if r[4]]
    by_weight = F.when(F.col("severity") == "required", 25).when(F.col("severity") == "recommended", 10).otherwise(4)
    by_rule = F.when(F.col("severity") == "required", 15).when(F.col("severity") == "recommended", 3).otherwise(0)
    lost = pattern_found.agg(F.coalesce(F.sum(by_weight * F.col("n_exposed")), F.lit(0)).alias("a"))
    rules = rule_found.filter(~F.col("satisfied") & F.col("rule").isin(*scans)).agg(F.coalesce(F.sum(by_rule), F.lit(0)).alias("b"))
    return lost.crossJoin(rules).select(F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("a") - F.col("b"))).cast("bigint").alias("score"))


def audit_roots(paths: DataFrame, lines_by_file: Mapping[str, Sequence[str]], rules: Sequence[tuple] | None = None) -> DataFrame:
    """The status and score of each root of a listing (root, path): root, n_exposed, n_rules (satisfied ones), score, status.

    The same weights and levels as `privacy_score` and `audit_status`, as sums for each root with partial aggregates, so
    a root of any size is spread; repeated paths count once. Rules are bits of a number, so only exposed paths are told
    apart, and all others of a root are one row from the first aggregate on. A root whose paths are all null has nothing.
    """
    rules = rules if rules is not None else T.privacy_rules()
    severity = F.create_map(*[F.lit(x) for i, level, _, _ in T.SENSITIVE_PATTERNS for x in (i, level)])
    lost = {r[0]: {"required": 15, "recommended": 3}.get(r[2], 0) if r[4] else 0 for r in rules}
    asked = [r[0] for r in rules if r[2] in ("required", "recommended")]
    p, zero = F.col("path"), F.lit(0).cast("bigint")
    open_path = ~is_allowlisted(p) & ~ignored_by_any(p, lines_by_file)
    met = [F.when(matches_glob(p, *r[3]), F.lit(1 << (i % _BITS)).cast("bigint")).otherwise(zero) for i, r in enumerate(rules)]
    parts = {f"met_{i}": functools.reduce(Column.bitwiseOR, met[i : i + _BITS]) for i in range(0, len(met), _BITS)}
    union = lambda: [F.bit_or(c).alias(c) for c in parts]
    rows = paths.select("root", "path", *[v.alias(c) for c, v in parts.items()], F.when(open_path, sensitive_pattern(p)).alias("pattern"))
    rows = rows.select("root", F.when(F.col("pattern").isNotNull(), p).alias("path"), severity[F.col("pattern")].alias("level"), *parts)
    rows = rows.groupBy("root", "path", "level").agg(*union()) if parts else rows.distinct()
    rows = rows.groupBy("root").agg(
        F.count("level").alias("n_exposed"), F.coalesce(F.sum(F.when(F.col("level") == "required", 25).when(F.col("level") == "recommended", 10).when(F.col("level").isNotNull(), 4)), zero).alias("a"),
        F.coalesce(F.bool_or(F.col("level") == "required"), F.lit(False)).alias("fail"), F.coalesce(F.bool_or(F.col("level") == "recommended"), F.lit(False)).alias("warn"), *union(),
    )

    def total(weights: list[int]) -> Column:
        """The weights of the rules that are met: for each number and weight, how many of its bits are set."""
        masks: dict[tuple[str, int], int] = {}
        for i, w in enumerate(weights):
            part = f"met_{i - i % _BITS}"
            masks[part, w] = masks.get((part, w), 0) | 1 << (i % _BITS)
        return sum((F.bit_count(F.col(part).bitwiseAND(F.lit(mask).cast("bigint"))) * F.lit(w) for (part, w), mask in masks.items() if w), zero)

    rows = rows.withColumns({"n_rules": total([1] * len(rules)), "n_asked": total([int(r[0] in asked) for r in rules]), "kept": total([lost[r[0]] for r in rules])})
    score = F.greatest(zero, 100 - F.col("a") - (sum(lost.values()) - F.coalesce("kept", zero)))
    warn = F.col("warn") | (F.coalesce("n_asked", zero) < len(asked))
    status = F.when(F.col("fail"), "fail").when(warn, "warning").otherwise("pass")
    return rows.select("root", "n_exposed", F.coalesce("n_rules", zero).cast("bigint").alias("n_rules"), score.cast("bigint").alias("score"), status.alias("status"))


def check_totals(exposed: DataFrame) -> DataFrame:
    """One row: exposed files, exposed pattern types."""
    return exposed.agg(F.count_distinct("path").alias("files"), F.count_distinct("pattern").alias("patterns"))


def severity_counts(pattern_found: DataFrame) -> DataFrame:
    """An anonymous report: (severity, n_patterns, n_exposed)."""
    return pattern_found.groupBy("severity").agg(F.count(F.when(~F.col("satisfied"), 1)).alias("n_patterns"), F.sum("n_exposed").alias("n_exposed"))


def delta_counts(before: DataFrame, after: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two snapshots of any size, kept as rows, states (id, satisfied) and paths (id, path): id, was, now, change (gained, lost or same), added and removed paths.

    Every step is a count with partial aggregates, so neither an id's paths nor all of a table meet in one row or task.
    """
    none = F.lit(None).cast("boolean")
    sides = old.select("id", "path", F.lit(1).alias("side")).unionByName(new.select("id", "path", F.lit(2).alias("side"))).filter("path is not null")
    sides = sides.groupBy("id", "path").agg(F.bit_or("side").alias("sides"))
    rows = sides.select("id", none.alias("was"), none.alias("now"), (F.col("sides") == 2).cast("int").alias("added"), (F.col("sides") == 1).cast("int").alias("removed"))
    states = before.select("id", F.col("satisfied").alias("was"), none.alias("now")).unionByName(after.select("id", none.alias("was"), F.col("satisfied").alias("now")))
    rows = rows.unionByName(states.select("*", F.lit(0).alias("added"), F.lit(0).alias("removed")))
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    return rows.groupBy("id").agg(F.bool_or("was").alias("was"), F.bool_or("now").alias("now"), F.sum("added").alias("added"), F.sum("removed").alias("removed")).select(
        "id", was.alias("was"), now.alias("now"), F.when(was == now, "same").when(now, "gained").otherwise("lost").alias("change"), "added", "removed"
    )


def status_rank(status: Column) -> Column:
    return F.when(status == "fail", 2).when(status == "warning", 1).otherwise(0)


def worst_status(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max_by("status", status_rank(F.col("status"))).alias("status"))


def degraded(audits: DataFrame) -> DataFrame:
    """Audits (root, ts, status, exposed array) with degraded: whether the status rose or a new path is exposed since the last one of its root; a root's first is not."""
    order = Window.partitionBy("root").orderBy("ts")
    before, seen = F.lag("status").over(order), F.lag("exposed").over(order)
    worse = before.isNotNull() & (status_rank(F.col("status")) > status_rank(before))
    fresh = F.size(F.array_except("exposed", seen)) > 0
    return audits.withColumn("degraded", F.coalesce(worse | fresh, F.lit(False)))


def should_audit(audits: DataFrame, least_seconds: int = 30) -> DataFrame:
    """Requests (root, ts, force) with due: forced, the first of a root, or late enough after the last one."""
    before = F.lag("ts").over(Window.partitionBy("root").orderBy("ts"))
    late = F.unix_micros("ts") - F.unix_micros(before) >= least_seconds * 1_000_000
    return audits.withColumn("due", F.col("force") | F.coalesce(late, F.lit(True)))


def drift(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Ignore lines that files lack: (file, line) of expected less present."""
    return expected.select("file", F.trim("line").alias("line")).distinct().join(present.select("file", F.trim("line").alias("line")), ["file", "line"], "left_anti")


def sync_plan(expected: DataFrame, present: DataFrame, files: DataFrame) -> DataFrame:
    """(file, plan): create where a wanted file is missing, update where it lacks lines, else unchanged."""
    lacking = drift(expected, present).groupBy("file").agg(F.count("*").alias("lacking"))
    there = files.select("file", F.lit(True).alias("there")).distinct()
    return expected.select("file").distinct().join(there, "file", "left").join(lacking, "file", "left").select(
        "file", F.when(F.col("there").isNull(), "create").when(F.col("lacking").isNotNull(), "update").otherwise("unchanged").alias("plan"), F.coalesce("lacking", F.lit(0)).alias("lacking")
    )


def fix_items(pattern_found: DataFrame, rule_found: DataFrame, tool_found: DataFrame) -> DataFrame:
    """What can be fixed: (kind, id, severity, selected). Exposed patterns are selected, rules where they are required or
    leave an exposure; if no rule is, all are."""
    patterns = pattern_found.filter(~F.col("satisfied")).select(F.lit("pattern").alias("kind"), F.col("pattern").alias("id"), "severity", F.lit(True).alias("selected"))
    gaps = tool_found.select("rule").distinct().withColumn("gap", F.lit(True))
    missing = rule_found.filter((~F.col("satisfied")) & (F.col("severity") != "informational")).withColumn("missing", F.lit(True)).select("rule", "severity", "missing")
    rules = rule_found.select("rule", "severity").join(missing.select("rule", "missing"), "rule", "left").join(gaps, "rule", "left").filter("missing or gap")
    chosen = (F.col("severity") == "required") | F.coalesce("gap", F.lit(False))
    none = F.max(chosen.cast("int")).over(Window.partitionBy(F.lit(0))) == 0
    rules = rules.select(F.lit("rule").alias("kind"), F.col("rule").alias("id"), "severity", (chosen | none).alias("selected"))
    return patterns.unionByName(rules)


def select_fixes(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def protect_lines(exposed: DataFrame, with_recommended: bool = False) -> DataFrame:
    """(pattern, line): the ignore line of every exposed pattern that is required (or recommended, if asked)."""
    severities = ["required", "recommended"] if with_recommended else ["required"]
    return pattern_table(exposed.sparkSession).filter(F.col("severity").isin(*severities)).join(exposed.select("pattern").distinct(), "pattern", "left_semi").select("pattern", F.col("ignore_line").alias("line"))


def tracked_and_ignored(tracked: DataFrame, lines_by_file: Mapping[str, Sequence[str]], limit: int = 8) -> DataFrame:
    """One row: how many tracked paths ignore lines cover, and the first of them."""
    hit = tracked.filter(ignored_by_any(F.col("path"), lines_by_file)).select("path").distinct()
    first = hit.orderBy("path").limit(limit).agg(F.array_sort(F.collect_list("path")).alias("first"))
    return hit.agg(F.count("*").alias("n")).crossJoin(first)


def update_index(index: DataFrame, changes: DataFrame, lines_by_file: Mapping[str, Sequence[str]]) -> DataFrame:
    """The index of sensitive paths after changes (path, ts, removed): each path's last change wins, of two at one time the
    removal; then exposures of the index alone. `sources.logs` keeps such an index as a table that changes part by part."""
    last = changes.groupBy("path").agg(F.max_by("removed", F.struct("ts", "removed")).alias("removed"))
    kept = index.select("path").join(last, "path", "left_anti").unionByName(last.filter(~F.col("removed")).select("path"))
    return exposures(kept.filter(sensitive_pattern(F.col("path")).isNotNull()), lines_by_file)
