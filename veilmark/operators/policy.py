"""Fix planning, settings and watch lists around the path audit."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.functions import path_tables as T
from veilmark.functions.checks import severity_rank
from veilmark.functions.paths import matches_glob


def rule_table(spark: SparkSession, rules: Sequence[tuple] | None = None) -> DataFrame:
    """The audit's rules as rows: rule, tool, severity, scans, fix_path (the file that a fix writes)."""
    rows = [(r[0], r[1], r[2], r[4], r[3][0]) for r in (rules if rules is not None else T.privacy_rules())]
    return spark.createDataFrame(rows, "rule string, tool string, severity string, scans boolean, fix_path string")


def matched_files(paths: DataFrame, rules: Sequence[tuple] | None = None) -> DataFrame:
    """(rule, path): the files of a listing that satisfy a rule, each once."""
    rules = rules if rules is not None else T.privacy_rules()
    hits = F.array_compact(F.array(*[F.when(matches_glob(F.col("path"), *r[3]), F.lit(r[0])) for r in rules]))
    return paths.select(F.explode(hits).alias("rule"), "path").distinct()


def fix_scenario(rules: DataFrame, matched: DataFrame) -> DataFrame:
    """One row with scenario: existing-files if an ignore file that scans is there, else no-files."""
    there = matched.join(rules.filter("scans"), "rule", "left_semi")
    return there.agg(F.when(F.count("*") > 0, "existing-files").otherwise("no-files").alias("scenario"))


def pattern_targets(rules: DataFrame, matched: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(path): the ignore files that patterns are written to: those of the (selected) rules that scan, and what already satisfies them."""
    scanning = rules.filter("scans")
    if selected is not None:
        scanning = scanning.join(selected.select("rule").distinct(), "rule", "left_semi")
    present = matched.join(scanning, "rule", "left_semi").select("path")
    return scanning.select(F.col("fix_path").alias("path")).unionByName(present).distinct()


def planned_paths(rules: DataFrame, matched: DataFrame, selected: DataFrame, with_patterns: bool) -> DataFrame:
    """(path): what a fix with the selected rules would write: files of missing ones that aren't informational, and pattern targets."""
    missing = rules.join(selected.select("rule").distinct(), "rule", "left_semi").join(matched.select("rule").distinct(), "rule", "left_anti")
    paths = missing.filter("severity != 'informational'").select(F.col("fix_path").alias("path"))
    return (paths.unionByName(pattern_targets(rules, matched, selected)) if with_patterns else paths).distinct()


def fix_files(rules: DataFrame, matched: DataFrame, any_exposed: DataFrame) -> DataFrame:
    """(path, state): the ignore files a report offers: missing ones, and where something is exposed (`any_exposed`: rows) also the present,
    to be refreshed; a path that is both is missing."""
    wanted = rules.filter("scans and severity != 'informational'")
    present = matched.select("rule").distinct().withColumn("present", F.lit(True))
    exposed = any_exposed.limit(1).agg((F.count("*") > 0).alias("exposed"))
    rows = wanted.join(present, "rule", "left").crossJoin(F.broadcast(exposed))  # one row
    rows = rows.filter("present is null or exposed").select(F.col("fix_path").alias("path"), F.when(F.col("present").isNull(), "missing").otherwise("refreshed").alias("state"))
    return rows.groupBy("path").agg(F.min("state").alias("state"))


def check_report(rules: DataFrame, matched: DataFrame, pattern_found: DataFrame, exposed: DataFrame, complete: bool = True, version: str = "1") -> DataFrame:
    """One row with the whole report as JSON: which rules' files are there, totals, exposed patterns by weight and id, and the files a fix
    offers by path. Only the configuration's rules and patterns, and counts, are gathered."""
    present = matched.select("rule").distinct().withColumn("present", F.lit(True))
    there = rules.join(present, "rule", "left").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", F.coalesce("present", F.lit(False)))))).alias("ignoreFilesPresent"))
    totals = exposed.agg(F.struct(F.count_distinct("path").alias("exposedFiles"), F.count_distinct("pattern").alias("exposedPatternTypes")).alias("totals"))
    row = F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("pattern").alias("id"), "severity", "category", F.col("n_exposed").alias("count"))
    ordered = pattern_found.filter(~F.col("satisfied")).agg(F.array_sort(F.collect_list(row)).alias("p"))
    patterns = ordered.select(F.transform("p", lambda x: F.struct(*[x[n].alias(n) for n in ("id", "severity", "category", "count")])).alias("exposedPatterns"))
    files = fix_files(rules, matched, exposed).agg(F.array_sort(F.collect_list(F.struct("path", "state"))).alias("fixFiles"))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.lit(version).alias("toolVersion"), F.lit(complete).alias("scanComplete"), "ignoreFilesPresent", "totals", "exposedPatterns", "fixFiles")
    return there.crossJoin(totals).crossJoin(patterns).crossJoin(files).select(F.to_json(body).alias("report"))  # one row each


def file_of_finding(exposed: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, path): exposed paths by their finding's id, which is the first 12 hex digits of the SHA-256 of pattern and path."""
    return exposed.select(F.substring(F.sha2(F.concat_ws("\n", "pattern", "path"), 256), 1, 12).alias("id"), "path").join(ids.select("id").distinct(), "id", "left_semi")


def resolve_configuration(rules: Sequence[tuple], disabled: Iterable[str] = (), skipped: Iterable[str] = ()) -> tuple[list[tuple], list[str]]:
    """The rules less the disabled ones that aren't required, and the extra skipped directories, trimmed, each once. Configuration only."""
    off = set(disabled)
    return [r for r in rules if r[2] == "required" or r[0] not in off], list(dict.fromkeys(s for s in map(str.strip, skipped) if s))


def ignore_settings(contents: Column) -> Column:
    """struct<commit, tools> of the section `ignore:` of settings files: commit is true only if it says so; tools is the last flow list
    or the items below `tools:`, lower-cased; null if there are none.

    Lines are trimmed of comments; a line at the margin opens or ends the section; only items that follow
    `tools:` without another key between count.
    """
    text = F.regexp_replace(F.concat(F.lit("\n"), contents, F.lit("\n")), r"\r", "")
    text = F.regexp_replace(text, r"(?m)(^|[ \t])#[^\n]*", "$1")
    text = F.regexp_replace(text, r"(?m)[ \t]+$", "")
    text = F.regexp_replace(text, r"\n{2,}", "\n")
    section = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(?<=\n)ignore:\n((?: [^\n]*\n)*)"), F.lit(1)), lambda s: s), "")
    last = lambda values: F.get(values, F.size(values) - 1)
    commit = last(F.regexp_extract_all(section, F.lit(r"(?m)^ +commit: *[\"']?([^\n\"']*)"), F.lit(1)))
    flow = last(F.regexp_extract_all(section, F.lit(r"(?m)^ +tools: *\[([^\n\]]*)"), F.lit(1)))
    block = F.array_join(F.regexp_extract_all(section, F.lit(r"(?m)^ +tools:\n((?: *-[^\n]*\n)*)"), F.lit(1)), "")
    clean = lambda items: F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(F.regexp_replace(F.trim(x), r"^([\"'])(.*)\1$", "$2"))), lambda x: x != ""))
    items = F.when(flow.isNotNull(), clean(F.split(flow, ","))).otherwise(clean(F.regexp_extract_all(block, F.lit(r"(?m)^ *-([^\n]*)"), F.lit(1))))
    return F.struct((F.lower(F.coalesce(commit, F.lit(""))) == "true").alias("commit"), F.when(F.size(items) > 0, items).alias("tools"))


def summary_text(paths: Column, limit: int = 2) -> Column:
    """The first paths of an array joined by commas, with how many more there are; null for none."""
    shown = F.array_join(F.slice(paths, 1, max(1, limit)), ", ")
    more = F.concat(shown, F.lit(" +"), (F.size(paths) - limit).cast("string"), F.lit(" more"))
    return F.when((F.size(paths) > 0) & F.lit(limit > 0), F.when(F.size(paths) <= limit, shown).otherwise(more))


def active_entries(entries: DataFrame, limit: int | None, order: str = "added_at", tie: str = "id") -> DataFrame:
    """The oldest entries of each owner up to a tier's limit (None: all). Ranks are taken within an owner, so none of a table meets in one task."""
    if limit is None:
        return entries
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(order, tie))
    return entries.withColumn("place", rank).filter(F.col("place") <= limit).drop("place")


def attention_entries(active: DataFrame, statuses: DataFrame) -> DataFrame:
    """(id, path, name, status) of active entries (id, path, name) whose status is fail; a missing name is the path's last part."""
    path = F.coalesce("path", "name", F.col("id").cast("string"))
    rows = active.join(statuses.filter("status = 'fail'").select("id", "status"), "id")
    return rows.select("id", path.alias("path"), F.coalesce("name", F.regexp_extract(path, r"([^/]*)/*$", 1)).alias("name"), "status")


def selection(picked: DataFrame, supported: Sequence[str]) -> DataFrame:
    """What each pick (pick, n, path, is_dir) opens: (pick, kind, paths): the first directory, else its supported files, each once, in order."""
    ok = F.col("is_dir") | F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*supported)
    rows = picked.filter(ok).groupBy("pick", "path", "is_dir").agg(F.min("n").alias("n"))
    found = rows.groupBy("pick").agg(
        F.min(F.when(F.col("is_dir"), F.struct("n", "path"))).alias("folder"), F.array_sort(F.collect_list(F.when(~F.col("is_dir"), F.struct("n", "path")))).alias("files")
    )
    paths = F.when(F.col("folder").isNotNull(), F.array("folder.path")).otherwise(F.transform("files", lambda f: f["path"]))
    return found.select("pick", F.when(F.col("folder").isNotNull(), "directory").otherwise("documents").alias("kind"), paths.alias("paths"))


def config_lookup(tree: Column, *path: str) -> tuple[Column, Column, Column]:
    """What a JSON settings tree holds at a path of keys, as a string, a list of strings and a boolean; null (list: empty) for other kinds."""
    at = "$" + "".join(f"['{k}']" for k in path)
    found = F.get_json_object(F.concat(F.lit('{"v":'), F.coalesce(tree, F.lit("null")), F.lit("}")), "$.v" + at[1:])
    parent = F.get_json_object(tree, "$" + "".join(f"['{k}']" for k in path[:-1]))
    raw = F.from_json(parent, "map<string,variant>")[path[-1]]
    kind = F.call_function("schema_of_variant", raw)
    strings = F.filter(F.from_json(F.when(kind.startswith("ARRAY"), found), "array<variant>"), lambda v: F.call_function("schema_of_variant", v) == "STRING")
    listed = F.coalesce(F.transform(strings, lambda v: v.cast("string")), F.array().cast("array<string>"))
    return F.when(kind == "STRING", found), listed, F.when(kind == "BOOLEAN", found == "true")


def trust_drift(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) between a trusted snapshot of policy files (path, sha256) and the files now (path, contents): added, removed or changed."""
    now = current.select("path", F.sha2(F.col("contents").cast("binary"), 256).alias("now"))
    change = F.when(F.col("sha256").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("sha256") != F.col("now"), "changed")
    return snapshot.select("path", "sha256").join(now, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def missing_lines(files: Mapping[str, Sequence[str]], wanted: Sequence[str]) -> dict[str, list[str]]:
    """For each ignore file the wanted lines it lacks, in order, each once. Configuration only."""
    return {f: [w for w in dict.fromkeys(wanted) if w not in set(lines)] for f, lines in files.items()}
