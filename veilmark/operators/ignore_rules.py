"""Ignore rules as rows: paths of many repositories against the lines of their ignore files, by hash joins.

A line is found by a key that every path it covers has: a whole path or folder, a name, an ending, or the folder a glob
starts in. Each path has a few such keys; equal keys meet, and globs are then verified. No path meets a rule that
shares no key with it, and no rule is compiled into the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule rows up to this number are broadcast (some 200 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 50_000


def glob_regex(glob: Column) -> Column:
    """The regex, without anchors, of a column of globs: `**/` any folders or none, `**` anything, `*` and `?` within a name."""
    out = F.regexp_replace(glob, r"([\\.+^$|(){}\[\]])", r"\\$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*/", "\x01"), r"\*\*", "\x02")
    out = F.regexp_replace(F.regexp_replace(out, r"\*", "\x03"), r"\?", "\x04")
    for mark, regex in (("\x01", "(?:.*/)?"), ("\x02", ".*"), ("\x03", "[^/]*"), ("\x04", "[^/]")):
        out = F.replace(out, F.lit(mark), F.lit(regex))
    return out


def compiled(lines: DataFrame) -> DataFrame:
    """Lines (repo, file, line) as rules: repo, file, negated, kind, key, regex (null: the key decides alone).

    Blanks around a line don't count; empty lines, comments and lines without a name are left out, and a line that
    a file repeats is one. kind is path (the key is a path or a folder above), name (a part of the path), ending
    (what follows a name's last dot), folder (the part of an anchored glob before its first wildcard) or any.
    """
    rows = lines.select("repo", "file", F.trim("line").alias("line")).filter("line is not null and line != '' and not startswith(line, '#')")
    negated = F.col("line").startswith("!") & (F.length("line") > 1)
    rows = rows.select("repo", "file", negated.alias("negated"), F.trim(F.when(negated, F.substr("line", F.lit(2))).otherwise(F.col("line"))).alias("p"))
    first = F.col("p").startswith("/")
    rows = rows.select("repo", "file", "negated", first.alias("first"), F.regexp_replace(F.regexp_replace("p", "^/", ""), "/$", "").alias("p")).filter("p != ''").distinct()
    wild, anchored = F.col("p").rlike(r"[*?]"), F.col("first") | F.contains("p", F.lit("/"))
    ending = F.regexp_extract("p", r"\.([^.*?/]+)$", 1)
    folder = F.regexp_extract("p", r"^((?:[^/*?]*/)*)[^/]*[*?]", 1)
    kind = F.when(anchored & ~wild, "path").when(anchored, "folder").when(~wild, "name").when(ending != "", "ending").otherwise("any")
    key = F.when(kind.isin("path", "name"), F.col("p")).when(kind == "folder", F.regexp_replace(folder, "/$", "")).when(kind == "ending", ending).otherwise("")
    whole = F.when(anchored, F.concat(F.lit("^"), glob_regex(F.col("p")), F.lit("$"))).otherwise(F.concat(F.lit("(?:^|/)"), glob_regex(F.col("p")), F.lit("(?:/|$)")))
    return rows.select("repo", "file", "negated", kind.alias("kind"), key.alias("key"), F.when(wild, whole).alias("regex"))


def _keys(path: Column) -> Column:
    """array<struct<kind, key>>: all keys by which a rule can reach a path, each once."""
    parts = F.split(path, "/")
    names = F.array_distinct(F.filter(parts, lambda s: s != ""))
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    endings = F.array_distinct(F.filter(F.transform(names, lambda s: F.regexp_extract(s, r"\.([^.]+)$", 1)), lambda s: s != ""))

    def of(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    folders = F.concat(F.array(F.lit("")), F.slice(above, F.lit(1), F.size(parts) - 1))
    return F.concat(of("path", above), of("name", names), of("ending", endings), of("folder", F.array_distinct(folders)), F.array(F.struct(F.lit("any").alias("kind"), F.lit("").alias("key"))))


def covered_by(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, path, file) for every ignore file that covers a path of its repository: one of its lines does and no `!` line does.

    Equal paths of a repository are one. A repository or path that is null has no rules. Skew: the keys of a large
    repository are as many as its paths, so its rows spread; a key that many of them share (`any`, an ending) meets the
    rules as a broadcast while these are few, else in a join that adaptive execution may split; what is left
    combines before the last shuffle.
    """
    rules = compiled(lines)
    known = F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules
    rows = paths.select("repo", "path").filter("repo is not null and path is not null").distinct()
    keyed = rows.select("repo", "path", F.inline(_keys(F.col("path"))))
    met = keyed.join(known, ["repo", "kind", "key"]).filter(F.col("regex").isNull() | F.rlike("path", F.col("regex")))
    by_file = met.groupBy("repo", "path", "file").agg(F.bool_or(~F.col("negated")).alias("hit"), F.bool_or("negated").alias("back"))
    return by_file.filter("hit and not back").select("repo", "path", "file")


def with_ignored(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """`paths` (repo, path, more columns) with `ignored`: whether any ignore file of the repository covers the path, and by how many `n_files`."""
    found = covered_by(paths, lines).groupBy("repo", "path").agg(F.count("*").alias("n_files"))
    return paths.drop("n_files", "ignored").join(found, ["repo", "path"], "left").withColumns({"ignored": F.col("n_files").isNotNull(), "n_files": F.coalesce("n_files", F.lit(0).cast("bigint"))})
