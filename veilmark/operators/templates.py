"""Exclude lists of many repositories, completed by the templates that each of them asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.functions.template_tables import ALIASES, TEMPLATES


def template_of(name: Column) -> Column:
    """The template that a name or another name of it means, whatever its case; null if none does."""
    known = {**{t: t for t in TEMPLATES}, **ALIASES}
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.lower(F.trim(name))]


def chosen_templates(choices: DataFrame) -> DataFrame:
    """Choices (repo, n, raw: names with commas between) as rows repo, place, name, template: `common` first, each template once, in order.

    A name that is none has template null and a row of its own, so that it can be told; empty names don't count. A
    repository with a choice, if an empty one, has `common`.
    """
    names = choices.select("repo", "n", F.posexplode(F.split(F.coalesce("raw", F.lit("")), ",")).alias("m", "name")).select("repo", "n", "m", F.trim("name").alias("name")).filter("name != ''")
    asked = names.select("repo", F.struct(F.lit(1).alias("later"), "n", "m").alias("rank"), "name", template_of(F.col("name")).alias("template"))
    none = F.struct(F.lit(0).alias("later"), F.lit(None).cast(dict(choices.dtypes)["n"]).alias("n"), F.lit(0).alias("m"))
    always = choices.select("repo").distinct().select("repo", none.alias("rank"), F.lit("common").alias("name"), F.lit("common").alias("template"))
    rows = always.unionByName(asked).groupBy("repo", F.coalesce("template", F.lower("name")).alias("key"), F.col("template").isNull().alias("unknown"))
    rows = rows.agg(F.min("rank").alias("rank"), F.min_by("name", "rank").alias("name"), F.first("template").alias("template"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("rank"))
    return rows.select("repo", place.alias("place"), "name", "template")


def template_patterns(choices: DataFrame) -> DataFrame:
    """(repo, n, pattern): the patterns of the templates that each repository asks for, each once, in the order of templates."""
    table = F.create_map(*[x for t, patterns in TEMPLATES.items() for x in (F.lit(t), F.array(*map(F.lit, patterns)))])
    rows = chosen_templates(choices).filter("template is not null").select("repo", "place", F.posexplode(table[F.col("template")]).alias("k", "pattern"))
    rows = rows.groupBy("repo", "pattern").agg(F.min(F.struct("place", "k")).alias("rank"))
    return rows.select("repo", F.row_number().over(Window.partitionBy("repo").orderBy("rank")).alias("n"), "pattern")


def merge_excludes(existing: DataFrame, additional: DataFrame) -> DataFrame:
    """Lists (repo, n, pattern) completed by others: repo, n, pattern, added. A repository's own patterns stay as they are, in
    their order, repeated ones too; what it lacks follows, each once, in the order of the additional ones."""
    own = existing.select("repo", F.struct(F.lit(0).alias("later"), F.col("n").cast("bigint").alias("n")).alias("rank"), "pattern", F.lit(False).alias("added"))
    more = additional.groupBy("repo", "pattern").agg(F.min("n").cast("bigint").alias("n"))
    more = more.join(existing.select("repo", "pattern").distinct(), ["repo", "pattern"], "left_anti")
    rows = own.unionByName(more.select("repo", F.struct(F.lit(1).alias("later"), "n").alias("rank"), "pattern", F.lit(True).alias("added")))
    return rows.select("repo", F.row_number().over(Window.partitionBy("repo").orderBy("rank", "pattern")).alias("n"), "pattern", "added")
