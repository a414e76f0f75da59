"""Texts rewritten at their findings: masked, restored, redacted, sealed and unsealed.

All take rows with their findings in an array (`spans.with_findings`) and give the same rows back with the text replaced,
whatever their ids are; nothing shuffles.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.catalog import ENTITY_TYPES
from veilmark.functions.seal import SEAL_LIMIT, open_token, parse_key, seal_value
from veilmark.operators.spans import let, quoted, with_tokens


def _lookup(entity_type: Column, place: int) -> Column:
    return F.create_map(*[F.lit(x) for row in ENTITY_TYPES for x in (row[0], row[place])])[entity_type]


def rebuild(text_col: str, places: str) -> Column:
    """A text with its non-overlapping places (start, end, replacement), an array in order, replaced; a null replacement gives a null text."""
    piece = f"concat(substring(`{text_col}`, b + 1, x.start - b), x.replacement)"
    pieces = "transform(p, (x, i) -> " + let("b", "coalesce(get(p, i - 1).end, 0)", piece) + ")"
    tail = f"substring(`{text_col}`, p[size(p) - 1].end + 1)"
    return F.expr(f"if(size({places}) = 0, `{text_col}`, {let('p', places, f'if(exists(p, x -> x.replacement is null), null, concat(array_join({pieces}, {quoted(str())}), {tail}))')})")


def _replaced(df: DataFrame, text_col: str, findings_col: str, replacement) -> DataFrame:
    places = f"places_{uuid4().hex[:8]}"
    rows = df.withColumn(places, F.transform(findings_col, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), replacement(f).alias("replacement"))))
    return rows.withColumn(text_col, rebuild(text_col, places)).drop(places)


def placeholders(findings_col: str) -> Column:
    """array<struct<placeholder, value>>: {{PREFIX_n}} for each different value of a text's findings, numbered by first place for
    each prefix; an equal value keeps its placeholder, whatever its later type."""
    prefixes = "map(" + ", ".join(f"'{t}', '{p}'" for t, p, *_ in ENTITY_TYPES) + ")"
    firsts = let("v", f"transform(`{findings_col}`, x -> x.value)", f"filter(`{findings_col}`, (x, i) -> array_position(v, x.value) = i + 1)")
    named = f"transform({firsts}, x -> struct(x.value as value, {prefixes}[x.entity_type] as prefix))"
    nth = "size(filter(slice(f, 1, i + 1), y -> y.prefix = x.prefix))"
    token = "concat('{{', x.prefix, '_', cast(" + nth + " as string), '}}')"
    return F.expr(let("f", named, f"transform(f, (x, i) -> struct({token} as placeholder, x.value as value))"))


def mask(df: DataFrame, text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """`df` with its texts' findings masked, and mapping map<placeholder, value> (taking the place of a column so named)."""
    names = f"names_{uuid4().hex[:8]}"
    rows = df.drop("mapping").withColumn(names, placeholders(findings_col))
    by_value = lambda f: F.get(F.filter(F.col(names), lambda n: n["value"] == f["value"]), F.lit(0))["placeholder"]
    rows = _replaced(rows, text_col, findings_col, by_value)
    return rows.withColumn("mapping", F.map_from_entries(names)).drop(names)


def restore(text: Column, mapping: Column) -> Column:
    """A masked text with every placeholder replaced by its value."""
    return F.aggregate(F.map_entries(mapping), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def redact(df: DataFrame, prefix: str = "VEIL", text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """`df` with findings replaced by <prefix>_REDACTED_<label>."""
    return _replaced(df, text_col, findings_col, lambda f: F.concat(F.lit(f"{prefix}_REDACTED_"), _lookup(f["entity_type"], 5)))


def redact_values(text: Column, values: Column) -> Column:
    """`text` with each of an array of secret values replaced by ***, the longest first."""
    ordered = F.array_sort(F.filter(values, lambda v: v != ""), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(ordered, text, lambda t, v: F.replace(t, v, F.lit("***")))


def scrub_summary(df: DataFrame, limit: int = 2 << 20, text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """One row on a redaction: texts touched, findings redacted, and texts of over `limit` bytes, which are left alone as errors."""
    large = F.octet_length(F.col(text_col)) > limit
    n = F.size(findings_col)
    return df.agg(
        F.count(F.when((n > 0) & ~large, 1)).alias("touched"), F.coalesce(F.sum(F.when(~large, n)), F.lit(0)).cast("bigint").alias("redactions"), F.count(F.when(large, 1)).alias("errors")
    )


def seal_findings(df: DataFrame, key: bytes, text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """`df` with findings sealed under their prefix; a text with one that is too large is null."""
    return _replaced(df, text_col, findings_col, lambda f: seal_value(f["value"], _lookup(f["entity_type"], 1), key))


def unseal(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """`df` with every token replaced by its value; a text with a token that doesn't open is null."""
    tokens = f"tokens_{uuid4().hex[:8]}"
    return _replaced(with_tokens(df, text_col, tokens), text_col, tokens, lambda t: open_token(t["value"], key)).drop(tokens)


__all__ = [
    "SEAL_LIMIT", "mask", "open_token", "parse_key", "placeholders", "rebuild", "redact", "redact_values", "restore", "scrub_summary",
    "seal_findings", "seal_value", "unseal",
]
