"""Encoded payloads in texts: base64, wrapped base64 and hex that decode to readable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.operators.spans import Pattern, islands, let, listed, quoted, running_totals, with_spans

#: Most decoded bytes of a blob, blobs of a text, and decoded bytes of a text.
BLOB_BYTES, TEXT_BLOBS, TEXT_BYTES = 64_000, 128, 512_000
#: A run of base64 has 24 characters, its padding counted: payloads from 16 bytes on. A wrapped run is only looked for where a run
#: starts, as from within it no other match could be had: a long run stays linear.
_SHAPES = [
    Pattern(0, "base64", "blob", 1.0, r"[A-Za-z0-9+/_-]{24,}={0,2}|[A-Za-z0-9+/_-]{23}=|[A-Za-z0-9+/_-]{22}=="),
    Pattern(1, "wrapped", "blob", 1.0, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]{16,})+={0,2}", ("\n",)),
    Pattern(2, "hex", "blob", 1.0, r"\b[0-9A-Fa-f]{32,}\b"),
]


def _decoded(kind: Column, value: Column) -> Column:
    flat = F.rtrim(F.translate(value, "-_\r\n", "+/"), F.lit("="))
    padded = F.rpad(flat, (F.ceil(F.length(flat) / 4) * 4).cast("int"), "=")
    return F.when(kind == "hex", F.when(F.length(value) % 2 == 0, F.unhex(value))).otherwise(F.try_to_binary(padded, F.lit("base64")))


def with_blobs(df: DataFrame, text_col: str = "text", column: str = "blobs") -> DataFrame:
    """`df` with an array `column` of the readable payloads of each text: start, end, kind, decoded, accepted, exceeded.

    A payload is readable if its bytes are UTF-8 of which at least three quarters are no control characters; of
    overlapping ones the longest counts. accepted ends where a text's budget of blobs or bytes does, and exceeded says
    so for the whole text, so that a gate can refuse instead of letting the rest by. Nothing shuffles; null texts have none.
    """
    rows = with_spans(df, text_col, _SHAPES, column)
    kept = [F.col(f"`{c}`") for c in rows.columns if c != column]

    def decoded(f: Column) -> Column:
        return F.struct(f["start"].alias("start"), f["end"].alias("end"), f["entity_type"].alias("kind"), _decoded(f["entity_type"], f["value"]).alias("raw"))

    rows = rows.select(*kept, F.transform(column, decoded).alias(column))
    fits = f"octet_length(x.raw) between 1 and {BLOB_BYTES} and is_valid_utf8(cast(x.raw as string))"
    rows = rows.select(*kept, F.expr(f"transform(filter(`{column}`, x -> {fits}), x -> struct(x.start as start, x.end as end, x.kind as kind, cast(x.raw as string) as decoded))").alias(column))
    control = quoted(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")
    plain = f"length(regexp_replace(x.decoded, {control}, '')) * 4 >= length(x.decoded) * 3 and rlike(x.decoded, {quoted(chr(92) + 'S')})"
    rows = rows.select(*kept, F.expr(f"sort_array(filter(`{column}`, x -> {plain}))").alias(column))
    none = "cast(array() as array<struct<start:int,end:int,kind:string,decoded:string>>)"
    touches = "exists(a, y -> o.x.start < y.end and y.start < o.x.end)"
    longest = f"aggregate(sort_array(transform(g, x -> struct(x.start - x.end as size, x as x))), {none}, (a, o) -> if({touches}, a, concat(a, array(o.x))))"
    rows = rows.select(*kept, F.expr(f"if(size(`{column}`) > 0, sort_array(flatten(transform({islands(f'`{column}`')}, g -> {longest}))), {none})").alias(column))
    totals = running_totals(f"transform(`{column}`, x -> octet_length(x.decoded))", "")
    budget = let("ok", f"transform({totals}, (n, i) -> i < {TEXT_BLOBS} and n <= {TEXT_BYTES})", f"zip_with(`{column}`, ok, (x, o) -> struct(x.start as start, x.end as end, x.kind as kind, x.decoded as decoded, o as accepted, exists(ok, y -> not y) as exceeded))")
    return rows.select(*kept, F.expr(f"if(size(`{column}`) > 0, {budget}, array())").alias(column))


def decode_blobs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The payloads as rows: doc_id, start, end, kind, decoded, accepted, exceeded."""
    rows = with_blobs(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return listed(rows, F.col("blobs"), "doc_id")
