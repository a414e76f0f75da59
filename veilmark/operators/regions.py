"""Where values stand in page texts, case and accents set aside, and which values stand nowhere."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@lru_cache(maxsize=1 << 16)
def _letter(c: str) -> str:
    """A character in lower case without its accents; empty for a mark that stands alone."""
    return "".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x) != "Mn")


def folded(text: str) -> tuple[str, list[int] | range]:
    """A text in lower case without accents, and where each of its characters comes from."""
    if text.isascii():
        return text.lower(), range(len(text))
    letters = [_letter(c) for c in text]
    return "".join(letters), [i for i, x in enumerate(letters) for _ in x]


def places(text: str, values: dict[str, list], automaton: ahocorasick.Automaton) -> Iterator[tuple[int, int, str]]:
    """(start, end, folded value) of all values in a text; places of one value don't overlap, of different ones may."""
    low, origin = folded(text)
    reach: dict[str, int] = {}
    for last, value in automaton.iter(low):
        start = last - len(value) + 1
        if start < reach.get(value, 0):
            continue
        reach[value] = last + 1
        end = origin[last] + 1
        while end < len(text) and unicodedata.category(text[end]) == "Mn":
            end += 1
        yield origin[start], end, value


#: Places that a task gathers before it hands them on.
_PLACES = 1 << 14


def _searched(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The places in batches of (doc_id, page, text, wanted), handed on before they are many, in the midst of a text too."""
    known, automaton, by_value = None, None, {}
    found: list[list] = [[] for _ in schema]
    for batch in batches:
        for row in range(batch.num_rows):
            doc, page, text, wanted = (batch.column(c)[row].as_py() for c in range(4))
            if wanted != known:
                known, automaton, by_value = wanted, ahocorasick.Automaton(), {}
                for w in wanted:
                    low = folded(w["value"])[0]
                    if low:
                        by_value.setdefault(low, w["value_id"])
                for low in by_value:
                    automaton.add_word(low, low)
                automaton.make_automaton()
            if not by_value:
                continue
            for start, end, low in places(text, by_value, automaton):
                for column, value in zip(found, (doc, page, by_value[low], start, end), strict=True):
                    column.append(value)
                if len(found[0]) >= _PLACES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)
                    found = [[] for _ in schema]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)


def find_regions(pages: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, page, value_id, start, end): every place in a document's pages where one of its values stands.

    `pages` are (doc_id, page, text), `values` (doc_id, value_id, value); equal values of a document, case and accents
    set aside, are one, with the smallest value_id. Offsets are characters of the page's own text, accents that follow
    as marks included. A page is searched once for all values of its document. Null texts hold nothing; null and
    empty values, and such of marks alone, stand nowhere; nothing is found across two pages.
    """
    ids = dict(values.dtypes)["value_id"]
    kinds = dict(pages.dtypes)
    by_doc = values.filter("value is not null and value != '' and doc_id is not null").groupBy("doc_id", "value").agg(F.min("value_id").alias("value_id"))
    by_doc = by_doc.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("value_id", "value"))).alias("wanted"))
    rows = pages.select("doc_id", "page", "text").filter("text is not null").join(by_doc, "doc_id")
    out = f"doc_id {kinds['doc_id']}, page {kinds['page']}, value_id {ids}, start int, end int"

    schema = to_arrow_schema(StructType.fromDDL(out))
    return rows.select("doc_id", "page", "text", "wanted").mapInArrow(lambda batches: _searched(batches, schema), out)


def redaction_plan(pages: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, value_id, value, n_regions, n_pages, resolved): what of each value can be redacted; unresolved ones stand on no page.

    Values that are the same but for case and accents share their places.
    """
    regions = find_regions(pages, values).groupBy("doc_id", "value_id").agg(F.count("*").alias("n_regions"), F.count_distinct("page").alias("n_pages"))

    @F.pandas_udf("string")
    def fold(given: pd.Series) -> pd.Series:
        return given.map(lambda v: folded(v)[0], na_action="ignore")

    named = values.withColumn("low", fold("value"))
    first = named.filter("low != ''").groupBy("doc_id", "low").agg(F.min(F.struct("value_id", "value")).alias("f")).select("doc_id", "low", F.col("f.value_id").alias("as_id"))
    rows = named.join(first, ["doc_id", "low"], "left").join(regions.withColumnRenamed("value_id", "as_id"), ["doc_id", "as_id"], "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("doc_id", "value_id", "value", F.coalesce("n_regions", zero).alias("n_regions"), F.coalesce("n_pages", zero).alias("n_pages"), F.col("n_regions").isNotNull().alias("resolved"))


def redact_regions(pages: DataFrame, regions: DataFrame, mark: str = "█") -> DataFrame:
    """`pages` with every character of their regions replaced by `mark`; overlapping regions are one. Offsets stay as they are."""
    spans = regions.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = pages.join(spans, ["doc_id", "page"], "left")
    piece = "concat(a.text, substring(text, a.at + 1, greatest(s.start - a.at, 0)), repeat('{m}', greatest(s.end - greatest(a.at, s.start), 0)))".format(m=mark)
    done = F.expr(f"aggregate(spans, struct(0 as at, '' as text), (a, s) -> struct(greatest(a.at, s.end) as at, {piece} as text), a -> concat(a.text, substring(text, a.at + 1)))")
    return rows.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done)).drop("spans")
