"""The scan of very long texts: one text as many tasks, by overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilmark.operators.spans import detect, listed, with_findings

#: Characters of a window, and by how many it begins before its own part and ends behind it.
WINDOW, OVERLAP = 200_000, 8192
_FAR, _BLANKS = 64, " \n"
#: Characters of windows that are handed on at once, and the most windows.
_HANDED, _MOST = 1 << 20, 4096


def cut(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows of texts: doc_id, own_start, own_end, start, text; offsets are characters.

    Each window's own part follows the one before. A window goes on to the next blank or line end beyond its overlap on
    either side (at most _FAR overlaps away), so that no word is cut. A null text has none.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    schema = StructType([rows.schema.fields[0], *StructType.fromDDL("own_start int, own_end int, start int, text string").fields])
    arrow_schema = to_arrow_schema(schema)

    def bounds(text: str, own: int, end: int) -> tuple[int, int]:
        start, stop = max(0, own - overlap), min(len(text), end + overlap)
        far_start, far_stop = max(0, start - _FAR * overlap), min(len(text), stop + _FAR * overlap)
        before = max(text.rfind(c, far_start, start) for c in _BLANKS) + 1
        after = min((p for p in (text.find(c, stop, far_stop) for c in _BLANKS) if p >= 0), default=-1)
        return (before if before else far_start), (after if after >= 0 else far_stop)

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), arrow_schema, strict=True)], schema=arrow_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text = (batch.column(c)[i].as_py() for c in range(2))
                for own in range(0, max(len(text), 1), window):
                    end = min(own + window, len(text))
                    start, stop = bounds(text, own, end)
                    held.append((doc, own, end, start, text[start:stop]))
                    size += stop - start
                    if size >= _HANDED or len(held) >= _MOST:
                        yield handed(held)
                        held, size = [], 0
        if held:
            yield handed(held)

    return rows.mapInArrow(run, schema)


def window_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, overlap: int = OVERLAP, **options) -> DataFrame:
    """What `spans.detect` finds (doc_id, start, end, entity_type, value, confidence, source, rule_ord), a text of any length over many tasks.

    Texts of at most `window` characters are scanned where they are. Of longer ones, windows are dealt out, and a
    finding counts in the window whose own part it starts in, so none counts twice. As windows end at blanks, what holds
    none is never cut; a match over several words or lines (a private key) is found if it goes no more than `overlap`
    characters beyond the part it starts in. Null texts have none, ids may repeat; `options` are those of
    `spans.with_findings`.
    """
    long = F.coalesce(F.length(text_col) > window, F.lit(False))
    short = detect(df.filter(~long), id_col, text_col, **options)
    windows = cut(df.filter(long), id_col, text_col, window, overlap).withColumnRenamed("start", "begins")
    windows = windows.repartition(F.xxhash64("doc_id", "own_start", F.length("text")))
    found = listed(with_findings(windows, "text", **options), F.col("findings"), "doc_id", "own_start", "own_end", "begins")
    found = found.withColumns({"start": F.col("start") + F.col("begins"), "end": F.col("end") + F.col("begins")})
    return short.unionByName(found.filter("start >= own_start and start < own_end").drop("own_start", "own_end", "begins"))
