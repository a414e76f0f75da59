"""Managed blocks of ignore files: marked sections that the library writes, kept apart from a user's own lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def markers(product: str = "veilmark", section: str | None = None) -> tuple[str, str]:
    name = f" [{section}]" if section else ""
    return f"# >>> {product} managed{name} >>>", f"# <<< {product} managed{name} <<<"


def normalise_patterns(lines: list[str]) -> list[str]:
    """Trimmed lines without empty ones and comments, each once, in order."""
    return list(dict.fromkeys(x for x in map(str.strip, lines) if x and not x.startswith("#")))


def find_blocks(lines: list[str], start: str, end: str) -> list[tuple[int, int]] | None:
    """(first, last) line of each block; None if one is opened twice, never closed, or closed unopened."""
    out, opened = [], None
    for i, line in enumerate(lines):
        if line.strip() == start:
            if opened is not None:
                return None
            opened = i
        elif line.strip() == end:
            if opened is None:
                return None
            out.append((opened, i))
            opened = None
    return None if opened is not None else out


def _outside(lines: list[str], blocks: list[tuple[int, int]], instead: list[str]) -> list[str]:
    """Lines with the first block replaced and the others left out."""
    out: list[str] = []
    for i, line in enumerate(lines):
        inside = next((b for b in blocks if b[0] <= i <= b[1]), None)
        if inside is None:
            out.append(line)
        elif i == blocks[0][0]:
            out += instead
    return out


def upsert(contents: str | None, patterns: list[str], product: str = "veilmark", section: str | None = None) -> tuple[str, str]:
    """(contents, result) with the block written: created, updated, unchanged or malformed."""
    start, end = markers(product, section)
    block = [start, *normalise_patterns(patterns), end]
    if contents is None:
        return "\n".join(block) + "\n", "created"
    closed = contents if contents.endswith("\n") else contents + "\n"
    lines = contents.splitlines()
    blocks = find_blocks(lines, start, end)
    if blocks is None:
        return closed, "malformed"
    new = _outside(lines, blocks, block) if blocks else [*lines, *([""] if lines and lines[-1] else []), *block]
    text = "\n".join(new) + "\n"
    return text, "unchanged" if text == closed else "updated"


def remove(contents: str, product: str = "veilmark", section: str | None = None) -> str | None:
    """Contents without the blocks; None if there is none or they are malformed."""
    lines = contents.splitlines()
    blocks = find_blocks(lines, *markers(product, section))
    if not blocks:
        return None
    rest = "\n".join(_outside(lines, blocks, [])).rstrip("\n")
    return rest + "\n" if rest else ""


def upsert_column(contents: Column, patterns: Column, product: str = "veilmark") -> Column:
    """struct<contents, result> for files and their wanted patterns."""

    @F.pandas_udf("contents string, result string")
    def run(files: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([upsert(f, list(w if w is not None else []), product) for f, w in zip(files, wanted, strict=True)], columns=["contents", "result"])

    return run(contents, patterns)


def block_patterns(contents: Column, product: str = "veilmark") -> Column:
    """The lines of the first block, normalised; null if there is none."""
    start, end = (m.replace("[", r"\[").replace("]", r"\]") for m in markers(product))
    inner = F.regexp_extract(contents, rf"(?s){start}\r?\n(.*?){end}", 1)
    lines = F.transform(F.split(inner, r"\r?\n"), F.trim)
    return F.when(contents.rlike(rf"(?s){start}\r?\n.*?{end}"), F.array_distinct(F.filter(lines, lambda x: ~x.rlike("^(?:#|$)"))))
