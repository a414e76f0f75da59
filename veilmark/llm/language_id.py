"""Operator 9: language ID with bit-sliced Bloom filters of n-grams, a bit a language at every position."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import filter_texts, map_texts, written

#: Bits of a n-gram's hash are read at so many positions.
_HASHES = 3
#: Odd multipliers of the n-gram hash.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Code points of a text handled at once.
_SLICE = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: whether it is a letter, or a combining mark, which is a part of its letter."""
    return np.fromiter((chr(c).isalpha() or category(chr(c)) in ("Mn", "Mc", "Me") for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def gram_hashes(text: str | None, n: int) -> np.ndarray:
    """Hashes of the n-grams of a lower-cased text whose non-letters are blanks; uint64, with repeats.

    Runs of blanks count as one, so each word's edge is part of its n-grams. Empty if there is no letter.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found, tail = [], np.zeros(n - 1, np.uint64)
    letters = _letters()
    seen = False
    for start in range(0, max(len(points), 1), _SLICE):
        part = points[start : start + _SLICE]
        if start + _SLICE >= len(points):
            part = np.append(part, np.uint32(32))
        blank = ~letters[part]
        seen = seen or not blank.all()
        part = np.where(blank, 0, part).astype(np.uint64)
        both = np.concatenate((tail, part))
        keep = np.ones(len(both), bool)
        keep[1:] = (both[1:] != 0) | (both[:-1] != 0)
        keep[: n - 1] = True
        both = both[keep]
        tail = both[len(both) - n + 1 :]
        if len(both) < n:
            continue
        h = np.zeros(len(both) - n + 1, np.uint64)
        letters_in = np.zeros(len(h), bool)
        for i in range(n):
            piece = both[i : len(h) + i]
            h = (h ^ (piece + np.uint64(i + 1))) * _ODD[i % 4]
            h ^= h >> np.uint64(29)
            letters_in |= piece != 0
        found.append(h[letters_in])
    return np.concatenate(found) if found and seen else np.empty(0, np.uint64)


def positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter positions of each hash."""
    return [((hashes * _ODD[i]) >> np.uint64(64 - bits)).astype(np.int64) for i in range(_HASHES)]


@dataclass(frozen=True)
class LanguageFilters:
    """`slices[w][p]` holds at position p a bit for each of the languages 64w to 64w+63; `false_rate` by language."""

    languages: list[str]
    n: int
    bits: int
    slices: np.ndarray
    false_rate: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with most n-grams of the text, and the share of n-grams it has, both without the
        expected false positives; `und` and 0 without a letter or without languages. Ties: the first by name."""
        hashes = gram_hashes(text, self.n)
        if not len(hashes) or not self.languages:
            return "und", 0.0
        at = positions(hashes, self.bits)
        counts = []
        for w, words in enumerate(self.slices):
            masks = words[at[0]]
            for p in at[1:]:
                masks &= words[p]
            for bit in range(min(64, len(self.languages) - 64 * w)):
                counts.append(np.count_nonzero(masks & np.uint64(1 << bit)))
        expected = self.false_rate * len(hashes)
        true = np.maximum(0.0, (np.array(counts) - expected) / (1 - self.false_rate))
        best = int(np.argmax(true))
        return self.languages[best], float(min(1.0, true[best] / len(hashes)))


def _document_counts(docs: DataFrame, n: int) -> DataFrame:
    """(lang, gram, n_docs), added up over each task's batches before anything shuffles."""
    limit = 400_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merged(lang: str, grams: list[np.ndarray]) -> None:
            keys, counts = held.get(lang, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            new, of_new = np.unique(np.concatenate(grams), return_counts=True)
            every, place = np.unique(np.concatenate((keys, new)), return_inverse=True)
            held[lang] = every, np.bincount(place, np.concatenate((counts, of_new)), len(every)).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            keys, counts = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n_docs"])

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                by_lang: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(np.unique(gram_hashes(text, n)))
                for lang, grams in by_lang.items():
                    merged(lang, grams)
                    if len(held[lang][0]) > limit:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    partial = docs.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n_docs bigint")
    return partial.groupBy("lang", "gram").agg(F.sum("n_docs").alias("n_docs"))


def fit(docs: DataFrame, n: int = 3, min_share: float = 0.005, bits: int = 20) -> LanguageFilters:
    """Learns from the columns text and lang of `docs`, rows with a null in either left out.

    An n-gram enters a language's filter if at least `min_share` of that language's documents (and two, where
    there are over a hundred) hold it, so a language's share of the filter is bounded by its documents' length,
    not their number. Counts come from all rows; the driver gets at most 2**bits positions.
    """
    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    numbers = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)]) if languages else None
    slices = np.zeros(((len(languages) + 63) // 64, 1 << bits), np.uint64)
    if languages:
        floor = F.create_map(*[F.lit(x) for lang in languages for x in (lang, max(min_share * sizes[lang], 2 if sizes[lang] > 100 else 1))])
        grams = _document_counts(rows, n).filter(F.col("n_docs") >= floor[F.col("lang")]).select(numbers[F.col("lang")].alias("number"), "gram")
        masks = written(_position_masks(grams, bits))
        for r in masks.toLocalIterator():
            slices[r["slice"], r["position"]] = np.uint64(r["mask"] & 0xFFFFFFFFFFFFFFFF)
    fill = [np.count_nonzero(slices[i // 64] & np.uint64(1 << (i % 64))) / (1 << bits) for i in range(len(languages))]
    return LanguageFilters(languages, n, bits, slices, np.array(fill) ** _HASHES)


def _position_masks(grams: DataFrame, bits: int) -> DataFrame:
    """(slice, position, mask): the languages' bits at every position, or-ed."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = positions(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            bit = (np.uint64(1) << (number % 64).astype(np.uint64)).view(np.int64)
            for p in at:
                yield pa.RecordBatch.from_arrays([pa.array((number // 64).astype(np.int32)), pa.array(p), pa.array(bit)], ["slice", "position", "mask"])

    placed = grams.mapInArrow(place, "slice int, position bigint, mask bigint")
    return placed.groupBy("slice", "position").agg(F.bit_or("mask").alias("mask"))


def predict(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, lang_pred, score (0 to 1), row by row from the whole text alone.

    A null text, and one without a letter, is `und` with score 0. Repeated rows get a row each. The filters
    (2**bits words for each 64 languages: a fixed size) are broadcast; nothing shuffles.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    id_type = dict(docs.dtypes)[id_col]

    def run(ids: list, texts: list) -> dict:
        found = [sent.value.predict(t) for t in texts]
        return {"doc_id": ids, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_texts(docs, run, f"doc_id {id_type}, lang_pred string, score double", id_col, text_col)


def keep_known_languages(docs: DataFrame, filters: LanguageFilters, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text is `und`, or has under `min_score` of its n-grams in its best language.

    Null texts and texts without a letter are `und`: they go. Each row is decided by its text alone, so repeated
    rows share their lot; without any learned language all rows go; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def keep(texts: list) -> list:
        return [lang != "und" and score >= min_score for lang, score in map(sent.value.predict, texts)]

    return filter_texts(docs, keep, text_col)
