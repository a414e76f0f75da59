"""Operator 13: quality rules: fixed base rules, and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import map_texts, written

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 8
#: Lengths of the character n-grams; words count alone and in pairs.
_GRAMS = (2, 3, 4)
#: Code points of a text whose n-grams are handled at once.
_SLICE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashed(values: np.ndarray, bits: int) -> np.ndarray:
    mixed = values * _ODD
    return ((mixed ^ (mixed >> np.uint64(29))) * _ODD >> np.uint64(64 - bits)).astype(np.int64)


class Words:
    """Numbers for the words of one slice of a batch: equal words have equal numbers, and each its hash."""

    def __init__(self) -> None:
        self._numbers: defaultdict[bytes, int] = defaultdict(count().__next__)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._numbers.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, self._numbers), np.uint64, len(self._numbers))


def repeated_words(numbers: np.ndarray) -> int:
    """Words that lie in a window of eight which stands twice or more in the text, the first one included; exact."""
    if len(numbers) <= _WINDOW:
        return 0
    ids, width = numbers, 1
    while width < _WINDOW:  # equal windows of twice the width are equal pairs of windows
        _, ids = np.unique(ids[:-width] * np.int64(int(ids.max()) + 1) + ids[width:], return_inverse=True)
        width *= 2
    often = np.flatnonzero(np.bincount(ids)[ids] > 1)
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, often, 1)
    np.add.at(change, often + _WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(change)[:-1]))


def base_counts(data: bytes, numbers: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text in UTF-8 with these word numbers."""
    inside = data.translate(None, _SPACE)
    points = len(inside.decode("utf-8", "surrogatepass"))
    lines = [line for line in data.split(b"\n") if line.strip(_SPACE)]
    return points, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(numbers)


def gram_slots(text: str, numbers: np.ndarray, hashes: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, slots) of a text's n-grams, in bounded pieces: kind 0 words and pairs of them, kind 1 characters.

    Words have the slots up to 2**bits, characters those behind.
    """
    words = hashes[numbers]
    for start in range(0, len(words), _SLICE):
        piece = words[start : start + _SLICE + 1]
        yield 0, _hashed(piece[:_SLICE], bits)
        yield 0, _hashed(piece[:-1] * _ODD + piece[1:] + np.uint64(1), bits)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for n in _GRAMS:
        for start in range(0, len(points) - n + 1, _SLICE):
            piece = points[start : start + _SLICE + n - 1].astype(np.uint64)
            mixed = np.full(len(piece) - n + 1, n, np.uint64)
            for i in range(n):
                mixed = mixed * np.uint64(0x100000001B3) + piece[i : len(mixed) + i]
            yield 1, _hashed(mixed, bits) + (1 << bits)


@dataclass(frozen=True)
class QualityModel:
    """A text's margin is `bias` plus the mean weight of its word n-grams plus that of its character n-grams;
    its probability of good quality is the logistic function of `slope` * margin + `shift`."""

    bits: int
    coefficients: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: str, numbers: np.ndarray, hashes: np.ndarray) -> float:
        total, grams = [0.0, 0.0], [0, 0]
        for kind, slots in gram_slots(text, numbers, hashes, self.bits):
            total[kind] += float(self.coefficients[slots].sum())
            grams[kind] += len(slots)
        return self.bias + sum(t / max(n, 1) for t, n in zip(total, grams, strict=True))

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -700, 700))))


def _prepared(texts: list) -> tuple[list[tuple[str, bytes, np.ndarray]], np.ndarray]:
    """(text, UTF-8, word numbers) of each text (null: empty), and the hashes of all words of the slice."""
    known = Words()
    rows = [(t or "", (t or "").encode("utf-8", "surrogatepass")) for t in texts]
    return [(t, data, known.of(data.split())) for t, data in rows], known.hashes()


def training_rows(
    docs: DataFrame, labels: DataFrame, max_per_class: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """(doc_id, text, label, weight, fold 0-4): at most `max_per_class` labelled documents of each class, a written table.

    Labels other than 0 and 1, nulls, and ids with both labels are left out. Which ids are taken, and their fold, a
    hash of the id decides. A row's weight is its class's labelled ids over those taken, so the classes keep their
    shares whatever the bound. Of documents that repeat an id, the smallest text counts once.
    """
    given = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
    given = given.filter("label = other and label_id is not null").select("label_id", F.col("label").cast("double").alias("label"), F.xxhash64("label_id").alias("lot"))
    given = written(given)
    total = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count("*").alias("n")).collect()}
    taken = None
    for label in (0.0, 1.0):
        some = given.filter(F.col("label") == label).orderBy("lot", "label_id").limit(max_per_class)
        some = some.withColumn("weight", F.lit(max(1.0, total.get(label, 0) / max_per_class)))
        taken = some if taken is None else taken.unionByName(some)
    taken = F.broadcast(written(taken))  # at most 2 * max_per_class rows of 30 bytes
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    rows = rows.join(taken, F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("weight").alias("weight"), F.first("lot").alias("lot"))
    return written(rows.select("doc_id", "text", "label", "weight", F.pmod("lot", F.lit(5)).cast("int").alias("fold")))


def fit(
    docs: DataFrame, labels: DataFrame, max_per_class: int = 5_000, bits: int = 16, penalty: float = 1e-2, rounds: int = 40,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> QualityModel | None:
    """Learns good quality (1) from bad (0) by Spark's logistic regression, on a documented bound of labelled rows.

    Four folds of five teach the weights, the fifth calibrates them (Platt: a logistic regression on the margin). A
    document's features are the shares of its hashed n-grams: 2**bits slots for words, as many for characters.
    None if a class is missing in either part, so that there is nothing to learn.
    """
    from pyspark.ml.classification import LogisticRegression  # here, so that workers which only score do without
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors, VectorUDT

    rows = training_rows(docs, labels, max_per_class, id_col, text_col, label_col)
    classes = rows.select((F.col("fold") == 4).alias("held"), "label", "weight").distinct().collect()
    if len(classes) < 4:
        return None
    of_class = {r["label"]: r["weight"] for r in classes}
    weight = F.when(F.col("label") == 1, of_class[1.0]).otherwise(of_class[0.0]).alias("weight")
    slots = 2 << bits

    def shares(rows_of: list, texts: list) -> dict:
        prepared, hashes = _prepared(texts)
        at, values = [], []
        for text, _, numbers in prepared:
            counts, total = np.zeros(slots, np.float64), [0, 0]
            for kind, found in gram_slots(text, numbers, hashes, bits):
                counts += np.bincount(found, minlength=slots)
                total[kind] += len(found)
            held = np.flatnonzero(counts)
            at.append(held)
            values.append(counts[held] / np.where(held < 1 << bits, max(total[0], 1), max(total[1], 1)))
        return {"label": rows_of, "at": at, "shares": values}

    vector = F.udf(lambda at, values: Vectors.sparse(slots, at, values), VectorUDT())  # for the bounded sample alone
    taught = map_texts(rows.filter("fold < 4"), shares, "label double, at array<int>, shares array<double>", "label", "text")
    taught = written(taught).select("label", weight, vector("at", "shares").alias("features"))
    model = LogisticRegression(maxIter=rounds, regParam=penalty, tol=1e-5, weightCol="weight").fit(taught)
    plain = QualityModel(bits, np.asarray(model.coefficients.toArray()), float(model.intercept))
    sent = docs.sparkSession.sparkContext.broadcast(plain)

    def margins(rows_of: list, texts: list) -> dict:
        prepared, hashes = _prepared(texts)
        return {"label": rows_of, "margin": [sent.value.margin(text, numbers, hashes) for text, _, numbers in prepared]}

    held = written(map_texts(rows.filter("fold = 4"), margins, "label double, margin double", "label", "text"))
    platt = LogisticRegression(maxIter=50, regParam=1e-4, weightCol="weight").fit(held.select("label", weight, array_to_vector(F.array("margin")).alias("features")))
    return QualityModel(bits, plain.coefficients, plain.bias, float(platt.coefficients[0]), float(platt.intercept))


def quality(
    docs: DataFrame, model: QualityModel | None, min_probability: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability.

    Words are what ASCII white space parts. A row fails the base rules with fewer than `min_words` words, or if over
    `max_repeat_percent` hundredths of its words lie in eight-word windows that stand twice in it. It is kept if it
    does not, and if the model gives it at least `min_probability`; without a model (None) the base rules decide
    alone and the probability is null. Each row is judged by its whole text alone: a null text is empty, repeated
    rows get a row each, other columns are not read, an empty table gives no rows. The model (2**(bits+1)
    weights, 1 MiB by default) is broadcast; nothing shuffles.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids: list, texts: list) -> dict:
        prepared, hashes = _prepared(texts)
        out: dict[str, list] = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")}
        for text, data, numbers in prepared:
            chars, symbols, lines, repeats = base_counts(data, numbers)
            failed = len(numbers) < min_words or 100 * repeats > max_repeat_percent * len(numbers)
            sure = sent.value.probability(sent.value.margin(text, numbers, hashes)) if sent.value else None
            row = len(numbers), chars, symbols, lines, repeats, failed, not failed and (sure is None or sure >= min_probability), sure
            for values, value in zip(out.values(), row, strict=True):
                values.append(value)
        return {"doc_id": ids, **out}

    id_type = dict(docs.dtypes)[id_col]
    longs = ", ".join(f"{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return map_texts(docs, run, f"doc_id {id_type}, {longs}, base_failed boolean, kept boolean, probability double", id_col, text_col)
