"""Operator 11: importance resampling towards a target distribution over hashed word runs, in two Arrow passes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import bound_batches, map_texts, parts, words_of, written
from veilmark.llm.ranking import numbered


class _Buckets(dict):
    """The bucket of a feature, worked out once; one of these lives as long as one slice of a batch."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def features(text: str | None, longest: int) -> tuple[int, list[bytes]]:
    """The number of words of a text, and its runs of 1 to `longest` consecutive words; none for null or without a word."""
    joined = words_of(text)
    words = joined.split(b" ") if joined else []
    runs = list(words)
    for n in range(2, longest + 1):
        runs += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), runs


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000, longest: int = 1) -> np.ndarray:
    """Pass one: how often each bucket is hit by the features of all rows, repeats counted.

    Each partition adds its np.bincount vectors up to one of `buckets` numbers, whatever its size, and treeReduce
    merges these on the executors; the driver gets a few. A table without rows, or without partitions, has zeros.
    """
    bound_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in parts(batch, 0):
                known = _Buckets(buckets)
                for text in part.column(0).to_pylist():
                    _, runs = features(text, longest)
                    total += np.bincount(np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)), minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    vectors = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "counts binary")
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return vectors.rdd.map(lambda row: np.frombuffer(row[0], np.int64)).union(none).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, the floor of 1000 times the log of its share in the target over its share in the source, both plus one."""
    buckets = len(source)
    held, wanted = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(t + 1) * held) / (float(s + 1) * wanted))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """Pass two: doc_id, n_words, n_features and weight (the floored mean gain of the features; 0 without any) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(ids: list, texts: list) -> dict:
        known = _Buckets(len(sent.value))
        found = [features(t, longest) for t in texts]
        sizes = np.array([len(runs) for _, runs in found], np.int64)
        at = np.fromiter((known[r] for _, runs in found for r in runs), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        sums = np.bincount(owner, sent.value[at], len(texts)).astype(np.int64)  # whole numbers far below 2**53
        return {"doc_id": ids, "n_words": [n for n, _ in found], "n_features": sizes, "weight": sums // np.maximum(sizes, 1)}

    id_type = dict(docs.dtypes)[id_col]
    return map_texts(docs, run, f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint", id_col, text_col)


def noise(doc_id: Column, seed: str) -> Column:
    """A row's Gumbel noise in thousandths, rounded down: the same for every run of the same seed and id (null: empty)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(uniform)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024",
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_features, weight, score, and rank if it is drawn, else null.

    Of the rows with at least `min_words` words, `percent` hundredths (rounded down) with the highest scores are
    drawn, without replacement (Gumbel top-k); their ranks run from 1 by falling score, ties to the smaller doc_id
    (null last), and ties in that too in a fixed order. Scores are whole numbers of a bounded range (logs of
    ratios of 64-bit counts and of 32-bit noise, in thousandths: under 200,000 values), so their histogram tells
    the driver where the draw ends; only rows up to there are sorted, by ranges. Null texts have no features and weight
    0; an empty table gives no rows, and an empty target has all buckets at the same count. Repeated rows are rows
    of their own; other columns are not read. A lost executor costs its partitions of a pass, no more.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    weighed = weights(docs, gain, id_col, text_col, longest)
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("tie", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= min_words)
    histogram = sorted(((r["score"], r["n"]) for r in able.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in histogram) * percent // 100
    seen, last = 0, None
    for score, n in histogram:
        if seen >= wanted:
            break
        seen, last = seen + n, score
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    up_to = (F.col("n_words") >= min_words) & (F.col("score") >= last)
    drawn = numbered(scored.filter(up_to), [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie").asc()])
    drawn = drawn.select(*out, F.when(F.col("at") < wanted, F.col("at") + 1).alias("rank"))
    return drawn.unionByName(scored.filter(~up_to).select(*out, F.lit(None).cast("bigint").alias("rank")))
