"""Operator 2: n-gram Jaccard self-join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilmark.llm.common import BROADCAST_KEYS, bound_batches, drop_rows, map_texts, parts, row_key, words_of, written
from veilmark.llm.components import connected_components
from veilmark.llm.shingles import gram_hashes, mix, word_hashes

#: Members of a bucket, and n-grams of theirs, that are compared at once; larger buckets are split into blocks and pairs of blocks.
_BLOCK, _BLOCK_GRAMS = 512, 400_000


def bands_and_rows(threshold: float, recall: float, max_rows: int = 5) -> tuple[int, int]:
    """The number of bands, and of rows in each, so that a pair at the threshold meets with at least `recall`."""
    hit = threshold**max_rows
    return math.ceil(math.log(1 - recall) / math.log(1 - hit)), max_rows


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(grams: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest product with each multiplier over a set of (already mixed) gram hashes."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 2048):
        np.minimum(low, np.multiply.outer(multipliers, grams[start : start + 2048]).min(axis=1), out=low)
    return low


def _sketches(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, size, low, high, bands): number of grams, a 128-bit hash of the set, band hashes."""
    multipliers = _multipliers(bands * rows)
    order = _multipliers(rows + bands)

    def sketch(ids: list, texts: list) -> dict:
        out: dict[str, list] = {"doc_id": ids, "size": [], "low": [], "high": [], "bands": []}
        for words in word_hashes([words_of(t) for t in texts]):
            grams = np.unique(gram_hashes(words, n))
            out["size"].append(len(grams))
            out["low"].append(int(mix(grams).sum(dtype=np.uint64).view(np.int64)))
            out["high"].append(int(mix(grams ^ order[0]).sum(dtype=np.uint64).view(np.int64)))
            hashes = mix((signature(grams, multipliers).reshape(bands, rows) * order[:rows]).sum(axis=1, dtype=np.uint64) + order[rows:])
            out["bands"].append(hashes.view(np.int64).tolist() if len(grams) else [])
        return out

    id_type = dict(docs.dtypes)[id_col]
    texts = docs.select(F.struct(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key")).alias("id"), F.col(text_col).alias("text"))
    found = map_texts(texts, sketch, f"doc_id struct<id: {id_type}, key: string>, size int, low bigint, high bigint, bands array<bigint>", "id", "text")
    return found.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.key").alias("row_key"), "size", "low", "high", "bands")


def _together(numbers: list[np.ndarray]) -> np.ndarray:
    """For each pair of sets of numbers, how many they share: products of membership matrices, a slice of numbers at a time."""
    owner = np.repeat(np.arange(len(numbers)), [len(s) for s in numbers])
    _, number, counts = np.unique(np.concatenate(numbers), return_inverse=True, return_counts=True)
    shared = counts[number] > 1
    renumber = np.cumsum(counts > 1) - 1
    owner, number = owner[shared], renumber[number[shared]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    out = np.zeros((len(numbers), len(numbers)), np.float32)
    last = int(number[-1]) + 1 if len(number) else 0
    for start in range(0, last, 2048):
        a, b = np.searchsorted(number, (start, start + 2048))
        has = np.zeros((len(numbers), min(2048, last - start)), np.float32)
        has[owner[a:b], number[a:b] - start] = 1
        out += has @ has.T
    return out


def similar(sets: list[np.ndarray], threshold: float, split: int | None = None) -> np.ndarray:
    """The matrix of pairs (i < j) of sets with Jaccard similarity of at least the threshold; with `split`, i < split <= j only."""
    sizes = np.array([len(s) for s in sets], np.float64)
    together = _together(sets)
    union = sizes[:, None] + sizes[None, :] - together
    hit = (together >= threshold * union - 1e-6) & (together > 0)
    hit &= np.triu(np.ones_like(hit), 1)
    if split is not None:
        hit[split:] = False
        hit[:, :split] = False
    return hit


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row that links reach."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verified(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, linked_rows, root) of each group (bucket, x, y) of `members`, read as a stream in that order.

    A pair counts in the smallest of the buckets it shares, so its links add up without listing pairs.
    """
    place = members.columns.index("text")
    bound_batches(members.sparkSession)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            for part in parts(batch, place):
                for row in part.to_pylist():
                    if held and (row["bucket"], row["x"], row["y"]) != (held[0]["bucket"], held[0]["x"], held[0]["y"]):
                        yield held
                        held = []
                    held.append(row)
        if held:
            yield held

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            rows = list({r["node"]: r for r in sorted(rows, key=lambda r: r["block"])}.values())
            bucket, x, y = rows[0]["bucket"], rows[0]["x"], rows[0]["y"]
            split = None if x == y else sum(r["block"] == x for r in rows)
            if len(rows) < 2 or split == len(rows):
                continue
            sets = [np.unique(gram_hashes(w, n)) for w in word_hashes([words_of(r["text"]) for r in rows])]
            hit = similar(sets, threshold, split)
            hit |= hit.T
            touched = np.flatnonzero(hit.any(axis=1))
            if not len(touched):
                continue
            root = _roots(hit)
            smaller = [np.array([b for b in r["buckets"] if b < bucket], np.int64) for r in rows]
            first = hit & (_together(smaller) == 0)
            linked_rows = first @ np.array([r["copies"] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i]["node"] for i in touched], pa.string()), pa.array(linked_rows[touched], pa.int64()), pa.array([rows[i]["node"] for i in root[touched]], pa.string())],
                ["node", "linked_rows", "root"],
            )

    return members.mapInArrow(verify, "node string, linked_rows bigint, root string")


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999
) -> DataFrame:
    """One row for each row of `docs`: doc_id, class_id, n_links, n_copies, kept, row_key.

    Documents link if the sets of their n-grams of lower-cased words have a Jaccard similarity of at least
    `threshold`. class_id is the smallest doc_id that links reach, n_links the number of other documents that
    link with this one, n_copies the number with an equal set (itself included), kept whether class_id is its own.

    Equal sets are one class and take part once. Bands and rows are chosen so that a pair at the threshold
    shares a band with probability `recall`; only band hashes shuffle. Buckets with the same members are one.
    The texts of members of shared buckets then meet, each pair is verified on its full sets, and links are
    counted where the pair's first shared bucket is; pairs are never listed. A bucket above a fixed number of
    members, or of n-grams of theirs, is split into blocks, and each pair of blocks is a task's group of bounded size, so the count
    stays whole; its work, and the rows sent by a 512th, grow with the square of the number of *different* texts in a bucket.

    A text of fewer than n words is one gram; a null text, and one without words, links with nothing. Rows
    with a null id get class_id null unless an equal set or a link has an id. Of rows that repeat id and
    text, all get the same values. Other columns are not read.
    """
    bands, rows = bands_and_rows(threshold, recall)
    sketches = written(_sketches(docs, n, bands, rows, id_col, text_col))
    full = sketches.filter("size > 0")
    classes = written(
        full.groupBy("low", "high", "size").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first"),
            F.count("*").alias("copies"), F.first("bands").alias("bands"),
        ).select(F.concat_ws("-", F.hex("low"), F.hex("high"), "size").alias("node"), "low", "high", "size", "first.doc_id", "first.row_key", "copies", "bands")
    )
    placed = classes.select("node", "size", F.posexplode("bands").alias("band", "hash")).select("node", "size", F.xxhash64("band", "hash").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("size").alias("grams"), F.bit_xor(F.xxhash64("node")).alias("who"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("also")).filter("members > 1")
    kept_buckets = written(crowded.groupBy("members", "who", "also").agg(F.min(F.struct("bucket", "grams")).alias("b")).select("b.bucket", "members", "b.grams"))
    candidates = written(
        placed.join(kept_buckets, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "members", "grams")).alias("buckets"))
        .join(classes.select("node", "row_key", "copies"), "node")
    )
    keys = candidates.select("row_key", "node", "copies", "buckets")
    slim = F.broadcast(keys.select("row_key")) if candidates.count() <= BROADCAST_KEYS else keys.select("row_key")
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text")).join(slim, "row_key", "left_semi")
    with_text = texts.join(keys, "row_key").select("node", "copies", "text", F.transform("buckets", lambda b: b["bucket"]).alias("buckets"), F.explode("buckets").alias("b"))
    blocks = F.greatest(F.ceil(F.col("b.members") / _BLOCK), F.ceil(F.col("b.grams") / _BLOCK_GRAMS)).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    members = with_text.select("node", "copies", "text", "buckets", F.col("b.bucket").alias("bucket"), block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    members = members.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other")
    found = written(_verified(members.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y"), n, threshold))

    links = found.groupBy("node").agg(F.sum("linked_rows").alias("linked_rows"))
    roots = connected_components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_node = classes.select("node", "low", "high", "size", "doc_id", "copies").join(links, "node", "left").join(roots, "node", "left")
    by_node = by_node.withColumn("root", F.coalesce("root", "node"))
    linked = by_node.filter("root != node or linked_rows is not null")
    first = linked.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    linked = linked.join(first, "root").select("low", "high", "size", "copies", "class_id", "linked_rows")
    alone = by_node.filter("root = node and linked_rows is null").select("low", "high", "size", "copies", F.col("doc_id").alias("class_id"), "linked_rows")
    decided = written(linked.unionByName(alone))
    out = full.select("doc_id", "row_key", "low", "high", "size").join(decided, ["low", "high", "size"]).select(
        "doc_id", "class_id", (F.coalesce("linked_rows", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "row_key",
    )
    wordless = sketches.filter("size = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"),
        F.lit(1).cast("bigint").alias("n_copies"), F.lit(True).alias("kept"), "row_key",
    )
    return out.unionByName(wordless)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each class of near copies (the smallest id); all columns stay.

    Null texts and texts without words are near nothing and stay. Rows of a class with equal ids stay or go
    together where their texts are equal too; of a class without ids all stay. An empty table stays empty.
    """
    dropped = written(ngram_join(docs, id_col, text_col).filter("not kept").select("row_key").distinct())
    return drop_rows(docs, dropped, id_col, text_col)
