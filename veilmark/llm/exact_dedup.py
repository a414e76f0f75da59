"""Operator 3: exact dedup by two-pass Bloom filtering, with DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import drop_rows, row_key, written

#: Bits of the filter in one row of the filter table: 64 words of 64 bits.
_BUCKET_BITS = 4096
#: Pass one reads this many positions for each hash.
_SEEDS = (0x51ED, 0xA24B)


def normalised(text: Column) -> Column:
    """The text that decides equality: each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _positions(filter_bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), F.col("sha")), F.lit(filter_bits)) for seed in _SEEDS]


def repeated_filter(hashed: DataFrame, filter_bits: int) -> DataFrame:
    """Pass one: rows (bucket, words array<bigint>) of a bitmap whose set bits are positions hit at least twice.

    Counts are combined on the map side, so what shuffles is at most a small pair for each hash.
    """
    twice = (
        hashed.select(F.explode(F.array(*_positions(filter_bits))).alias("position"))
        .groupBy("position")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )
    by_word = (
        twice.groupBy((F.col("position") / 64).cast("bigint").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(position % 64 as int))")).alias("bits"))
    )
    entries = F.map_from_entries(F.collect_list(F.struct((F.col("word") % 64).cast("int"), "bits")))
    return (
        by_word.groupBy((F.col("word") / 64).cast("bigint").alias("bucket"))
        .agg(entries.alias("m"))
        .select("bucket", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("bigint"))).alias("words"))
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bits: int = 1 << 27
) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, row_key.

    Pass one builds a Bloom filter of positions that at least two hashes hit. Pass two looks every hash up
    in it: rows that miss have no equal and pass straight through; only the others shuffle, by their SHA-256.
    The filter is broadcast; it never exceeds `max_filter_bits` (16 MiB by default), and a fuller filter only
    sends more of the (small) hash rows to the exact grouping, never a wrong answer.

    Null and empty texts are equal to each other; white-space runs count as one space. Of rows that repeat
    both id and text, one is kept. A null id is never smaller than an id; a group of null ids only keeps one
    row and has keep_id null. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    hashed = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(normalised(F.col(text_col)), 256).alias("sha"),
            row_key(id_col, text_col).alias("row_key"),
        ).withColumn("rid", F.monotonically_increasing_id())
    )
    rows = hashed.count()
    filter_bits = min(max_filter_bits, max(1 << 16, 1 << (rows * bits_per_row - 1).bit_length() if rows else 0))
    bitmap = F.broadcast(repeated_filter(hashed, filter_bits))
    first, second = _positions(filter_bits)

    def hit(position: Column, words: Column) -> Column:
        word = words[((position % _BUCKET_BITS) / 64).cast("int")]
        shifted = F.call_function("shiftrightunsigned", word, (position % 64).cast("int"))
        return F.coalesce(shifted.bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(False))

    probed = hashed.withColumn("p1", first).withColumn("p2", second)
    for p in ("p1", "p2"):
        side = bitmap.select(F.col("bucket").alias(f"{p}_bucket"), F.col("words").alias(f"{p}_words"))
        probed = probed.join(side, (F.col(p) / _BUCKET_BITS).cast("bigint") == F.col(f"{p}_bucket"), "left")
    probed = probed.select("doc_id", "sha", "row_key", "rid", (hit(F.col("p1"), F.col("p1_words")) & hit(F.col("p2"), F.col("p2_words"))).alias("maybe"))

    alone = probed.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "row_key",
    )
    maybe = probed.filter("maybe")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    groups = written(maybe.groupBy("sha").agg(first_row, F.count("*").alias("group_size")))  # a table, so that a skewed join can be split
    grouped = maybe.join(groups, "sha").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"), F.col("sha").alias("text_sha256"), "row_key",
    )
    return alone.unionByName(grouped)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text an earlier row has; all columns stay.

    Rows that repeat both id and text share a row key: of those, one stays as well.
    """
    keys = written(exact_dedup(docs, id_col, text_col).groupBy("row_key").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")))
    left = drop_rows(docs, keys.filter("not kept"), id_col, text_col)
    repeats = keys.filter("kept and rows > 1").select("row_key")
    if repeats.isEmpty():
        return left
    mark = f"key_{uuid.uuid4().hex[:8]}"
    marked = left.withColumn(mark, row_key(id_col, text_col))
    twice = repeats.withColumnRenamed("row_key", mark)
    once = marked.join(twice, mark, "left_anti")
    return once.unionByName(marked.join(twice, mark, "left_semi").dropDuplicates([mark])).drop(mark)
