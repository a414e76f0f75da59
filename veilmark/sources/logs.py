"""Audit logs in files that are closed when they are full, and an index of paths that changes part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.fold import fold_by_key
from veilmark.functions.paths import sensitive_pattern

#: Bytes beyond which a log file is closed; files of a log that stay; parts of an index.
FILE_BYTES, KEEP_FILES, PARTS = 256 << 10, 2, 64


def rotated(entries: DataFrame, log: str = "log", order: str = "seq", line: str = "line", most: int = FILE_BYTES, heads: DataFrame | None = None) -> DataFrame:
    """Entries with `file_no`: a log's lines in order of `order`, a file closed behind the line that takes it over `most` bytes.

    `heads` (log, file_no, bytes) says where each log stopped. Null lines are empty; a log streams through its task.
    """
    rows = entries.withColumn("line_bytes", F.coalesce(F.octet_length(line), F.lit(0)) + 1)
    none = F.lit(None).cast("bigint")
    if heads is None:
        rows = rows.withColumns({"head_no": none, "head_bytes": none})
    else:
        known = heads.select(F.col("log").alias("known_log"), F.col("file_no").alias("head_no"), F.col("bytes").alias("head_bytes"))
        rows = rows.join(known, F.col(log).cast("string").eqNullSafe(F.col("known_log").cast("string")), "left").drop("known_log")

    def step(state: tuple | None, row: dict) -> tuple:
        number, size = state or (row["head_no"] or 0, row["head_bytes"] or 0)
        if size > most:
            number, size = number + 1, 0
        return (number, size + row["line_bytes"]), {"file_no": number}

    return fold_by_key(rows, [log], [order], step, "file_no bigint").drop("line_bytes", "head_no", "head_bytes")


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return spark.read.schema(schema).text(folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def _written_by_parts(df: DataFrame, folder: str, *parts: str, kind: str = "parquet") -> None:
    df.write.partitionBy(*parts).mode("overwrite").option("partitionOverwriteMode", "dynamic").format(kind).save(folder)


def append_rotated(entries: DataFrame, folder: str, batch: int, log: str = "log", order: str = "seq", line: str = "line", most: int = FILE_BYTES) -> None:
    """Appends entries as lines below folder/log=.../file_no=.../batch=..., as `foreachBatch` calls it.

    The last file of a log goes on until it is full, also after a restart. A batch that is written again replaces what
    it wrote before, as long as no later one came.
    """
    spark = entries.sparkSession
    before = _stored(spark, folder, "value string, log string, file_no bigint, batch bigint")
    heads = None
    if before is not None:
        sizes = before.filter(F.col("batch") < batch).groupBy("log", "file_no").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
        heads = sizes.groupBy("log").agg(F.max_by(F.struct("file_no", "bytes"), "file_no").alias("h")).select("log", "h.*")
    rows = rotated(entries, log, order, line, most, heads)
    rows = rows.select(F.col(log).cast("string").alias("log"), "file_no", F.lit(batch).cast("bigint").alias("batch"), F.col(order).alias("place"), F.coalesce(F.col(line), F.lit("")).alias("value"))
    ordered = rows.repartition("log", "file_no").sortWithinPartitions("log", "file_no", "batch", "place").drop("place")
    _written_by_parts(ordered, folder, "log", "file_no", "batch", kind="text")


def read_log(spark: SparkSession, folder: str, keep: int | None = KEEP_FILES) -> DataFrame:
    """(log, file_no, batch, line) of the newest `keep` files of each log (None: all)."""
    rows = spark.read.schema("value string, log string, file_no bigint, batch bigint").text(folder).withColumnRenamed("value", "line")
    if keep is None:
        return rows
    newest = rows.groupBy(F.col("log").alias("of_log")).agg(F.max("file_no").alias("newest"))
    return rows.join(newest, F.col("log").eqNullSafe(F.col("of_log"))).filter(F.col("file_no") > F.col("newest") - keep).select("log", "file_no", "batch", "line")


_INDEX = "path string, part int, version bigint"


def _versions(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """(part, version): the newest committed version of each part of an index, or the newest before a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema("part int, version bigint").parquet(f"{folder}/commits")
    rows = rows if before is None else rows.filter(F.col("version") < before)
    return rows.groupBy("part").agg(F.max("version").alias("version"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all indexed paths, as of the last committed batch."""
    versions = _versions(spark, folder)
    if versions is None:
        return spark.createDataFrame([], "path string")
    rows = spark.read.schema(_INDEX).parquet(f"{folder}/paths")
    return rows.join(F.broadcast(versions), ["part", "version"]).filter("path is not null").select("path")


def upsert_index(changes: DataFrame, folder: str, batch: int, parts: int = PARTS) -> None:
    """Changes (path, ts, removed) to an index of sensitive paths, as `foreachBatch` calls it; batches come in order of their numbers.

    A path's last change decides, and of two at one time the removal. Only the parts (by a hash of the path) that the
    changes touch are read and written, each as a new version; a version counts when its batch is committed, which is
    the last thing done, so a batch that broke off is not seen, and one that comes again replaces itself. Every part's
    version holds a row without a path, so that a part that has become empty is known. `parts` must stay the same.
    """
    spark = changes.sparkSession
    part = lambda c: F.pmod(F.hash(c), F.lit(parts)).alias("part")
    last = changes.filter("path is not null and path != ''").groupBy("path").agg(F.max_by("removed", F.struct("ts", "removed")).alias("removed"))
    last = last.select("path", "removed", part("path"), sensitive_pattern(F.col("path")).isNotNull().alias("sensitive"))
    touched = last.select("part").distinct()
    now = last.filter("sensitive and not removed").select("path", "part").unionByName(touched.select(F.lit(None).cast("string").alias("path"), "part"))
    versions = _versions(spark, folder, batch)
    if versions is not None:
        # touched parts are at most `parts` rows: the scan skips the folders of the others
        old = spark.read.schema(_INDEX).parquet(f"{folder}/paths").join(F.broadcast(versions.join(touched, "part")), ["part", "version"]).filter("path is not null")
        now = now.unionByName(old.select("path", "part").join(last.select("path"), "path", "left_anti"))
    rows = now.withColumn("version", F.lit(batch).cast("bigint")).repartition("part")
    _written_by_parts(rows.select("path", "part", "version"), f"{folder}/paths", "part", "version")
    done = touched.select("part", F.lit(batch).cast("bigint").alias("version"), F.lit(batch).cast("bigint").alias("batch"))
    _written_by_parts(done.coalesce(1), f"{folder}/commits", "batch")
