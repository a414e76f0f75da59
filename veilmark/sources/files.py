"""Files as tables, and reports as files; Spark's own readers and writers do the work on any file system."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.paths import is_excluded, under_skipped
from veilmark.functions.text import decoded_text, likely_text, trimmed_text

#: Largest input, and largest part of a transcript (bytes).
INPUT_LIMIT, TRANSCRIPT_LIMIT = 2 * 1024 * 1024, 2_000_000
SCAN_SKIPPED = [".git", "node_modules", ".build", "target", "DerivedData"]
#: Document sizes of the free and paid tier (bytes).
SIZE_LIMITS = {"free": 15 * 1024 * 1024, "pro": 50 * 1024 * 1024}


def read_files(spark: SparkSession, folder: str, excludes: Sequence[str] = (), limit: int = INPUT_LIMIT) -> DataFrame:
    """(path, text, truncated) of the UTF-8 files below a folder, skipped directories and excluded paths left out.

    Paths are relative to the folder; files over the limit or in another encoding are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_replace("path", "^.*?" + folder.rstrip("/").replace(".", r"\.").split("://")[-1] + "/", "")
    rows = files.filter(F.col("length") <= limit).select(relative.alias("path"), "content")
    rows = rows.filter(~under_skipped(F.col("path"), SCAN_SKIPPED) & ~is_excluded(F.col("path"), excludes) & F.is_valid_utf8(F.col("content").cast("string")))
    return rows.select("path", trimmed_text(F.col("content").cast("string")).alias("t")).select("path", "t.text", "t.truncated")


def read_documents(spark: SparkSession, folder: str, tier: str = "free") -> DataFrame:
    """(path, text) of likely texts within the tier's size: UTF-8, else Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(F.col("length") <= SIZE_LIMITS[tier])
    return files.filter(likely_text(F.col("content"))).select("path", decoded_text(F.col("content")).alias("text"))


def extract_documents(files: DataFrame, extractors: Mapping[str, Callable[[bytes], str | None]]) -> DataFrame:
    """(path, text) of files (path, content) by the extractor of their extension (lower case, without the dot), a caller's function on bytes.

    Files of other extensions are read as likely texts; one that an extractor can't read has text null. Each file is
    read alone, where it is.
    """
    kinds = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = kinds.isin(*extractors)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for kind, content in zip(frame["kind"], frame["content"], strict=True):
                try:
                    texts.append(None if content is None else extractors[kind](bytes(content)))
                except Exception:  # whatever a caller's parser raises on a broken file
                    texts.append(None)
            yield pd.DataFrame({"path": frame["path"], "text": pd.Series(texts, dtype=object)})

    found = files.filter(named).select("path", kinds.alias("kind"), "content").mapInPandas(run, "path string, text string")
    rest = files.filter(~named & likely_text(F.col("content"))).select("path", decoded_text(F.col("content")).alias("text"))
    return found.unionByName(rest)


def read_transcripts(spark: SparkSession, folder: str, most: int = 200) -> DataFrame:
    """(path, text) of the first `most` .jsonl and .txt files by path, at most 2 MB of each: a report's limit, not a sample."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(F.col("path").rlike(r"\.(?:jsonl|txt)$")).dropDuplicates(["path"])
    return files.orderBy("path").limit(most).select("path", decoded_text(F.substring("content", 1, TRANSCRIPT_LIMIT)).alias("text"))


def blobs_to_texts(blobs: DataFrame) -> DataFrame:
    """(path, text) of staged blobs (path, blob), what is no UTF-8 or too large left out."""
    fits = (F.octet_length("blob") <= INPUT_LIMIT) & F.is_valid_utf8(F.col("blob").cast("string"))
    return blobs.filter(fits).select("path", F.col("blob").cast("string").alias("text"))


def write_findings(findings: DataFrame, folder: str) -> None:
    """A report of findings as JSON lines."""
    findings.write.mode("overwrite").json(folder)


def append_log(entries: DataFrame, folder: str) -> None:
    """An audit log, appended as JSON lines; old files go by the folder's retention."""
    entries.write.mode("append").json(folder)


def store_mapping(mappings: DataFrame, key: bytes, hours: int | None = 24) -> DataFrame:
    """Rows (mapping_id, created_at, mapping map) as stored: payload binary under the key, expires_at (None: never)."""
    payload = F.call_function("aes_encrypt", F.to_json("mapping").cast("binary"), F.lit(key), F.lit("GCM"))
    expires = F.col("created_at") + F.make_dt_interval(hours=F.lit(hours)) if hours is not None else F.lit(None).cast("timestamp")
    return mappings.select("mapping_id", "created_at", expires.alias("expires_at"), payload.alias("payload"))


def find_mapping(stored: DataFrame, placeholder: str, key: bytes, now: Column) -> DataFrame:
    """The newest unexpired mapping that holds a placeholder: mapping_id, value."""
    opened = F.from_json(F.call_function("try_aes_decrypt", "payload", F.lit(key), F.lit("GCM")).cast("string"), "map<string,string>")
    live = stored.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("mapping_id", "created_at", opened[placeholder].alias("value"))
    return live.filter("value is not null").agg(F.max_by(F.struct("mapping_id", "value"), "created_at").alias("m")).select("m.*")
