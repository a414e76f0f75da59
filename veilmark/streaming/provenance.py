"""Provenance of files that run or steer programs: a record for each change of such a file, chained within its ledger."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.fold import fold_by_key
from veilmark.functions.paths import artifact_class, resolve_path

_FIELDS = ("file_path", "filePath", "path", "target_file")
#: Bytes beyond which a file's content is not hashed.
CONTENT_BYTES = 2 << 20


def artifact_changes(events: DataFrame, files: DataFrame | None = None, adapter: str = "editor", tool: str = "edit") -> DataFrame:
    """Events (ledger, event_id, ts, payload) as records: ledger, event_id, ts, n (the place of the path in its event), record.

    Every path that a payload names (in `tool_input` or at its top) is taken from its `cwd` and classed; those of no class
    leave no record. A path outside the `cwd` is told by its kind and name alone. `files` (path, text) are hashed where they are and
    joined by whole paths, so texts don't move; a file that is missing, null, or of over 2 MiB has no content hash, and of
    files with equal paths the largest hash counts. A payload that is no JSON object, or names no path, leaves no record.
    """
    payload = F.col("payload")
    named = F.array_compact(F.array(*[F.get_json_object(payload, f"$.{at}{f}") for at in ("tool_input.", "toolInput.", "") for f in _FIELDS]))
    cwd = F.coalesce(F.get_json_object(payload, "$.cwd"), F.lit(""))
    root = F.when(cwd == "", "").otherwise(resolve_path(cwd)).alias("root")
    rows = events.select("ledger", "event_id", "ts", root, F.posexplode(named).alias("n", "named"))
    absolute = F.col("named").rlike(r"^[/\\]") | (F.col("root") == "")
    rows = rows.withColumn("path", resolve_path(F.when(absolute, F.col("named")).otherwise(F.concat("root", F.lit("/"), "named"))))
    rows = rows.withColumn("kind", artifact_class(F.col("path"))["kind"]).filter("kind is not null")
    if files is None:
        rows = rows.withColumn("content", F.lit(None).cast("string"))
    else:
        content = F.when(F.octet_length("text") <= CONTENT_BYTES, F.sha2("text", 256))
        known = files.select(F.col("path").alias("known"), content.alias("content")).groupBy("known").agg(F.max("content").alias("content"))
        rows = rows.join(known, F.col("path") == F.col("known"), "left")
    inside = F.concat(F.regexp_replace("root", "/$", ""), F.lit("/"))
    relative = (
        F.when((F.col("root") == "") & ~F.col("path").startswith("/"), F.col("path"))
        .when((F.col("root") != "") & F.col("path").startswith(inside), F.expr("substring(path, length(regexp_replace(root, '/$', '')) + 2)"))
        .otherwise(F.concat(F.lit("<external>/"), "kind", F.lit("/"), F.regexp_extract("path", "[^/]*$", 0)))
    )
    record = F.struct(
        F.lit(adapter).alias("adapter"), F.col("kind").alias("artifactKind"), F.col("content").alias("contentHash"), F.lit("changed").alias("outcome"),
        F.sha2("path", 256).alias("pathHash"), relative.alias("relativePath"), F.sha2("root", 256).alias("repositoryID"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), F.lit(tool).alias("toolName"),
    )
    return rows.select("ledger", "event_id", "ts", "n", record.alias("record"))


def artifact_ledger(changes: DataFrame) -> DataFrame:
    """Records with seq (from 0 in each ledger) and line: JSON with keys in order, and in previousHash the SHA-256 of the line before, null for the first.

    In order of ts, event_id and n; a ledger streams through its task. `events.broken_links` finds lines that were changed, and
    `logs.rotated` deals the lines out to files.
    """

    def step(state: tuple | None, row: dict) -> tuple:
        seq, previous = state or (0, None)
        line = json.dumps({**row["record"], "previousHash": previous}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        return (seq + 1, hashlib.sha256(line.encode()).hexdigest()), {"seq": seq, "line": line}

    return fold_by_key(changes, ["ledger"], ["ts", "event_id", "n"], step, "seq bigint, line string")
