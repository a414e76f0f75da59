"""Gates that look into files: prompts with what they attach and mention, and reads with what they would show.

Files are a table (path, text). Only files that some event names are scanned, each once however many events name it;
what meets the events is a row of counts for each file (and its sealed text, where one is asked for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import text as X
from veilmark.functions.catalog import CRITICAL
from veilmark.functions.paths import is_excluded, is_suspicious, resolve_path
from veilmark.operators.rewrite import seal_findings
from veilmark.operators.spans import with_findings

#: Largest payload or file of a read, and largest file of a prompt (bytes).
INPUT_LIMIT, ATTACHMENT_LIMIT = 2 << 20, 64 << 10
#: Where sealed copies lie: a folder of this name, files whose names begin so.
SEALED_FOLDER, SEALED_NAME = "veilmark-seal", "sealed-"
_PATH = ("$.file_path", "$.filePath", "$.path", "$.tool_input.file_path", "$.tool_input.path")
_CONTENT = ("$.content", "$.file_content", "$.tool_input.content")


def _valid(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$").startswith("{"), F.lit(False))


def attached(payload: Column) -> Column:
    """Paths of a payload's attachments, in order."""
    items = F.from_json(F.get_json_object(payload, "$.attachments"), "array<struct<file_path: string, filePath: string>>")
    paths = F.transform(F.coalesce(items, F.array().cast("array<struct<file_path: string, filePath: string>>")), lambda a: F.coalesce(a["file_path"], a["filePath"]))
    return F.filter(paths, lambda p: p.isNotNull() & (p != ""))


def mentioned(prompt: Column) -> Column:
    """Paths named with @ in a prompt: from a letter, digit, dot, slash or _ up to a blank or one of , ; ) ], with a slash or dot inside."""
    found = F.regexp_extract_all(prompt, F.lit(r"@([A-Za-z0-9./_][^\s,;)\]]*)"), F.lit(1))
    return F.filter(found, lambda p: p.rlike("[/.]"))


def _located(path: Column, cwd: Column) -> Column:
    return resolve_path(F.when(cwd.isNull() | path.startswith("/"), path).otherwise(F.concat(cwd, F.lit("/"), path)))


def _counts(rows: DataFrame) -> dict[str, Column]:
    critical = F.filter("findings", lambda f: f["entity_type"].isin(*CRITICAL))
    return {"n_all": F.size("findings"), "n_critical": F.size(critical)}


def _key_of(id_col: str, payload_col: str) -> Column:
    """What an event is known by in joins: repeated ids with other payloads are other events, equal rows fare alike."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (id_col, payload_col)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _scanned_files(files: DataFrame, wanted: DataFrame, limit: int, key: bytes | None, secrets_only: bool) -> DataFrame:
    """(path, too_large, n_all, n_critical, sealed) of the wanted files; of a path that stands twice, the smallest text. Large files aren't scanned."""
    rows = files.select("path", "text").join(wanted.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.min("text").alias("text"))
    large = F.octet_length("text") > limit
    rows = with_findings(rows.select("path", F.coalesce(large, F.lit(False)).alias("too_large"), F.when(~large, F.col("text")).alias("text")), secrets_only=secrets_only)
    rows = rows.withColumns(_counts(rows))
    sealed = F.lit(None).cast("string")
    if key is not None:
        rows = seal_findings(rows, key)
        sealed = F.col("text")
    return rows.select("path", "too_large", "n_all", "n_critical", sealed.alias("sealed"))


def prompt_gate(
    events: DataFrame, files: DataFrame, policy: str = "block", secrets_only: bool = False, excluded: tuple[str, ...] = (), key: bytes | None = None,
    limit: int = ATTACHMENT_LIMIT, id_col: str = "event_id", payload_col: str = "payload",
) -> DataFrame:
    """Prompts with what they attach and mention: id, decision, reason, n_findings, n_files, sealed.

    Findings in the prompt or in a file that it names deny (policy block or soft) or advise; each place that names a
    file counts. Excluded paths, files that aren't there, and files of over `limit` bytes are not read (n_files is
    how many places were). A payload that is too large, no JSON or without a prompt is let by and says why. With a key
    and policy block, `sealed` is the prompt and its files, one after the other, with their findings sealed (null
    where there is none, or one that can't be sealed). Texts are scanned one by one, so nothing is found across the
    seam of two. Every row of `events` gives one; a null payload is no JSON.
    """
    payload = F.col(payload_col)
    prompt = F.coalesce(F.get_json_object(payload, "$.prompt"), F.get_json_object(payload, "$.tool_info.user_prompt"))
    reason = F.when(F.octet_length(payload) > INPUT_LIMIT, "stdin_too_large").when(~_valid(payload), "invalid_json").when(prompt.isNull(), "missing_prompt")
    rows = events.select(id_col, payload_col, _key_of(id_col, payload_col).alias("event_key"), reason.alias("reason"), F.when(reason.isNull(), prompt).alias("text"))
    cwd, covers = F.get_json_object(payload, "$.cwd"), [f"{p}**" if p.endswith("/") else p for p in excluded]
    raw = F.concat(attached(payload), mentioned(F.col("text")))
    if covers:
        raw = F.filter(raw, lambda p: ~is_excluded(F.regexp_replace(p, r"^(?:\./)+", ""), covers))
    # keys and places shuffle, not payloads
    named = rows.filter("reason is null").select("event_key", F.transform(raw, lambda p: _located(p, cwd)).alias("paths")).distinct()
    named = named.select("event_key", F.posexplode_outer("paths").alias("place", "path")).filter("path is not null")
    sealing = key if policy == "block" else None
    scanned = _scanned_files(files, named, limit, sealing, secrets_only).filter("not too_large")
    by_event = named.join(scanned, "path").groupBy("event_key").agg(
        F.count("*").alias("n_files"), F.sum("n_all").alias("in_files"),
        *([F.sort_array(F.collect_list(F.struct("place", F.col("sealed").isNull().alias("lost"), "sealed"))).alias("parts")] if sealing else []),
    )
    rows = with_findings(rows, "text", secrets_only=secrets_only)
    rows = rows.withColumn("in_prompt", F.size("findings"))
    if sealing:
        rows = seal_findings(rows, sealing)
    rows = rows.join(by_event, "event_key", "left")
    n = (F.col("in_prompt") + F.coalesce("in_files", F.lit(0))).cast("bigint")
    decision = F.when(n == 0, "allow").when(F.lit(policy == "advise"), "advise").otherwise("deny")
    none = F.lit(None).cast("string")
    whole = F.when(F.exists("parts", lambda p: p["lost"]), none).otherwise(F.concat_ws("\n", F.array("text"), F.coalesce(F.transform("parts", lambda p: p["sealed"]), F.array().cast("array<string>")))) if sealing else none
    sealed = F.when((n > 0) & F.col("text").isNotNull(), whole) if sealing else none
    return rows.select(id_col, decision.alias("decision"), F.coalesce("reason", F.lit("")).alias("reason"), n.alias("n_findings"), F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"), sealed.alias("sealed"))


def read_gate(
    events: DataFrame, files: DataFrame, excluded: tuple[str, ...] = (), key: bytes | None = None, limit: int | None = INPUT_LIMIT, id_col: str = "event_id", payload_col: str = "payload",
) -> DataFrame:
    """Reads with the file they would show: id, decision, reason, n_findings, sealed.

    What is shown is the payload's content, else the text of the file at its path (cwd before a relative one). In
    this order: a payload that is no JSON or names no path is denied (unreadable); a sealed copy and an excluded
    path are allowed; content over `limit` bytes (None: no limit) is denied unread (too-large, n_findings null); a
    suspicious path is denied (path), and so is content with critical findings (findings). With a key all findings count
    and `sealed` is the content with them sealed, null where nothing is found. Every row of `events` gives one.
    """
    payload = F.col(payload_col)
    raw = X.json_field(payload, *_PATH)
    valid = (F.octet_length(payload) <= INPUT_LIMIT) & _valid(payload) & raw.isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    most = limit if limit is not None else (1 << 31) - 1
    path = F.when(valid, _located(raw, F.get_json_object(payload, "$.cwd")))
    rows = events.select(id_col, valid.alias("valid"), path.alias("path"), F.when(valid, X.json_field(payload, *_CONTENT)).alias("text"))
    low = F.lower("path")
    copy = F.contains(low, F.lit(f"/{SEALED_FOLDER}/")) & F.contains(low, F.lit(f"/{SEALED_NAME}")) & low.endswith(".txt")
    passed = F.when(~F.col("valid"), "unreadable").when(copy, "sealed-copy").when(is_excluded(F.col("path"), excluded) if excluded else F.lit(False), "excluded")
    rows = rows.withColumn("reason", passed).withColumn("own", F.col("text").isNotNull())
    large = F.coalesce(F.octet_length("text") > most, F.lit(False))
    rows = with_findings(rows.withColumns({"too_large": large, "text": F.when(F.col("reason").isNull() & ~large, F.col("text"))}))
    rows = rows.withColumns(_counts(rows))
    if key is not None:
        rows = seal_findings(rows, key)
    wanted = rows.filter("reason is null and not own")
    found = _scanned_files(files, wanted, most, key, False)
    found = found.select("path", *[F.col(c).alias(f"file_{c}") for c in ("too_large", "n_all", "n_critical", "sealed")])
    rows = rows.join(found, "path", "left")

    def of(name: str, other: str, missing) -> Column:
        return F.when(F.col("own"), F.col(name)).otherwise(F.coalesce(other, F.lit(missing)))

    n = of("n_all" if key is not None else "n_critical", "file_n_all" if key is not None else "file_n_critical", 0)
    reason = F.coalesce("reason", F.when(of("too_large", "file_too_large", False), "too-large").when(F.coalesce(is_suspicious(F.col("path")), F.lit(False)), "path").when(n > 0, "findings"), F.lit(""))
    rows = rows.withColumns({"why": reason, "n": n, "shown": of("text", "file_sealed", None) if key is not None else F.lit(None).cast("string")})
    unread = F.col("why").isin("unreadable", "too-large", "sealed-copy", "excluded")
    return rows.select(
        id_col, F.when(F.col("why").isin("", "sealed-copy", "excluded"), "allow").otherwise("deny").alias("decision"), F.col("why").alias("reason"),
        F.when(~unread, F.col("n")).cast("bigint").alias("n_findings"), F.when(F.col("why").isin("path", "findings") & (F.col("n") > 0), F.col("shown")).alias("sealed"),
    )
