"""Operator 5: WARC archives written and read by Spark, and an index merged externally from sorted runs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilmark.llm.common import row_key, written

#: Fixed values of the format.
_VERSION, _PROFILE = "WARC/1.1\r\nWARC-Type: ", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:veilmark:page:"
#: Payloads below this size are always stored in full.
_LEAST_REVISIT = 100
#: Revisits up to this number are broadcast (16 bytes each); more are joined by a shuffle.
_BROADCAST_REVISITS = 200_000
#: Index rows in one range of the merge, about.
_MERGE_ROWS = 200_000


def records(pages: DataFrame, date: Column) -> DataFrame:
    """(value string): one WARC record for each row of `pages` (page_id, url, html), without its closing blank lines.

    Of equal payloads of at least 100 bytes, that with the smallest page_id is a response and others are
    revisits that refer to it. Only digests shuffle; equal ones are counted on the map side.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("")).alias("url"),
        payload.alias("payload"), F.octet_length(payload).alias("size"), F.sha2(payload, 256).alias("digest"),
        date.alias("date"), row_key("page_id", "html").alias("row_key"),
    )
    large = written(rows.filter(F.col("size") >= _LEAST_REVISIT).select("page_id", "digest", "row_key"))
    firsts = written(large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    revisits = written(large.join(firsts, "digest").filter("page_id is null or page_id > refers_to").select("row_key", "refers_to").distinct())
    known = F.broadcast(revisits) if revisits.count() <= _BROADCAST_REVISITS else revisits
    rows = rows.join(known, "row_key", "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    page_name = F.concat(F.lit(f"<{_NAME}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\n"))
    refers = F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <{_NAME}"), F.col("refers_to").cast("string"), F.lit(">\r\n"))
    return rows.select(
        F.concat(
            F.lit(_VERSION), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), page_name,
            F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Date: "), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"), F.when(again, refers).otherwise(""),
            F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
            F.lit("\r\n\r\n"), block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, folder: str, date: Column) -> None:
    """Writes gzip-compressed archives to a folder of any file system Spark writes to, one for each partition."""
    records(pages, date).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def _whole(fragments: Iterable[tuple[str, str]]) -> Iterator[tuple[str, int, dict, bytes]]:
    """(archive, ordinal, headers, block) from an archive's text between record starts.

    A payload may hold a record start; Content-Length says whether a record goes on in the next fragment. Fragments are counted as
    they come and joined once, so a payload full of record starts takes time in proportion to its length.
    """
    archive, ordinal, held = None, 0, []
    headers, have, size = {}, 0, 0
    for path, fragment in fragments:
        if path != archive:
            archive, ordinal, held = path, 0, []
        if not held and not fragment:
            continue
        held.append(_VERSION + fragment if held else fragment)
        if len(held) == 1 or not headers:
            head, end, rest = "".join(held).partition("\r\n\r\n")
            kind, *lines = head.split("\r\n")
            headers = {"WARC-Type": kind} | dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines) if end else {}
            have, size = len(rest.encode()), int(headers.get("Content-Length", 0))
        else:
            have += len(held[-1].encode())
        if headers and have >= size:
            yield archive, ordinal, headers, "".join(held).partition("\r\n\r\n")[2].encode()[:size]
            ordinal, held, headers = ordinal + 1, [], {}


def url_key(url: str) -> str:
    """The sort key of an address: host labels from the top level down, then path and query; no scheme, port or fragment."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    host = re.sub(r"^www[0-9]*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row for each record: page_id, url, url_key, date, record_type, refers_to, payload_bytes, payload_digest,
    archive, ordinal and (if asked) payload. A response's digest is that of the payload as read; an archive whose
    payload doesn't match its own digest fails. Memory holds one record at a time and an Arrow batch."""
    schema = (
        "page_id bigint, url string, url_key string, date string, record_type string, refers_to bigint, "
        "payload_bytes bigint, payload_digest string, archive string, ordinal bigint" + ", payload string" * with_payload
    )
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def number(name: str) -> int | None:
        digits = name.strip("<>").removeprefix(_NAME)
        return int(digits) if digits else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments = (x for b in batches for at in range(0, b.num_rows, 500) for x in zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True))
        rows: list[dict] = []
        for archive, ordinal, headers, block in _whole(fragments):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
            response = headers["WARC-Type"] == "response"
            if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"record {ordinal} of {archive} does not match its digest")
            url = headers.get("WARC-Target-URI", "")
            row = {
                "page_id": number(headers["WARC-Record-ID"]), "url": url, "url_key": url_key(url), "date": headers["WARC-Date"],
                "record_type": headers["WARC-Type"], "refers_to": None if response else number(headers["WARC-Refers-To"]),
                "payload_bytes": size, "payload_digest": digest, "archive": archive.rsplit("/", 1)[-1], "ordinal": ordinal,
            }
            rows.append(row | {"payload": payload.decode()} if with_payload else row)
            if len(rows) == 500:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    text = spark.read.option("lineSep", _VERSION).text(folder)
    return text.select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(parse, schema)


class LoserTree:
    """Merges sorted runs: an inner node holds the run that lost there, so each step replays one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [0] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:
                if self._less(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merge_index(captures: DataFrame) -> DataFrame:
    """`captures` in the global order of url_key, date, page_id, archive, ordinal: with position (from 0) and
    capture (from 1, within a url_key).

    Captures are dealt out by ranges of that order, so a url_key with very many captures spans ranges too. In
    a range, the captures of each archive are a locally sorted run, and a loser tree merges the runs; a range
    holds a bounded number of rows. Only one summary row for each range goes to the driver, for the offsets.
    Null url keys come first as empty ones; a null page_id sorts before all.
    """
    spark = captures.sparkSession
    total = captures.count()
    ranges = max(1, -(-total // _MERGE_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 1000))
    names = captures.columns
    keys = [F.coalesce("url_key", F.lit("")).alias("k0"), F.col("date").alias("k1"), F.coalesce("page_id", F.lit(-(2**63))).alias("k2"), F.col("archive").alias("k3"), F.col("ordinal").alias("k4")]
    order = ["k0", "k1", "k2", "k3", "k4"]
    dealt = captures.select(*names, *keys).repartitionByRange(ranges, *order).sortWithinPartitions("k3", *order)
    schema = ", ".join(f"`{n}` {t}" for n, t in captures.dtypes) + ", part int, place bigint, in_key bigint"
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        columns = [held.column(k).to_pylist() for k in order]
        archives = columns[3]
        bounds = [0] + [i for i in range(1, len(archives)) if archives[i] != archives[i - 1]] + [len(archives)]

        def run(a: int, b: int) -> Iterator[tuple]:
            return ((*(c[i] for c in columns), i) for i in range(a, b))

        merged = [x[-1] for x in LoserTree([run(a, b) for a, b in zip(bounds, bounds[1:], strict=False)])]
        in_key, last, n = [], None, 0
        for i in merged:
            n = n + 1 if columns[0][i] == last else 1
            last = columns[0][i]
            in_key.append(n)
        out = held.select(names).take(pa.array(merged))
        out = out.append_column("part", pa.array([TaskContext.get().partitionId()] * len(merged), pa.int32()))
        out = out.append_column("place", pa.array(range(len(merged)), pa.int64())).append_column("in_key", pa.array(in_key, pa.int64()))
        yield from out.cast(arrow_schema).combine_chunks().to_batches(5000)

    merged = written(dealt.mapInArrow(merge, schema))
    key = F.coalesce("url_key", F.lit(""))
    summary = merged.groupBy("part").agg(F.count("*").alias("n"), F.min_by(key, "place").alias("first"), F.max_by(key, "place").alias("last"), F.max_by("in_key", "place").alias("run"))
    offsets, at, last, carried = [], 0, None, 0
    for r in sorted(summary.collect(), key=lambda r: r["part"]):
        carry = carried if r["first"] == last else 0
        offsets.append((r["part"], at, r["first"], carry))
        at += r["n"]
        carried = r["run"] + (carry if r["first"] == r["last"] else 0)
        last = r["last"]
    table = F.broadcast(spark.createDataFrame(offsets, "part int, offset bigint, first_key string, carry bigint"))
    capture = F.col("in_key") + F.when(key == F.col("first_key"), F.col("carry")).otherwise(0)
    return merged.join(table, "part").select(*names, (F.col("place") + F.col("offset")).alias("position"), capture.alias("capture"))
