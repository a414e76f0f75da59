"""Query op5: all pages written as WARC archives, read back, and their index merged into capture histories."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import shared_folder, small_batches, table, written
from veilmark.llm.warc import merge_index, read_archives, write_archives


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    date = F.timestamp_seconds(1_704_067_200 + F.coalesce("page_id", F.lit(0)) % 31_536_000)  # pages have no time of capture
    folder = f"{shared_folder(spark)}/archives"
    write_archives(pages, folder, date)
    with small_batches(spark, 1000):  # a row is a whole page
        captures = written(read_archives(spark, folder, with_payload=False))
    return merge_index(captures).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position", "capture",
    )


QUERIES = {"op5_warc": op5_warc}
ORACLE_SQL = {
    "op5_warc": r"""
        WITH facts AS (
            SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                regexp_extract(url, '^[a-z]+://(?:www[0-9]*\.)?([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
                regexp_extract(url, '(\?[^#]*)', 1) AS query
            FROM pages
        ), keyed AS (
            SELECT *, array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || query AS url_key,
                min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM facts
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to, url_key,
            row_number() OVER (ORDER BY url_key, page_id) - 1 AS position, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture
        FROM keyed
    """,
}
