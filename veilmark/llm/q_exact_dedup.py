"""Query op3: exact dedup over all documents."""

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm.common import table
from veilmark.llm.exact_dedup import exact_dedup


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row_key")


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        ), groups AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM hashed JOIN groups USING (text_sha256)
    """,
}
