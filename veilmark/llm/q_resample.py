"""Query op11: a tenth of all documents, drawn towards the distribution of the benchmark's words."""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm.common import table
from veilmark.llm.q_merkle import CRC32_TABLE, crc32_sql
from veilmark.llm.resample import resample


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


QUERIES = {"op11_resample": op11_resample}


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE_SQL = {
    "op11_resample": f"""
        WITH {CRC32_TABLE},
        rows_of AS (SELECT row_number() OVER () AS row_no, doc_id, {_words("text")} AS words FROM documents),
        held AS (SELECT row_no, unnest(words) AS word FROM rows_of),
        wanted AS (SELECT unnest({_words("text")}) AS word FROM benchmark),
        every AS (SELECT DISTINCT word FROM (SELECT word FROM held UNION ALL SELECT word FROM wanted)),
        buckets AS (SELECT word, {crc32_sql("word", "steps")} % 10000 AS bucket FROM every, crc_table),
        s AS (SELECT bucket, count(*) AS n FROM held JOIN buckets USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (word) GROUP BY bucket),
        totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000 AS held, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000 AS wanted),
        gains AS (
            SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * totals.held) / ((coalesce(s.n, 0) + 1)::DOUBLE * totals.wanted)))::BIGINT AS gain
            FROM s FULL JOIN t USING (bucket), totals
        ),
        means AS (SELECT row_no, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM held JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row_no),
        scored AS (
            SELECT row_no, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM rows_of LEFT JOIN means USING (row_no)
        ),
        ranked AS (
            SELECT row_no, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row_no) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank, n_features AS n_words
        FROM scored LEFT JOIN ranked USING (row_no)
    """,
}
