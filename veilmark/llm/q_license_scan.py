"""Query op1: licence scan of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import table
from veilmark.llm.license_scan import scan_licenses


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["rule"].startswith("base:"))
    starts = F.transform(base, lambda d: d["start_word"])

    def labels(detections):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"),
        (F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / 100).cast("double").alias("score"),
    )


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL: dict[str, str] = {}
