"""Query op13: base rules and learned quality of all documents."""

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm.common import table
from veilmark.llm.quality_rules import fit, quality


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op13_quality_rules": op13_quality_rules}
#: A learned verdict is no SQL; the tests hold the base columns against brute force and the verdict against held-out labels.
ORACLE_SQL: dict[str, str] = {}
