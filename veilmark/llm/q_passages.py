"""Query op10: passages of at least fifty words that several documents share."""

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm.common import table
from veilmark.llm.passages import repeated_passages


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op10_passages": op10_passages}
ORACLE_SQL: dict[str, str] = {}
