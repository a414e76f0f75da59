"""Query op2: near copies among all documents, by Jaccard similarity of five-word n-grams."""

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm.common import table
from veilmark.llm.ngram_join import ngram_join


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("row_key")


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLE_SQL: dict[str, str] = {}
