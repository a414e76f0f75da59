"""Query op4: main text of all pages."""

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm.common import table
from veilmark.llm.main_text import main_texts


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


QUERIES = {"op4_main_text": op4_main_text}
ORACLE_SQL: dict[str, str] = {}
