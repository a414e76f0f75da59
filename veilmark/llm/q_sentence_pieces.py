"""Query op7: SentencePiece ids of all documents, and what they decode to."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilmark.llm.common import table
from veilmark.llm.sentence_pieces import encode_and_decode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_and_decode(table(spark, sf_dir, "documents"), MODEL, with_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op7_sentence_pieces": op7_sentence_pieces}
ORACLE_SQL: dict[str, str] = {}
