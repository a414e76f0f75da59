"""Operator 7: SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from veilmark.llm.common import bound_batches, map_texts, parts

MARK = "▁"
#: A chunk is a run of white-space marks and what follows up to the next mark.
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: What an entry takes beside its characters and ids: two strings, a tuple, a list and its place in the table.
_ENTRY_BYTES = 300


class ChunkTable:
    """A task's table of distinct chunks: each is segmented once, and its ids are looked up by position.

    Right only if no piece has a white-space mark behind another character, and the model puts a mark before
    every text and keeps all spaces; both are checked when the model loads. `most` bounds the table's bytes:
    a full table is emptied and filled again, which changes no result. It goes with its task.
    """

    def __init__(self, model: bytes, most: int = 32 << 20) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = map(self.sp.id_to_piece, range(self.sp.vocab_size()))
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        if crossing or self.sp.normalize(" a  b ") != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}" or self.sp.normalize("Åﬁ") != f"{MARK}Åﬁ":
            raise ValueError("pieces of this model cross white-space marks, or it changes texts; chunks can't be segmented alone")
        self.most, self.bytes, self.table = most, 0, {}

    def segment(self, chunk: str) -> tuple[str, list[int]]:
        """The ids of one marked chunk, also as decimal text; the library's own dummy mark stands for the first one."""
        if chunk == MARK:
            ids = [self.sp.piece_to_id(MARK)]
        else:
            ids = self.sp.encode(chunk[1:].replace(MARK, " "))
        return " ".join(map(str, ids)), ids

    def encode(self, text: str) -> tuple[str, list[int]]:
        """The ids of a whole text with the end id, also as decimal text."""
        entries, table = [], self.table
        if text:
            for chunk in _CHUNK.findall(MARK + text.replace(" ", MARK)):
                entry = table.get(chunk)
                if entry is None:
                    entry = self.segment(chunk)
                    size = _ENTRY_BYTES + 2 * len(chunk) + 40 * len(entry[1])
                    if size * 8 <= self.most:  # a huge chunk would only push others out
                        if self.bytes + size > self.most:
                            table.clear()
                            self.bytes = 0
                        table[chunk] = entry
                        self.bytes += size
                entries.append(entry)
        end = self.sp.eos_id()
        joined = " ".join([*(e[0] for e in entries), str(end)])
        return joined, [*chain.from_iterable(e[1] for e in entries), end]


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, ids (if asked), ids_sha256, decoded, decoded_sha256.

    Texts are encoded whole, with an end id and no start id, as the library does; a null text is empty and has
    the end id alone. The distinct-chunk table lives in each task: joining every word occurrence with one
    global table would shuffle more than the texts themselves. The model file (half a megabyte) is read on the
    driver and broadcast. Repeated rows get a row each; other columns are not read; nothing shuffles.
    """
    model = _sent(docs, model_path)
    id_type = dict(docs.dtypes)[id_col]
    schema = f"doc_id {id_type}, n_tokens bigint, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded string, decoded_sha256 string"

    def start() -> Callable[[list, list], dict]:
        table = ChunkTable(model.value)

        def run(ids: list, texts: list) -> dict:
            out: dict[str, list] = {"doc_id": ids, "n_tokens": [], **({"ids": []} if with_ids else {}), "ids_sha256": [], "decoded": [], "decoded_sha256": []}
            for text in texts:
                joined, found = table.encode(text or "")
                decoded = table.sp.decode(found)
                out["n_tokens"].append(len(found))
                out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["decoded"].append(decoded)
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(np.array(found, np.int32))
            return out

        return run

    return map_texts(docs, None, schema, id_col, text_col, start)


def _sent(docs: DataFrame, model_path: str) -> Broadcast:
    with open(model_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def with_pieces(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """`docs` with the columns n_tokens bigint, ids array<int> and round_trip boolean (taking the place of any so
    named), row by row. round_trip is false where ids decode to another text, as for one that holds the white-space
    mark itself. A null or empty text has the end id alone (and null decodes to the empty text, so round_trip is
    true); repeated rows get equal ids; an empty table stays empty.
    """
    model = _sent(docs, model_path)
    docs = docs.drop("n_tokens", "ids", "round_trip")
    place = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])
    arrow_schema = to_arrow_schema(schema)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model.value)
        for batch in batches:
            for part in parts(batch, place):
                ids, offsets, same = array("i"), [0], []
                for text in part.column(place).to_pylist():
                    found = table.encode(text or "")[1]
                    same.append(table.sp.decode(found) == (text or ""))
                    ids.extend(found)
                    offsets.append(len(ids))
                starts = np.array(offsets, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(ids, np.int32)) if ids else pa.array([], pa.int32()))
                columns = [*part.columns, pa.array(np.diff(starts).astype(np.int64)), lists, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

    return docs.mapInArrow(run, schema)
