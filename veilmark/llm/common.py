"""What the operators of this package share: shared-folder tables, word splitting, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII bytes that are no part of a word; A-Z is lower-cased first. Bytes from 0x80 up belong to words.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER_OR_SPACE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) may that setting be unset; a temporary folder takes its
    place there. On a cluster that would be a folder executors don't share, so it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="veilmark-shared-")
    return f"{base.rstrip('/')}/veilmark-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: lineage is cut, executors may go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that `written` gave and no result needs any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what runs inside; for tables of large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words_of(text: str | None) -> bytes:
    """The words of a text joined by single spaces, as UTF-8 bytes (A-Z lower-cased; null: empty)."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER_OR_SPACE).split())


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits of a row's id and text as hex, by which a decision finds its row again; nulls differ from empty values."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.md5(F.concat_ws("|", *parts))


#: Rows of a batch, and bytes of texts, that are handled at once; a longer text goes alone.
_PART_ROWS, _PART_BYTES = 500, 2 << 20
#: Bytes of an Arrow batch on its way to a worker: Spark's own bound is 10,000 rows, whatever their size.
_BATCH_BYTES = 8 << 20


def parts(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, bounded by rows and by the bytes of the string column at `place`."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start >= _PART_ROWS or size + n > _PART_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, where it sets no lower bound itself; the setting stays, as plans run later."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > _BATCH_BYTES:
        spark.conf.set(name, str(_BATCH_BYTES))


def map_texts(
    df: DataFrame, fn: Callable[[list, list], dict] | None, schema: str, id_col: str, text_col: str, setup: Callable[[], Callable[[list, list], dict]] | None = None
) -> DataFrame:
    """Runs `fn(ids, texts) -> columns` over bounded slices of `df`; rows keep their partitions, nothing shuffles.

    `setup()` gives that function anew for each task, so what it holds goes when the task ends.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup() if setup else fn
        for batch in batches:
            for part in parts(batch, 1):
                out = work(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)

    return rows.mapInArrow(run, schema)


#: Row keys up to this number are broadcast (32 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def drop_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `dropped` (row_key, a written table) names, with all their columns.

    Rows that repeat both an id and its text share a key: they go together.
    """
    mark = f"key_{uuid.uuid4().hex[:8]}"
    keys = dropped.select(F.col("row_key").alias(mark))
    keys = F.broadcast(keys) if dropped.count() <= BROADCAST_KEYS else keys
    return docs.withColumn(mark, row_key(id_col, text_col)).join(keys, mark, "left_anti").drop(mark)


def filter_texts(docs: DataFrame, keep: Callable[[list], list], text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, for which `keep(texts)` says true; row by row, nothing shuffles.

    A null text is passed to `keep` as None; repeated rows are decided alike.
    """
    place = docs.columns.index(text_col)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, place):
                yield part.filter(pa.array(keep(part.column(place).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
