"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.sources.scratch import written

#: Rows and bytes that whole-text operators hold as Python objects at once: texts may be 100 kB
#: each, and two Python workers share an executor.
PIECE_ROWS, PIECE_BYTES = 512, 8 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the folder that all executors share, and read back."""
    return written(df, name)


def text_of(col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def variant_of(col: str = "text") -> Column:
    """XXH64 of the text: with the id it names a row by what a stage judges, so that rows that share an id are told apart."""
    return F.xxhash64(text_of(col))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, halved until its parts keep to PIECE_ROWS and PIECE_BYTES or are single rows; nothing is copied."""
    if batch.num_rows > PIECE_ROWS or (batch.num_rows > 1 and batch.nbytes > PIECE_BYTES):
        half = batch.num_rows // 2
        yield from _pieces(batch.slice(0, half))
        yield from _pieces(batch.slice(half))
    elif batch.num_rows:
        yield batch


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow with a function that ``make`` builds once per task (tables, caches).

    Spark bounds a batch that it sends by bytes; the function sees it in smaller pieces. Where the
    session leaves Spark's default of 10,000 rows a batch, it is set to PIECE_ROWS, as JVM and
    Python both hold a batch of every task; a value of the caller's own stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        conf.set(_BATCH, str(PIECE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for piece in _pieces(batch):
                yield each(piece)

    return df.mapInArrow(run, schema)


#: Rows of ids that may be broadcast: at some 40 bytes each, under 10 MB.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a table of ids, cut and marked for a broadcast only if counted to be small.

    Beyond the bound the join shuffles, as a hash join that AQE can split at hot keys.
    """
    df = cut(df, "ids")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def drop_rows(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id and text are in ``rejected(doc_id, variant)``; other rows of the same or a null id stay."""
    dropped = small(rejected.select(F.col("doc_id").alias("_id"), F.col("variant").alias("_variant")).distinct())
    same_id = docs["doc_id"].cast("long").eqNullSafe(dropped["_id"])
    return docs.join(dropped, same_id & (variant_of("text") == dropped["_variant"]), "left_anti")
