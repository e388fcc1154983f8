"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Documents are aggregated by encoded length; everything else is read off suffix sums of the
histogram, which has as many rows as there are different lengths.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampledger.llm.bpe import tokenizer_path, worker_bpe
from ampledger.llm.common import cut, map_rows, table

BLOCK = 4096  # lengths a block of the suffix sums


def encoded_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, length`` of every row; null texts count as empty (length 0)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        bpe = worker_bpe(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [bpe.count(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "length"])

        return each

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), make, "doc_id long, length long")


def length_table(lengths: DataFrame) -> DataFrame:
    """From rows with a ``length``, one row per different length, taken as a context limit.

    ``n_docs`` documents have just that length; ``docs_over`` and ``tokens_over`` sum those
    that are longer, ``docs_within`` and ``tokens_within`` the rest; ``tokens_kept`` is the
    total once every document is truncated to the limit, ``tokens_lost`` what that cuts off,
    ``quantile`` the share of documents within the limit. Null lengths count as 0; no rows
    give no rows.

    Suffix sums run in two levels, within blocks of lengths and over the blocks' totals, so
    no task sees more than one block or one row per block.
    """
    length = F.coalesce("length", F.lit(0)).cast("long").alias("length")
    counts = lengths.select(length).groupBy("length").agg(F.count("*").alias("n_docs"))
    counts = cut(counts.withColumn("block", F.floor(F.col("length") / BLOCK)), "histogram")
    tokens = F.col("length") * F.col("n_docs")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(over), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(over), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(Window.partitionBy()).alias("all_docs"),
        F.sum("t").over(Window.partitionBy()).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.join(blocks, "block")
        .select(
            "length",
            "n_docs",
            "all_docs",
            "all_tokens",
            (F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("docs_after")).alias("docs_over"),
            (F.coalesce(F.sum(tokens).over(longer), F.lit(0)) + F.col("tokens_after")).alias("tokens_over"),
        )
        .select(
            F.col("length").alias("context_limit"),
            "n_docs",
            (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
            (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_within"),
            "docs_over",
            "tokens_over",
            (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("tokens_kept"),
            (F.col("tokens_over") - F.col("docs_over") * F.col("length")).alias("tokens_lost"),
            F.round((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs"), 9).alias("quantile"),
        )
    )


def quantiles(lengths_table: DataFrame, shares: list[float | str]) -> DataFrame:
    """``share, length``: the least context limit within which at least that share of documents lies.

    Shares are taken as the decimals they are written as, and compared as whole numbers. An empty table gives null lengths.
    """
    exact = [Fraction(str(q)) for q in shares]
    docs = F.col("docs_within") + F.col("docs_over")
    wide = lambda c, n: c.cast("decimal(19,0)") * F.lit(Decimal(n)).cast("decimal(19,0)")
    enough = [wide(F.col("docs_within"), q.denominator) >= wide(docs, q.numerator) for q in exact]
    least = [F.min(F.when(ok, F.col("context_limit"))).alias(str(k)) for k, ok in enumerate(enough)]
    each = F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(str(k)).alias("length")) for k, q in enumerate(exact)))
    return lengths_table.agg(*least).select(F.inline(each))


def totals_at(lengths_table: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_within, docs_over, tokens_kept, tokens_lost`` for any limits, whether or not a document has that length.

    What lies within a limit is read off the row of the greatest length up to it. An empty table gives zeros.
    """
    most = lambda c, n: F.coalesce(F.max(F.when(F.col("context_limit") <= n, F.col(c))), F.lit(0)).cast("long")
    whole = lambda a, b: F.coalesce(F.max(F.col(a) + F.col(b)), F.lit(0)).cast("long")
    sums = {"docs": whole("docs_within", "docs_over"), "tokens": whole("tokens_within", "tokens_over")}
    sums |= {f"{c}_{k}": most(f"{c}_within", n) for k, n in enumerate(limits) for c in ("docs", "tokens")}
    rows = []
    for k, n in enumerate(limits):
        over = F.col("docs") - F.col(f"docs_{k}")
        kept = F.col(f"tokens_{k}") + over * n
        rows.append(
            F.struct(
                F.lit(n).cast("long").alias("context_limit"), F.col(f"docs_{k}").alias("docs_within"), over.alias("docs_over"),
                kept.alias("tokens_kept"), (F.col("tokens") - kept).alias("tokens_lost"),
            )
        )
    return lengths_table.agg(*(c.alias(n) for n, c in sums.items())).select(F.inline(F.array(*rows)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path()))
