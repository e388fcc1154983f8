"""Exact dedup: binary fuse filters per immutable snapshot, exact buckets, byte check.

The corpus is a sequence of immutable snapshots, the last of which is the newest batch.
Each keeps one static filter per digest shard. Incoming digests, already reduced to one
row per distinct digest of their batch, are screened by the filters of all earlier
snapshots; those that pass are joined with the snapshot's exact digest bucket, and
duplicates inside a batch come from its own grouping. Texts move only for digests that
have more than one row: there every byte is compared, as the text itself is the grouping key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm import fuse
from ampledger.llm.common import cut, small, table, text_of

KEYS_PER_SHARD = 200_000  # a filter shard then takes about 0.25 MB
BROADCAST_DIGESTS = 100_000  # 40 bytes each: at most about 8 MB are broadcast
SALTS = 16


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _build_filters(keys: pd.DataFrame) -> pd.DataFrame:
    made = fuse.build(keys["key"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame([made | {"snapshot": keys["snapshot"].iloc[0], "shard": keys["shard"].iloc[0]}])


def _screen(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    keys, found = incoming["key"].to_numpy(np.int64).view(np.uint64), []
    for f in filters.to_dict("records"):
        hit = incoming[(incoming["snapshot"].to_numpy() > f["snapshot"]) & fuse.contains(f, keys)]
        found.append(pd.DataFrame({"digest": hit["digest"], "variant": hit["variant"], "snapshot": f["snapshot"]}))
    return pd.concat(found) if found else pd.DataFrame({"digest": [], "variant": [], "snapshot": []})


def exact_dedup(
    docs: DataFrame,
    snapshot: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_bytes,
    variant: Callable[[Column], Column] = F.xxhash64,
    broadcast_digests: int = BROADCAST_DIGESTS,
    keys_per_shard: int = KEYS_PER_SHARD,
) -> DataFrame:
    """One row per row of ``docs``: ``row_id, doc_id, digest, snapshot, keep_id, group_size, kept``.

    ``snapshot`` numbers the immutable snapshot of each row, in order of arrival. Null texts
    count as empty. Of equal texts the row with the largest id is kept; a null id counts as
    smaller than any other, and of repeated rows with that same id one is kept. Other columns
    of ``docs`` are neither read nor returned, so their names cannot clash. An empty table
    gives an empty result.

    Groups are keyed by ``digest`` and ``variant`` of the text; a digest that two texts share is thus
    still told apart, and where both agree for two texts their rows are grouped by the bytes.
    Such rows have negative row ids.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        digest(text).alias("digest"),
        variant(text).alias("variant"),
        F.coalesce(snapshot.cast("int"), F.lit(0)).alias("snapshot"),
    )
    marks = cut(rows.drop("text").withColumn("row_id", F.monotonically_increasing_id()), "digests")

    # Duplicates of a batch are grouped within it; what is left is one row per distinct digest.
    batches = cut(marks.groupBy("snapshot", "digest", "variant").agg(F.count("*").alias("n")), "batches")
    distinct = batches.count()
    shards = max(1, -(-distinct // keys_per_shard))
    key = F.xxhash64("digest", "variant")
    keyed = batches.select(
        "snapshot", "digest", "variant", key.alias("key"), F.pmod(F.hash(key), F.lit(shards)).alias("shard")
    )
    filters = (
        keyed.select("snapshot", "shard", "key")
        .groupBy("snapshot", "shard")
        .applyInPandas(_build_filters, "snapshot int, shard int, seed int, length int, segments int, cells binary")
    )
    passed = (
        keyed.groupBy("shard")
        .cogroup(filters.groupBy("shard"))
        .applyInPandas(_screen, "digest binary, variant long, snapshot int")
    )
    confirmed = passed.join(batches, ["snapshot", "digest", "variant"], "left_semi")
    repeated = cut(
        batches.where("n > 1").select("digest", "variant").unionByName(confirmed.select("digest", "variant")).distinct(),
        "repeated",
    )

    # Byte check of the repeated digests only.
    texts = rows.select("doc_id", "text", "digest", "variant")
    on, n_repeated = ["digest", "variant"], repeated.count()
    if n_repeated <= broadcast_digests:
        suspects = texts.join(F.broadcast(repeated), on, "left_semi")
    else:  # a hot text is spread over salts before it moves, by its place where ids are null
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        texts = texts.withColumn("salt", F.pmod(F.hash(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(SALTS)))
        suspects = texts.join(salted.hint("shuffle_hash"), [*on, "salt"], "left_semi")
        suspects = suspects.groupBy(*on, "salt", "text").agg(
            F.max("doc_id").alias("doc_id"), F.count("*").alias("n")
        )
    size = F.sum("n") if "n" in suspects.columns else F.count("*")
    same = suspects.groupBy(*on, "text").agg(F.max("doc_id").alias("keep_id"), size.alias("group_size"))
    classes = same.groupBy(*on).agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    classes = cut(classes, "classes")
    shared = classes.where("texts > 1").select(*on)
    told_apart = None
    if not shared.isEmpty():  # texts that only their bytes tell apart
        told_apart = cut(_by_bytes(rows.join(shared, on, "left_semi")), "told-apart")
        marks = marks.join(shared, on, "left_anti")
    classes = classes.where("texts = 1").drop("texts")
    # Among repeated rows of the id that stays, the one with the least row_id. Where this join moves rows, those of
    # one text and id (a null one too) are first combined in their tasks.
    if n_repeated <= broadcast_digests:
        marked, held = marks.alias("m"), F.broadcast(classes).alias("c")  # no more classes than repeated digests
    else:
        marked, held = marks.groupBy(*on, "doc_id").agg(F.min("row_id").alias("row_id")).alias("m"), classes.alias("c")
    same_id = F.col("m.doc_id").eqNullSafe(F.col("c.keep_id"))
    staying = marked.join(held, (F.col("m.digest") == F.col("c.digest")) & (F.col("m.variant") == F.col("c.variant")) & same_id)
    stays = staying.groupBy("c.digest", "c.variant").agg(F.min("m.row_id").alias("keep_row"))
    kept = classes.join(stays, on)
    if n_repeated <= broadcast_digests:
        found = marks.join(F.broadcast(kept), on, "left")
    else:
        salted = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = marks.withColumn("salt", F.pmod(F.hash("row_id"), F.lit(SALTS)))
        found = dealt.join(salted, [*on, "salt"], "left")
    found = found.select(
        "row_id",
        "doc_id",
        "digest",
        "variant",
        "snapshot",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(True)).alias("kept"),
    )
    return found if told_apart is None else found.unionByName(told_apart)


def _by_bytes(rows: DataFrame) -> DataFrame:
    """Rows of digests that several texts share, grouped by the text itself; salted, as a hot text may be among them."""
    rows = cut(rows.withColumn("row_id", -1 - F.monotonically_increasing_id()), "shared-digests")
    rows = rows.withColumn("salt", F.pmod(F.hash("row_id"), F.lit(SALTS)))
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.col("doc_id").isNotNull().alias("known"), (-F.col("row_id")).alias("nth"))
    parts = rows.groupBy("text", "salt").agg(F.max(order).alias("top"), F.count("*").alias("n"))
    whole = parts.groupBy("text").agg(F.max("top").alias("top"), F.sum("n").alias("group_size"))
    met = rows.join(whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["text", "salt"])
    keep = F.when(F.col("top.known"), F.col("top.id"))
    return met.select("row_id", "doc_id", "digest", "variant", "snapshot", keep.alias("keep_id"), "group_size", (-F.col("row_id") == F.col("top.nth")).alias("kept"))


SNAPSHOTS = 4


def arrival(id_col: str = "doc_id") -> Column:
    """Snapshot number for a table that carries none: three immutable snapshots and a new batch.

    Spread by a hash of the id, so every snapshot is a like share of the corpus; all rows belong to one.
    """
    return F.pmod(F.xxhash64(id_col), F.lit(SNAPSHOTS)).cast("int")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), arrival())
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` less all but the kept row of each text; schema unchanged.

    Rows that repeat both id and text are reduced to one of them by a path of their own,
    which is empty where ids are unique.
    """
    found = cut(exact_dedup(docs, arrival()).select("doc_id", "variant", "kept"), "dedup")
    _id, variant = F.col("doc_id").alias("_id"), F.col("variant").alias("_variant")
    dropped = found.where("not kept").select(_id, variant).distinct()
    again = dropped.join(
        found.where("kept"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_variant") == F.col("variant")), "left_semi"
    )

    def same(keys: DataFrame) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (F.xxhash64(text_of("text")) == keys["_variant"])

    dropped, again = small(dropped), small(again)
    unique = docs.join(dropped, same(dropped), "left_anti")
    return unique.unionByName(docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))
