"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments (23, 23 and 18 bits). Two fingerprints
with at most two differing bits agree on at least one whole segment (pigeonhole), and in
the next segment they differ in at most two bits. That segment is turned into the indices
of the Golay codewords to which the words within one bit of it decode; as two words at
distance two have a word in between, they share an index. So (whole segment, index) is a
key that every linked pair shares, some 16 keys a fingerprint, and no more than one in
2^35 unrelated pairs meets in one. Pairs that meet are verified; components follow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm.common import cut, drop_rows, map_rows, small, table, variant_of
from ampledger.llm.components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
SEGMENTS = ((41, 23), (18, 23), (0, 18))  # (shift, width)
PAIR_BUCKET = 64  # buckets of more fingerprints are linked over midpoints instead
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the binary Golay code


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator polynomial."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


def golay_leaders() -> np.ndarray:
    """Error pattern of up to three bits for each of the 2^11 syndromes (the code is perfect)."""
    bits = 1 << np.arange(23, dtype=np.int64)
    pairs = [a | b for i, a in enumerate(bits) for b in bits[:i]]
    triples = [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    patterns = np.array([0, *bits, *pairs, *triples], np.int64)
    leaders = np.full(2048, -1, np.int64)
    leaders[_syndromes(patterns)] = patterns
    return leaders


def golay_indices(words: np.ndarray, leaders: np.ndarray) -> np.ndarray:
    """(n, 24): the 12-bit index of the codeword nearest to each word and to its 23 neighbours."""
    near = np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])[None, :] ^ words.astype(np.int64)[:, None]
    return (near ^ leaders[_syndromes(near)]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of uint64 fingerprints: the positions in ``fps`` and the distinct keys of each."""
    leaders, owners, keys = golay_leaders(), [], []
    parts = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    for k in range(3):
        index = np.sort(golay_indices(parts[(k + 1) % 3], leaders), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, _ = np.nonzero(new)
        owners.append(row)
        keys.append((np.int64(k) << 35) | (parts[k][row] << 12) | index[new])
    return np.concatenate(owners), np.concatenate(keys)


def _fingerprints(shingle: int) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            columns = [batch.column(0), *batch.columns[2:], pa.array(made.view(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *batch.schema.names[2:], "fp"])

        return each

    return make


def _keys() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy()
        owner, keys = fuzzy_keys(fps.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fps[owner]), pa.array(keys)], ["fp", "key"])

    return each


def _midpoints() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy()
        mid = (fps.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(fps, 65)), pa.array(mid.ravel())], ["fp", "mid"])

    return each


def near_links(fps: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fps(fp)`` whose closure is "differ in <= 2 bits".

    Buckets of up to ``pair_bucket`` fingerprints are joined with themselves and verified.
    Larger ones would grow with the square, so each fingerprint in one is filed under the 65
    words within one bit of it, and those filed together are linked to the least of them:
    two fingerprints share such a word exactly if they differ in two bits or fewer.
    """
    keys = cut(map_rows(fps.select("fp"), _keys, "fp long, key long"), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keys.join(sizes, "key"), "buckets")
    few = met.where(F.col("n") <= pair_bucket)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & close)
        .select("a", "b")
    )
    crowded = met.where(F.col("n") > pair_bucket).select("fp").distinct()
    filed = map_rows(crowded, _midpoints, "fp long, mid long")
    least = filed.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = filed.join(least, "mid").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` for each row; component_id is the least id reachable by links.

    ``shingle``: words of a shingle. The distance is MAX_BITS, for which the keys are made.

    Null and wordless texts have fingerprint zero and are linked as any other. Equal
    fingerprints are collapsed before links are sought, so copies cost one row. A null id
    is ignored for component_id (null if a component has no other). Repeated rows give
    repeated results; other columns are not read. An empty table gives an empty result.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return _with_least(map_rows(picked, _fingerprints(shingle), "doc_id long, fp long"), "component_id", F.col("doc_id"))


def _with_least(marked: DataFrame, name: str, value: Column) -> DataFrame:
    """``marked(fp, ...)`` with the least ``value`` of each row's component as column ``name``."""
    marked = cut(marked, "fingerprints")
    fps = cut(marked.groupBy("fp").agg(F.min(value).alias("least")), "distinct-fps")
    roots = connected_components(near_links(fps)).select(F.col("node").alias("fp"), "root")
    rooted = cut(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias(name))
    named = small(rooted.join(ids, "root").select("fp", name))
    return marked.join(named, "fp")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component, the one with the least id; schema unchanged.

    Of several texts with that id the one with the least XXH64 stays; a null id stays only
    where the component has no other. Rows that repeat both that id and that text all stay: a
    stage before this one removes repeats.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", variant_of("text").alias("variant"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "variant")
    found = _with_least(map_rows(picked, _fingerprints(shingle), "doc_id long, variant long, fp long"), "kept", row)
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("variant") == F.col("kept.variant"))
    return drop_rows(docs, found.where(~same))
