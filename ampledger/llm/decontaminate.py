"""Benchmark decontamination by greedy string tiling.

Documents and test items that share seeds of three words are paired; each pair is tiled by
running Karp-Rabin: windows of falling length are hashed, equal ones verified and grown to
maximal matches, and these marked, longest first, so that every word of either side lies in
one tile at most. A document is contaminated by an item if its tiles cover enough of the
item, in whatever order the passages stand.

Pairing loses nothing: tiles of three words or more that cover ``need`` words of an item hold
at least ``need / 3`` of its seeds, so one seed is met even if all but that many, the
commonest ones, are left out.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampledger.llm.common import cut, drop_rows, map_rows, table, variant_of

TILE_WORDS = 3  # least tile, and the length of a seed
COVERAGE = 0.8
WORDS_SHIPPED = 400_000  # benchmark words that may be shipped to the tasks, some 60 MB as Python objects
BUNDLES = 16  # lists into which the items that a text meets are dealt, where the benchmark is too large to ship
FILTER_BITS = 1 << 26  # of the filter that is shipped in place of a larger benchmark's seeds: 8 MB

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _windows(ids: np.ndarray, free: np.ndarray, size: int, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``size`` unmarked words. The hash rolls: prefix sums, shifted to one exponent."""
    n = len(ids)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(ids.astype(np.uint64) * power[:n], dtype=np.uint64)])
    whole = np.concatenate([[0], np.cumsum(free)])
    starts = np.flatnonzero(whole[size:] - whole[:-size] == size)
    return starts, (sums[starts + size] - sums[starts]) * power[len(power) - 1 - starts]


def _within(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a window."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return np.cumsum(edges[:-1]) > 0


def _maximal(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """(3, n): length, place in a and place in b of the maximal runs of ``size`` or more equal words; 0 and -1 are equal to nothing.

    Runs are verified word by word along all places of a at once, so that a match is walked once
    and not once from each of its starts.
    """
    run, found = np.zeros(len(a), np.int64), []
    for j in range(len(b) + 1):
        grown = np.zeros(len(a), np.int64)
        if j < len(b) and b[j] > 0:
            np.multiply(np.concatenate([[0], run[:-1]]) + 1, a == b[j], out=grown)
        ended = np.flatnonzero((run >= size) & (np.append(grown[1:], 0) == 0))
        if len(ended):
            found.append((run[ended], ended - run[ended] + 1, j - run[ended]))
        run = grown
    return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


def _mark(found: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Longest first, then earliest; what a tile leaves of other matches stays in play where it has ``size`` words."""
    out = []
    while found.shape[1]:
        k, at_a, at_b = found
        best = found[:, k == k.max()]
        best = best[:, best[1] == best[1].min()]
        n, i, j = (int(v) for v in best[:, best[2].argmin()])
        out.append((n, i, j))
        hit = ((at_a < i + n) & (at_a + k > i)) | ((at_b < j + n) & (at_b + k > j))
        rest = found[:, ~hit]
        k, at_a, at_b = found[:, hit]
        # stretches of each match that the tile takes, by its place in a and in b; an empty one counts as the other
        a0, a1 = np.clip(i - at_a, 0, k), np.clip(i + n - at_a, 0, k)
        b0, b1 = np.clip(j - at_b, 0, k), np.clip(j + n - at_b, 0, k)
        no_a, no_b = a0 == a1, b0 == b1
        a0, a1, b0, b1 = np.where(no_a, b0, a0), np.where(no_a, b1, a1), np.where(no_b, a0, b0), np.where(no_b, a1, b1)
        pieces = ((np.zeros_like(k), np.minimum(a0, b0)), (np.minimum(a1, b1), np.maximum(a0, b0)), (np.maximum(a1, b1), k))
        found = np.concatenate([rest, *(np.stack([z - s, at_a + s, at_b + s])[:, z - s >= size] for s, z in pieces)], axis=1)
    return out


def tiles(doc: list[str], item: list[str], least: int = TILE_WORDS) -> list[tuple[int, int, int]]:
    """``(length, at in doc, at in item)`` of the tiles, in the order in which they are marked."""
    number = {w: k + 1 for k, w in enumerate(dict.fromkeys(item))}
    a = np.fromiter((number.get(w, 0) for w in doc), np.int64, len(doc))
    b = np.fromiter((number[w] for w in item), np.int64, len(item))
    free_a, free_b = a > 0, np.ones(len(b), bool)
    out, size = [], len(b)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(max(len(a), len(b)) + 1, _BASE), dtype=np.uint64)
        while size >= least and free_b.any():
            at_a, hash_a = _windows(a, free_a, size, power)
            at_b, hash_b = _windows(b, free_b, size, power)
            met_a = at_a[np.isin(hash_a, hash_b)]
            if len(met_a):
                # only places inside windows that met, with a gap between those that are no neighbours
                places = np.flatnonzero(_within(met_a, size, len(a)))
                gaps = np.concatenate([[0], np.cumsum(np.diff(places) > 1)])
                at = np.arange(len(places)) + gaps
                part, where = np.full(at[-1] + 1, -1), np.zeros(at[-1] + 1, np.int64)
                part[at], where[at] = a[places], places
                inside = _within(at_b[np.isin(hash_b, hash_a)], size, len(b))
                for k, i, j in _mark(_maximal(part, np.where(inside, b, 0), size), size):
                    i = int(where[i])
                    free_a[i : i + k] = free_b[j : j + k] = False
                    out.append((k, i, j))
            size = max(least, size // 2) if size > least else 0
    return out


def _kept_seeds(n_words: int, n_seeds: int, size: int, coverage: float) -> int:
    """How many of an item's seeds, the rarest, are looked up."""
    return n_seeds - max(1, math.ceil(math.ceil(coverage * n_words - 1e-9) / size)) + 1


class Seeds:
    """Items, numbered as given, by their rarer seeds. Of each seed one word, the rarest in the benchmark, is looked up in a document first."""

    def __init__(self, items: list[tuple[int | None, str | None]], coverage: float = COVERAGE, least: int = TILE_WORDS):
        self.ids = [i for i, _ in items]
        self.items = [words_of(t) for _, t in items]
        self.coverage, self.least = coverage, least
        grams = [self._grams(ws, min(least, len(ws))) for ws in self.items]
        often, usual = Counter(g for gs in grams for g in gs), Counter(w for ws in self.items for w in ws)
        self.seeds: dict[tuple[str, ...], set[int]] = defaultdict(set)
        self.anchors: dict[str, set[tuple[int, int]]] = defaultdict(set)  # word -> (place in seed, words of seed)
        for i, (ws, gs) in enumerate(zip(self.items, grams, strict=True)):
            size = min(least, len(ws))
            for k in sorted(range(len(gs)), key=lambda k: (often[gs[k]], k))[: _kept_seeds(len(ws), len(gs), size, coverage) if gs else 0]:
                seed = gs[k]
                self.seeds[seed].add(i)
                place = min(range(size), key=lambda p: (usual[seed[p]], -len(seed[p]), p))
                self.anchors[seed[place]].add((place, size))

    @staticmethod
    def _grams(words: list[str], size: int) -> list[tuple[str, ...]]:
        return list(zip(*(words[k:] for k in range(size)), strict=False)) if size else []

    def items_in(self, words: list[str]) -> set[int]:
        """Items with one of their rarer seeds in the words."""
        found: set[int] = set()
        anchors, seeds = self.anchors, self.seeds
        for k in [k for k, w in enumerate(words) if w in anchors]:
            for place, size in anchors[words[k]]:
                if k >= place:
                    found |= seeds.get(tuple(words[k - place : k - place + size]), _NONE)
        return found

    def matches(self, words: list[str], among: Iterable[int] | None = None) -> list[tuple[int, int, int, int]]:
        """``(item, tiles, covered, words of the item)`` of the items that are covered enough."""
        out, grams = [], {}
        for i in sorted(self.items_in(words)) if among is None else among:
            item = self.items[i]
            size = min(self.least, len(item))
            if size not in grams:
                grams[size] = set(self._grams(words, size))
            met = [k for k, g in enumerate(self._grams(item, size)) if g in grams[size]]
            if len({k + t for k in met for t in range(size)}) < self.coverage * len(item):
                continue  # no tiling can cover enough
            found = tiles(words, item, size)
            covered = sum(t[0] for t in found)
            if covered >= self.coverage * len(item):
                out.append((i, len(found), covered, len(item)))
        return out


_NONE: frozenset[int] = frozenset()
_held: dict[str, Seeds] = {}  # of a Python worker: the last benchmark shipped to it

_FOUND = "doc_id long, item_id long, tiles long, covered long, item_words long, coverage double"


def _found_rows(rows: list[tuple], at: list[int], held: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """Rows of _FOUND, each with the held columns of the input row that it is of."""
    cols = list(zip(*rows, strict=True)) or [()] * 6
    types = [pa.int64()] * 5 + [pa.float64()]
    made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
    return pa.RecordBatch.from_arrays(
        made + [c.take(pa.array(at, pa.int64())) for c in held], ["doc_id", "item_id", "tiles", "covered", "item_words", "coverage", *names]
    )


def _tile_rows(items, least: int, coverage: float) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    name = uuid.uuid4().hex

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        if name not in _held:
            _held.clear()
            _held[name] = Seeds(items.value, coverage, least)
        seeds = _held[name]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, at = [], []
            for n, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for i, found, covered, size in seeds.matches(words_of(text)):
                    rows.append((doc_id, seeds.ids[i], found, covered, size, covered / size))
                    at.append(n)
            return _found_rows(rows, at, batch.columns[2:], batch.schema.names[2:])

        return each

    return make


def _seed_hashes(words: list[str], size: int) -> np.ndarray:
    """A 64-bit number for each run of ``size`` words; unequal runs that share one are told apart by tiling."""
    if len(words) < size or not size:
        return np.zeros(0, np.int64)
    known: dict[str, int] = {}
    one = np.fromiter((known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode("utf-8", "surrogatepass"))) for w in words), np.uint64, len(words))
    n, out = len(words) - size + 1, np.full(len(words) - size + 1, np.uint64(size))
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out + one[k : k + n]) * _BASE
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _item_seeds(least: int) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(least, len(words))
                rows += [(item, k, int(s), len(words), size) for k, s in enumerate(_seed_hashes(words, size))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_row", "place", "seed", "words", "size"])

        return each

    return make


def _document_seeds(bits, least: int) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            owner, seeds = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                mine = np.unique(np.concatenate([_seed_hashes(words, size) for size in range(1, least + 1)]))
                spot = mine.view(np.uint64) % np.uint64(FILTER_BITS)
                mine = mine[(held[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                owner.append(np.full(len(mine), n))
                seeds.append(mine)
            at, cols = pa.array(np.concatenate(owner)), [batch.column(0), *batch.columns[2:]]
            names = ["doc_id", *batch.schema.names[2:]]
            return pa.RecordBatch.from_arrays([c.take(at) for c in cols] + [pa.array(np.concatenate(seeds))], [*names, "seed"])

        return each

    return make


def _filter_of(seeds: DataFrame, size: int = FILTER_BITS) -> bytes:
    """``size`` bits, set at every seed: 1,024 rows of fixed size reach the driver at most, however many the seeds."""
    rows = 1024
    width = size // rows

    def part(keys: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(width, np.uint8)
        bits[keys["spot"].to_numpy() % width] = 1
        return pd.DataFrame({"row": [int(keys["spot"].iloc[0]) // width], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    spot = F.expr(f"cast(pmod(pmod(seed, {size}), {size}) as int)")
    spots = seeds.select(spot.alias("spot")).distinct().withColumn("row", F.expr(f"spot div {width}"))
    made = spots.groupBy("row").applyInPandas(part, "row long, bits binary").collect()
    out = bytearray(size // 8)
    for r in made:
        out[r.row * width // 8 : (r.row + 1) * width // 8] = r.bits
    return bytes(out)


def _pairs_by_join(picked: DataFrame, items: DataFrame, coverage: float, least: int, held: str) -> DataFrame:
    """For a benchmark too large to ship: seeds meet by an equi-join in one pass over the texts, pairs are tiled after it.

    A text sends out only those of its seeds that pass a filter of fixed size.
    """
    items = cut(items.withColumn("item_row", F.monotonically_increasing_id()), "items")
    seeds = cut(map_rows(items.select("item_row", "text"), _item_seeds(least), "item_row long, place long, seed long, words long, size long"), "item-seeds")
    often = seeds.groupBy("seed").agg(F.count("*").alias("often"))
    rarest = F.row_number().over(Window.partitionBy("item_row").orderBy("often", "place"))
    need = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("words") * coverage - 1e-9) / F.col("size")))
    ranked = seeds.join(often, "seed").withColumn("nth", rarest)
    total = F.count("*").over(Window.partitionBy("item_row"))
    kept = cut(ranked.withColumn("n", total).where(F.col("nth") <= F.col("n") - need + 1).select("seed", "item_row").distinct(), "kept-seeds")
    bits = picked.sparkSession.sparkContext.broadcast(_filter_of(kept))
    marked = picked.select("doc_id", "text", variant_of("text").alias("_variant"))
    sent = map_rows(marked, _document_seeds(bits, least), "_id long, _variant long, seed long")
    met = cut(sent.join(kept, "seed").select("_id", "_variant", "item_row").distinct(), "pairs")
    # A text is read once for each bundle of the items that it meets, and not once for each item.
    named = items.select("item_row", F.struct(F.col("item_id").alias("id"), "text").alias("item"))
    bundle = F.pmod("item_row", F.lit(BUNDLES)).alias("bundle")
    lists = met.join(named, "item_row").groupBy("_id", "_variant", bundle).agg(F.collect_list("item").alias("_items"))
    same = picked["doc_id"].eqNullSafe(lists["_id"]) & (variant_of("text") == lists["_variant"])
    rest = [c for c in picked.columns if c not in ("doc_id", "text")]
    pairs = picked.join(lists.hint("shuffle_hash"), same).select("doc_id", "text", "_items", *rest)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, at = [], []
            columns = (batch.column(k).to_pylist() for k in range(3))
            for n, (doc_id, text, listed) in enumerate(zip(*columns, strict=True)):
                seeds = Seeds([(item["id"], item["text"]) for item in listed], coverage, least)
                for i, found, covered, size in seeds.matches(words_of(text), range(len(listed))):
                    rows.append((doc_id, seeds.ids[i], found, covered, size, covered / size))
                    at.append(n)
            return _found_rows(rows, at, batch.columns[3:], batch.schema.names[3:])

        return each

    return map_rows(pairs, make, _FOUND + held)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    coverage: float = COVERAGE,
    least: int = TILE_WORDS,
    words_shipped: int = WORDS_SHIPPED,
) -> DataFrame:
    """``doc_id, item_id, tiles, covered, item_words, coverage`` of each pair covered enough; clean documents give no row.

    Words are runs of letters, digits and underscores in lower case. Every pair whose tiling
    covers enough is found. Items of fewer than ``least`` words are their own seed; null, empty
    and wordless items and texts match nothing. Repeated documents give repeated rows; items
    are told apart by id and text, so that several texts of one id each count, those of a null
    id too, and repeats of both count once. Other columns are not read. The benchmark is
    counted first: up to ``words_shipped`` words it goes to the tasks as it is, a larger one
    meets the documents in a join of seeds.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _matches(picked, benchmark, coverage, least, words_shipped)


def _matches(picked: DataFrame, benchmark: DataFrame, coverage: float, least: int, words_shipped: int, held: str = "") -> DataFrame:
    """``contaminated`` for ``picked(doc_id, text, ...)``; ``held`` is the schema of what follows the text, returned last."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    words = items.agg(F.coalesce(F.sum(F.length("text") / 5 + 1), F.lit(0))).first()[0]
    if words > words_shipped:
        return _pairs_by_join(picked, items, coverage, least, held)
    shipped = picked.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])
    return map_rows(picked, _tile_rows(shipped, least, coverage), _FOUND + held)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the rows that some item contaminates; schema unchanged. Each row is judged by its own text."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", variant_of("text").alias("variant"))
    return drop_rows(docs, _matches(picked, benchmark, COVERAGE, TILE_WORDS, WORDS_SHIPPED, ", variant long"))
