"""Removal of repeated passages by suffix order over a prefix-free parse.

Texts are UTF-8 bytes. A byte is removed if a string of ``length`` bytes that covers it also starts
earlier: in a document of lesser id, or earlier in its own.

A rolling hash over eight bytes sets triggers, some one in 64. A string of ``length`` bytes belongs to
its first trigger; one without any is parsed again by triggers four times as dense, one without
these by every byte. All of this is read off the string alone, so equal strings stand alike to their
trigger. Strings of neighbouring starts with one trigger form a phrase: what stands left of the
trigger, and what is parsed right of it.

* Phrases of equal bytes are collapsed to the first; strings in all others are repeats as they stand. Those of
  one text never leave it.
* Distinct phrases can share a string only if they share half of it on one side of the trigger. Phrases
  that share no such half with another drop out, by a filter as large as the number of shared halves asks
  for. The rest meet by it, in groups, and are shuffled once. Halves are dealt to rounds over the texts, so many that
  a round's filter stays under 2 to the power of FILTER_MOST bits and its phrases under about the size of the texts.
* In a group, the suffix array of the dictionary (the distinct left parts up to the trigger) and the
  order of what the parse has next (the right parts) combine into the corpus order of all starts. Left parts
  end with their only trigger, so none is a prefix of another, and strings are equal exactly
  where these are equal and the right parts agree for the bytes that are left.
* Phrases whose half is in many places are collapsed before they meet. A group still too large for one task
  is told apart by digests of its strings instead, which are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm.common import BROADCAST_ROWS, cut, map_rows, table, text_of, variant_of
from ampledger.llm.decontaminate import _filter_of
from ampledger.sources.scratch import release

LENGTH = 100  # bytes of a repeated string
TRIGGER = 8  # bytes of a trigger
DENSITIES = (6, 4)  # leading zero bits of a trigger's hash, by level; at the last level every byte is one
BLOCK = 1 << 20  # starts of a text that are parsed at once
GROUP_ROWS = 1000  # phrases of a group that one task orders; larger ones go by digest
BUCKET_ROWS = 20_000  # phrases of a task's groups, about
SPANS_BYTES = 16 << 20  # of lists of spans that may be broadcast
FILTER_LEAST, FILTER_MOST = 20, 28  # a filter has 2 to the power of these bits: 32 MB at most
KEY_BITS = 10  # bits of a filter for a half in it, at least: one in 30 or fewer of the others gets through
ROW_BYTES = 160  # on disk of a phrase: some 45 in its table, 115 in the shuffle

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_ID = "doc_id long, variant long"
_FAR = np.int64(1) << 60


# --- the parse, in tasks ---


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one number; ``data`` ends with eight bytes of padding."""
    n = len(data) - 8
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        part = np.frombuffer(data, "<u8", (len(data) - k) // 8, k)
        at = out[k::8]
        at[:] = part[: len(at)]
    return out


def _hash_at(words: np.ndarray, places: np.ndarray, width: int, salt: np.ndarray) -> np.ndarray:
    """A number for the ``width`` bytes from each place on."""
    out = salt.astype(np.uint64)
    for off in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        out = (out ^ words[places + off]) * _ODD
        out ^= out >> np.uint64(29)
    return (out * _MIX).view(np.int64)


def phrases(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(segment, a, b, q, key) of each phrase: starts a to b of strings whose first trigger is at q, and their shared half.

    ``starts`` and ``ends`` bound segments of ``length`` bytes or more in the concatenated text.
    """
    mixed = words * _ODD
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    reach, half = length - TRIGGER, (length - TRIGGER) // 2
    found, sparse = [], None
    for level, zeros in enumerate(DENSITIES):
        q = np.flatnonzero(mixed < np.uint64(1 << (64 - zeros)))
        seg = np.searchsorted(starts, q, "right") - 1
        inside = (seg >= 0) & (q + TRIGGER <= ends[seg])
        q, seg = q[inside], seg[inside]
        before = np.maximum(np.concatenate([[-1], q[:-1]]), starts[seg] - 1)
        a, b = np.maximum(before + 1, q - reach), np.minimum(q, ends[seg] - length)
        if sparse is not None:  # only strings that no sparser trigger is in
            after = np.append(sparse, _FAR)[np.searchsorted(sparse, q, "right")]
            b = np.where(np.isin(q, sparse, assume_unique=True), -1, np.minimum(b, after - reach - 1))
        on = a <= b
        found.append((seg[on], a[on], b[on], q[on], np.full(on.sum(), level)))
        sparse = q
    # strings without any trigger: each is its own
    last = np.searchsorted(q, ends, "left") - 1
    tail = np.where(last >= 0, np.append(q, -1)[last], -1)
    low = np.concatenate([before + 1, np.maximum(tail + 1, starts)])
    high = np.concatenate([np.minimum(q - reach - 1, ends[seg] - length), ends - length])
    owner, count = np.concatenate([seg, np.arange(len(starts))]), np.maximum(high - low + 1, 0)
    lone = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found.append((np.repeat(owner, count), lone, lone, lone, np.full(len(lone), len(DENSITIES))))
    seg, a, b, q, level = (np.concatenate(c) for c in zip(*found, strict=True))
    right, left = b > q - half, a <= q - half
    r, lf = np.flatnonzero(right), np.flatnonzero(left)
    keys = [_hash_at(words, q[r], length - half, 2 * level[r] + 2), _hash_at(words, q[lf] - half, half + TRIGGER, 2 * level[lf] + 3)]
    both = np.concatenate([r, lf])
    return (
        seg[both],
        np.concatenate([np.maximum(a[r], q[r] - half + 1), a[lf]]),
        np.concatenate([b[r], np.minimum(b[lf], q[lf] - half)]),
        q[both],
        np.concatenate(keys),
    )


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Blocks of about BLOCK bytes: data, (text, place) of each segment, and where each starts and ends in the data."""
    parts, owners, size = [], [], 0

    def block():
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        return b"".join(parts) + bytes(8), owners, ends - lengths, ends

    for n, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, BLOCK):
            parts.append(text[at : at + BLOCK + length - 1])
            owners.append((n, at))
            size += len(parts[-1])
            if size >= BLOCK:
                yield block()
                parts, owners, size = [], [], 0
    if parts:
        yield block()


def _of_one_text(words: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray, q: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Whether a phrase has the bytes of an earlier one of the same text.

    Phrases whose text and half are equal are compared by two hashes of 64 bits: one of the ``length`` bytes from its
    first start on, one of those from its last, which is all of it.
    """
    order = np.lexsort((text, key))
    same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    many = order[np.append(same, False) | np.append(False, same)] if len(same) else order[:0]
    head = _hash_at(words, a[many], length, 2 * (q - a)[many])
    tail = _hash_at(words, b[many], length, 2 * (b - a)[many] + 1)
    rank = np.lexsort((a[many], tail, head, text[many], key[many]))
    columns = (c[rank] for c in (tail, head, text[many], key[many]))
    equal = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    out = np.zeros(len(key), bool)
    out[many[rank[1:][equal]]] = True
    return out


def _key_counts(length: int) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Halves and the phrases that each is in, those of equal bytes counted once for each block of a text; without a half, the bytes."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(0).to_pylist()
            keys = [np.zeros(0, np.int64)]
            for data, owners, starts, ends in _segments(texts, length):
                words = _words(data)
                seg, a, b, q, key = phrases(words, starts, ends, length)
                keys.append(key[~_of_one_text(words, np.array([n for n, _ in owners])[seg], a, b, q, key, length)])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            columns = [np.append(key, 0), np.append(n, sum(map(len, texts))).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], mask=np.arange(len(key) + 1) == len(key)), pa.array(columns[1])], ["seed", "n"])

        return each

    return make


def _spots(key: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Two of 2 to the ``power`` places, from bits of the key that do not overlap."""
    bits = key.view(np.uint64)
    return bits >> np.uint64(64 - power), bits >> np.uint64(8) & np.uint64((1 << power) - 1)


def _filter(keys: DataFrame, n: int) -> tuple[bytes, int]:
    """A filter of the ``n`` keys in ``keys(seed)``, and the power of two of its bits."""
    power = min(max(FILTER_LEAST, (n * KEY_BITS - 1).bit_length()), FILTER_MOST)
    spots = F.array(F.shiftrightunsigned("seed", 64 - power), F.shiftrightunsigned("seed", 8).bitwiseAND(F.lit((1 << power) - 1)))
    return _filter_of(keys.select(F.explode(spots).alias("seed")), 1 << power), power


def _held(held: tuple[np.ndarray, int], key: np.ndarray) -> np.ndarray:
    bits, power = held
    probed = [(bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 for spot in _spots(key, power)]
    return (probed[0] & probed[1]).astype(bool)


def _phrase_rows(filters, length: int, part: int, rounds: int) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Phrases of the round ``part`` whose half passes the first filter, with a digest if it passes the second.

    Those that repeat an earlier one of the same text are merged spans without bytes, whether their half passes or not;
    as neighbours are of different rounds, the first gives them all.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        shared, hot = ((np.frombuffer(bits, np.uint8), power) for bits, power in filters.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(2).to_pylist()
            known = {n: set() for n, text in enumerate(texts) if len(text) > BLOCK}  # of texts in several blocks
            rows, again = [], []
            for data, owners, starts, ends in _segments(texts, length):
                words = _words(data)
                found = phrases(words, starts, ends, length)
                mine = found[4] % rounds == part
                seg, a, b, q, key = (c[mine] for c in found) if part else found
                repeats = _of_one_text(words, np.array([n for n, _ in owners])[seg], a, b, q, key, length)
                at = np.flatnonzero(repeats if part == 0 else np.zeros(0, bool))
                at = at[np.argsort(a[at], kind="stable")]
                opens = np.ones(len(at), bool)
                opens[1:] = (seg[at][1:] != seg[at][:-1]) | (a[at][1:] != b[at][:-1] + 1)
                last = np.append(opens[1:], True)[: len(at)]
                for s, lo, hi in zip(seg[at][opens].tolist(), a[at][opens].tolist(), b[at][last].tolist(), strict=True):
                    n, offset = owners[s]
                    again.append((n, lo - int(starts[s]) + offset, hi - int(starts[s]) + offset))
                on = np.flatnonzero(~repeats & (key % rounds == part) & _held(shared, key))
                on = on[np.argsort(a[on], kind="stable")]
                columns = (seg[on], a[on], b[on], q[on], key[on], _held(hot, key[on]))
                for s, lo, hi, at, k, much in zip(*(c.tolist() for c in columns), strict=True):
                    n, offset = owners[s]
                    x = data[lo : hi + length]
                    digest = xxhash.xxh3_128_digest(x, at - lo) if much or n in known else None
                    place = lo - int(starts[s]) + offset
                    if n in known:
                        if digest in known[n]:
                            again.append((n, place, place + hi - lo))
                            continue
                        known[n].add(digest)
                    rows.append((n, place, place + hi - lo, at - lo, k, digest if much else None, x))
            rows += [(n, a, b, None, None, None, None) for n, a, b in again]
            at, a, b, t, key, digest, x = list(zip(*rows, strict=True)) or [()] * 7
            at = pa.array(at, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.int32())]
            columns += [pa.array(key, pa.int64()), pa.array(digest, pa.binary()), pa.array(x, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "variant", "a", "b", "t", "key", "digest", "x"])

        return each

    return make


# --- suffix order, in tasks ---


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def dictionary_ranks(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a dictionary, inverted: the rank of each suffix of each of ``parts``, and where each part begins.

    Equal suffixes share a rank. A suffix ends with its part. By prefix doubling, from eight bytes on.
    """
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    words = _words(b"".join(parts) + bytes(8))
    left = np.repeat(ends, lengths) - np.arange(len(words))  # bytes up to the part's end
    held = np.minimum(left, 8)
    big = words.byteswap() >> (np.uint64(8) * (8 - held).astype(np.uint64)) << (np.uint64(8) * (8 - held).astype(np.uint64))
    rank, span, longest = _dense(_dense(big) * 9 + held) + 1, 8, int(lengths.max(initial=0))
    while span < longest:
        after = np.where(left > span, np.append(rank[span:], np.zeros(min(span, len(rank)), np.int64))[: len(rank)], 0)
        rank = _dense(rank * (len(rank) + 2) + after) + 1
        span *= 2
    return rank, ends - lengths


def parse_order(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each of ``parts`` in byte order, and how many bytes each in that order shares with the one before it."""
    width = max(map(len, parts), default=0)
    order = sorted(range(len(parts)), key=parts.__getitem__)
    rank = np.empty(len(parts), np.int64)
    rank[order] = np.arange(len(parts))
    grid = np.frombuffer(b"".join(parts[k].ljust(width, b"\0") for k in order), np.uint8).reshape(len(parts), width)
    lengths = np.array([len(parts[k]) for k in order], np.int64)
    shared = np.zeros(len(parts), np.int64)
    differ = np.concatenate([grid[1:] != grid[:-1], np.ones((max(0, len(parts) - 1), 1), bool)], axis=1)
    shared[1:] = np.minimum(differ.argmax(axis=1), np.minimum(lengths[1:], lengths[:-1]))
    return rank, shared


def corpus_order(xs: list[bytes], triggers: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all strings in the phrases ``xs``, in the order of their bytes: (phrase, offset, rank, first of its kind).

    ``triggers``: place of each phrase's trigger. A start is the first of its kind if the one before it has other bytes.
    """
    lefts = [x[: t + TRIGGER] for x, t in zip(xs, triggers.tolist(), strict=True)]
    entry: dict[bytes, int] = {}
    of = np.array([entry.setdefault(p, len(entry)) for p in lefts])
    ranks, begins = dictionary_ranks(list(entry))
    right, shared = parse_order([x[t:] for x, t in zip(xs, triggers.tolist(), strict=True)])
    counts = np.array([len(x) - length + 1 for x in xs])
    row = np.repeat(np.arange(len(xs)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    alpha = ranks[begins[of[row]] + offset]
    need = length - (triggers[row] - offset)  # bytes from the trigger on
    run = np.empty(len(row), np.int64)
    for n in np.unique(need):
        mine = need == n
        run[mine] = np.cumsum(shared < n)[right[row[mine]]]
    order = np.lexsort((right[row], alpha))
    new = np.ones(len(order), bool)
    new[1:] = (alpha[order][1:] != alpha[order][:-1]) | (run[order][1:] != run[order][:-1])
    return row[order], offset[order], alpha[order], new


def _ordered(length: int) -> Callable[[pa.Table], pa.Table]:
    """Spans of starts, in one bucket of whole groups, whose string starts earlier."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        none, doc, variant, first, trigger, key = (
            group[c].cast(pa.int64()).fill_null(0).to_numpy() for c in ("no_id", "doc_id", "variant", "a", "t", "key")
        )
        xs = group["x"].to_pylist()
        documents = np.lexsort((variant, doc, none))
        names = np.stack([none, doc, variant])[:, documents]
        rank = np.empty(len(documents), np.int64)
        rank[documents] = np.cumsum(np.concatenate([[False], (names[:, 1:] != names[:, :-1]).any(axis=0)]))
        began = (rank << 36) + first
        # phrases of equal bytes: the first stays, all of the others repeats it
        entry: dict[tuple[int, int, bytes], int] = {}
        order = np.argsort(began, kind="stable")
        of = np.empty(len(xs), np.int64)
        for n, k, t in zip(order.tolist(), key[order].tolist(), trigger[order].tolist(), strict=True):
            of[n] = entry.setdefault((k, t, xs[n]), n)
        whole = np.flatnonzero(began != began[of])
        wide = np.array([len(x) for x in xs], np.int64) - length
        # a half that is left with one phrase has nothing to meet
        kept = np.fromiter(entry.values(), np.int64, len(entry))
        _, group_of, size = np.unique(key[kept], return_inverse=True, return_counts=True)
        kept = kept[size[group_of] > 1]
        row = offset = least = np.zeros(0, np.int64)
        if len(kept):
            row, offset, _, new = corpus_order([xs[k] for k in kept.tolist()], trigger[kept], length)
        place = began[kept][row] + offset
        if len(kept):
            least = np.repeat(np.minimum.reduceat(place, np.flatnonzero(new)), np.diff(np.append(np.flatnonzero(new), len(new))))
        later = np.flatnonzero(place != least)
        later = later[np.lexsort((offset[later], row[later]))]
        r, o = row[later], offset[later]
        opens = np.ones(len(r), bool)
        opens[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)
        at, to = np.flatnonzero(opens), np.append(np.flatnonzero(opens)[1:], len(r))[: opens.sum()] - 1
        owner = np.concatenate([whole, kept[r[at]]])
        a = first[owner] + np.concatenate([np.zeros(len(whole), np.int64), o[at]])
        b = first[owner] + np.concatenate([wide[whole], o[to]])
        owner = pa.array(owner)
        out = [group["doc_id"].take(owner), group["variant"].take(owner), pa.array(a), pa.array(b)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out], ["doc_id", "variant", "a", "b"])

    return run


def _strings(length: int) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Every string of each phrase, as a digest of 128 bits."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, place, digest = [], [], []
            for n, (a, x) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                for k in range(len(x) - length + 1):
                    at.append(n)
                    place.append(a + k)
                    digest.append(xxhash.xxh3_128_digest(x[k : k + length]))
            at = pa.array(at, pa.int64())
            columns = [batch.column(k).take(at) for k in range(3)] + [pa.array(place, pa.int64()), pa.array(digest, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["no_id", "doc_id", "variant", "a", "digest"])

        return each

    return make


# --- the plan ---


def _place(a: Column | str = "a") -> Column:
    """What is earlier is less: documents of lesser id first, those without one last, texts of one id by their hash."""
    return F.struct(F.col("no_id"), F.col("doc_id"), F.col("variant"), F.col(a).alias("a") if isinstance(a, str) else a.alias("a"))


def _elsewhere(first: str) -> Column:
    """The row is not the one at ``first``."""
    same = [F.col(c).eqNullSafe(F.col(f"{first}.{c}")) for c in ("doc_id", "variant", "a")]
    return ~(same[0] & same[1] & same[2])


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, variant, copy``: whether another document of lesser id has the same text."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("variant", variant_of("text"))
    picked = picked.withColumn("sha", F.unhex(F.sha2("text", 256)))
    owner = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    again = picked.select("sha", owner.alias("owner")).groupBy("sha").agg(F.min("owner").alias("first"), F.count("*").alias("n"))
    again = cut(again.where("n > 1").select(F.col("sha").alias("_sha"), "first"), "copies")
    few = again.count() <= BROADCAST_ROWS
    met = picked.join(F.broadcast(again) if few else again.hint("shuffle_hash"), picked["sha"] == again["_sha"], "left")
    copy = F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    out = met.select("doc_id", "text", "variant", copy.alias("copy"))
    return out if few else cut(out, "marked")


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the table that needs them is written, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _rounds(halves: int, rows: int, size: int) -> int:
    """Rounds over texts of ``size`` bytes for as many shared halves, in as many phrases."""
    return max(1, -(-halves * KEY_BITS >> FILTER_MOST), -(-rows * ROW_BYTES // max(1, size)))


def repeated_starts(texts: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, variant, a, b``: places a to b of ``texts(doc_id, variant, text)`` start strings that also start earlier.

    ``length`` is 24 at least. Documents are told apart by id and ``variant``, the hash of the text. Spans may overlap.
    """
    if length < 3 * TRIGGER:
        raise ValueError("length must be 24 or more")
    texts = texts.where(F.octet_length("text") >= length).select("doc_id", "variant", F.col("text").cast("binary").alias("text"))
    with _freed(texts.sparkSession):
        counts = map_rows(texts.select("text"), _key_counts(length), "seed long, n long")
        met = cut(counts.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1"), "shared-halves")
        shared = met.where("seed is not null")
        size = met.where("seed is null").agg(F.sum("n")).first()[0] or 0
        halves, rows = shared.agg(F.count("*"), F.sum("n")).first()
        rounds = _rounds(halves, rows or 0, size)
        parts = [_starts_of(texts, shared, length, group_rows, part, rounds) for part in range(rounds)]
    release(met)
    return reduce(DataFrame.unionByName, parts)


def _starts_of(texts: DataFrame, shared: DataFrame, length: int, group_rows: int, part: int, rounds: int) -> DataFrame:
    """The starts in phrases of one round."""
    mine = shared.where(F.expr(f"pmod(seed, {rounds}) = {part}"))
    kinds = [mine.select("seed"), mine.where(F.col("n") > group_rows).select("seed")]
    filters = texts.sparkSession.sparkContext.broadcast([_filter(keys, keys.count()) for keys in kinds])
    rows = map_rows(texts, _phrase_rows(filters, length, part, rounds), f"{_ID}, a long, b long, t int, key long, digest binary, x binary")
    held = cut(rows.withColumn("no_id", F.col("doc_id").isNull()), "phrases")
    found, rows, hot = held.where("t is null"), held.where("t is not null and digest is null"), held.where("digest is not null")
    names = ["key", "no_id", "doc_id", "variant", "a", "t", "x"]
    # halves in many places: phrases of equal bytes are combined before the shuffle
    distinct = cut(hot.groupBy("digest", "key", "t", "x").agg(F.min(_place()).alias("first"), F.count("*").alias("n")), "dictionary")
    repeated = distinct.where("n > 1").select("digest", "first")
    copies = hot.drop("x").join(repeated, "digest").where(_elsewhere("first"))
    sizes = distinct.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = cut(distinct.join(sizes, "key").select("key", "size", "first.*", "t", "x"), "groups")
    few = rows.select(*names).unionByName(met.where(F.col("size") <= group_rows).select(*names))
    buckets = max(1, few.count() // BUCKET_ROWS)
    few = few.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    ordered = few.groupBy("bucket").applyInArrow(_ordered(length), f"{_ID}, a long, b long")
    many = met.where(F.col("size") > group_rows).select("no_id", "doc_id", "variant", "a", "x")
    strings = map_rows(many, _strings(length), f"no_id boolean, {_ID}, a long, digest binary")
    least = strings.groupBy("digest").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1")
    told = strings.join(least.select("digest", "first"), "digest").where(_elsewhere("first"))
    spans = [found, copies, ordered, told.withColumn("b", F.col("a"))]
    starts = cut(reduce(DataFrame.unionByName, [s.select("doc_id", "variant", "a", "b") for s in spans]), "starts")
    release(held, distinct, met)
    filters.unpersist()
    return starts


def merged(starts: np.ndarray, lasts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes (begin, end exclusive) from starts a to b of strings."""
    order = np.argsort(starts, kind="stable")
    a, end = starts[order], np.maximum.accumulate(lasts[order] + length)
    opens = np.flatnonzero(np.concatenate([[True], a[1:] > end[:-1]]))
    return a[opens], end[np.append(opens[1:] - 1, len(a) - 1)]


def _taken_out(length: int) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, removed, begins, ends = [], [], [], []
            for text, copy, a, b in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if copy and len(text) >= length:
                    lo, hi = np.array([0]), np.array([len(text)])
                elif a:
                    lo, hi = merged(np.array(a), np.array(b), length)
                else:
                    lo = hi = np.zeros(0, np.int64)
                edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)) if len(lo) else text)
                removed.append(int((hi - lo).sum()))
                begins.append(lo.tolist())
                ends.append(hi.tolist())
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array(removed, pa.int64()), pa.array(begins, longs), pa.array(ends, longs), pa.array(kept, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_removed", "begins", "ends", "kept"])

        return each

    return make


def without_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, begins, ends, kept`` for each row: the runs of bytes taken out, and what is left, as bytes.

    Null texts count as empty; texts shorter than ``length`` stay as they are. Rows without an id come
    after all others, texts that share an id are ordered by their hash, and rows that repeat both id
    and text are one document, each with its result. Of equal texts under several ids only the
    first stays. An empty table gives an empty result; other columns are not read.
    """
    with _freed(docs.sparkSession):
        marked = _marked(docs, id_col, text_col)
    starts = repeated_starts(marked.where("not copy").drop("copy"), length, group_rows)
    lists = starts.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("variant").alias("_variant"), F.col("found.a").alias("a"), F.col("found.b").alias("b"))
    lists = F.broadcast(lists) if starts.count() * 48 <= SPANS_BYTES else lists.hint("shuffle_hash")
    same = marked["doc_id"].eqNullSafe(lists["_id"]) & (marked["variant"] == lists["_variant"])
    met = marked.join(lists, same, "left").select("doc_id", F.col("text").cast("binary").alias("text"), "copy", "a", "b")
    out = map_rows(met, _taken_out(length), "doc_id long, n_removed long, begins array<long>, ends array<long>, kept binary")
    return out.withColumn("n_bytes", F.octet_length("kept") + F.col("n_removed"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        "n_removed",
        F.size("begins").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
