"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up in
one token, so it marks a certain cut. Words are cut at all such pairs, the fragments are
merged independently (and cached), and their ids are concatenated. The rules of text
preparation, vocabulary and merges come from the tokenizer file, whose path is a parameter.

The texts are prepared as tokenizers 0.23 does, which composes by the tables of Unicode 9,
classes by those of Unicode 16 and lower-cases by those of Unicode 17. Where these differ from
the tables of Python 3.13 (Unicode 15.1), the values stand below.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import operator
import struct
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm.common import map_rows, table

TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 120_000  # of a Python worker, some 80 MB with the fragments; the cache starts anew beyond that
COUNT_WORDS = 250_000  # in each of two generations of a Python worker's counts, some 60 MB in all
CACHE_CHARS = 64  # longer words are encoded anew each time, so that the caches are bounded in bytes too
SHORT = 64  # bytes of a fragment that is merged over a list
_BITS = 20
_MASK, _NONE = (1 << _BITS) - 1, 1 << 62

# Unicode White_Space, as the tokenizer file's \s means it.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Marks that Unicode 10 and later gave a combining class, and the parts of the one
# letter they compose. Composition by Unicode 9 leaves each alone and starts anew after it.
NEW_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930),
    (0x11935, 0x11935), (0x11938, 0x11938), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42),
    (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
# Letters and digits of Unicode 16.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_DIGITS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Fixed values: (first capital, last capital, small letter of the first) of Unicode 16 and 17.
NEW_CASES = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_NEWEST = min(a for a, *_ in (*NEW_MARKS, *NEW_LETTERS, *NEW_DIGITS, *NEW_CASES))


def _ranges(points: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in points)


_MARKS = regex.compile(f"([{_ranges(NEW_MARKS)}])")
_SMALL = {c: small + c - a for a, b, small in NEW_CASES for c in range(a, b + 1)}


def prepared(text: str) -> str:
    """Composed and in lower case, each letter alone: no final sigma."""
    if text.isascii():
        return text.lower()
    if ord(max(text)) < _NEWEST:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    parts = _MARKS.split(text)
    parts[::2] = (unicodedata.normalize("NFC", p) for p in parts[::2])
    return "".join(parts).replace("Σ", "σ").translate(_SMALL).lower()


def _kinds() -> dict[str, list[tuple[int, int]]]:
    """Ranges of the letters (L) and the digits (N)."""
    out = {"L": list(NEW_LETTERS), "N": list(NEW_DIGITS)}
    runs = itertools.groupby(range(0x110000), lambda c: unicodedata.category(chr(c))[0])
    for kind, run in runs:
        if kind in out:
            first = last = next(run)
            for last in run:
                pass
            out[kind].append((first, last))
    return {kind: sorted(ranges) for kind, ranges in out.items()}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the rest are moved to U+0100 and on, in order.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class WordBpe:
    """Encoder for a lower-casing, word-ending BPE file. Special tokens in a text are recognised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        # of a pair of ids: the rank and the id of what they merge to, as one number
        self.joins = {
            self.vocab[a] << _BITS | self.vocab[b]: i << _BITS | self.vocab[a + b]
            for (a, b), i in self.ranks.items()
            if a in self.vocab and b in self.vocab
        }
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace(r"\s", _SPACE)
        self.words = regex.compile(pattern, regex.V0)
        # The installed regex may know later tables: texts with a code point that it classes otherwise go by ranges.
        kinds = _kinds()
        self.exact = regex.compile(pattern.replace(r"\p{L}", _ranges(kinds["L"])).replace(r"\p{N}", _ranges(kinds["N"])), regex.V0)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        odd = set()
        for kind, ranges in kinds.items():
            odd ^= set(regex.findall(rf"\p{{{kind}}}", every)) ^ {chr(c) for a, b in ranges for c in range(a, b + 1)}
        self.first_odd = min(odd, default=chr(0x10FFFF))
        self.odd = frozenset(odd)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.symbols = byte_symbols()
        bodies = (t.removesuffix(self.end) if self.end else t for t in self.vocab)
        self.inside = {b[i : i + 2] for b in bodies for i in range(len(b) - 1)}
        #: of each word met: its ids as little-endian 32-bit numbers, and its tokens joined by spaces
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        #: of words met: how many tokens each is; those met before the last start are in the older
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def fragments_of(self, word: str) -> list[str]:
        """``word``, in byte symbols, cut at every forced boundary."""
        if self.inside.issuperset(map(operator.add, word, word[1:])):
            return [word]
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge(self, fragment: str, last: bool) -> tuple[int, ...]:
        """Merges of lowest rank first, leftmost first among equals: over a list for a short fragment, else over a heap."""
        if len(fragment) > SHORT:
            return self._merge_long(fragment, last)
        parts = [self.vocab.get(c, -1) for c in fragment]
        if last:
            parts[-1] = self.vocab.get(fragment[-1] + self.end, -1)
        if -1 in parts:
            return self._merge_long(fragment, last)
        get = self.joins.get
        found = [get(a << _BITS | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (best := min(found)) != _NONE:
            i = found.index(best)
            parts[i : i + 2] = [best & _MASK]
            del found[i]
            if i:
                found[i - 1] = get(parts[i - 1] << _BITS | parts[i], _NONE)
            if i < len(found):
                found[i] = get(parts[i] << _BITS | parts[i + 1], _NONE)
        return tuple(parts)

    def _merge_long(self, fragment: str, last: bool) -> tuple[int, ...]:
        parts: list[str | None] = list(fragment)
        if last:
            parts[-1] += self.end
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, joined = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((joined, parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, joined + parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], joined))) is not None:
                heapq.heappush(heap, (r, h, parts[h] + joined))
        return tuple(self.vocab[p] for p in parts if p is not None and p in self.vocab)

    def word(self, word: str) -> tuple[bytes, str]:
        shown = "".join(map(self.symbols.__getitem__, word.encode("utf-8", "surrogatepass")))
        pieces, out = self.fragments_of(shown), []
        for i, piece in enumerate(pieces):
            key = (piece, i == len(pieces) - 1)
            ids = self.fragments.get(key)
            if ids is None:
                ids = self.merge(*key)
                if len(piece) <= CACHE_CHARS:
                    if len(self.fragments) >= CACHE_WORDS:
                        self.fragments.clear()
                    self.fragments[key] = ids
            out.extend(ids)
        found = struct.pack(f"<{len(out)}I", *out), self.decode(out)
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def count_word(self, word: str) -> int:
        """The number of tokens of a word that ``counts`` lacks. Once that is full it becomes the older generation, so that common words stay."""
        n = self.older.get(word)
        if n is None:
            shown = "".join(map(self.symbols.__getitem__, word.encode("utf-8", "surrogatepass")))
            pieces = self.fragments_of(shown)
            n = sum(len(self.merge(piece, False)) for piece in pieces[:-1]) + len(self.merge(pieces[-1], True))
        if len(word) <= CACHE_CHARS:
            if len(self.counts) >= COUNT_WORDS:
                self.older, self.counts = self.counts, {}
            self.counts[word] = n
        return n

    def split(self, text: str) -> list[str]:
        text = prepared(text)
        exact = not text.isascii() and max(text) >= self.first_odd and not self.odd.isdisjoint(text)
        return (self.exact if exact else self.words).findall(text)

    def plain(self, text: str) -> list[tuple[bytes, str]]:
        get, new = self.cache.get, self.word
        return [get(w) or new(w) for w in self.split(text)]

    def count(self, text: str | None) -> int:
        """How many ids ``encode`` gives, without making them."""
        text, n, at = text or "", 0, 0
        if "<|" in text:
            for m in self.specials.finditer(text):
                n += self._count_plain(text[at : m.start()]) + 1
                at = m.end()
        return n + self._count_plain(text[at:] if at else text)

    def _count_plain(self, text: str) -> int:
        words = self.split(text)
        found = list(map(self.counts.get, words))
        if None in found:
            found = [self.count_word(w) if n is None else n for w, n in zip(words, map(self.counts.get, words), strict=True)]
        return sum(found)

    def pieces(self, text: str | None) -> list[tuple[bytes, str]]:
        """Encoded and decoded form of each word and special token of the text, in order."""
        text, out, at = text or "", [], 0
        if "<|" in text:
            for m in self.specials.finditer(text):
                out += self.plain(text[at : m.start()])
                out.append((struct.pack("<I", self.special[m.group()]), m.group()))
                at = m.end()
        return out + self.plain(text[at:]) if at else self.plain(text)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        return b"".join([p[0] for p in self.pieces(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by spaces, special ones included."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.cache
def worker_bpe(path: str) -> WordBpe:
    """One encoder for all tasks of a Python worker, so that file and caches are not made anew for each."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded`` for every row; null texts count as empty (no ids, empty text).

    Repeated rows give repeated results, other columns are not read, very long texts are
    encoded whole. Memory: the caches are bounded, texts come in small Arrow batches.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        bpe = worker_bpe(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())],
                ["doc_id", "ids", "decoded"],
            )

        return each

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return map_rows(picked, make, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, decode and digest in one pass."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        bpe = worker_bpe(path)
        sha = hashlib.sha256

        def one(text: str | None) -> tuple[int, str, str]:
            pieces = bpe.pieces(text)
            ids, shown = b"".join([p[0] for p in pieces]), " ".join([p[1] for p in pieces if p[1]])
            return len(ids) // 4, sha(ids).hexdigest(), sha(shown.encode()).hexdigest()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [one(t) for t in batch.column(1).to_pylist()]
            n, a, b = zip(*made, strict=True)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return each

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return map_rows(picked, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), tokenizer_path())
