"""Phrase collocations by best-first branch and bound over counts of prefixes.

A phrase scores as the least of 1000 a n / (l r) over its cuts, where a, l and r count the phrase, the
words before the cut and those after it. As r is at least a, no phrase that begins with a prefix
p scores more than 1000 n / f(p). So prefixes are expanded by one word from the highest bound down,
in batches: a pass over the texts counts the next words of all prefixes up to a count that each
language has its own limit for. When nothing is left to expand below the limit, phrases are settled from the
highest score of one cut down: a pass counts their ends that no prefix led to, and their neighbours; then the scores are
known, and the limit rises to what can still reach the language's last place, or tie with it, until nothing can.

Words are numbers in the passes: a hash of language and word, checked to be unequal for unequal
words. Tasks know a set of phrases by a filter of fixed size; what it lets through in error is
dropped by an exact join of the counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampledger.llm.common import cut, table, text_of
from ampledger.llm.decontaminate import FILTER_BITS, _filter_of
from ampledger.llm.repeats import _words

LEAST, LONGEST, PLACES = 100, 5, 2000
FIRST_LIMIT = 64  # at first, words that are up to one in so many are expanded
CHUNK = 4 << 20  # bytes of text counted at once, about
HELD_ROWS = 600_000  # counts of phrases that a task holds before it sends them
PIECE_MARKS = rb"[.,;:!?\x0a-\x0d]"

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_W = [f"w{k}" for k in range(1, LONGEST + 1)]
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2


# --- words and phrases, in tasks ---


def _blocks(texts: Iterator[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    """Texts in lists of about CHUNK bytes; a longer text is cut at ends of pieces."""
    held, size = [], 0
    for lang, text in texts:
        at = 0
        while at < len(text):
            end = re.compile(PIECE_MARKS).search(text, at + CHUNK) if len(text) - at > CHUNK else None
            part = text[at : end.end() if end else len(text)]
            held.append((lang, part))
            at, size = at + len(part), size + len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _tokens(block: list[tuple[str, bytes]], salt: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, begin, end, piece, text, number) of the words of a block, in order; the number is the hash of language and word."""
    data = b"\n".join(text for _, text in block).lower() + b"\n"  # of bytes, lower() takes A-Z alone
    kind = _KIND[np.frombuffer(data, np.uint8)]
    word = kind == 0
    begin = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    end = np.flatnonzero(~word & np.concatenate([[False], word[:-1]]))
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
    lengths = np.array([len(text) + 1 for _, text in block])
    text = np.searchsorted(np.cumsum(lengths), begin, "right")
    seeds = np.array([xxhash.xxh64_intdigest(lang.encode(), salt) for lang, _ in block], np.uint64)
    words, size = _words(data + bytes(8)), end - begin
    number = seeds[text] ^ (size.astype(np.uint64) * _MIX)
    live = np.flatnonzero(size <= 64)
    off = 0
    while len(live):
        left = np.minimum(size[live] - off, 8).astype(np.uint64)
        part = words[begin[live] + off] << (np.uint64(8) * (np.uint64(8) - left)) >> (np.uint64(8) * (np.uint64(8) - left))
        mixed = (number[live] ^ part) * _ODD
        number[live] = mixed ^ (mixed >> np.uint64(29))
        off += 8
        live = live[size[live] > off]
    for k in np.flatnonzero(size > 64).tolist():
        number[k] ^= np.uint64(xxhash.xxh64_intdigest(data[begin[k] : end[k]], salt))
    number *= _MIX
    number[number == 0] = 1  # zero stands for no word
    return data, begin, end, piece, text, number


def _grown(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The number of a phrase from that of all but its last word and that of the word."""
    out = (prefix * _ODD) ^ word
    out ^= out >> np.uint64(29)
    return out * _MIX


def _groups(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows of ``columns`` stand together, and where each kind begins in it."""
    mixed = columns[0]
    for c in columns[1:]:
        mixed = _grown(mixed, c)
    order = np.argsort(mixed, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = mixed[order][1:] != mixed[order][:-1]
    if any((~new[1:] & (c[order][1:] != c[order][:-1])).any() for c in columns):  # unequal phrases of one number
        order = np.lexsort(columns)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, np.flatnonzero(new)


def _in(bits: np.ndarray, number: np.ndarray) -> np.ndarray:
    spot = number % np.uint64(FILTER_BITS)
    return (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def _count_words(salt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(_texts(batches)):
            data, begin, end, _, text, number = _tokens(block, salt)
            if not len(number):
                continue
            order, at = _groups([number])
            first = order[at]
            counts = np.diff(np.append(at, len(order)))
            names = [data[b:e].decode("utf-8", "replace") for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
            langs = [block[t][0] for t in text[first].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(number[first].view(np.int64)), pa.array(counts.astype(np.int64))],
                ["lang", "word", "w", "n"],
            )

    return run


def _count_next(bits, words, sizes: list[int], salt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of each phrase in ``bits``, of ``sizes`` words, with each next word in ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.frombuffer(bits.value, np.uint8), np.frombuffer(words.value, np.uint8)
        for block in _blocks(_texts(batches)):
            _, _, _, piece, _, number = _tokens(block, salt)
            usual, prefix = _in(known, number), number
            for k in range(1, LONGEST):
                if len(number) <= k:
                    break
                if k in sizes:
                    on = np.flatnonzero((piece[k:] == piece[:-k]) & usual[k:] & _in(held, prefix[: len(number) - k]))
                    yield _rows([number[on + j] for j in range(k + 1)])
                prefix = _grown(prefix[:-1], number[k:])

    return run


def _rows(columns: list[np.ndarray], *edges: np.ndarray) -> pa.RecordBatch:
    """Distinct rows of words with their count, and the least and greatest of each of ``edges``."""
    order, at = _groups(columns)
    first = order[at]
    none = np.zeros(len(at), np.int64)
    out = [columns[j][first].view(np.int64) if j < len(columns) else none for j in range(LONGEST)]
    out.append(np.diff(np.append(at, len(order))).astype(np.int64))
    for e in edges:
        for f in (np.minimum, np.maximum):
            out.append(f.reduceat(e[order], at) if len(at) else none)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in out], [*_W, "n", "p0", "p1", "n0", "n1"][: len(out)])


def _combined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows of ``_rows`` with edges, equal words together."""
    columns = [np.concatenate([p.column(j).to_numpy() for p in parts]) for j in range(LONGEST + 5)]
    order, at = _groups([c.view(np.uint64) for c in columns[:LONGEST]])
    out = [c[order[at]] for c in columns[:LONGEST]] + [np.add.reduceat(columns[LONGEST][order], at)]
    out += [f.reduceat(columns[LONGEST + 1 + j][order], at) for j, f in enumerate((np.minimum, np.maximum, np.minimum, np.maximum))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in out], parts[0].schema.names)


def _count_around(bits, salt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the phrases in ``bits`` of two to four words, and the least and greatest word before and after; zero: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = np.frombuffer(bits.value, np.uint8), []
        for block in _blocks(_texts(batches)):
            _, _, _, piece, _, number = _tokens(block, salt)
            if not len(number):
                continue
            same, signed, prefix = piece[1:] == piece[:-1], number.view(np.int64), number
            before = np.concatenate([[0], np.where(same, signed[:-1], 0)])
            after = np.concatenate([np.where(same, signed[1:], 0), [0]])
            for k in range(2, LONGEST):
                if len(number) < k:
                    break
                prefix = _grown(prefix[:-1], number[k - 1 :])
                on = np.flatnonzero((piece[k - 1 :] == piece[: len(number) - k + 1]) & _in(held, prefix))
                parts.append(_rows([number[on + j] for j in range(k)], before[on], after[on + k - 1]))
            if sum(p.num_rows for p in parts) > HELD_ROWS:
                parts = [_combined(parts)]
                if parts[0].num_rows > HELD_ROWS // 2:
                    yield parts.pop()
        if any(p.num_rows for p in parts):
            yield _combined(parts)

    return run


def _phrase_number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(j).to_numpy().view(np.uint64) for j in range(LONGEST)]
        out = columns[0]
        for c in columns[1:]:
            out = np.where(c == 0, out, _grown(out, c))
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["seed"])


# --- the plan ---

_PRODUCT = "cast(1000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(total as decimal(19,0))"


def _bits(phrases: DataFrame):
    return phrases.sparkSession.sparkContext.broadcast(_filter_of(phrases.select(*_W).mapInArrow(_phrase_number, "seed long")))


def _part(first: int, last: int) -> list:
    """Words ``first`` to ``last`` of w1..w5 as key columns k1..k5; zero: none."""
    return [(F.col(f"w{first + j}") if first + j <= last else F.lit(0).cast("long")).alias(f"k{j + 1}") for j in range(LONGEST)]


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` with l, r and score of their lowest cut; ``counts(k1..k5, f)`` has all their beginnings and ends."""
    cuts = None
    keep = [*_W, "lang", "size", "a", "total"]
    for k in range(1, LONGEST):
        sided = phrases.where(F.col("size") > k).withColumn("cut", F.lit(k))
        ends = None
        for size in range(k + 1, LONGEST + 1):
            part = sided.where(F.col("size") == size).select(*keep, "cut", F.array(*_part(1, k)).alias("left"), F.array(*_part(k + 1, size)).alias("right"))
            ends = part if ends is None else ends.unionByName(part)
        cuts = ends if cuts is None else cuts.unionByName(ends)
    keyed = counts.select(F.array("k1", "k2", "k3", "k4", "k5").alias("key"), "f")
    cuts = cuts.join(keyed.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(keyed.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr(f"cast(({_PRODUCT}) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    return cuts.groupBy(*keep).agg(lowest.alias("low")).select(*keep, "low.score", "low.l", "low.r")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, places: int = PLACES, first_limit: int = FIRST_LIMIT
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``places`` phrases of two to five words.

    Phrases occur ``least`` times or more and are part of no longer such phrase that occurs as often. A null
    language counts as ``und``, a null text as empty. Repeated rows count each time; ties in score and
    count go by the phrase's bytes, so the result is one. A language without such phrases, and
    an empty table, have no rows. Other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_of(text_col).cast("binary").alias("text"))
    for salt in range(8):
        counted = texts.mapInArrow(_count_words(salt), "lang string, word string, w long, n long")
        words = cut(counted.groupBy("lang", "w", "word").agg(F.sum("n").alias("n")), "words")
        owner = F.struct("lang", "word")
        if words.groupBy("w").agg(F.min(owner).alias("x"), F.max(owner).alias("y")).where("x <> y").isEmpty():
            break
    else:
        raise RuntimeError("unequal words share their numbers")
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = words.where(F.col("n") >= least).join(totals, "lang")
    none = [F.lit(0).cast("long").alias(w) for w in _W[1:]]
    words = cut(words.select(F.col("w").alias("w1"), *none, "lang", "word", "total", F.col("n").alias("a")), "frequent-words")
    usual = _bits(words)
    limits = totals.select("lang", (F.col("total") / first_limit).cast("long").alias("limit"))
    known = words.drop("word").withColumn("size", F.lit(1)).withColumn("done", F.lit(False))
    wave = 0
    while True:
        state = known.join(limits, "lang")
        now = ~F.col("done") & (F.col("size") < LONGEST) & (F.col("a") <= F.col("limit"))
        todo = cut(state.where(now).drop("limit", "done"), "frontier")
        sizes = [r["size"] for r in todo.select("size").distinct().collect()]  # 1 to 4
        if sizes:
            found = texts.mapInArrow(_count_next(_bits(todo), usual, sizes, salt), ", ".join(f"{w} long" for w in [*_W, "n"]))
            found = found.groupBy(*_W).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
            grown = [F.when(F.col(f"w{k}") == 0, 0).otherwise(1) for k in range(1, LONGEST + 1)]
            found = cut(found.withColumn("size", sum(grown[1:], grown[0])), "grown")
            prefix = [F.when(F.col("size") > k, F.col(f"w{k}")).otherwise(F.lit(0).cast("long")).alias(f"w{k}") for k in range(1, LONGEST + 1)]
            keyed = found.select(F.array(*prefix).alias("prefix"), *_W, "a", "size")
            owners = todo.select(F.array(*_W).alias("prefix"), "lang", "total")
            more = keyed.join(owners, "prefix").drop("prefix").withColumn("done", F.lit(False))
            names = [*_W, "lang", "total", "a", "size", "done"]
            old = state.withColumn("done", F.col("done") | now).select(*names)
            known = cut(old.unionByName(more.select(*names)), "known")
            wave += 1
            if wave == 1:  # a guess at the last place's score, so that the limit need not rise twice
                limits = cut(_raised(known, limits, _guess(known, words, places)), "limits")
            continue
        ranked = _ranked(texts, known, words, salt, places)
        last = ranked.where(F.col("place") == places).select("lang", F.col("score").alias("last"))
        limits = cut(_raised(known, limits, last), "limits")
        if known.join(limits, "lang").where(~F.col("done") & (F.col("size") < LONGEST) & (F.col("a") <= F.col("limit"))).isEmpty():
            break
    return ranked.select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _raised(known: DataFrame, limits: DataFrame, last: DataFrame) -> DataFrame:
    """``limits(lang, limit)`` raised to the count up to which a prefix's bound reaches ``last(lang, last)``; all, where there is none."""
    total = known.groupBy("lang").agg(F.max("total").alias("total"))
    met = limits.join(total, "lang").join(last, "lang", "left")
    reach = F.expr("cast((cast(1000 as decimal(38,0)) * cast(total as decimal(19,0))) div cast(greatest(last, 1) as decimal(19,0)) as bigint)")
    return met.select("lang", F.greatest("limit", F.coalesce(reach, F.lit(2**62))).alias("limit"))


def _guess(known: DataFrame, words: DataFrame, places: int) -> DataFrame:
    """A quarter of the score at twice the last place among phrases of two words so far; only the order of work hangs on it."""
    pairs = known.where("size = 2")
    f1, f2 = (words.select(F.col("w1").alias(w), F.col("a").alias(f)) for w, f in (("w1", "l"), ("w2", "r")))
    score = (F.lit(250.0) * F.col("a") * F.col("total") / F.col("l") / F.col("r")).cast("long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "w1", "w2"))
    scored = pairs.join(f1, "w1").join(f2, "w2").withColumn("score", score).withColumn("place", place)
    return scored.where(F.col("place") <= 2 * places).where(F.col("place") == 2 * places).select("lang", F.col("score").alias("last"))


def _inside(known: DataFrame) -> DataFrame:
    """The phrases of two words and more that make up all of a known phrase but its first or last word, and occur no oftener."""
    every = range(1, LONGEST + 1)
    long = known.where("size > 2")
    head = [F.when(F.col("size") > k, F.col(f"w{k}")).otherwise(F.lit(0).cast("long")).alias(f"w{k}") for k in every]
    tail = [(F.col(f"w{k + 1}") if k < LONGEST else F.lit(0).cast("long")).alias(f"w{k}") for k in every]
    most = long.select(*head, "a").unionByName(long.select(*tail, "a")).groupBy(*_W).agg(F.max("a").alias("most"))
    return known.join(most, _W).where("most >= a").select(*_W)


def _bounded(phrases: DataFrame, counted: DataFrame) -> DataFrame:
    """``phrases`` with ``bound``, the score of the cut before the last word, whose counts are always known: the score is no greater."""
    every = range(1, LONGEST + 1)
    zero = F.lit(0).cast("long")
    left = F.array(*(F.when(F.col("size") > k, F.col(f"w{k}")).otherwise(zero) for k in every)).alias("left")
    right = F.array(F.get(F.array(*_W), F.col("size") - 1), zero, zero, zero, zero).alias("right")
    keyed = counted.select(F.array(*_W).alias("key"), "f")
    met = phrases.select("*", left, right).join(keyed.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
    met = met.join(keyed.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    bound = F.expr(f"cast(({_PRODUCT}) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")
    return met.withColumn("bound", bound).drop("left", "right", "l", "r")


def _ranked(texts: DataFrame, known: DataFrame, words: DataFrame, salt: int, places: int) -> DataFrame:
    """The first ``places`` surviving phrases of each language, with score and ``place`` by score, count and bytes.

    Best first: phrases are settled from the highest bound down, twice as many as there are places at first. Where
    what is left could still come in among the last place, or tie with it, four times as many are.
    """
    phrases = known.where("size > 1").select(*_W, "lang", "size", "a", "total")
    counted = known.select(*_W, F.col("a").alias("f"))
    bounded = cut(_bounded(phrases.join(_inside(known), _W, "left_anti"), counted), "bounded")
    most = 2 * places
    while True:
        turn = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("bound")))
        taken = cut(bounded.withColumn("turn", turn).where(F.col("turn") <= most).drop("turn", "bound"), "taken")
        ranked = cut(_settled(texts, taken, counted, words, salt).where(F.col("place") <= places), "ranked")
        last = ranked.where(F.col("place") == places).select("lang", F.col("score").alias("last"))
        rest = bounded.join(taken, _W, "left_anti").groupBy("lang").agg(F.max("bound").alias("best"))
        if rest.join(last, "lang", "left").where("last is null or best >= last").isEmpty():
            return ranked
        most *= 4


def _settled(texts: DataFrame, taken: DataFrame, counted: DataFrame, words: DataFrame, salt: int) -> DataFrame:
    """Of the phrases ``taken`` those that survive, scored and ranked. One pass counts what no prefix led to, and their neighbours."""
    every = [f"k{j}" for j in range(1, LONGEST + 1)]
    ends = None
    for k in range(2, LONGEST):
        for size in range(k + 1, LONGEST + 1):
            part = taken.where(F.col("size") == size).select(*_part(size - k + 1, size))
            ends = part if ends is None else ends.unionByName(part)
    ends = ends.select(*(F.col(c).alias(w) for c, w in zip(every, _W, strict=True))).distinct().join(counted, _W, "left_anti")
    targets = cut(taken.where("w5 = 0").select(*_W).unionByName(ends).distinct(), "targets")
    kind = ", ".join(f"{w} long" for w in [*_W, "n", "p0", "p1", "n0", "n1"])
    seen = texts.mapInArrow(_count_around(_bits(targets), salt), kind)
    summed = seen.groupBy(*_W).agg(F.sum("n").alias("f"), F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.min("n0").alias("n0"), F.max("n1").alias("n1"))
    around = cut(summed.join(targets, _W, "left_semi"), "around")
    keys = [F.col(w).alias(k) for k, w in zip(every, _W, strict=True)]
    counts = around.select(*_W, "f").unionByName(counted).groupBy(*keys).agg(F.max("f").alias("f"))
    inside = around.where("(p0 = p1 and p0 <> 0) or (n0 = n1 and n0 <> 0)").select(*_W)
    scored = _scored(taken, counts).join(inside, _W, "left_anti")
    spelt = words.select(F.col("w1").alias("w"), "word")
    parts = scored.select(*_W, F.posexplode(F.array(*_W)).alias("pos", "w")).where("w <> 0").join(spelt, "w")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    named = scored.join(parts.groupBy(*_W).agg(phrase.alias("phrase")), _W)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("place", F.row_number().over(order))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_MARKS = "[.,;:!?\\n\\x0B\\f\\r]"
_NEXT = ", ".join(f"lead(w, {k}) OVER said AS w{k}" for k in range(1, LONGEST))
_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {' || chr(32) || '.join(['w', *(f'w{j}' for j in range(1, k))])} AS p, {k} AS k, count(*) AS f FROM word"
    + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") + " GROUP BY ALL" + (f" HAVING f >= {LEAST}" if k > 1 else "")
    for k in range(1, LONGEST + 1)
)
#: All runs of one to five words are counted outright; of a phrase's cuts the lowest counts.
OP11_SQL = f"""WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_MARKS}')) AS piece FROM documents),
  numbered AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM piece),
  said AS (SELECT lang, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM numbered),
  word AS MATERIALIZED (SELECT lang, w, {_NEXT} FROM said WINDOW said AS (PARTITION BY id ORDER BY i)),
  counted AS MATERIALIZED ({_GRAMS}),
  total AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY ALL),
  candidate AS (SELECT lang, p, k, f AS a, string_split(p, ' ') AS ws FROM counted WHERE k > 1),
  cut_at AS (SELECT *, unnest(range(1, k)) AS j FROM candidate),
  spans AS (SELECT *, unnest(range(j, k + 1)) AS e FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate)),
  part AS (SELECT lang, array_to_string(ws[j:e], ' ') AS p, max(a) AS a FROM spans WHERE e > j AND e - j + 1 < k GROUP BY ALL),
  scored AS (SELECT c.lang, c.p, c.a, j, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score
    FROM cut_at c JOIN total USING (lang) JOIN counted l ON l.lang = c.lang AND l.p = array_to_string(c.ws[:c.j], ' ')
    JOIN counted r ON r.lang = c.lang AND r.p = array_to_string(c.ws[c.j + 1:], ' ')),
  lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
  kept AS (SELECT lowest.* FROM lowest LEFT JOIN part USING (lang, p) WHERE part.a IS NULL OR 100 * part.a < 100 * lowest.a)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, CAST(a AS BIGINT) AS a,
    CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
  FROM kept QUALIFY rank <= {PLACES}"""
