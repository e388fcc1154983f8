"""Personal data: base patterns, and bootstrapped contextual extraction beyond them.

Base spans (email, ip, card, phone) are the seeds. The two words before and the two words
after a seed are lexical patterns. Spark scores the graph of patterns and instances in
rounds: a pattern by the share of its occurrences in the whole corpus that hold trusted
instances of its kind, an instance by the noisy-or of its patterns (seeds stay at 1).
Identifier-shaped runs that no base pattern covers, but that stand in a high-confidence
pattern of a kind they fit, become further spans.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm.common import cut, map_rows, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT = 3  # distinct trusted instances that a pattern needs
MIN_SCORE = 0.5
PATTERNS_SHIPPED = 200_000  # patterns that may be shipped to the tasks, some 40 MB as Python objects

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive and anchored at a digit run's start: the same matches, without quadratic retries.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Shapes that are like an identifier of a kind but that its base pattern does not take.
# Runs are taken whole, from their begin, so that no identifier is cut and no run is read twice.
_UNSEEN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|＠) ?[A-Za-z0-9-]++(?:(?: ?(?:\[dot\]|\(dot\)) ?|\.)[A-Za-z0-9-]++)++)"
    r"|(?P<ip>(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:]))"
    r"|(?P<number>(?<![0-9A-Za-z.])\(?[0-9](?:[ ().-]{0,2}[0-9])*+)"
)
NUMBER_DIGITS, CARD_DIGITS = 7, 12  # that an unseen number needs, and from which on it may be a card
#: A word, or one mark: spans mostly begin and end between these, so that what is glued to an identifier is a word of its own.
_WORD = re.compile(r"\w+|[^\w\s]")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the run of local characters before it, then the longest domain after it."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def unseen_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifier-shaped runs that overlap no base span; a number of 12 digits or more may be a card, else a phone.

    A number that goes over into a word ends at the last mark or space before it.
    """
    taken, found, k = sorted((a, b) for _, a, b in base), [], 0
    for m in _UNSEEN.finditer(text):
        a, b = m.span()
        kind = m.lastgroup or "number"
        if kind == "number":
            if text[b : b + 1].isalnum():
                while b > a and text[b - 1] in _DIGITS:
                    b -= 1
                while b > a and text[b - 1] not in _DIGITS:
                    b -= 1
            digits = sum(c in _DIGITS for c in text[a:b])
            if digits < NUMBER_DIGITS:
                continue
            kind = "card" if digits >= CARD_DIGITS else "phone"
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if any(a < y for _, y in itertools.takewhile(lambda s: s[0] < b, itertools.islice(taken, k, None))):
            continue
        found.append((kind, a, b))
    return found


def _plain(word: str) -> str:
    return re.sub(r"[0-9]+", "0", word.lower())


def contexts(text: str, a: int, b: int) -> list[str]:
    """The two words before the span and the two after it, each pair as one pattern; words as _WORD has them."""
    left, at = [], a
    for _ in range(2):
        while at > 0 and text[at - 1].isspace():
            at -= 1
        end = at
        while at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_"):
            at -= 1
        at -= at == end and at > 0
        left.insert(0, text[at:end])
    right = [m.group() for m, _ in zip(_WORD.finditer(text, b), range(2))]
    out = [f"< {_plain(left[0])} {_plain(left[1])}"] if all(left) else []
    return out + ([f"> {_plain(right[0])} {_plain(right[1])}"] if len(right) == 2 else [])


def _spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


_EDGE = pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]
)


def _scan() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def edge(text: str, kind: str, a: int, b: int, seed: bool) -> dict:
        value = hashlib.blake2b(f"{kind} {text[a:b].lower()}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return {
            "kind": kind, "start": a, "end": b, "seed": seed,
            "instance": int.from_bytes(value, "little", signed=True), "patterns": contexts(text, a, b),
        }

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            n, shown = Counter(k for k, _, _ in base), _spans_text(base)
            found = [edge(text, *s, True) for s in base] + [edge(text, *s, False) for s in unseen_spans(text, base)]
            row = [*(n[k] for k in KINDS), hashlib.sha256(shown.encode()).hexdigest(), shown, found]
            for col, value in zip(cols, row, strict=True):
                col.append(value)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(_EDGE)]
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "found"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return each


def _count_pairs(docs: DataFrame, patterns: DataFrame, text_col: str, shipped: int = PATTERNS_SHIPPED) -> DataFrame:
    """``pair, total``: occurrences in all texts of each pair of neighbouring words in ``patterns(pair)``, in one pass.

    Up to ``shipped`` patterns go to the tasks, which count these alone. Beyond that every pair is
    counted, piece by piece before the shuffle, and the patterns are met in a join.
    """
    few = patterns.count() <= shipped
    wanted = docs.sparkSession.sparkContext.broadcast({tuple(r.pair.split(" ", 1)) for r in patterns.collect()} if few else None)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        pairs, digits = wanted.value, re.compile(r"[0-9]+")

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist() if pairs is None or pairs else ():
                words = _WORD.findall(digits.sub("0", (text or "").lower()))
                met = zip(words, words[1:], strict=False)
                seen.update(met if pairs is None else (p for p in met if p in pairs))
            return pa.RecordBatch.from_arrays(
                [pa.array([" ".join(p) for p in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["pair", "n"]
            )

        return each

    counted = map_rows(docs.select(text_col), make, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("total"))
    return counted if few else counted.join(patterns, "pair", "left_semi")


def score_patterns(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind, pattern, score, support`` from ``edges(kind, pattern, instance, seed, n)`` and ``totals(pair, total)``.

    score: the share of the pattern's occurrences in the corpus that hold trusted instances,
    each weighted by its own score; support: distinct instances trusted by half or more. A pair
    that was not counted, as a span cuts a word of it, has the occurrences beside its spans alone.
    """
    paired = edges.withColumn("pair", F.substring("pattern", 3, 1 << 30)).join(totals, "pair", "left")
    counted = cut(paired.drop("pair").fillna(0, "total"), "pii-edges")
    trust = counted.select("kind", "instance", F.col("seed").cast("double").alias("trust")).distinct()
    for k in range(rounds):
        patterns = (
            counted.join(trust, ["kind", "instance"])
            .groupBy("kind", "pattern")
            .agg(
                (F.sum(F.col("n") * F.col("trust")) / F.greatest(F.max("total"), F.sum("n"))).alias("score"),
                F.sum((F.col("trust") >= 0.5).cast("long")).alias("support"),
            )
            .withColumn("score", F.when(F.col("support") >= MIN_SUPPORT, F.least("score", F.lit(0.999999))).otherwise(0.0))
        )
        patterns = cut(patterns, "pii-patterns")
        if k < rounds - 1:
            doubt = F.exp(F.sum(F.log1p(-F.col("score"))))
            trust = (
                counted.join(patterns.select("kind", "pattern", "score"), ["kind", "pattern"])
                .groupBy("kind", "instance")
                .agg(F.when(F.max("seed"), 1.0).otherwise(1.0 - doubt).alias("trust"))
            )
            trust = cut(trust, "pii-trust")
    return patterns


def reachable(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind, pattern`` of all patterns that can have MIN_SUPPORT in some round, whatever the scores.

    In the first round only seeds are trusted; in each further one also what stands in a pattern of the round before.
    """
    near = edges.where("seed")
    for k in range(rounds):
        found = near.groupBy("kind", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SUPPORT)
        admitted = cut(found.select("kind", "pattern"), "pii-reachable")
        if k < rounds - 1:
            met = edges.where("not seed").join(admitted, ["kind", "pattern"], "left_semi").select("kind", "instance").distinct()
            more = edges.where("not seed").join(cut(met, "pii-met"), ["kind", "instance"], "left_semi")
            near = edges.where("seed").unionByName(more)
    return admitted


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns_shipped: int = PATTERNS_SHIPPED) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, one row per row of ``docs``.

    The counts and the digest are of base spans; ``spans`` holds these and the discovered
    ones, as ``kind:start:end`` by kind, then start (code points, end exclusive). Null and
    empty texts have none. Repeated rows give repeated results; a corpus without seeds gives
    base spans alone; other columns are not read; an empty table gives an empty result.
    Long digit or letter runs take linear time.
    """
    edge = "struct<kind:string,start:int,end:int,seed:boolean,instance:bigint,patterns:array<string>>"
    schema = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<{edge}>"
    scanned = map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), _scan, schema)
    scanned = cut(scanned.withColumn("row_id", F.monotonically_increasing_id()), "pii-scan")
    slots = scanned.select("row_id", F.explode("found").alias("s")).select("row_id", "s.*")
    slots = cut(slots.withColumn("pattern", F.explode("patterns")).drop("patterns"), "pii-slots")
    edges = slots.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = cut(edges, "pii-graph")
    kept = reachable(edges)
    pairs = cut(kept.select(F.substring("pattern", 3, 1 << 30).alias("pair")).distinct(), "pii-pairs")
    totals = _count_pairs(docs, pairs, text_col, patterns_shipped)
    good = score_patterns(edges.join(kept, ["kind", "pattern"], "left_semi"), totals).where(F.col("score") >= MIN_SCORE)
    more = (
        slots.where("not seed")
        .join(good.select("kind", "pattern"), ["kind", "pattern"], "left_semi")
        .groupBy("row_id")
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    )
    base = F.expr(
        "transform(filter(found, x -> x.seed), x -> struct(x.kind as kind, x.start as start, x.end as end))"
    )
    order = F.expr(f"array({', '.join(repr(k) for k in KINDS)})")
    keyed = F.transform("all", lambda x: F.struct(F.array_position(order, x["kind"]), x["start"], x["kind"], x["end"]))
    shown = F.expr("transform(sorted, x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string)))")
    return (
        scanned.join(more, "row_id", "left")
        .withColumn("all", F.concat(base, F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))))
        .withColumn("sorted", F.array_sort(keyed))
        .select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.array_join(shown, ",").alias("spans"))
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
