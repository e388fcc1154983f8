"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Texts and lexicon are folded alike: compatibility forms, homoglyphs, digit and sign
substitutions inside words, stretched letters. The lexicon holds word stems and words,
weighted by their log odds among labelled training documents; phrases around a term that
clean documents use are exceptions and void the match. Matches give two length-normalised
figures, and a logistic curve fitted on other training documents turns these into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm.common import cut, drop_rows, map_rows, table, variant_of
from ampledger.llm.labels import fit_logistic, fold_of, labelled_sample, logistic

TRAIN_DOCS = 12_000  # labelled rows that the lexicon and the curve are fitted on, at most
MIN_DOCS = 3  # toxic training documents that a term needs, clean ones that an exception needs
MIN_ODDS = 3.0  # log odds of a term outside of exceptions
CANDIDATE_ODDS = 1.0  # of the terms around which exceptions are sought
THRESHOLD = 0.7
STEMS = (4, 5, 6, 8)

#: Terms with which learning begins, and phrases that are never meant.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")
SEED_EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "stupid simple", "idiot proof")

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ℓ": "l", "ƨ": "s", "ⅼ": "l", "ⅰ": "i", "ʟ": "l", "ɪ": "i", "ꜱ": "s",
}
#: Digits and signs that stand for letters inside a word.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_HOMOGLYPHS, _LEET = str.maketrans(HOMOGLYPHS), str.maketrans(LEET)
_JOINERS = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")  # invisible
_MARKS = re.compile("[\u0300-\u036f]")  # that decomposing sets apart from their letters
_RUN = re.compile(r"(?:[^\W_]|[@$!|€])++")
_PART = re.compile(r"[^\W_]++")
_LEETED = re.compile(r"[0-9@$!|€]")
_LETTER = re.compile(r"[^\W\d_]")
_STRETCH = re.compile(r"(.)\1\1+")


def _words(text: str) -> list[str]:
    """Runs of letters, digits and signs. Signs after the last letter, and what follows them, are no part of its word."""
    out = []
    for run in _RUN.findall(text):
        if run.isalnum():
            out.append(run)
            continue
        last = len(run)
        while last and not run[last - 1].isalpha():
            last -= 1
        while 0 < last < len(run) and run[last].isalnum():
            last += 1
        out += [run[:last]] if last else []
        out += _PART.findall(run, last)
    return out


def fold_words(text: str | None) -> list[str]:
    """Words of the folded text, in time that grows with its length. l and i become one letter, as 1 and ! stand for both."""
    text = text or ""
    if not text.isascii():
        text = _MARKS.sub("", _JOINERS.sub("", unicodedata.normalize("NFKD", text)))
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", text.translate(_HOMOGLYPHS))
    words = _words(text)
    if _LEETED.search(text):
        words = [w.translate(_LEET) if _LEETED.search(w) and _LETTER.search(w) else w for w in words]
    joined = " ".join(words).replace("l", "i")
    return _STRETCH.sub(r"\1", joined).split(" ") if words else []


def terms_of(word: str) -> list[str]:
    """``^stem`` for the stems of a word, ``=word`` for the whole of it."""
    return ["=" + word, *("^" + word[:n] for n in STEMS if len(word) >= n)] if len(word) >= 3 else []


class Lexicon:
    """Terms with weights and exception phrases, as one Aho-Corasick automaton over `` word word ``."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.weights, self.exceptions = weights, list(exceptions)
        self.machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            body = " " + term[1:] + (" " if term[0] == "=" else "")
            self.machine.add_word(body, max((len(body), weight), self.machine.get(body, (0, 0.0))))
        for phrase in self.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, words: list[str]) -> list[float]:
        """The weight of each matched word that no exception phrase covers; of several terms the greatest."""
        if not words or not len(self.machine):
            return []
        best: dict[int, float] = {}
        void: list[tuple[int, int]] = []
        for end, (length, weight) in self.machine.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                void.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        # in order of place, with how far the exceptions that began so far reach
        void.sort()
        out, k, reach = [], 0, 0
        for at in sorted(best):
            while k < len(void) and void[k][0] <= at:
                reach = max(reach, void[k][1])
                k += 1
            if at >= reach:
                out.append(best[at])
        return out

    def figures(self, text: str | None) -> tuple[float, float]:
        """Weight per square root of length, and mean weight of the matches; both 0 without any."""
        words = fold_words(text)
        hits = self.hits(words)
        return (sum(hits) / math.sqrt(len(words)), sum(hits) / len(hits)) if hits else (0.0, 0.0)


def _tally(of: Callable[[list[str]], set[str]]) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Counts of documents by term and label, combined within each batch."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[1 if y else 0].update(of(fold_words(text)))
            terms = list(seen[0] | seen[1])
            cols = [pa.array(terms, pa.string()), *(pa.array([s[t] for t in terms], pa.int64()) for s in seen)]
            return pa.RecordBatch.from_arrays(cols, ["term", "clean", "toxic"])

        return each

    return make


def _outside(words: list[str], exceptions: frozenset[str]) -> set[str]:
    """The words that stand anywhere outside of the exception phrases, which are pairs."""
    if not exceptions:
        return set(words)
    covered = {k + t for k, p in enumerate(zip(words, words[1:], strict=False)) if " ".join(p) in exceptions for t in (0, 1)}
    return {w for k, w in enumerate(words) if k not in covered}


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """From ``sample(text, y)``, whose bound on rows bounds the terms that reach the driver.

    Pairs of words around a candidate term that clean documents use oftener than toxic ones are
    exceptions; terms are then weighted by what is left of their occurrences, so that a term is
    not lost for being harmless in a phrase.
    """
    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    toxic, clean = size["toxic"] + 1.0, size["n"] - size["toxic"] + 1.0
    schema, pick = "term string, clean long, toxic long", sample.select("text", "y")
    odds = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("clean") + 0.5) / clean)

    def sums(of: Callable[[list[str]], set[str]]) -> DataFrame:
        counted = map_rows(pick, _tally(of), schema).groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        return counted.withColumn("odds", odds)

    def weigh(exceptions: frozenset[str], least: float) -> dict[str, float]:
        found = sums(lambda words: {t for w in _outside(words, exceptions) for t in terms_of(w)})
        seeds = {"=" + w: MIN_ODDS for s in SEED_TERMS for w in fold_words(s)}
        return seeds | {r.term: r.odds for r in found.where((F.col("toxic") >= MIN_DOCS) & (F.col("odds") >= least)).orderBy("term").collect()}

    def hit_by(weights: dict[str, float]) -> Callable[[str], bool]:
        stems, whole = (frozenset(t[1:] for t in weights if t[0] == mark) for mark in "^=")
        return lambda word: word in whole or any(word[:n] in stems for n in STEMS)

    hit = hit_by(weigh(frozenset(), CANDIDATE_ODDS))
    phrases = sums(lambda words: {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if hit(a) or hit(b)})
    meant = [r.term for r in phrases.where((F.col("clean") >= MIN_DOCS) & (F.col("odds") < 0)).orderBy("term").collect()]
    exceptions = frozenset(meant) | {" ".join(fold_words(p)) for p in SEED_EXCEPTIONS}
    weights = weigh(exceptions, MIN_ODDS)
    hit = hit_by(weights)
    return Lexicon(weights, sorted(p for p in exceptions if any(map(hit, p.split()))))


def _figures(lexicon_of: Callable[[], Lexicon]) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        lexicon = lexicon_of()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = np.array([lexicon.figures(t) for t in batch.column(1).to_pylist()], float).reshape(-1, 2)
            held = batch.schema.names[2:]
            columns = [batch.column(0), *batch.columns[2:], pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *held, "x1", "x2"])

        return each

    return make


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, curve: np.ndarray):
        self.lexicon, self.curve = lexicon, curve

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, score``, one row per row of ``docs``."""
        return self._scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))).select("doc_id", "score")

    def rejected(self, docs: DataFrame) -> DataFrame:
        """``doc_id, variant`` of the rows that score THRESHOLD or more."""
        picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", variant_of("text").alias("variant"))
        return self._scored(picked, ", variant long").where(F.col("score") >= THRESHOLD).select("doc_id", "variant")

    def _scored(self, picked: DataFrame, held: str = "") -> DataFrame:
        """``picked(doc_id, text, ...)`` with a score in place of the text; ``held`` is the schema of what follows the text."""
        weights, exceptions, curve = self.lexicon.weights, self.lexicon.exceptions, self.curve
        made = map_rows(picked, _figures(lambda: Lexicon(weights, exceptions)), f"doc_id long{held}, x1 double, x2 double")
        z = F.col("x1") * float(curve[0]) + F.col("x2") * float(curve[1]) + float(curve[2])
        return made.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z)))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, bound: int = TRAIN_DOCS) -> ToxicityModel:
    """Lexicon from two thirds of the sample, curve from the rest, so that terms learnt by chance count for little.

    ``train`` selects rows of ``labels(doc_id, toxic)``. Without labels the seed terms and a
    neutral curve remain.
    """
    sample = cut(labelled_sample(docs, labels, "toxic", train, bound), "toxic-sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))
    lexicon = learn_lexicon(sample.where(part != 0))
    weights, exceptions = lexicon.weights, lexicon.exceptions
    rest = sample.where(part == 0)
    marked = map_rows(rest.select("y", "text"), _figures(lambda: Lexicon(weights, exceptions)), "y int, x1 double, x2 double").collect()
    x, y = np.array([(r.x1, r.x2) for r in marked]).reshape(-1, 2), np.array([r.y for r in marked], float)
    curve = fit_logistic(x, y)
    if len(y) == 0 or y.min() == y.max() or logistic(np.array([[3.0, 5.0]]), curve)[0] < logistic(np.zeros((1, 2)), curve)[0]:
        curve = np.array([1.0, 1.0, -4.0])
    return ToxicityModel(lexicon, curve)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Whole texts are scored, by text alone; null and empty texts get the score of no match.
    Repeated rows give repeated results, null ids are scored too, other columns are not
    read, an empty table gives an empty result.
    """
    fold = fold_of("doc_id", 3)
    scored = fit_toxicity(docs, labels, fold != 1).score(docs)
    return scored.select(
        "doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` less the rows that score THRESHOLD or more; schema unchanged. Each row is judged by its own text."""
    model = fit_toxicity(docs, labels, fold_of("doc_id", 3) != 1)
    return drop_rows(docs, model.rejected(docs))
