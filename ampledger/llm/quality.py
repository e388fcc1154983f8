"""Quality: a linear-chain CRF labels every line good or bad; marginals make the document's score.

Features describe a line and its neighbours. Labels exist for documents only, so lines
start with their document's label, and lines of bad documents that look like good ones are
relabelled once before the chain is trained. A document's figure is the mean of the lines'
forward-backward marginals, weighted by length, and a logistic curve fitted on documents
that the chain has not seen turns it into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm import crf
from ampledger.llm.common import cut, map_rows, table
from ampledger.llm.labels import fit_logistic, fold_of, labelled_sample, logistic

TRAIN_DOCS = 3_000  # labelled rows fitted on, at most; all their lines count
THRESHOLD = 0.3

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[^\w\s.,;:'’()\"-]")
_STOP = re.compile(r"[.,;:]")
_TAILED = re.compile(r"(?<![^\w\s.,;:?'’)\"])[^\w\s.,;:?'’)\"]++(?=\s|$)")
_ALONE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_OWN = 18
_NEAR = (3, 5, 7, 8, 9, 10, 11, 13)  # figures of the lines before and after that a line sees
FEATURES = _OWN + 2 * len(_NEAR)


def _line(line: str, words: list[str], seen: Counter, before: str) -> list[float]:
    n, size = len(words), len(line)
    low = [w.lower() for w in words]
    kinds = Counter(low)
    letters = max(1, size - n)
    return [
        1.0,
        math.log1p(n),
        min(30.0, letters / n) / 10,
        len(_UPPER.findall(line)) / letters,
        len(_DIGIT.findall(line)) / letters,
        len(_SIGN.findall(line)) / letters,
        len(_STOP.findall(line)) / n,
        len(_TAILED.findall(line)) / n,
        len(_ALONE.findall(line)) / n,
        len(kinds) / n,
        max(kinds.values()) / n,
        sum(len(w) <= 3 for w in low) / n,
        float(line.rstrip()[-1:] in ".!?…"),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        min(3, seen[line]) / 3,
        float(line == before),
        min(40, max(map(len, words))) / 40,
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
    ]


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) and the lines' lengths; blank lines are passed over."""
    lines = [(s, w) for s in re.split(r"[\n\r]+", text or "") if (w := s.split())]
    if not lines:
        return np.zeros((0, FEATURES)), np.zeros(0)
    seen: Counter = Counter()
    own, before = [], ""
    for s, w in lines:
        own.append(_line(s, w, seen, before))
        seen[s] += 1
        before = s
    x = np.array(own)
    near = np.vstack([np.zeros((1, len(_NEAR))), x[:, _NEAR], np.zeros((1, len(_NEAR)))])
    return np.hstack([x, near[:-2], near[2:]]), np.array([len(s) for s, _ in lines], float)


def figures(model: crf.Crf, text: str | None) -> tuple[float, float]:
    """Length-weighted mean of the lines' P(good), less one half, and its log odds; both 0 for a text without lines."""
    x, size = line_features(text)
    if not len(x):
        return 0.0, 0.0
    mean = float((model.marginals(x) * size).sum() / size.sum())
    return mean - 0.5, math.log((mean + 0.01) / (1.01 - mean))


def train_lines(docs: list[tuple[str, int]]) -> crf.Crf:
    """The chain, from (text, label) of whole documents."""
    found = ((line_features(text)[0], y) for text, y in docs)
    chains = [(x, np.full(len(x), y)) for x, y in found if len(x)]
    if not chains:
        return crf.train([])
    flat, labels = np.concatenate([x for x, _ in chains]), np.concatenate([y for _, y in chains])
    looks = fit_logistic(flat[:, 1:], labels, l2=1e-2)
    rate = labels.mean()
    for k, (x, y) in enumerate(chains):
        if y[0] == 0:
            p = logistic(x[:, 1:], looks)
            good = p > max(0.5, rate)
            good[np.argmin(p)] = False
            chains[k] = (x, good.astype(int))
    return crf.train(chains)


class QualityModel:
    def __init__(self, chain: crf.Crf, curve: np.ndarray):
        self.chain, self.curve = chain, curve

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, score``, one row per row of ``docs``."""
        chain, curve = self.chain, self.curve

        def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                x = np.array([figures(chain, t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
                return pa.RecordBatch.from_arrays([batch.column(0), pa.array(logistic(x, curve))], ["doc_id", "score"])

            return each

        picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
        return map_rows(picked, make, "doc_id long, score double")


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, bound: int = TRAIN_DOCS) -> QualityModel:
    """Chain from two thirds of a bounded sample of labelled rows, curve from the rest; neutral without labels."""
    sample = labelled_sample(docs, labels, "quality", train, bound)
    sample = cut(sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3))), "quality-sample")
    rows = [(r.text, r.y) for r in sample.where("part <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").toLocalIterator()]
    chain = train_lines(rows)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([figures(chain, t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["y", "x1", "x2"])

        return each

    marked = map_rows(sample.where("part = 0").select("y", "text"), make, "y int, x1 double, x2 double").collect()
    x, y = np.array([(r.x1, r.x2) for r in marked]).reshape(-1, 2), np.array([r.y for r in marked], float)
    return QualityModel(chain, fit_logistic(x, y))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Every line of a text counts. Null, empty and blank texts get the curve's value at an even
    marginal. Repeated rows give repeated results, null ids are scored too, other columns are
    not read, an empty table gives an empty result.
    """
    fold = fold_of("doc_id", 5)
    scored = fit_quality(docs, labels, fold != 0).score(docs)
    return scored.select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
