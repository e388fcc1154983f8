import math
from fractions import Fraction

import numpy as np
import pytest

from ampledger.llm.whitening import count_above, leading_pairs, op13_whitening, tridiagonal, whitened

SCHEMA = "vec_id long, embedding array<double>, label int, n long, x string"


def definition(rows, components=16):
    """vec_id -> (deviation, whitened by eigh), from the definition, in exact fractions up to the covariance."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    centred = [[Fraction(a) - m for a, m in zip(x, mean, strict=True)] for x in fit]
    d = len(mean)
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        z = np.array([float(Fraction(a) - m) for a, m in zip(x, mean, strict=True)]) @ basis / np.sqrt(values)
        out.append((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), z))
    return n, values / np.trace(cov), out


def test_counts_and_pairs_of_hard_spectra():
    rng = np.random.default_rng(3)
    for values in ([9, 4, 4, 4, 1, 0, 0, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 1e-14, 0.0], [1e12, 3.0, 2.0, 1e-3], [5.0], list(range(40, 0, -1))):
        d = len(values)
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        matrix = (q * np.array(values, float)) @ q.T
        matrix = (matrix + matrix.T) / 2
        diagonal, off = tridiagonal(matrix)
        for shift in (0.7, 3.5, 1e6):
            assert count_above(diagonal, off, shift) == sum(v > shift for v in values)
        found, vectors = leading_pairs(matrix, 6)
        want = np.linalg.eigvalsh(matrix)[::-1]
        assert np.allclose(found, want[: len(found)], atol=1e-13 * want[0] * d)
        assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-7)
        assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-12 * want[0] * d
        assert len(found) >= min(6, sum(v > 1e-9 * want[0] for v in values))


def test_whitened_by_definition(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((60, 5)) @ np.diag([3, 2, 1, 0.5, 0.2]) + 2
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(100, vectors[0].tolist()), (100, vectors[0].tolist()), (None, vectors[1].tolist())]
    odd = [(7, None), (8, [1.0, None, 0.0, 0.0, 0.0]), (9, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (11, []), (12, [1.0]), (13, [1e300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows + odd], SCHEMA)
    got = whitened(df, components=4).orderBy("vec_id", "component").collect()
    n, explained, want = definition(rows, 4)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
    signs = None
    for i, deviation, z in want:
        mine = np.array([r.whitened for r in sorted(by_id[i], key=lambda r: r.component)][:: len(by_id[i]) // 4])
        assert {r.deviation for r in by_id[i]} == {deviation}
        signs = np.sign(mine * z) if signs is None else signs
        assert np.allclose(mine, signs * z, atol=1e-9)


def test_large_entries_stay_exact_and_empty_tables_give_nothing(spark):
    rows = [(i, [2.0**40 * (i % 3), float(i)], 0, 1, "x") for i in range(6)]
    got = whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    xs = [[math.floor(64 * c) + 1000000 for c in r[1]] for r in rows]
    for i, x in enumerate(xs):
        exact = sum((6 * a - sum(y[k] for y in xs)) ** 2 for k, a in enumerate(x))
        assert {r.deviation for r in got if r.vec_id == i} == {exact if exact < 2**63 else None}
    for few in ([], [(1, [1.0, 2.0], 0, 1, "x")] * 3, [(1, None, None, None, None)]):
        assert whitened(spark.createDataFrame(few, SCHEMA)).count() == 0


def test_the_query_against_a_dense_solver(spark):
    sf = "/root/testdata/sf0.001"
    got = op13_whitening(spark, sf).collect()
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    cov = np.cov(fit.astype(float), rowvar=False, bias=True)
    values, basis = np.linalg.eigh(cov)
    want = (x - fit.mean(0)) @ basis[:, ::-1][:, :16] / np.sqrt(values[::-1][:16])
    mine = np.zeros((len(rows), 16))
    place = {i: k for k, (i, _) in enumerate(rows)}
    for r in got:
        mine[place[r.vec_id], r.component - 1] = r.whitened
    assert len(got) == 16 * len(rows)
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-6)
    assert got[0].identity_error < 1e-9
