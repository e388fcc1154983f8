import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ampledger.llm import fuse, simhash
from ampledger.llm.components import connected_components
from ampledger.llm.exact_dedup import OP1_SQL, arrival, drop_exact_duplicates, exact_dedup, op1_exact_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, keep_id string, kept long"  # the last two clash with results


def test_fuse_filter_holds_all_keys_and_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000, 60_000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        f = fuse.build(np.concatenate([keys, keys[: n // 2]]))
        assert fuse.contains(f, keys).all()
        assert fuse.contains(f, rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.02
        assert len(f["cells"]) < 1.3 * n or n < 10_000  # small filters have a larger share of spare slots


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {(i, max(g, key=lambda x: (x is not None, x)), len(g), t) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("broadcast", [0, 10**6])
@pytest.mark.parametrize("weak", [0, 1, 2])
def test_exact_dedup_against_brute_force(spark, broadcast, weak):
    rnd = random.Random(3)
    texts = ["", None, "a", "a ", "A", "é", "é", "x" * 50_000, "hot"] + [f"t{i}" for i in range(40)]
    rows = [(i, rnd.choice(texts)) for i in range(300)] + [(1000 + i, "hot") for i in range(200)]
    df = spark.createDataFrame([(*r, "z", 9) for r in rows], DOCS)
    kind = {"digest": lambda c: F.unhex(F.hex(F.pmod(F.length(c), F.lit(3))))} if weak else {}
    if weak == 2:  # only the bytes tell the texts apart
        kind["variant"] = lambda c: F.pmod(F.length(c), F.lit(5)).cast("long")
    got = exact_dedup(df, arrival(), broadcast_digests=broadcast, keys_per_shard=16, **kind).collect()
    by = dict(rows)
    assert {(r.doc_id, r.keep_id, r.group_size, by[r.doc_id] or "") for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got) and len(got) == len(rows)


def test_exact_dedup_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (5, "b"), (5, "b"), (4, "b"), (7, None)], "doc_id long, text string")
    got = exact_dedup(df, arrival()).collect()
    assert sorted((r.keep_id or -1, r.group_size, r.kept) for r in got) == [
        (-1, 2, False), (-1, 2, True), (5, 3, False), (5, 3, False), (5, 3, True), (7, 1, True)
    ]
    kept = drop_exact_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, "a"), (5, "b"), (7, "")]
    assert exact_dedup(df.limit(0), arrival()).count() == 0 and drop_exact_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_a_hot_text_under_null_ids(spark, weak):
    rows = [(None, "hot")] * 400 + [(None, "cold"), (3, "hot"), (3, "hot"), (9, "own"), (4, None), (None, "")]
    kind = {"digest": lambda c: F.unhex(F.lit("00")), "variant": lambda c: F.lit(1).cast("long")} if weak else {}
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), arrival(), broadcast_digests=0, **kind).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in got) == sorted((i or -1, k or -1, n) for i, k, n, _ in all_rows(rows))
    assert sorted((r.keep_id or -1, r.group_size) for r in got if r.kept) == [(-1, 1), (3, 402), (4, 2), (9, 1)]


def all_rows(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return [(i, max((x for x in g if x is not None), default=None), len(g), t) for t, g in groups.items() for i in g]


def test_op1_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(OP1_SQL).fetchall()
    assert sorted(map(tuple, op1_exact_dedup(spark, SF).collect())) == sorted(map(tuple, want))


def words_fp(text):
    """The contract, word by word."""
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint(spark):
    rnd = random.Random(5)
    for t in [None, "", " \n\t", "One", "one TWO", "É È ß İ", "a\x0bb\x1cc\x85d", " ".join(rnd.choices("abcdE", k=9000))]:
        assert simhash.fingerprint(t) == words_fp(t)
    spark_hash = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    import xxhash

    assert spark_hash & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_golay_keys_meet_within_two_bits():
    leaders = simhash.golay_leaders()
    assert (leaders >= 0).all()  # perfect: every syndrome has a pattern of weight <= 3
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    near = base.copy()
    for k in range(400):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    (oa, ka), (ob, kb) = simhash.fuzzy_keys(base), simhash.fuzzy_keys(near)
    for k in range(400):
        assert set(ka[oa == k]) & set(kb[ob == k])
    assert len(ka) / 400 < 19


@pytest.mark.parametrize("bucket", [1, 64])
def test_links_have_the_closure_of_all_pairs(spark, bucket):
    rng = np.random.default_rng(4)
    fps = {0}
    for c in rng.integers(0, 2**63, 6, dtype=np.uint64):
        for _ in range(40):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.near_links(df, bucket).collect()
    real = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links)
    assert components(fps, [tuple(r) for r in links]) == components(fps, real)


def test_connected_components(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(500, 100 + i) for i in range(50)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(90)]
    links += [(7, 7), links[0]]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    real = [x for x in links if x[0] != x[1]]
    assert got == components({n for x in real for n in x}, real)
    assert connected_components(df.limit(0)).count() == 0


def test_simhash_components_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "solo"), (9005, rows[0][1]), (9005, rows[0][1]), (9006, rows[0][1] + " end")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp long")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(df).collect()}
    fps = {i: words_fp(t) for i, t in rows}
    real = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    comp = components(fps, real)
    assert got == {i: (fps[i], comp[i]) for i in fps}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == set(comp.values())
    assert simhash.simhash_components(df.limit(0)).count() == 0
