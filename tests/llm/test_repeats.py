import hashlib
import random
import time

import numpy as np
import pytest

from ampledger.llm import repeats
from ampledger.llm.common import variant_of
from ampledger.llm.repeats import _words, corpus_order, dictionary_ranks, op12_repeats, parse_order, phrases, repeated_starts, without_repeats

SCHEMA = "doc_id long, text string, a string, variant int"


def brute(rows, length):
    """(id, text) -> removed runs, from the definition; rows that repeat id and text are one document."""
    from xxhash import xxh64_intdigest

    def signed(h):
        return h - 2**64 if h >= 2**63 else h

    docs = {(i, (t or "").encode()) for i, t in rows}
    seen, out = set(), {}
    for i, data in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, signed(xxh64_intdigest(d[1], 42)))):
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out[i, data] = [tuple(e) for e in edges.reshape(-1, 2).tolist()]
    return out


def check(spark, rows, length, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = without_repeats(df, length, **more).collect()
    want = brute(rows, length)
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode())
    for r in got:
        fits = []
        for data in texts[r.doc_id]:
            runs = want[r.doc_id, data]
            kept = b"".join(data[s:e] for s, e in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)], strict=True))
            fits.append((list(zip(r.begins, r.ends, strict=True)), bytes(r.kept), r.n_bytes) == (runs, kept, len(data)))
        assert any(fits), (r.doc_id, r.begins, r.ends)


def material(rng, n, alphabet="abcdefgh ß"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_parse_is_read_off_each_string():
    rng, length = random.Random(1), 40
    data = [(material(rng, 900) + "a" * 300 + material(rng, 50) * 4).encode() for _ in range(3)]
    joined, lengths = b"".join(data) + bytes(8), np.array([len(d) for d in data])
    ends = np.cumsum(lengths)
    seg, a, b, q, key = phrases(_words(joined), ends - lengths, ends, length)
    spots = {}
    for s, lo, hi, at, k in zip(seg.tolist(), a.tolist(), b.tolist(), q.tolist(), key.tolist(), strict=True):
        for i in range(lo, hi + 1):
            assert i >= ends[s] - lengths[s] and i + length <= ends[s]
            spots.setdefault(i, []).append((at - i, k))
    assert sorted(spots) == [i for e, n in zip(ends, lengths, strict=True) for i in range(e - n, e - length + 1)]
    assert all(len(v) == 1 for v in spots.values())
    by_string = {}
    for i, v in spots.items():
        assert by_string.setdefault(joined[i : i + length], v) == v


def test_suffix_arrays_by_sorting():
    rng = random.Random(2)
    parts = [material(rng, rng.randint(1, 60), "ab\0").encode() for _ in range(40)] + [b"\0", b"\0\0", b"ab" * 40]
    ranks, begins = dictionary_ranks(parts)
    suffixes = [p[k:] for p in parts for k in range(len(p))]
    order = {s: n for n, s in enumerate(sorted(set(suffixes)))}
    assert [order[s] + 1 for s in suffixes] == ranks.tolist() and begins[1] == len(parts[0])
    rank, shared = parse_order(parts)
    ordered = sorted(range(len(parts)), key=lambda k: (parts[k], k))
    assert [parts[k] for k in np.argsort(rank)] == [parts[k] for k in ordered]
    for n in range(1, len(parts)):
        x, y = parts[ordered[n - 1]], parts[ordered[n]]
        assert shared[n] == next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))


def test_corpus_order_is_that_of_the_strings():
    rng, length = random.Random(3), 40
    core = material(rng, 400)
    texts = [material(rng, 100) + core[rng.randint(0, 100) : rng.randint(200, 400)] + material(rng, 100) for _ in range(30)]
    data = [t.encode() for t in texts]
    joined, lengths = b"".join(data) + bytes(8), np.array([len(d) for d in data])
    ends = np.cumsum(lengths)
    _, a, b, q, _ = phrases(_words(joined), ends - lengths, ends, length)
    xs = [joined[lo : hi + length] for lo, hi in zip(a.tolist(), b.tolist(), strict=True)]
    row, offset, _, new = corpus_order(xs, q - a, length)
    strings = [xs[r][o : o + length] for r, o in zip(row.tolist(), offset.tolist(), strict=True)]
    kinds = []
    for s, first in zip(strings, new.tolist(), strict=True):
        assert first == (not kinds or kinds[-1] != s)
        kinds += [s] if first else []
    assert len(kinds) == len(set(kinds)) == len(set(strings))


@pytest.mark.parametrize("group_rows", [1000, 1])
def test_removed_by_definition(spark, group_rows):
    rng = random.Random(4 + group_rows)
    core, line = material(rng, 700), material(rng, 130)
    rows = [(i, material(rng, rng.randint(0, 400)) + core[rng.randint(0, 300) : rng.randint(200, 700)] + material(rng, rng.randint(0, 300))) for i in range(40)]
    rows += [(i, material(rng, 60) + line + material(rng, 40)) for i in range(100, 140)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1]), (7, core), (7, line + core), (None, core), (None, line), (300, None), (301, "")]
    rows += [(302, "a" * 700), (303, "ab" * 300 + "a" * 150), (304, core + core + line), (305, "short"), (306, "short"), (-5, core[100:300])]
    check(spark, rows, 100, group_rows=group_rows)


def test_small_alphabets_and_lengths(spark):
    rng = random.Random(9)
    for length, alphabet in ((24, "ab"), (33, "abc"), (100, "xy")):
        rows = [(i, material(rng, rng.randint(0, 500), alphabet) * rng.randint(1, 3)) for i in range(25)]
        check(spark, rows, length)


def test_empty_table_and_long_texts(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = random.Random(5)
    long = "".join(material(rng, 5000) for _ in range(500))
    began = time.time()
    df = spark.createDataFrame([(1, long, "", 0), (2, long[1_200_000:1_300_000], "", 0), (3, "-" * 400_000, "", 0)], SCHEMA)
    got = {r.doc_id: r for r in without_repeats(df).collect()}
    data = long.encode()
    assert got[1].n_removed == 0 and bytes(got[1].kept) == data
    assert got[2].n_removed == got[2].n_bytes and got[3].begins == [1] and got[3].n_removed == 399_999
    assert time.time() - began < 60


def near_copies(spark, rng, copies=30, size=40_000):
    core = material(rng, size)
    rows = [(i, f"{i:04d} {core[: 500 * i]}{i:04d}{core[500 * i :]}") for i in range(copies)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("variant", variant_of("text"))


def test_rounds_keep_tables_under_the_texts(spark, monkeypatch):
    """However much of the texts is shared, no table of phrases outgrows them; before, one table had them all."""
    made = []

    def counted(df, name):
        out = cut(df, name)
        made.append((name, out.count()))
        return out

    cut = repeats.cut
    monkeypatch.setattr(repeats, "cut", counted)
    texts = near_copies(spark, random.Random(6))
    size = texts.selectExpr("sum(octet_length(text))").first()[0]
    repeated_starts(texts)
    tables = [n for name, n in made if name == "phrases"]
    assert sum(tables) > size / 25 and max(tables) * 160 < 1.4 * size


def test_shuffle_files_go_with_each_table(spark):
    """Before, they stayed on disk until the driver's next garbage collection."""

    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = shuffled(), spark.conf.get(name)
    repeated_starts(near_copies(spark, random.Random(7)))
    assert shuffled() <= before + 100_000 and spark.conf.get(name) == conf


@pytest.mark.parametrize("n", [1000, 70_000, 110_000])
def test_filter_grows_with_its_keys(spark, n):
    keys = np.random.default_rng(8).integers(-(2**63), 2**63, 4 * n)
    bits, power = repeats._filter(spark.createDataFrame([(k,) for k in keys[:n].tolist()], "seed long"), n)
    held = repeats._held((np.frombuffer(bits, np.uint8), power), keys)
    assert held[:n].all() and held[n:].mean() < 0.04


@pytest.mark.parametrize("group_rows", [1000, 3])
def test_many_rounds_by_definition(spark, monkeypatch, group_rows):
    monkeypatch.setattr(repeats, "FILTER_LEAST", 13)
    monkeypatch.setattr(repeats, "FILTER_MOST", 13)
    rng = random.Random(10)
    core, line = material(rng, 9000), material(rng, 130)
    rows = [(i, material(rng, 300) + core[rng.randint(0, 4000) : rng.randint(4000, 9000)] + line * 3 + material(rng, 100)) for i in range(12)]
    rows += [(20, rows[3][1]), (3, rows[3][1]), (None, core), (21, core[100:300] * 4)]
    check(spark, rows, 100, group_rows=group_rows)


def test_phrases_of_one_text_are_told_apart(spark):
    rng, length = random.Random(11), 40
    line = material(rng, 90)
    texts = [(line * 6 + material(rng, 300) + line[:70] + "x" + line * 2).encode(), (line * 2 + material(rng, 60)).encode()]
    joined, lengths = b"".join(texts) + bytes(8), np.array([len(t) for t in texts])
    ends, words = np.cumsum(lengths), _words(joined)
    seg, a, b, q, key = phrases(words, ends - lengths, ends, length)
    got = repeats._of_one_text(words, seg, a, b, q, key, length)
    seen, want = set(), np.zeros(len(a), bool)
    for k in np.argsort(a).tolist():
        phrase = (seg[k], q[k] - a[k], joined[a[k] : b[k] + length])
        want[k] = phrase in seen
        seen.add(phrase)
    assert got.tolist() == want.tolist() and 0 < got.sum() < len(got)


def test_the_query_by_definition(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 100)
    got = {r.doc_id: r for r in op12_repeats(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        runs = want[i, data]
        kept = b"".join(data[s:e] for s, e in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)], strict=True))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed for r in got.values()) > 0
