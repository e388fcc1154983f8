import collections
import random
import re

import duckdb
import numpy as np
import pytest

from ampledger.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string, n long, phrase string"


def brute(rows, least, places):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {x: a for x, a in counts.items() if a >= least and len(x[1]) > 1}
    inside = set()
    for (lang, p), f in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and 100 * f >= 100 * found[lang, p[i:j]]:
                    inside.add((lang, p[i:j]))
    by_lang = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            by_lang[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, n, p.decode(), -a, left, right, totals[lang], -s) for lang, v in by_lang.items() for n, (s, a, p, left, right) in enumerate(sorted(v)[:places], 1))


def prose(rng, n):
    words = [f"W{int(rng.paretovariate(0.7)) % 60}" for _ in range(n)]
    for _ in range(n // 8):
        words[rng.randrange(n)] = rng.choice(["new york city hall", "New york city", "a b a b a b", "x x x x x x x", "w1 w2 w3 w4 w5 w6"])
    return "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n"]) for w in words)


@pytest.mark.parametrize("places,first_limit", [(2000, 64), (12, 4), (5, 1000), (1, 2)])
def test_ranked_by_definition(spark, monkeypatch, places, first_limit):
    rng = random.Random(places)
    monkeypatch.setattr(C, "CHUNK", 5000)
    monkeypatch.setattr(C, "HELD_ROWS", 600_000 if places > 10 else 150)
    rows = [(rng.choice(["en", "fr", None]), prose(rng, rng.randint(1, 500))) for _ in range(60)]
    rows += [("en", None), ("de", "one Ünd two"), ("", "q q q"), ("fr", "É" * 100 + " " + "y" * 300), ("xx", "a" * 90 + " b " + "a" * 90 + " b")]
    df = spark.createDataFrame([(1, lang, t, 2, "z") for lang, t in rows], SCHEMA)
    got = C.collocations(df, least=7, places=places, first_limit=first_limit).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 7, places)


def test_empty_tables_and_unequal_phrases_of_one_number(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, 1, None)], SCHEMA)).count() == 0
    one, two = np.array([1, 2, 1, 2], np.uint64), np.array([5, 6, 5, 6], np.uint64)
    order, at = C._groups([one, two])
    assert len(at) == 2 and sorted(order[at[1] :].tolist()) in ([0, 2], [1, 3])


def test_the_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in C.op11_collocations(spark, sf).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.sql(C.OP11_SQL).fetchall()) and len(got) > 50
