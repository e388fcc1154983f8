import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ampledger.llm import common, crf, decontaminate, html_text, pii, quality, toxicity, url_filter
from ampledger.llm.labels import fit_logistic, fold_of, labelled_sample, logistic

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


# --- personal data


def base_by_definition(text):
    """The contract's patterns as given, one after another."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_definition(spark):
    rnd = random.Random(8)
    texts = [r.text or "" for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()]
    texts += ["".join(rnd.choices("ab.@-+ 0123459()_%é\n", k=120)) for _ in range(4000)]
    texts += ["a@b.c@d.e", "x@y@z.w", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1 (743) 555-3824", "4111 1111 1111 1111", "٣@٣.com", "01.02.03.004", "0000000000001.1.1.1"]
    for t in texts:
        assert pii.base_spans(t) == base_by_definition(t), repr(t)[:200]
    for long in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 90_000, "a@" * 90_000):
        pii.base_spans(long), pii.unseen_spans(long, [])


def test_bootstrapped_contexts_find_unseen_numbers(spark):
    rows = [(i, f"please call me +1 (555) 010-{1000 + i} or write soon") for i in range(6)]
    rows += [(100, "please call me 555 010 7777 or write soon"), (101, "in total 555 010 7778 were sold today"), (102, None), (103, "")]
    rows += [(104, "please call me 555 010 7777 or write soon")] * 2
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert got[100].spans == got[104].spans == "phone:15:27" and got[100].n_phone == 0
    assert got[101].spans == "" and got[102].spans == "" and got[0].spans == "phone:15:32" and got[0].n_phone == 1
    assert pii.find_pii(df).count() == len(rows) and pii.find_pii(df.limit(0)).count() == 0


def test_contexts_glued_to_identifiers_and_patterns_of_later_rounds(spark):
    glued = [(i, f"contact tel:+1 (555) 010-{1000 + i}, or write soon") for i in range(6)]
    glued += [(6, "contact tel:555 010 7777, or write soon")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(glued, "doc_id long, text string")).collect()}
    assert got[6] == "phone:12:24"
    assert pii.contexts("see (a@b.com), or", 5, 12) == ["< see (", "> ) ,"] and pii.contexts("(a@b.com", 1, 8) == []
    # "fax line" holds no seed; three of its numbers are trusted by "call me", the fourth by them
    later = [(i, f"please call me +1 (555) 010-{1000 + i}") for i in range(12)]
    later += [(20 + i, f"please call me 555 010 777{i}") for i in range(3)] + [(30 + i, f"the fax line 555 010 777{i}") for i in range(4)]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(later, "doc_id long, text string")).collect()}
    assert got[20] == "phone:15:27" and got[33] == "phone:13:25"


def test_pieces_keep_their_bounds_and_all_rows():
    batch = pa.RecordBatch.from_pydict({"n": list(range(3000)), "t": ["x" * (9_000_000 if n == 7 else 10) for n in range(3000)]})
    pieces = list(common._pieces(batch))
    assert [n for p in pieces for n in p.column(0).to_pylist()] == list(range(3000))
    assert all(p.num_rows <= common.PIECE_ROWS and (p.num_rows == 1 or p.nbytes <= common.PIECE_BYTES) for p in pieces) and list(common._pieces(batch.slice(0, 0))) == []


@pytest.mark.parametrize("shipped", [0, 50_000])
def test_discovery_of_planted_identifiers(spark, shipped):
    """Identifiers that no base pattern takes, in the contexts of those that it does: most are found, and little else."""
    rnd = random.Random(15)
    frames = ("please call me {} or write soon", "our fax line is {} all day", "mail it to {} before noon", "host address {} was seen", "card number {} expires in")
    base = ("+1 (555) 01{0:02d}-1{0:03d}", "+44 20 7946 1{0:03d}", "user{0}@example.org", "10.1.{0}.7", None)
    unseen = ("555 010 7{0:03d}", "(020) 7946 2{0:03d}", "user{0} [at] example [dot] org", "fe80:0:0:{0}:1:2:3:4", None)
    words = [f"word{k}" for k in range(200)]
    fill = lambda: " ".join(rnd.choices(words, k=12))
    rows, planted = [], {}
    for k in range(400):
        which = rnd.randrange(4)
        new = rnd.random() < 0.25
        told = (unseen if new else base)[which].format(k % 99)
        before = f"{fill()} {frames[which].split('{}')[0]}"
        rows.append((k, before + told + frames[which].split("{}")[1] + " " + fill()))
        if new:
            planted[k] = (len(before), len(before) + len(told))
    rows += [(1000 + k, f"{fill()} in total 555 010 {6000 + k} {rnd.choice(words)} were sold {fill()}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df, patterns_shipped=shipped).collect()}
    found = {k for k, (a, b) in planted.items() if f":{a}:{b}" in got[k].spans}
    n_more = sum(len([s for s in r.spans.split(",") if s]) - r.n_email - r.n_ip - r.n_card - r.n_phone for r in got.values())
    assert len(found) >= 0.9 * len(planted) and len(found) >= 0.9 * n_more


# --- urls


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/EN/x", "http://www.example.com/en/", "http://a.example.com/en/?q", "http://com", "http://x.com?y",
    "http://xcom/", "https://example.com/en", "ftp://É.net/es/ü", "a://b://c.com/d", "https://u:p@k.net:80/fr/#x", "http://net/fr/", "http://q.org/" + "é/" * 5000,
]


def test_url_filter_equals_sql_and_the_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[5]), (5, URLS[5])]
    rows += [(r.page_id + 100, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, score int")
    got = url_filter.filter_urls(df).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = con.execute(url_filter.OP6_SQL).fetchall()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = dict(rows)
    for r in got:
        host, path = split_url(by[r.page_id]) if r.page_id is not None else split_url(URLS[5])
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[0]) and r.verdict == (best[1] or ("allow" if r.score >= r.cut else "block"))
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_models_against_plain_python(spark):
    rows = [(i, f"http://good{i % 7}.site.com/p{i}") for i in range(60)] + [(i + 60, f"http://bad{i % 5}.net/es/{i}") for i in range(50)]
    rows += [(200, "http://good1.site.org/p9"), (201, "http://bad2.org/es/4")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200].score > got[201].score and got[200].verdict == "allow" and got[201].verdict == "block"
    n = url_filter.CONTEXT
    fold = lambda u: "^" * n + re.sub(r"[^a-z0\-./_%~]", "*", re.sub("[1-9]", "0", "".join(split_url(u)).lower()))
    grams = lambda s: [s[k : k + n + 1] for k in range(len(s) - n)]
    seen = {y: [g for i, u in rows if i < 200 and (i < 60) == y for g in grams(fold(u))] for y in (True, False)}
    times = lambda y, part, k: sum(g[n - k :].startswith(part) for g in seen[y])

    def p(y, g, k):
        """P of the last symbol of ``g`` after the k before it."""
        if k == 0:
            return (sum(x[-1] == g[-1] for x in seen[y]) + 0.5) / (len(seen[y]) + 0.5 * url_filter.A)
        before, whole = g[n - k : -1], g[n - k :]
        held = {m: times(m, before, k) for m in seen}
        if sum(held.values()) < url_filter.SUPPORT:
            return p(y, g, k - 1)
        return (times(y, whole, k) + url_filter.SMOOTH * p(y, g, k - 1)) / (held[y] + url_filter.SMOOTH)

    log_p = lambda y, g: math.log(p(y, g, n))
    for i in (0, 61, 200, 201):
        told = grams(fold(dict(rows)[i]))
        want = sum(math.floor(1000 * (log_p(True, g) - log_p(False, g)) + 0.5) for g in told)
        assert got[i].score == math.floor(want / len(told))


def test_url_work_is_linear_and_salted_joins_agree(spark, monkeypatch):
    rows = [(i, f"http://site{i % 9}.com/" + "abc-de/" * (20 * i)) for i in range(40)] + [(100 + i, f"http://x.net/es/{i}") for i in range(40)]
    rows += [(200, "http://long.org/" + "".join(random.Random(4).choices("abcdef/-0é", k=200_000)))]
    df = spark.createDataFrame(rows, "page_id long, url string")
    began = time.perf_counter()
    one = sorted(url_filter.filter_urls(df).collect())
    assert time.perf_counter() - began < 30
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 10)
    assert sorted(url_filter.filter_urls(df).collect()) == one


# --- chains and curves


def test_chain_equals_enumeration():
    rng = np.random.default_rng(3)
    model = crf.Crf(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(4), np.ones(4))
    x = rng.normal(size=(7, 4))
    e = model.emissions(x)
    paths = [[k >> i & 1 for i in range(7)] for k in range(128)]
    score = [model.first[p[0]] + sum(e[i, p[i]] for i in range(7)) + sum(model.moves[p[i], p[i + 1]] for i in range(6)) for p in paths]
    assert model.viterbi(x).tolist() == paths[int(np.argmax(score))]
    w = np.exp(np.array(score) - max(score))
    assert np.allclose(model.marginals(x), (w[:, None] * np.array(paths)).sum(0) / w.sum())
    assert len(model.viterbi(x[:0])) == 0 and len(model.marginals(x[:0])) == 0


def test_chain_learns_and_curve_fits():
    rng = np.random.default_rng(5)
    chains = []
    for _ in range(80):
        y = np.repeat(rng.integers(0, 2, 6), rng.integers(1, 12, 6))
        chains.append((np.column_stack([y + rng.normal(0, 0.8, len(y)), np.ones(len(y))]), y))
    model = crf.train(chains[:60])
    right = np.concatenate([model.viterbi(x) == y for x, y in chains[60:]]).mean()
    alone = np.concatenate([(x[:, 0] > 0.5) == y for x, y in chains[60:]]).mean()
    assert right > alone + 0.05
    x = rng.normal(size=(400, 1))
    assert logistic(np.array([[2.0], [-2.0]]), fit_logistic(x, (x[:, 0] > 0).astype(float))).round().tolist() == [1, 0]
    assert 0 < logistic(np.zeros((1, 1)), fit_logistic(np.zeros((3, 1)), np.ones(3)))[0] < 1


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for s in np.unique(score):
        rank[score == s] = np.searchsorted(score[order], s, "left") + (np.sum(score == s) + 1) / 2
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(spark, found, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = [r for r in found.collect() if r.held_out and r.doc_id in labels]
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([labels[r.doc_id] for r in rows])


def odd_documents(spark):
    rows = [(1, None), (2, ""), (3, " \n\n"), (None, "words here"), (4, "x" * 100_000), (4, "x" * 100_000), (5, "a\n" * 20_000)]
    return spark.createDataFrame([(*r, 0.5, 7) for r in rows], "doc_id long, text string, score double, predicted int")


@pytest.mark.parametrize("scorer", [quality.score_quality, toxicity.score_toxicity])
def test_scorers_on_odd_and_empty_tables(spark, scorer):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality long, toxic long")
    got = scorer(df, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    folds = {quality.score_quality: (5, 0), toxicity.score_toxicity: (3, 1)}[scorer]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds[0] == folds[1]) for r in got if r.doc_id is not None)
    assert scorer(df.limit(0), labels.limit(0)).count() == 0
    assert df.select(fold_of("doc_id", 5).alias("f")).where("f is null").count() == 0


def test_quality_held_out(spark):
    score, predicted, y = held_out(spark, quality.op10_quality(spark, BIG), "quality")
    assert auc(score, y) > 0.97 and (predicted == y).mean() > 0.95


def test_quality_sees_every_line():
    good = "The river rose in the night and by morning the road was gone.\n"
    model = quality.train_lines([(good * k, 1) for k in (3, 5, 8)] * 5 + [("BUY!! NOW!! CHEAP!! PILLS!!\n" * k, 0) for k in (3, 5, 8)] * 5)
    clean, _ = quality.figures(model, good * 50)
    spoilt, _ = quality.figures(model, good * 50 + "BUY!! NOW!! CHEAP!! PILLS!!\n" * 100)
    assert clean > 0.3 > spoilt and quality.figures(model, None) == (0.0, 0.0)


def test_quality_scores_by_enumeration(spark):
    """The query's score of short documents, from all labellings of their lines."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels, fold_of("doc_id", 5) != 0)
    rows = [(k, "\n".join(lines)) for k, lines in enumerate((["One line of plain words here."], ["BUY!! NOW", "The river rose in the night.", "click $$$ >>> x"], ["a", "", "b c d", "e f, g.", "Hi!"]))]
    got = {r.doc_id: r.score for r in model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    chain, curve = model.chain, model.curve
    for k, text in rows:
        x, size = quality.line_features(text)
        e, weight = chain.emissions(x), {}
        for ys in itertools.product((0, 1), repeat=len(x)):
            total = chain.first[ys[0]] + sum(e[n, y] for n, y in enumerate(ys)) + sum(chain.moves[a, b] for a, b in zip(ys, ys[1:], strict=False))
            weight[ys] = math.exp(total)
        share = [sum(w for ys, w in weight.items() if ys[n]) / sum(weight.values()) for n in range(len(x))]
        mean = float(np.dot(share, size) / size.sum())
        assert got[k] == pytest.approx(float(logistic(np.array([[mean - 0.5, math.log((mean + 0.01) / (1.01 - mean))]]), curve)[0]), rel=1e-6)


def test_toxicity_held_out(spark):
    score, predicted, y = held_out(spark, toxicity.op8_toxicity(spark, BIG), "toxic")
    assert auc(score, y) > 0.8 and predicted[y == 0].mean() < 0.02 and predicted[y == 1].mean() > 0.6


def test_folding_and_exceptions():
    assert toxicity.fold_words("1D10T ｉｄｉｏｔ іdіоt idiiiiot id!ot") == ["idiot"] * 2 + ["idiot", "idiot", "idiot"]
    assert toxicity.fold_words("In 1984, 300 men!") == ["in", "1984", "300", "men"] and toxicity.fold_words(None) == []
    lex = toxicity.Lexicon({"=trash": 4.0, "^cioW": 1.0, "^mor": 2.0, "=moron": 5.0}, ["trash can"])
    assert lex.hits(toxicity.fold_words("the trash can and the trash")) == [4.0]
    assert lex.hits(["moron", "moral", "amor"]) == [5.0, 2.0]
    assert lex.figures("trash " + "word " * 99)[0] == pytest.approx(0.4) and lex.figures("") == (0.0, 0.0)
    assert toxicity.Lexicon({}, []).hits(["x"]) == []
    lex = toxicity.Lexicon({"=bad": 1.0, "=dog": 2.0}, ["bad dog", "dog show", "my bad dog show"])
    assert lex.hits("my bad dog show bad dog bad my dog".split()) == [1.0, 2.0]
    began = time.perf_counter()
    assert lex.hits("bad dog my".split() * 20_000 + ["bad"]) == [1.0] and time.perf_counter() - began < 1


def hits_by_definition(weights, exceptions, words):
    """Each word's greatest weight, unless an exception phrase covers it."""
    covered = {k + t for p in exceptions for k in range(len(words)) if words[k : k + len(p.split())] == p.split() for t in range(len(p.split()))}
    best = [max((v for t, v in weights.items() if (w == t[1:] if t[0] == "=" else w.startswith(t[1:]))), default=0.0) for w in words]
    return [b for k, b in enumerate(best) if b and k not in covered]


def test_hits_equal_the_definition():
    rnd = random.Random(14)
    words = ["ab", "abc", "abcd", "b", "bc", "abx", "c"]
    for _ in range(300):
        weights = {rnd.choice("=^") + w: rnd.random() for w in rnd.sample(words, 3)}
        exceptions = [" ".join(rnd.choices(words, k=rnd.randrange(1, 4))) for _ in range(3)]
        text = rnd.choices(words, k=12)
        assert toxicity.Lexicon(weights, exceptions).hits(text) == hits_by_definition(weights, exceptions, text)


def test_exceptions_are_learnt_and_terms_weighted_without_them(spark):
    """"rotten" is an insult on its own, but clean documents speak of rotten apples as often."""
    fill = [f"word{k} other{k % 3}" for k in range(30)]
    rows = [(f"you rotten {fill[k]}", 1) for k in range(12)] + [(f"a rotten apple {fill[k]}", 0) for k in range(12)] + [(f, 0) for f in fill]
    lex = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    assert "rotten appie" in lex.exceptions and lex.weights["=rotten"] > toxicity.MIN_ODDS
    assert lex.hits("a rotten appie".split()) == [] and lex.hits("you rotten word".split()) != []
    by_hand = math.log(12.5 / 13) - math.log(0.5 / 43)
    assert lex.weights["=rotten"] == pytest.approx(by_hand)


def test_scores_are_the_curve_of_the_figures(spark):
    rows = [(k, t) for k, t in enumerate(["", "you moron", "moron moron trash can", "trash", "fine day", None])]
    lexicon = toxicity.Lexicon({"=moron": 4.0, "=trash": 3.0}, ["trash can"])
    got = {r.doc_id: r.score for r in toxicity.ToxicityModel(lexicon, np.array([1.0, 0.5, -3.0])).score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        words = toxicity.fold_words(t)
        hits = hits_by_definition(lexicon.weights, lexicon.exceptions, words)
        x = (sum(hits) / math.sqrt(len(words)), sum(hits) / len(hits)) if hits else (0.0, 0.0)
        assert got[k] == pytest.approx(1 / (1 + math.exp(3.0 - x[0] - 0.5 * x[1])))


# --- decontamination


def greedy_by_definition(a, b, least):
    """Longest match of unmarked words again and again, by looking everywhere."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return out
        k, i, j = best[0], -best[1], -best[2]
        out.append((k, i, j))
        for t in range(k):
            free_a[i + t] = free_b[j + t] = False


def test_tiles_equal_exhaustive_greedy_tiling():
    rnd = random.Random(9)
    for _ in range(150):
        b = rnd.choices("abcdefgh", k=rnd.randrange(1, 25))
        a = rnd.choices("abcdefgh", k=10) + b[5:] + ["x"] + b[:7] + rnd.choices("abcdefgh", k=8)
        assert decontaminate.tiles(a, b, 3) == greedy_by_definition(a, b, 3)
    assert decontaminate.tiles([], ["a"], 1) == [] and decontaminate.tiles(["a"], [], 1) == []


def test_periodic_texts_are_tiled_in_time():
    rnd = random.Random(11)
    for a, b, covered in ((list("abcde") * 4000, list("abcde") * 80, 400), (["x"] * 20_000, ["x"] * 400, 400), (rnd.choices("ab", k=20_000), rnd.choices("ab", k=400), 300)):
        began = time.perf_counter()
        assert sum(t[0] for t in decontaminate.tiles(a, b)) >= covered
        assert time.perf_counter() - began < 1


def test_pairing_loses_no_item(spark):
    """All pairs against those that share a looked-up seed, on texts of few words, where seeds are common."""
    rnd = random.Random(12)
    items = [(k, " ".join(rnd.choices("abcdefghij", k=rnd.randrange(1, 14)))) for k in range(60)]
    seeds = decontaminate.Seeds(items)
    for _ in range(150):
        words = rnd.choices("abcdefghij", k=60)
        full = [(i, covered_by(words, b)) for i, b in enumerate(seeds.items)]
        assert [m[0] for m in seeds.matches(words)] == [i for i, n in full if n >= 0.8 * len(seeds.items[i])]


def covered_by(a, b):
    return sum(t[0] for t in decontaminate.tiles(a, b, min(3, len(b))))


@pytest.mark.parametrize("words_shipped", [3, 10**6])
def test_contamination_against_brute_force(spark, words_shipped):
    rnd = random.Random(10)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choices(vocab, k=30))) for k in range(12)] + [(50, "Tiny Item"), (51, None), (52, " .. ")]
    fill = lambda n: " ".join(rnd.choices(vocab, k=n))
    docs = [(k, f"{fill(40)} {items[k][1].upper()}, {fill(9)}") for k in range(6)]
    for k in range(6, 9):  # passages in another order
        w = items[k][1].split()
        docs.append((k, f"{' '.join(w[20:])} {fill(5)} {' '.join(w[8:20])} {fill(5)} {' '.join(w[:8])}"))
    w = items[10][1].split()  # runs of three and four words, no five of which stand together
    docs.append((10, " zz ".join(" ".join(w[k : k + n]) for k, n in ((26, 4), (19, 4), (23, 3), (12, 4), (16, 3), (5, 4), (9, 3), (0, 3)))))
    docs += [(20, fill(300)), (21, " ".join(items[9][1].split()[:15])), (22, None), (23, ""), (24, "a tiny item here"), (25, items[0][1]), (25, items[0][1])]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench, words_shipped=words_shipped).collect()
    want = []
    for i, t in docs:
        for j, s in items:
            a, b = decontaminate.words_of(t), decontaminate.words_of(s)
            if b and sum(k for k, _, _ in greedy_by_definition(a, b, min(3, len(b)))) >= 0.8 * len(b):
                want.append((i, j))
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want) and len(want) == 13 and (10, 10) in want
    left = {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert left == {20, 21, 22, 23}
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("words_shipped", [10, 10**6])
def test_contamination_by_each_text_of_an_id(spark, words_shipped):
    a, b, c = (" ".join(f"{k}{n}" for n in range(8)) for k in "abc")
    bench = spark.createDataFrame([(1, a), (1, b), (1, b), (None, c)], "item_id long, text string")
    docs = spark.createDataFrame([(10, a), (11, b), (12, c), (13, "clean")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench, words_shipped=words_shipped).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(10, 1), (11, 1), (12, None)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [13]


# --- pages


def test_blocks_of_broken_markup():
    page = (
        "<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><nav><ul><li><a href=x>A</a><li>B</ul></nav>"
        "<p class='a b'>one <b>bo</b>ld&amp;&eacute;&nbsp;x<br>two<p>three<script>var t='</p>';</script><div title=\"a>b\">four</div>5 < 6 </x></p>tail &am"
        "<a"
    )
    assert [b.text for b in html_text.blocks_of(page)] == ["A", "B", "one bold&é x two", "three", "four", "5 <  6".replace("  ", " "), "tail &am"]
    assert html_text.blocks_of(None) == [] and html_text.blocks_of("") == [] and html_text.blocks_of("<p></p><br>") == []
    assert [b.text for b in html_text.blocks_of("plain")] == ["plain"]
    for long in ("<" * 100_000, "<p " * 50_000, "<a b=" * 50_000, "<div>" * 3000 + "x", "&" * 100_000, "<!--" * 20_000, '<p a="' * 20_000):
        html_text.blocks_of(long)
    model = html_text.train_pages([])
    for deep in ("<div>a" * 8_000, "<div>" * 20_000, "<p><object>" + "<div>x" * 10_000, "<li>x" * 10_000):
        began = time.perf_counter()
        html_text.main_text(model, deep)
        assert time.perf_counter() - began < 1.5


def best_by_enumeration(model, x):
    """The labelling of greatest weight, over all."""
    e = model.emissions(x)
    weigh = lambda ys: model.first[ys[0]] + sum(e[n, y] for n, y in enumerate(ys)) + sum(model.moves[a, b] for a, b in zip(ys, ys[1:], strict=False))
    return max(itertools.product((0, 1), repeat=len(x)), key=weigh)


def test_main_text_is_the_best_labelling_and_reads_unseen_layouts(spark):
    """Decoding against all labellings on short pages; layouts that name no article, with blocks of each kind."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect()]
    model = html_text.train_pages(pages)
    prose = "The ferry left at nine, half an hour late, with the whole school on board and the band still playing."
    kept = {
        f"<body><div class='nav-bar'><a href=1>Start</a> <a href=2>Shop</a></div><div class='content'><p>{prose}</p><p>{prose[:40]}.</p></div><div class='footer'>© 2020 Press</div></body>": [prose, prose[:40] + "."],
        f"<body><section id=story><h2>Ferry leaves late</h2><p>{prose}</p></section><section class=comments><p>Nice one!</p></section></body>": ["Ferry leaves late", prose],
        f"<body><div id=cookie-consent>We use cookies.</div><main><p>{prose}</p><div class=advert>Buy boots</div><p>{prose}</p></main></body>": [prose, prose],
    }
    for page, want in kept.items():
        found = html_text.blocks_of(page)
        best = best_by_enumeration(model, html_text.features(found))
        assert html_text.main_text(model, page) == " ".join(b.text for b, y in zip(found, best, strict=True) if y) == " ".join(want)


def test_blocks_without_head_end_and_with_foreign_elements():
    texts = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert texts("<html><head><title>T</title><body><p>text") == ["text"]
    assert texts("<head><meta charset=x><title>T</title>\n<div>a</div><p>b") == ["a", "b"]
    assert texts("<head><title>T</title>plain <b>bold</b><p>b") == ["plain bold", "b"]
    assert texts("<head><title>T</title><script>x</script></head><p>b") == ["b"]
    assert texts('<p>a</p><svg class="i"/><p>b</p><svg><text>no</text></svg><p>c</p>') == ["a", "b", "c"]
    assert texts("<p>a</p><svg id=i/><text>no</text></svg><p>c</p>") == ["a", "c"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><object data=f><p>fallback</p></object>") == ["so x=2 holds", "fallback"]
    early, late = (html_text.features(html_text.blocks_of(f"<p>{t}</p>")) for t in ("1" * 200 + "a" * 600, "a" * 600 + "1" * 200))
    assert early[0, -5] == late[0, -5] == 0.25


def test_main_text_of_pages(spark):
    import html as lib

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.op7_html_text(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        inner = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1])
        want = " ".join(lib.unescape(re.sub("<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inner))).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_layouts_that_training_has_not_seen():
    model = html_text.train_pages([])
    page = """<html><body><header><p>The Daily Rain</p></header><nav><a href=/>Home</a> <a href=/w>World</a></nav>
    <div class="cookie-consent">We use cookies on this site.</div><main><h1>Bridge opens after nine years</h1>
    <p>The bridge over the lower river opened on Friday, nine years after it was first promised.</p>
    <div class="advert">Buy one umbrella, get one free.</div><p>Few came.</p>
    <p>Its cost had doubled twice, and the builder had changed three times along the way.</p></main>
    <section class="comments"><p>About time, I say, I have been waiting for this since my son was born.</p></section>
    <aside><p>Most read this week</p></aside><form><p>Sign up for our newsletter</p></form><footer>© The Daily Rain</footer></body></html>"""
    assert html_text.main_text(model, page) == (
        "Bridge opens after nine years The bridge over the lower river opened on Friday, nine years after it was first promised. "
        "Few came. Its cost had doubled twice, and the builder had changed three times along the way."
    )


def test_extraction_of_odd_and_empty_tables(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<article><p>kept</p></article>"), (3, "u", "<nav>Home</nav>"), (3, "u", "<nav>Home</nav>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract_main_text(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "kept", 4), (1, "", 0), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_fold_uses_crc32(spark):
    got = spark.range(50).select("id", fold_of("id", 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in got)
    assert spark.range(0).select(F.lit(1)).count() == 0


# --- whole chains, whole identifiers, bounded samples, linear time


def test_training_slopes_are_those_of_the_whole_chains():
    rng = np.random.default_rng(8)
    chains = [(rng.normal(size=(n, 3)), rng.integers(0, 2, n)) for n in (6, 5, 4, 3, 1)]
    params = [rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)]

    def loss(w, moves, first):
        total = 0.0
        for x, y in chains:
            e = x @ w
            of = lambda p: first[p[0]] + sum(e[i, p[i]] for i in range(len(p))) + sum(moves[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
            total += np.log(sum(np.exp(of(p)) for p in itertools.product((0, 1), repeat=len(x)))) - of(y.tolist())
        return total

    each = [crf._Batch(b, np.zeros(3), np.ones(3)).slopes(*params) for b in crf._batches(chains)]
    assert len(each) == 2
    for i, p in enumerate(params):
        for at in np.ndindex(p.shape):
            up, down = [q.copy() for q in params], [q.copy() for q in params]
            up[i][at] += 1e-5
            down[i][at] -= 1e-5
            assert sum(e[i][at] for e in each) == pytest.approx((loss(*up) - loss(*down)) / 2e-5, abs=1e-6)


def test_moves_late_in_a_chain_count():
    y = np.repeat([0, 1], [33, 31])
    model = crf.train([(np.ones((64, 1)), y)] * 20)
    assert model.moves[0, 1] > model.moves[1, 0] and model.first[0] > model.first[1] + 1


def test_identifiers_are_found_whole():
    for text, kind in (("bob [at] a.b.c.d.e.f.g.h", "email"), ("x" * 70 + " (at) mail (dot) example.org", "email"), ("555 010 7777 8888 9999 1111 2222", "card"), ("555-010-7777", "phone")):
        assert pii.unseen_spans(f"see {text}, or", []) == [(kind, 4, 4 + len(text))]
    assert pii.unseen_spans("call 555-010-7777 2nd floor", []) == [("phone", 5, 17)]
    assert pii.unseen_spans("bob [at] example.com. Then more. And", []) == [("email", 0, 20)]
    assert pii.unseen_spans("123456 and 1234567x", []) == []
    began = time.perf_counter()
    for text in ("1 " * 50_000 + "a", "a" * 100_000, "1" * 100_000 + "x", "a [at] " + "b." * 50_000, "(at)" * 25_000):
        pii.unseen_spans(text, [])
    assert time.perf_counter() - began < 3


def test_pattern_scores_by_plain_python(spark):
    rng = random.Random(11)
    edges = {(rng.choice(("email", "phone")), f"< a w{rng.randrange(6)}", rng.randrange(25)): (rng.random() < 0.4, rng.randint(1, 5)) for _ in range(120)}
    seeds = {(k, i) for (k, _, i), (seed, _) in edges.items() if seed}
    edges = {(k, p, i): ((k, i) in seeds, n) for (k, p, i), (_, n) in edges.items()}
    totals = {f"a w{k}": rng.randint(5, 80) for k in range(5)}
    rows = [(k, p, i, seed, n) for (k, p, i), (seed, n) in edges.items()]
    got = pii.score_patterns(
        spark.createDataFrame(rows, "kind string, pattern string, instance long, seed boolean, n long"),
        spark.createDataFrame(list(totals.items()), "pair string, total long"),
    )
    trust = {(k, i): float((k, i) in seeds) for k, _, i in edges}
    for _ in range(pii.ROUNDS):
        score, support = {}, {}
        for kind, pattern in {(k, p) for k, p, _ in edges}:
            mine = {i: n for (k, p, i), (_, n) in edges.items() if (k, p) == (kind, pattern)}
            support[kind, pattern] = sum(trust[kind, i] >= 0.5 for i in mine)
            share = sum(n * trust[kind, i] for i, n in mine.items()) / max(totals.get(pattern[2:], 0), sum(mine.values()))
            score[kind, pattern] = min(share, 0.999999) if support[kind, pattern] >= pii.MIN_SUPPORT else 0.0
        trust = {
            (kind, i): 1.0 if (kind, i) in seeds else 1 - math.prod(1 - score[k, p] for k, p, j in edges if (k, j) == (kind, i))
            for kind, i in trust
        }
    found = {(r.kind, r.pattern): (r.score, r.support) for r in got.collect()}
    assert found.keys() == score.keys() and any(0 < s < 0.999 for s in score.values())
    assert all(found[x][0] == pytest.approx(score[x], abs=1e-9) and found[x][1] == support[x] for x in score)


def test_a_hot_id_keeps_the_sample_at_its_bound(spark):
    rows = [(1, f"text {k % 50}") for k in range(400)] + [(k, "once") for k in range(2, 8)] + [(None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(k, 1 if k % 2 else 0) for k in range(1, 8)], "doc_id long, toxic int")
    take = lambda bound: labelled_sample(docs, marks, "toxic", F.lit(True), bound).collect()
    assert len(take(5)) == 5 and sorted(take(5)) == sorted(take(5))
    whole = take(1000)
    assert len(whole) == 56 and {r.y for r in whole if r.doc_id == 1} == {1}


def test_long_runs_of_signs_take_linear_time():
    for of in (lambda t: quality.line_features(t), lambda t: toxicity.fold_words(t)):
        for text in ("#" * 100_000 + "a", "1!" * 50_000, "1!" * 50_000 + "a", "!" * 100_000, "a" + "!1" * 50_000, "$a|" * 33_000):
            began = time.perf_counter()
            of(text)
            assert time.perf_counter() - began < 1
    line = 'go!! "why"## #a ## a# ?# b#c #'
    assert quality._TAILED.findall(line) == re.findall(r"[^\w\s.,;:?'’)\"]+(?=\s|$)", line)


def test_signs_that_begin_a_word_and_marks_on_letters_fold():
    assert toxicity.fold_words("$cum !diot @ss ïdïot | idiot! wow!1 12$34") == [w.replace("l", "i") for w in ("scum", "idiot", "ass", "idiot", "idiot", "wow", "1", "12", "34")]


def test_half_a_million_grams_are_broadcast(spark, monkeypatch):
    text = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz0-_/", k=500_000))
    df = spark.createDataFrame([(1, "http://a.com/" + text), (2, "http://b.net/es/" + text[:1000]), (3, "http://c.org/" + text[-1000:])], "page_id long, url string")
    shipped = []
    monkeypatch.setattr(url_filter.F, "broadcast", lambda table: shipped.append(table.count()) or table)
    one = sorted(url_filter.filter_urls(df).collect())
    assert len(shipped) == 1 and 400_000 < shipped[0] <= url_filter.BROADCAST_GRAMS
    monkeypatch.undo()
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 1000)
    assert sorted(url_filter.filter_urls(df).collect()) == one
