from pyspark.sql import functions as F

import corpus_pipeline
from ampledger.llm import bpe, common, decontaminate, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_stage_by_stage_against_brute_force(spark):
    """Each stage's keeps, worked out from the stage before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    (_, tox), (_, exact), (_, near), (_, decon), (_, enc) = corpus_pipeline.STAGES
    texts = lambda df: {r.doc_id: r.text or "" for r in df.collect()}
    before = texts(docs)
    kept = common.cut(tox(spark, docs, SF), "t")
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if r.score >= 0.7}
    assert bad and texts(kept) == {i: t for i, t in before.items() if i not in bad} and kept.columns == docs.columns
    now = texts(kept)
    kept = common.cut(exact(spark, kept, SF), "t")
    last = {}
    for i, t in now.items():
        last[t] = max(i, last.get(t, i))
    assert texts(kept) == {i: t for i, t in now.items() if last[t] == i} and kept.columns == docs.columns
    now = texts(kept)
    kept = common.cut(near(spark, kept, SF), "t")
    fps = {i: simhash.fingerprint(t) for i, t in now.items()}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and root[b] > root[a]:
                    root[b], changed = root[a], True
    assert texts(kept) == {i: t for i, t in now.items() if root[i] == i}
    now = texts(kept)
    kept = common.cut(decon(spark, kept, SF), "t")
    items = [decontaminate.words_of(r.text) for r in bench.collect()]

    def dirty(text):
        words = decontaminate.words_of(text)
        return any(b and sum(t[0] for t in decontaminate.tiles(words, b, min(3, len(b)))) >= 0.8 * len(b) for b in items)

    assert texts(kept) == {i: t for i, t in now.items() if not dirty(t)}
    own = bpe.WordBpe(bpe.tokenizer_path())
    got = {r.doc_id: r.n_tokens for r in enc(spark, kept, SF).collect()}
    assert got == {i: len(own.encode(t)) for i, t in texts(kept).items()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == got


def test_pipeline_on_an_empty_table_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    twice = docs.limit(20).unionByName(docs.limit(20))
    for name, stage in corpus_pipeline.STAGES[:4]:
        twice = common.cut(stage(spark, twice, SF), name)
    ids = [r.doc_id for r in twice.collect()]
    assert len(ids) == len(set(ids))


def test_stages_keep_columns_whose_names_they_use_themselves(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ("fp", "variant", "kept", "_id", "_variant", "score", "row_id", "digest", "n", "least", "root", "item_id")
    more = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:4]:
        plain, named = common.cut(stage(spark, docs, SF), name), common.cut(stage(spark, more, SF), name)
        assert named.columns == more.columns and named.where(" or ".join(f"`{n}` <> 'own {n}'" for n in names)).count() == 0
        assert named.select(docs.columns).exceptAll(plain).count() == 0 and named.count() == plain.count()
        docs, more = plain, named


def _named(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())


def test_stages_judge_rows_of_null_and_repeated_ids_one_by_one(spark):
    """Ids 5 and null stand for several texts; only the text that a stage rejects goes."""
    schema = "doc_id long, text string"
    a, b, c = (" ".join(f"{k}{n}" for n in range(60)) for k in "abc")
    near = lambda t: t.upper()  # noqa: E731  # the same fingerprint
    rows = [(5, a), (7, near(a)), (3, b), (5, near(b)), (None, near(b) + " "), (None, c), (None, c + "  ")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, schema))
    got = _named(kept)
    assert got[:2] == [(False, 3, b), (False, 5, a)] and len(got) == 3 and got[2][2].strip() == c

    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    rows = [(i, t) for i in (5, None) for t in ("see one two three four five six seven eight", "clean text", "", None)]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, schema), items)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in rows if not (t or "").startswith("see"))

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if r.score >= 0.7}
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic, clean = texts[min(bad)], texts[min(set(texts) - bad)]
    extra = [(min(bad), clean), (None, clean), (None, toxic)]
    # the labels are of the former ids alone, so that the fit stays as it was
    kept = toxicity.ToxicityModel.rejected(toxicity.fit_toxicity(docs, labels, toxicity.fold_of("doc_id", 3) != 1), spark.createDataFrame(extra, schema))
    assert [(r.doc_id) for r in kept.collect()] == [None]
    kept = toxicity.drop_toxic(docs.unionByName(spark.createDataFrame(extra[1:], schema)), labels)
    assert [r.text for r in kept.collect() if r.doc_id is None] == [clean]
