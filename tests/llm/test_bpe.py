import hashlib
import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ampledger.llm import bpe
from ampledger.llm.bpe import CACHE_CHARS, WordBpe, encode_documents, op3_bpe, tokenizer_path
from ampledger.llm.token_counts import encoded_lengths, length_table, quantiles, totals_at

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "Hello WORLD", "don't we'll I'VE", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ǅ ﬁ", "é é Å ①②½", "日本語 テスト", "👩‍👩‍👧 🎉!!",
    "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|end", "x\x00y\x1cz\x85w​q r", "1234567890 3.14 ٣",
    "ééèèêêçç ßß", "a" * 3000, "ab" * 700 + "!" * 900, "Ça c'est l'été d'S", "…—“quoted”", "﻿bom",
]


def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_encode_and_decode_equal_the_library(spark):
    t, own, rnd = library(), WordBpe(tokenizer_path()), random.Random(1)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    chars = [c for c in map(chr, [*range(32, 1500), *range(0x2000, 0x3100)]) if unicodedata.category(c) != "Cn"]
    texts += ["".join(rnd.choices(chars, k=200)) for _ in range(60)]
    for text in texts:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text) == want, repr(text)[:80]
        assert own.decode(want) == t.decode(want, skip_special_tokens=False)


def test_every_code_point_equals_the_library():
    t, own = library(), WordBpe(tokenizer_path())
    points = [chr(c) for c in (*range(1, 0x40000), *range(0x40000, 0x110000, 61)) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20_000):
        texts = [f"a{c}1{c}!{c}" for c in points[k : k + 20_000]]
        for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.encode(text) == want.ids, ascii(text)


def test_combining_marks_equal_the_library():
    t, own, rnd = library(), WordBpe(tokenizer_path()), random.Random(3)
    marks = [c for c in map(chr, range(0x300, 0x20000)) if unicodedata.category(c)[0] == "M"]
    texts = [f"e{a}{b}{a}" for a in marks for b in "\u0301\u0323\u0345\u3099\u094d\u0334"]
    texts += [f"e{b}{a}x" for a in marks for b in "\u0301\u0323\u0345\u3099\u094d\u0334"]
    composed = [unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x30000) if unicodedata.decomposition(chr(c)) and not 0xD800 <= c < 0xE000]
    texts += [f"{c}\u0323{rnd.choice(marks)}" for c in composed]
    every = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rnd.choices(every, k=30) + rnd.choices(marks, k=20)) for _ in range(3000)]
    texts += ["".join(rnd.sample(rnd.choices(every, k=6) + rnd.choices(marks, k=20), 26)) for _ in range(3000)]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == want.ids, ascii(text)


def test_cuts_are_forced_and_lose_nothing():
    own = WordBpe(tokenizer_path())
    word = "".join(own.symbols[b] for b in "éèçêthéing".encode())
    pieces = own.fragments_of(word)
    assert "".join(pieces) == word and len(pieces) > 1
    assert not any(a[-1] + b[0] in t for a, b in zip(pieces, pieces[1:], strict=False) for t in own.vocab)


def test_query_digests(spark):
    t = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op3_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_documents_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "the", 5), (3, "the the", 5), (3, "the the", 5)], "doc_id long, text string, ids int")
    got = encode_documents(df, tokenizer_path()).collect()
    assert sorted(((r.doc_id or 0), len(r.ids)) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert encode_documents(df.limit(0), tokenizer_path()).count() == 0


def test_length_table_against_brute_force(spark):
    rnd = random.Random(2)
    lengths = [rnd.choice([0, 1, 2, 5, 4095, 4096, 4097, 9000, 20_000]) for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in lengths] + [(None,)], "length long")
    lengths.append(0)
    got = {r.context_limit: r for r in length_table(df).collect()}
    assert set(got) == set(lengths)
    for c, r in got.items():
        assert r.n_docs == lengths.count(c) and r.docs_over == sum(n > c for n in lengths)
        assert r.docs_within == sum(n <= c for n in lengths) and r.tokens_within == sum(n for n in lengths if n <= c)
        assert r.tokens_over == sum(n for n in lengths if n > c) and r.tokens_kept == sum(min(n, c) for n in lengths)
        assert r.tokens_lost == sum(max(0, n - c) for n in lengths)
    for r in quantiles(length_table(df), [0.0, 0.5, 0.9, 1.0]).collect():
        assert r.length == min(c for c in lengths if sum(n <= c for n in lengths) >= r.share * len(lengths))
    limits = [0, 3, 4096, 9001, 20_000, 10**9]
    for r in totals_at(length_table(df), limits).collect():
        c = r.context_limit
        assert (r.docs_within, r.docs_over) == (sum(n <= c for n in lengths), sum(n > c for n in lengths))
        assert (r.tokens_kept, r.tokens_lost) == (sum(min(n, c) for n in lengths), sum(max(0, n - c) for n in lengths))
    none = length_table(df.limit(0))
    assert none.count() == 0 and quantiles(none, [0.5]).first().length is None and totals_at(none, [7]).first().tokens_kept == 0
    many = spark.createDataFrame([(1, 10**12 - 1), (2, 1)], "context_limit long, docs_within long").withColumn("docs_over", 10**12 - F.col("docs_within"))
    many = many.withColumn("docs_within", F.when(F.col("context_limit") == 2, 10**12).otherwise(F.col("docs_within"))).withColumn("docs_over", 10**12 - F.col("docs_within"))
    assert [r.length for r in quantiles(many, ["0.999999999999", "0.9999999999995"]).collect()] == [1, 2]


def test_encoded_lengths(spark):
    t = library()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.length for r in encoded_lengths(docs, tokenizer_path()).collect()} == want
    odd = spark.createDataFrame([(1, None, 9), (2, "the the", 9), (2, "the the", 9), (None, "", 9)], "doc_id long, text string, length int")
    assert sorted((r.doc_id or 0, r.length) for r in encoded_lengths(odd, tokenizer_path()).collect()) == [(0, 0), (1, 0), (2, 2), (2, 2)]


def test_long_words_are_not_kept():
    own, t = WordBpe(tokenizer_path()), library()
    text = "short " + "ab1-" * 5_000 + " " + "xyz" * 3_000 + " short again"
    assert own.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert own.cache and all(len(w) <= CACHE_CHARS for w in own.cache) and all(len(k[0]) <= CACHE_CHARS for k in own.fragments)


def test_counts_are_those_of_the_ids(monkeypatch):
    monkeypatch.setattr(bpe, "COUNT_WORDS", 40)
    coder, rng = bpe.WordBpe(bpe.tokenizer_path()), random.Random(7)
    words = ["".join(rng.choice("abcéß中9'_") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts = [None, "", "<|endoftext|>", "a<|endoftext|>b a b", "x" * 90, *(" ".join(rng.choices(words, k=60)) for _ in range(40))]
    assert [coder.count(t) for t in texts] == [len(coder.encode(t)) for t in texts]
    assert 0 < len(coder.counts) <= 40 and len(coder.older) == 40
