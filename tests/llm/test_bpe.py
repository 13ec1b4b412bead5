"""Encoding by speculation against the tokenizers library, token by token."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logvigil.llm import bpe
from logvigil.llm.queries import QUERIES, tokenizer_file

ODD = ["", " ", "\n\n", "<|endoftext|>", "a<|startoftext|>b", "<|endoftext|><|endoftext|>", "<|END", "don't we'll 's ''re", "aaa" * 30, "x" * 5000,
       "ab" * 400, "Σας ΣΣ", "İstanbul", "naïve café", "日本語テキスト", "1234 ½ ⅷ", "...!!!", "’s", "\x00a\x1cb", "a\tb\r\nc", "ͅ", "ﬁ",
       "👍🏽 ok", "h�", "the quick brown fox", "THE QUICK", "ẹ́ Å"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(tokenizer_file())


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_odd_texts(own, library):
    for text, raw in zip(ODD, own.encode(ODD)):
        assert ids(raw) == library.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_tables_agree_below_the_safe_bound(own, library):
    characters = [chr(c) for c in range(bpe.SAFE)]
    for text in [f"a{c}1{c}.{c}" for c in characters] + ["".join(random.Random(c).choices(characters, k=40)) for c in range(300)]:
        assert ids(own.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abetin'sAÉß.,! \n\t1大<|", max_size=40), max_size=8))
def test_random_texts(texts):
    encoder, library = bpe.encoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    assert [ids(r) for r in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_check_of_pairs_is_exact(own):
    """Every token that merges into itself is proposable, and a pair is compatible just where merging keeps it."""
    model, rng = own.bpe, random.Random(5)
    table = {v: k for k, v in model.byte_of.items()}
    assert len(table) == 256
    spelled = {}
    for token in rng.sample(range(512, model.size - 2), 3000):
        word = model.surface[token]
        symbols = [model.byte_of[c] for c in word.removesuffix("</w>")]
        if word.endswith("</w>"):
            symbols[-1] += bpe.END
        spelled[token] = symbols
        at = 0
        for s in symbols:
            at = model.nodes.get((at, s), -1) if at >= 0 else -1
        assert (at >= 0 and model.ends[at] == token) == (model.merge(symbols) == [token])
    inner = [t for t in spelled if not model.surface[t].endswith("</w>") and model.merge(spelled[t]) == [t]]
    last = [t for t in spelled if model.merge(spelled[t]) == [t]]
    pairs = [(rng.choice(inner), rng.choice(last)) for _ in range(3000)]
    kept = model.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), ok in zip(pairs, kept.tolist()):
        assert ok == (model.merge(spelled[a] + spelled[b]) == [a, b])


def test_forgetting_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    small, rng = bpe.Encoder(tokenizer_file()), random.Random(3)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("aeinrst", k=rng.randrange(1, 5))) for _ in range(rng.randrange(30))) for _ in range(5)]
        assert [ids(r) for r in small.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(small.young) <= 21 and len(small.old) <= 21


def test_rows(spark, library):
    rows = [(1, "Hello World", "x"), (1, "Hello World", "x"), (None, None, "y"), (2, "", "z"), (3, "word " * 200_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, tokenizer_file()), tokenizer_file()).collect()
    assert len(out) == 5
    for row in out:
        text = {1: "Hello World", 3: "word " * 200_000}.get(row.doc_id, "")
        expected = library.encode(text, add_special_tokens=False).ids
        assert (row.n_tokens, ids(row.ids), row.text) == (len(expected), expected, library.decode(expected, skip_special_tokens=False))
    assert bpe.encode(docs.limit(0), tokenizer_file()).count() == 0


def test_query(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op12_speculative_bpe"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        expected = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        decoded = library.decode(expected, skip_special_tokens=False)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (
            len(expected), hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
