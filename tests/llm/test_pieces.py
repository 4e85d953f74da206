"""Encoding against the model's own encoder, and decoding against the text."""
import os
import random

import pytest

from lodestone.llm import pieces

TEXTS = ["Hello world, the  cat\n\nsat", "", None, " ", "\n", "été naïve ▁ mark ☃ \U0001f600", "x" * 300, "é" * 100, "a\tb", "the the the"]
WORDS = ["und", "der", "international", "x", "  ", "   ", "\n", "été", "日本語の文章", "=" * 90, "ab12", "Straße", "\t", "☃", "don't", "a" * 130, " " * 37, "\U0001f600"]


@pytest.fixture(scope="module")
def model():
    if not os.path.exists(pieces.MODEL):
        pytest.skip("no model file")
    return pieces.load()


def own(text):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text)


def mixture(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", "", "  "]) for _ in range(n))


def test_lattice_of_words(spark, model):
    units = ["the", "thing", "ness", "☃x", "internationalisation", "a", "und", "x" * 40, "日本語", "don't", " thing", "   thing", *[" " * n for n in range(40)], " " * 15 + "☃", " " * 20 + "die"]
    got = {r.word: list(r.ids) for r in pieces.lattice(spark.createDataFrame([(" " + w,) for w in units], "word string"), model).collect()}
    for w in units:
        assert got[" " + w] == own(w) or not w, w


def test_round_trip(spark, model):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, " "), (None, "a b")], "doc_id long, text string")
    encoded = pieces.encode_documents(docs)
    out = {r.doc_id: r for r in encoded.collect()}
    assert all(r.round_trip for r in out.values()) and len(out) == len(TEXTS) + 1 and encoded.count() == len(TEXTS) + 2
    assert out[1].n_tokens == out[2].n_tokens == 0 and list(out[9].ids) == 3 * list(out[9].ids[: out[9].n_tokens // 3])
    back = {r.doc_id: r.text for r in pieces.decode_documents(encoded).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert pieces.encode_documents(docs.limit(0)).count() == 0


def test_clashing_names(spark, model):
    docs = spark.createDataFrame([(1, "und", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, n_tokens int, ids string")
    assert sorted((r.doc_id, r.n_tokens) for r in pieces.encode_documents(docs).collect()) == [(1, 1), (2, 0)]


def test_ids_are_the_models_own(spark, model):
    rng = random.Random(3)
    texts = [t for t in TEXTS if t and "▁" not in t] + ["  two   spaces" + " " * 40 + "end ", "日本語の文章を切る" * 30]
    texts += ["".join(rng.choice("abcdefghijklmnop") for _ in range(20_000)), "ab" * 30_000, "word " * 30_000, "international" * 10, "abc" * 60]
    texts += [mixture(rng, 60) for _ in range(30)] + ["".join(rng.choice(model.texts) for _ in range(40)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in pieces.encode_documents(docs).collect()}
    assert got == {i: own(t) for i, t in enumerate(texts)}


def test_words_are_remembered(model, monkeypatch):
    import pyarrow as pa

    from lodestone.llm import common

    monkeypatch.setattr(pieces, "KNOWN", 50)
    coder, rng = pieces.Lattice(pieces.packed(model)), random.Random(4)
    for _ in range(20):
        text = mixture(rng, 30)
        raw, off = common.utf8(pa.array([text]))
        buf, bounds = pieces.marked(raw, off)
        starts, ends, _ = pieces.units_of(buf, bounds)
        assert coder.all(buf, starts, ends)[0].tolist() == own(text)


def test_broken_utf8(model):
    coder = pieces.Lattice(pieces.packed(model))
    buf = b" ab\xff\x80cd \xc3"
    import numpy as np

    ids, n = coder.encode(buf, np.array([0, 7, 9]))
    assert pieces.decoded(ids, coder.raw, coder.offsets).tobytes() == buf and n.sum() == len(ids)
