import os

import pytest

from annalist.llm import tokenize

pytestmark = pytest.mark.skipif(not os.path.exists(tokenize.vocabulary_path()), reason="no vocabulary files")

TEXTS = ["it's  we'll\n\n x  ", "<|endoftext|> hi", "   ", " \n \t a", None, "", "a\xa0b c\x85", "don’t I'M 1234 שלום עולם!", "the " * 20_000, "é 👩‍👩‍👦", "a\x1cb\x1f c"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "w", [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, word string, ids array<int>").repartition(3)


def test_equals_the_library(spark):
    import tiktoken
    from tokenizers import Tokenizer

    got = {r.doc_id: r.ids for r in tokenize.encode(frame(spark), "doc_id", "text").collect()}
    t = Tokenizer.from_file(os.path.join(tokenize.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert tiktoken is not None


def test_round_trip_and_counts(spark):
    e = tokenize.encode(frame(spark), "doc_id", "text")
    back = {r.doc_id: r.text for r in tokenize.decode(e, "doc_id", spark).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}
    n = {r.doc_id: r.tokens for r in tokenize.token_counts(frame(spark), "doc_id", "text").collect()}
    assert n == {r.doc_id: len(r.ids) for r in e.collect()}


def test_nothing(spark):
    assert tokenize.encode(frame(spark, []), "doc_id", "text").collect() == []
