import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ondula.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
PARTS = ["<|endoftext|>", "it's", "we'll", " ", "  ", "\n", "\r\n", "\t", "a1", "12ab", "!!'s", "don't", "x<|endo", "ftext|>", "é", " ", "　", "日本、語。", "​", "'", "S", "9", "?!", "️", "﻿"]
TEXTS = ["", " ", "  lead", "trail  ", "a<|endoftext|>b <|endoftext|> c", "word " * 9000, "日本語、日本語。" * 4000, "x" * 40000, "a1" * 20000, "<|endoftext|>" * 4000, "é" * 30000,
         " \n\t" * 9000, "'s" * 20000]


def whole(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=30).map("".join), st.integers(1, 6))
def test_pieces_have_the_tokens_of_the_whole(text, size):
    parts = list(tokens.pieces(text, ("<|endoftext|>",), size))
    assert "".join(parts) == text
    assert sum(map(whole, parts)) == whole(text)


def test_long_texts_are_split():
    assert len(list(tokens.pieces("word " * 90000))) > 20
    assert len(list(tokens.pieces("日本語、日本語。" * 40000))) > 15


def test_counts(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, TEXTS[4]])] + [(None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = tokens.token_counts(docs, PATH, 1024)
    assert got.columns == ["doc_id", "text", "n_tokens", "n_bytes", "over_limit"]
    for r in got.collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), whole(r.text), whole(r.text) > 1024)
    assert tokens.token_counts(docs.where("false"), PATH, 1).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"])
def test_other_vocabularies(spark, name):
    texts = [t for t in TEXTS if len(t) < 50000] + ["Some <s> Words</s>, UPPER <|endoftext|>"]
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        own = SentencePieceProcessor(model_file=path)
        want = [len(own.encode(t)) for t in texts]
    elif name.endswith(".json"):
        own = Tokenizer.from_file(path)
        want = [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    else:
        plain = Tokenizer.from_file(PATH)
        plain.encode_special_tokens = True
        want = [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path, 10).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_unknown_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text("x")
    with pytest.raises(ValueError):
        tokens.encoder("v.txt", b"x")
