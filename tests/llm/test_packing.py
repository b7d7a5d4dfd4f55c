import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexspark.llm import packing
from lexspark.llm.queries import QUERIES
from lexspark.llm.vocabularies import byte_bpe, encoded_with_specials, special_tokens

from .conftest import ODD, SMALL


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked(rows, texts, tokenizer, size):
    """Every piece stands once, with the right ids, and sequences are gapless and not too long."""
    bins, pieces = defaultdict(list), defaultdict(list)
    for doc, piece, start, length, crc, sequence, offset in rows:
        bins[sequence].append((offset, length))
        pieces[doc].append((piece, start, length, crc))
    for doc, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces.pop(doc))):
            assert (piece, start) == (k, at) and crc == zlib.crc32(ids[at:at + length].tobytes())
            assert length == size or k == 0
            at += length
        assert at == len(ids)
    assert not pieces
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_query(spark, small, table, tokenizer):
    rows = table(QUERIES["op4_best_fit_packing"](spark, SMALL))
    used = checked(rows, small, tokenizer, 2048)
    assert used <= -(-sum(r[3] for r in rows) // 2048) + 1


def test_tree_of_many_leaves(documents, table, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "LEAF_PIECES", 60)
    texts = [(i, "word " * (i * 37 % 90)) for i in range(900)]
    rows = table(packing.sequences(documents(texts, extra=True), 64))
    used = checked(rows, texts, tokenizer, 64)
    at_once = packing.best_fit(sorted((r[3] for r in rows), reverse=True), 64)
    assert used <= 1.02 * len(at_once)


def test_odd_rows(documents, table):
    rows = table(packing.sequences(documents(ODD), 2048))
    assert sum(r[3] for r in rows if r[0] == 1) == 1 and sum(r[0] == 5 for r in rows) == 2
    assert any(r[0] is None for r in rows) and len({r[5] for r in rows if r[0] == 7}) > 1
    assert table(packing.sequences(documents([]))) == []


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit(fills):
    fills.sort(reverse=True)
    bins = packing.best_fit(fills, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(fills)))
    sizes = [sum(fills[i] for i in b) for b in bins]
    assert all(s <= 50 for s in sizes) and sum(2 * s <= 50 for s in sizes) <= 1


def test_long_texts_are_cut_safely(tokenizer):
    text = "Some words, and  more\n\n words é   x 123's <|endoftext|> " * 6000
    assert encoded_with_specials(byte_bpe(), text, special_tokens()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_token_as_the_json_tokenizer(spark, documents, tokenizer, table):
    texts = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>x"), (3, "no special <|endoftext| here")]
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rows = table(packing.sequences(documents(texts), size=2048))
    checked(rows, texts, tokenizer, 2048)
