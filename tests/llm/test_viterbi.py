import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from lexspark.llm import viterbi
from lexspark.llm.queries import QUERIES

from .conftest import ODD, SMALL


@pytest.fixture(scope="module")
def reference():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    tokenizer = Tokenizer(Unigram(pieces, unk_id=0, byte_fallback=True))
    return lambda text: len(tokenizer.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def test_query(spark, small, table, reference):
    assert table(QUERIES["op3_token_counts"](spark, SMALL)) == sorted(((i, len(t), reference(t)) for i, t in small), key=repr)


def test_ties_and_unknown_characters(documents, table, reference):
    texts = [(i, t) for i, t in enumerate(["aaaaaaaaaaaaaaaa", "  two  spaces ", "中文 \U0001f600\U0001f600 x", "é́\u0000", "\n\n", "   ", "▁▁a", "abababab cdcdcd"])]
    assert table(viterbi.report(documents(texts, extra=True)), "doc_id", "n_tokens") == [(i, reference(t)) for i, t in texts]


def test_small_vocabulary_by_brute_force():
    pieces = {"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0}
    counter = viterbi.UnigramCounter(list(pieces.items()), -10.0)

    def best(text):
        found = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = []
            for start in range(end):
                if text[start:end] in pieces:
                    options.append((found[start][0] + pieces[text[start:end]], found[start][1] + 1))
            if text[end - 1] not in pieces:
                options.append((found[end - 1][0] - 10.0, found[end - 1][1] + len(text[end - 1].encode())))
            found.append(max(options, key=lambda o: o[0]))
        return found[-1]

    for text in ("abab", "babab", "aabbaa", "abcab", "ccc", "é", "abaabaaba"):
        assert counter.count(text) == best(text)
    with pytest.raises(ValueError):
        viterbi.UnigramCounter([("a▁b", -1.0)], -10.0)


def test_odd_rows(documents, table):
    got = table(viterbi.report(documents(ODD)), "doc_id", "n_tokens")
    assert (1, 0) in got and (2, 0) in got and got.count((5, 1)) == 2 and len(got) == len(ODD)
    assert table(viterbi.report(documents([]))) == []
