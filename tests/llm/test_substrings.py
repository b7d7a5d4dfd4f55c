import hashlib
import random

import pytest

from lexspark.llm.substrings import RepeatedPassages

from .conftest import ODD


def plain(rows, window):
    """(doc_id, n_words, n_removed, kept_sha256) by comparing every window."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in texts:
        if i is not None:
            for j in range(len(words) - window + 1):
                key = tuple(words[j:j + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for j in range(len(words) - window + 1):
            if i is not None and first[tuple(words[j:j + window])] < i:
                gone |= set(range(j, j + window))
        kept = [w for j, w in enumerate(words) if j not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "seed", "letters"), [(8, 3, "ab"), (8, 8, "abcd"), (6, 1, "abcdefgh"), (5, 2, "a")])
def test_against_every_window(documents, table, window, seed, letters):
    rng = random.Random(window + seed)
    words = lambda n: [rng.choice(letters) + rng.choice(letters) for _ in range(n)]
    shared = [words(rng.randint(4, 25)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [words(rng.randint(0, 9)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    rows += [(rows[3][0] + 1, rows[3][1]), (rows[5][0] - 1, rows[5][1])]
    found = RepeatedPassages(documents(rows, extra=True), window, seed)
    assert table(found.remaining()) == plain(rows, window)


def test_spans_hold_word_for_word(documents, table):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(70)
    rows = [(4, " ".join(words(30) + passage + words(5))), (9, " ".join(words(11) + passage[3:] + words(40) + passage[:60])),
            (12, " ".join(passage))]
    texts = {i: t.split() for i, t in rows}
    spans = table(RepeatedPassages(documents(rows), 50).spans())
    assert {(d, a, b) for d, a, b, *_ in spans} == {(9, 11, 78), (9, 118, 178), (12, 0, 70)}
    for doc, a, b, source, at in spans:
        assert source < doc and texts[doc][a:b] == texts[source][at:at + b - a]


def test_odd_rows(documents, table):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [*ODD, (20, long), (21, long), (21, long), (None, long), (22, long.replace(" ", "\u00a0 "))]
    assert table(RepeatedPassages(documents(rows)).remaining()) == plain(rows, 50)
    assert table(RepeatedPassages(documents([])).remaining()) == []
    with pytest.raises(ValueError):
        RepeatedPassages(documents([]), 5, 6)
