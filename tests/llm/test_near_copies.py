import random

import pytest

from lexspark.llm import near_copies


def shingles(text, width=5):
    words = text.lower().split()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain(rows, similarity=0.8):
    sets, root = [shingles(t or "") for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


def changed(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return words


def test_chains_and_groups_against_all_pairs(documents, table):
    rng, rows = random.Random(4), []
    for g in range(12):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((6, 40, 200)))]
        for _ in range(12):
            rows.append((len(rows) * 11 % 151, " ".join(changed(rng, rng.choice((text, rows[-1][1].split() if rows and rng.random() < 0.3 else text)), rng.choice((0, 1, 2, 4)) if len(text) > 9 else rng.choice((0, 1))))))
    rows += [(200, "A  b c"), (201, "a b\nC"), (202, ""), (203, None), (204, "a b d")]
    kept = sorted(x for x, in table(near_copies.one_of_each(documents(rows, extra=True)), "doc_id"))
    assert kept == plain(rows) and len(kept) < len(rows) - 30


@pytest.mark.parametrize("similarity, least", [(0.8, 0.98), (0.9, 1.0), (0.95, 1.0)])
def test_recall_of_single_pairs(documents, table, similarity, least):
    rng, rows, pairs = random.Random(int(similarity * 100)), [], 0
    for g in range(300):
        text = [f"g{g}x{k}" for k in range(200)]
        copy = text
        while True:  # as many changes as the similarity bears
            further = changed(rng, copy, 1)
            a, b = shingles(" ".join(text)), shingles(" ".join(further))
            if len(a & b) < similarity * len(a | b):
                break
            copy = further
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(copy))]
    rows += [(1000, " ".join(f"y{k}" for k in range(50))), (1001, " ".join(f"y{k}" if k < 35 else f"z{k}" for k in range(50)))]
    kept = {x for x, in table(near_copies.one_of_each(documents(rows)), "doc_id")}
    gone = sum(2 * g + 1 not in kept for g in range(300))
    assert gone >= least * 300 and {1000, 1001} <= kept and all(2 * g in kept for g in range(300))


def test_rows_of_one_id_and_none(documents, table):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(3, text), (2, text + " more"), (5, "own"), (5, text), (None, text), (9, "other words are here now")]
    assert {x for x, in table(near_copies.one_of_each(documents(rows)), "doc_id")} == {2, 9, None}
    assert near_copies.one_of_each(documents([])).count() == 0
