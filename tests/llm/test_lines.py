import random

import pytest

from lexspark.llm import lines

from .conftest import ODD


def plain(rows, run):
    first, out = {}, []
    split = [(i, t, [x.strip(" \t\v\f\r") for x in t.split("\n")] if t is not None else []) for i, t in rows]
    for i, _, keys in split:
        for k in range(len(keys) - run + 1):
            window = tuple(keys[k:k + run])
            if any(window) and i is not None:
                first[window] = min(first.get(window, (i, k)), (i, k))
    for i, text, keys in split:
        gone = set()
        for k in range(len(keys) - run + 1):
            if i is not None and first.get(tuple(keys[k:k + run]), (i, k)) < (i, k):
                gone |= set(range(k, k + run))
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        out.append((i, kept, len(keys), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_against_every_run(documents, table, run):
    rng = random.Random(run)
    shared = [[f"line {rng.randrange(40)}" if rng.random() < 0.9 else "  " for _ in range(rng.randint(1, 12))] for _ in range(5)]
    rows = []
    for i in range(70):
        parts = [rng.choice(shared) if rng.random() < 0.5 else [f"own {rng.randrange(10**6)} "] * rng.randint(0, 3) for _ in range(rng.randint(0, 5))]
        rows.append((i * 7 % 71, "\n".join(x + rng.choice(["", " ", "\r"]) for p in parts for x in p)))
    done = lines.without_repeats(documents(rows, extra=True), run)
    assert table(done, "doc_id", "text", "_lines", "_removed") == plain(rows, run)


def test_odd_rows(documents, table):
    block = "\n".join(f"line {i}" for i in range(4))
    rows = [*ODD, (10, block), (11, block), (11, block), (None, block), (12, "\n\n\n\n"), (13, "\n\n\n\n"), (14, block + "\n" + block)]
    assert table(lines.without_repeats(documents(rows)), "doc_id", "text", "_lines", "_removed") == plain(rows, 3)
    assert table(lines.without_repeats(documents([]))) == []
    assert lines.without_repeats(documents(rows, extra=True)).columns == [*documents(rows, extra=True).columns, "_lines", "_removed"]
