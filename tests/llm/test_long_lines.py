import random

from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import lines

from .test_lines import plain


def plain_words(rows, run, words):
    """Like plain(), with runs of fewer lines that have enough words."""
    split = [(i, t, [x.strip(" \t\v\f\r") for x in t.split("\n")]) for i, t in rows]
    able = lambda w, n: any(w) and (n == run or sum(len(x.split()) for x in w) >= words)
    first, out = {}, []
    for i, _, keys in split:
        for n in range(1, run + 1):
            for k in range(len(keys) - n + 1):
                window = tuple(keys[k:k + n])
                first[window] = min(first.get(window, (i, k)), (i, k))
    for i, text, keys in split:
        gone = set()
        for n in range(1, run + 1):
            for k in range(len(keys) - n + 1):
                window = tuple(keys[k:k + n])
                if able(window, n) and first[window] < (i, k):
                    gone |= set(range(k, k + n))
        out.append((i, "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone), len(keys), len(gone)))
    return sorted(out, key=repr)


def test_long_lines_in_otherwise_different_documents(spark, documents, table):
    rng = random.Random(8)
    passages = [[" ".join(f"p{p}l{k}w{w}" for w in range(rng.choice((3, 8, 14, 15, 40)))) for k in range(n)] for p, n in enumerate((1, 1, 1, 2, 2, 2, 3, 4))]
    rows = []
    for i in range(90):
        parts = [[f"own {rng.randrange(10**6)}"] * rng.randint(0, 2), rng.choice(passages), [f"own {rng.randrange(10**6)} "], rng.choice(passages)]
        rows.append((i * 7 % 97, "\n".join(x for p in parts for x in p)))
    rows += [(200, passages[7][0]), (201, "\n\n")]
    done = table(lines.without_repeats(documents(rows), 3, 15), "doc_id", "text", "_lines", "_removed")
    assert done == plain_words(rows, 3, 15) != plain(rows, 3)
    assert table(lines.without_repeats(documents(rows), 3), "doc_id", "text", "_lines", "_removed") == plain(rows, 3)

    line = " ".join(f"licence{k}" for k in range(20))
    docs = documents([(i, f"first {i}\n{line}\nlast {i}") for i in range(5)]).withColumn("n_chars", F.length("text").cast("long"))
    left = table(corpus_pipeline.line_dedup(spark, docs, ""), "doc_id", "text")
    assert left == [(0, f"first 0\n{line}\nlast 0"), *((i, f"first {i}\nlast {i}") for i in range(1, 5))]
