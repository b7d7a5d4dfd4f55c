import random

import xxhash
from pyspark.sql import functions as F

from lexspark.llm import simhash
from lexspark.llm.components import components
from lexspark.llm.queries import QUERIES

from .conftest import ODD, SMALL


def plain_fingerprint(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(prints, ids, distance=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    best = {}
    for i, x in enumerate(ids):
        if x is not None:
            best[find(i)] = min(best.get(find(i), x), x)
    return [best.get(find(i)) for i in range(len(prints))]


def test_query_against_all_pairs(spark, small, table):
    got = table(QUERIES["op5_simhash"](spark, SMALL))
    prints = [plain_fingerprint(t, 3) for _, t in small]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(small, prints, plain_components(prints, [i for i, _ in small]))]
    assert got == sorted(want, key=repr)
    assert len({c for *_, c in got}) < len(got)


def test_links_of_planted_fingerprints(spark, table):
    rng = random.Random(3)
    prints = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints.append(centre)
        for _ in range(15):
            bits = rng.sample(range(64), rng.choice((1, 2, 3, 4)))
            prints.append(centre ^ sum(1 << b for b in bits))
    prints = list(dict.fromkeys(prints + [0, 1 << 63, (1 << 64) - 1, 3]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    got = dict(components(simhash.links(df)).collect())
    want = plain_components(prints, signed)
    assert [got.get(p, p) for p in signed] == want


def test_odd_rows(documents, table):
    got = table(simhash.groups(documents(ODD, extra=True), 3), "doc_id", "component_id")
    assert got == sorted([(1, 1), (2, 1), (3, 1), (8, 1), (4, 4), (5, 4), (5, 4), (None, None), (7, 7)], key=repr)
    assert table(simhash.groups(documents([]), 3)) == []


def test_one_of_each(documents, table):
    rows = [(3, "one two three four five six"), (2, "one two three four five six"), (9, "other words are here now"), (None, "one two three four five six")]
    kept = simhash.one_of_each(documents(rows, extra=True))
    assert sorted(x for x, in table(kept, "doc_id") if x) == [2, 9] and kept.count() == 3
    assert simhash.one_of_each(documents([])).count() == 0


def test_components_of_a_long_path(spark, table):
    n = 200
    edges = spark.range(n).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    assert set(table(components(edges))) == {(i, 0) for i in range(n + 1)}
