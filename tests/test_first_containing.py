"""Top-k containment: the k least ids holding each pattern, against brute force; rounds stop early."""

import random

from lexspark.operators import containment
from lexspark.operators.containment import first_containing


def brute(patterns, texts, k):
    out = []
    for p in set(patterns):
        if not p.strip():
            continue
        ids = sorted(i for i, t in texts if t is not None and p in t)[:k]
        out += [(p, i, r + 1) for r, i in enumerate(ids)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [(400, None)]
    patterns = ["alpha", "beta gamma", "ta ga", "zeta eta theta", "nothing here", "  ", "eps", "eps", "a b", "lph"]
    p = spark.createDataFrame([(x,) for x in patterns], "q string")
    t = spark.createDataFrame(texts, "id long, body string")
    for k in (1, 5, 30):
        got = sorted(tuple(r) for r in first_containing(p, "q", t, "id", "body", k, blocks=16).collect())
        assert got == brute(patterns, texts, k)


def test_everywhere_pattern_stops_after_first_round(spark, monkeypatch):
    texts = [(i, f"common word {i}") for i in range(2000)]
    rounds = []
    original = containment.top_k

    def counting(df, *args, **kwargs):
        rounds.append(1)
        return original(df, *args, **kwargs)

    monkeypatch.setattr("lexspark.operators.windows.top_k", counting)
    p = spark.createDataFrame([("common word",)], "q string")
    t = spark.createDataFrame(texts, "id long, body string")
    got = first_containing(p, "q", t, "id", "body", 5, blocks=32).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4]
    assert len(rounds) <= 3  # one round's cut, the count of full patterns, the final ranking


def test_empty_inputs(spark):
    p = spark.createDataFrame([("x",)], "q string")
    assert first_containing(p, "q", spark.createDataFrame([], "id long, body string"), "id", "body", 3).count() == 0
    assert first_containing(spark.createDataFrame([("  ",)], "q string"), "q", spark.createDataFrame([(1, "x")], "id long, body string"), "id", "body", 3).count() == 0
