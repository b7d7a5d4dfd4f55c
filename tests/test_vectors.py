import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators.embedding import RateLimited, embed, embedded, hashed_counts, text_similarity
from lexspark.operators.vectors import filter_after_ranking, nearest


def _brute(queries, vectors, k):
    found = {}
    for qid, q, wanted in queries:
        ranked = sorted((round(float(((np.array(v) - np.array(q)) ** 2).sum()), 9), vid)
                        for vid, v, source in vectors if wanted is None or wanted == source)
        found[qid] = [(vid, d) for d, vid in ranked[:k]]
    return found


def _data(copies: bool):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8)) * 4
    vectors = [(f"v{i:04d}", (centres[i % 6] + rng.normal(size=8) * 0.3).round(3).tolist(), f"s{i % 3}") for i in range(400)]
    if copies:  # a third of all rows is one and the same vector
        vectors = [(vid, vectors[0][1] if i % 3 == 0 else v, s) for i, (vid, v, s) in enumerate(vectors)]
    queries = [(i, (centres[i % 6] + rng.normal(size=8) * 0.3).round(3).tolist(), [None, "s1", "none"][i % 3]) for i in range(60)]
    queries += [(100 + i, vectors[i * 7][1], None) for i in range(20)]
    return queries, vectors


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "pivots": 8, "block_rows": 40}])
def test_both_ways_equal_brute_force(spark, copies, options):
    queries, vectors = _data(copies)
    qdf = spark.createDataFrame(queries, "qid long, embedding array<double>, wanted string")
    vdf = spark.createDataFrame(vectors, "chunk_id string, embedding array<double>, source_law string").repartition(5)
    got = {}
    for r in nearest(qdf, vdf, 4, query_id="qid", wanted="wanted", **options).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, r.distance))
    want = {q: rows for q, rows in _brute(queries, vectors, 4).items() if rows}
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]], q
        assert np.allclose([d for _, d in got[q]], [d for _, d in want[q]], atol=1e-8)


def test_stored_vector_finds_itself_first(spark):
    _, vectors = _data(False)
    vdf = spark.createDataFrame(vectors, "chunk_id string, embedding array<double>, source_law string")
    first = nearest(vdf.withColumnRenamed("chunk_id", "qid"), vdf, 1, query_id="qid")
    assert first.where("qid <> chunk_id OR similarity <> 1.0").count() == 0


def test_filter_comes_after_ranking(spark, rows):
    ranked = spark.createDataFrame([(1, r, r % 2 == 0) for r in range(1, 6)], "question_id long, rank int, legal boolean")
    kept = filter_after_ranking(ranked, F.col("legal"), 3, "question_id")
    assert rows(kept, "question_id", "rank") == [(1, 1), (1, 2)]


def test_hashed_vectors_have_unit_length():
    vectors = hashed_counts(32)(["theft of a bolt", "", "चोरी क्या है"])
    assert [round(float((v * v).sum()), 9) for v in vectors] == [1.0, 0.0, 1.0]


def test_embedding_retries_and_keeps_failed_rows(spark):
    def flaky(texts):
        if any("bad" in t for t in texts):
            raise RateLimited("slow down")
        if any("short" in t for t in texts):
            return [[1.0]] * (len(texts) - 1)
        return [[float(len(t))] for t in texts]

    data = spark.createDataFrame([(i, t) for i, t in enumerate(["ok", "bad", "fine", "short"])], "id int, chunk_text string")
    made = embed(data.coalesce(1), embedder=flaky, batch_size=1, pause=lambda seconds: None)
    got = {r.id: (r.embed_status, r.embedding, r.embed_error) for r in made.collect()}
    assert got[0] == ("ok", [2.0], None) and got[2] == ("ok", [4.0], None)
    assert got[1][0] == "failed" and got[1][1] is None and "rate limited" in got[1][2]
    assert got[3][0] == "failed"
    assert embedded(made).count() == 2


def test_waits_grow_with_each_rate_limit():
    from lexspark.operators.embedding import _attempt

    waits, turns = [], iter([RateLimited("x"), RateLimited("x"), None])

    def slow(texts):
        error = next(turns)
        if error:
            raise error
        return [[0.0]] * len(texts)

    vectors, reason = _attempt(slow, ["a"], 3, 5.0, waits.append)
    assert vectors == [[0.0]] and reason is None and waits == [5.0, 10.0]


def test_text_similarity_ranks_the_same_text_highest(spark):
    data = spark.createDataFrame([("a", "theft and stealing"), ("b", "weather report"), ("c", None)], "title string, body string")
    scored = {r.title: r.similarity_score for r in text_similarity(data, "a theft and stealing", ["title", "body"]).collect()}
    assert scored["a"] == 1.0 and scored["a"] > scored["b"]
