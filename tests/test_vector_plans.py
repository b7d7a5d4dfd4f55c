import numpy as np

from lexspark.operators import vectors as vectors_module
from lexspark.operators.embedding import embed
from lexspark.operators.vectors import nearest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _vectors(spark, n):
    made = np.random.default_rng(3).normal(size=(n, 6)).round(2).tolist()
    return spark.createDataFrame([(f"v{i:03d}", v, "s") for i, v in enumerate(made)], "chunk_id string, embedding array<double>, source_law string")


def test_the_search_is_not_repeated_by_later_reads_of_its_result(spark):
    vectors = _vectors(spark, 120)
    for options in ({}, {"broadcast_bytes": 0}):
        found = nearest(vectors.withColumnRenamed("chunk_id", "qid"), vectors, 3, query_id="qid", **options)
        assert "MapIn" not in _plan(found) and "FlatMap" not in _plan(found)
        assert found.count() == 360


def test_queries_with_equal_vectors_and_without_ids_all_get_their_rows(spark, rows):
    vectors = _vectors(spark, 60)
    one = vectors.first().embedding
    asked = spark.createDataFrame([(1, one), (2, one), (None, one), (4, [0.0] * 6)], "qid long, embedding array<double>")
    for options in ({}, {"broadcast_bytes": 0, "block_rows": 7}):
        found = rows(nearest(asked, vectors, 2, query_id="qid", **options), "qid", "chunk_id", "rank")
        mine = {q: [(c, r) for i, c, r in found if i == q] for q in (1, 2, None, 4)}
        assert mine[1] == mine[2] == mine[None] and mine[1][0] == ("v000", 1) and len(found) == 8


def test_embedding_turns_few_rows_at_a_time_into_objects(spark):
    texts = spark.range(0, 700, 1, 1).selectExpr("id", "CASE WHEN id % 50 <> 0 THEN concat('word ', id) END AS chunk_text")
    made = embed(texts, embedder=lambda part: [[float(len(t))] for t in part], batch_size=100)
    assert "MapInArrow" in _plan(made)  # a pandas frame would hold a whole Arrow batch
    assert made.where("embed_status = 'ok' AND embedding[0] = coalesce(length(chunk_text), 0)").count() == 700


def test_copies_are_searched_once_and_keep_their_ids(spark, rows):
    rng = np.random.default_rng(5)
    distinct = rng.normal(size=(40, 6)).round(2).tolist()
    stored = [(f"v{i % 290:03d}" if i % 31 else None, distinct[i % 40], f"s{i % 3}") for i in range(300)]  # ids repeat and are null
    vectors = spark.createDataFrame(stored, "chunk_id string, embedding array<double>, source_law string").repartition(3)
    asked = spark.createDataFrame([(i, v, [None, "s1", "none"][i % 3]) for i, v in enumerate(rng.normal(size=(30, 6)).tolist())],
                                  "qid long, embedding array<double>, wanted string")
    for options in ({}, {"broadcast_bytes": 0, "block_rows": 9}):
        for k in (3, 20):
            plain, once = (rows(nearest(asked, vectors, k, query_id="qid", wanted="wanted", many_pairs=pairs, **options))
                           for pairs in (10 ** 10, 0))
            assert plain == once and len(once) == 20 * k


def test_distinct_vectors_and_their_least_ids(spark, rows):
    made = [(f"v{i:03d}", [float(i % 4), 1.0], "a" if i % 8 < 4 else "b") for i in range(80)]
    stored = spark.createDataFrame(made, "vector_id string, vector array<double>, source string")
    first, members = vectors_module._copies(stored, 2, 0)
    assert rows(first, "vector_id", "vector", "source") == made[:8] and members.count() == 16
    assert vectors_module._copies(stored, 2, 81)[1] is None  # too few to look
    assert vectors_module._copies(stored.limit(4), 2, 0)[1] is None  # no copies
