"""Approximate neighbours: recall against the exact way, every row indexed, hot cells sliced, odd tables."""

import numpy as np
from pyspark.sql import functions as F

from lexspark.operators import ann
from lexspark.operators.vectors import nearest

BIG = "/root/testdata/sf0.1"


def recall(spark, v, k=5, **options):
    books = ann.fit(v)
    coded = ann.index(v, books)
    q = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    got = ann.search(q, v, books, coded, k, **options).collect()
    exact = nearest(q, v, k, vector_id="vec_id").collect()
    want = {(r[0], r[1]) for r in exact}
    return len(want & {(r.query_id, r.id) for r in got}) / len(want), got, coded


def test_recall_and_whole_index(spark):
    v = spark.read.parquet(f"{BIG}/embeddings.parquet")
    share, got, coded = recall(spark, v)
    assert share >= 0.9
    assert coded.count() == v.count()  # every row is indexed, the sample only fits the codebooks
    assert max(r.scanned for r in got) < v.count()  # queries do not read the whole table
    full, _, _ = recall(spark, v, probes=10_000, depth=10_000)
    assert full == 1.0  # all cells and all candidates: exact after re-ranking


def test_hot_cell_is_sliced_and_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "SLICE_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0] * 8) for i in range(60)] + [(100 + i, rng.normal(size=8).tolist()) for i in range(40)] + [(500, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    books = ann.fit(v, cells=4)
    coded = ann.index(v, books)
    assert coded.count() == 100 and coded.select("cell", "slice").distinct().count() > 4
    q = v.where("vec_id IN (0, 150, 500)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = ann.search(q, v, books, coded, 3, probes=4).where("query_id = 0").orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2] and all(r.distance == 0 for r in got)


def test_empty(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    books = ann.fit(v)
    assert ann.index(v, books).count() == 0
