"""op13: the audit against the checking SQL in DuckDB, with small spill budgets, odd rows and edge cases."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm import divergence
from lexspark.llm.queries import CHECKS

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()),
                                                       ("lang", T.StringType()), ("source", T.StringType()))])
ODD = [(1, None, "en", "a"), (2, "", None, None), (3, "Zebra zebra ZEBRA é", "xx", "s1"), (3, "Zebra zebra ZEBRA é", "xx", "s1"),
       (4, "zebra lion", "xx", "s2"), (5, "lion", "xx", "s3"), (6, None, "xx", None), (7, "word " * 30_000, "yy", "only")]


def sql(rows, min_docs=30):
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    db = duckdb.connect()
    db.register("documents", frame)
    query = CHECKS["op13_source_divergence"].replace(">= 30)", f">= {min_docs})")
    return sorted(db.sql(query).fetchall(), key=repr)


@pytest.fixture(scope="module")
def small_rows():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SMALL}/documents.parquet'").fetchall()


@pytest.mark.parametrize("min_docs,budget", [(30, divergence.BUDGET), (3, 7), (1, 1)])
def test_against_sql(spark, small_rows, table, min_docs, budget):
    rows = small_rows + ODD
    got = table(divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs=min_docs, budget=budget))
    want = sql(rows, min_docs)
    assert got == want
    assert any(r[2] == "term" for r in got) and any(r[2] == "pair" for r in got)


def test_odd_rows_alone(spark, table):
    got = table(divergence.audit(spark.createDataFrame(ODD, SCHEMA).withColumn("term", F.lit(1)).withColumn("count", F.lit("x")), min_docs=1))
    assert got == sql(ODD, 1)
    assert ("", "", "pair", "a", 0, 1) not in got  # '' and 'en' are different languages
    assert not [r for r in got if r[0] == "yy" and r[2] == "pair"]  # one source: no pairs


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_python_blocks_equal_spark_aggregation(spark, small_rows, table):
    docs = spark.createDataFrame(small_rows + ODD, SCHEMA)
    assert table(divergence.frequencies(docs, budget=5, python=True)) == table(divergence.frequencies(docs))


def test_blocks_are_counted_before_they_leave_a_task(spark):
    rows = [(1, "Aa bb aA\u00e9 aa", "x", "s"), (2, "bb-bb", "x", "s"), (3, "aa", "y", "s"), (4, "", "x", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).select("lang", "source", "text").coalesce(1)
    block = divergence._block(docs.toArrow().combine_chunks().to_batches()[0])
    assert sorted(block.to_pylist(), key=lambda r: (r["lang"], r["term"])) == [
        {"lang": "x", "source": "s", "term": "aa", "count": 2, "docs": 1},
        {"lang": "x", "source": "s", "term": "aa\u00e9", "count": 1, "docs": 1},
        {"lang": "x", "source": "s", "term": "bb", "count": 3, "docs": 2},
        {"lang": "y", "source": "s", "term": "aa", "count": 1, "docs": 1}]


def test_words_reach_spark_as_postings(spark):
    docs = spark.createDataFrame([(1, "a", "x", "s")], SCHEMA)
    assert "Generate" not in divergence.frequencies(docs)._jdf.queryExecution().executedPlan().toString()
