import datetime

import duckdb
import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def small():
    """(doc_id, text) of the smallest documents table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture()
def documents(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame(rows, DOCUMENTS)
        if extra:  # columns whose names operators use inside
            from pyspark.sql import functions as F

            for name in ("_spans", "_words", "_row", "document", "start", "end", "version", "piece", "node", "final", "n_words", "lang"):
                df = df.withColumn(name, F.lit("x"))
            df = df.withColumn("day", F.lit(datetime.date(2024, 1, 1)))
        return df

    return make


@pytest.fixture()
def table():
    def as_tuples(df, *columns):
        return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)

    return as_tuples


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (None, "a b c"), (7, "x " * 40_000), (8, None)]
