"""Reading: tables, file listings, fallbacks, newest snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_path(sf_dir: str, name: str) -> str:
    """A table as the source of a stream, whether it is one file or a folder of files.

    A glob that matches this name alone: a stream takes a plain path for a folder and fails on a single file.
    """
    return f"{sf_dir}/{name}.parque[t]"


def scan(df: DataFrame, order_by: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """A table, or its first ``rows`` rows in a stated order."""
    return df if rows is None else df.orderBy(*order_by).limit(rows)


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Names and sizes of a folder's files with a suffix. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length")


def table_or_fallback(spark: SparkSession, name: str, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """The named table if there is one, else the given rows, in either case with all columns of the schema."""
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame(list(rows), schema)
    table = spark.table(name)
    return table.select(*[
        F.col(f.name).cast(f.dataType) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def latest_snapshot(df: DataFrame, stamp: str = "snapshot_ts") -> DataFrame:
    """Rows of the greatest snapshot stamp; on a partitioned table only that partition is read."""
    newest = df.agg(F.max(stamp).alias(stamp))
    return df.join(F.broadcast(newest), stamp)  # the newest stamp is one row


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of several tables in one job."""
    whole = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        whole = one if whole is None else whole.unionByName(one)
    return whole
