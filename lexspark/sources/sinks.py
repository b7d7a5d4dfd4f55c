"""Writing: whole tables, appends, metadata, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = ["section_number", "title", "source_law", "chapter", "content_type"]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def overwrite(df: DataFrame, table: str, path: str | None = None, **partitioning) -> None:
    """Replace a table. With ``path`` its files lie there instead of in the warehouse."""
    writer = df.write.format("parquet").mode("overwrite")
    if path:
        writer = writer.option("path", path)
    if partitioning.get("partition_by"):
        writer = writer.partitionBy(*partitioning["partition_by"])
    writer.saveAsTable(table)


def append_merge_schema(df: DataFrame, path: str) -> None:
    """Append a batch whose columns may be new; ``read_merged`` sees the union of the columns."""
    df.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def create_if_missing(spark: SparkSession, table: str, schema: T.StructType, path: str | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS with a fixed schema."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    location = f" LOCATION {_quoted(path)}" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{location}")


def append_or_create(df: DataFrame, table: str, path: str | None = None) -> None:
    """Append, creating the table with the frame's schema when it is missing."""
    create_if_missing(df.sparkSession, table, df.schema, path)
    df.select(*df.sparkSession.table(table).columns).write.mode("append").insertInto(table)


def describe(spark: SparkSession, table: str, comment: str | None = None, properties: dict[str, str] | None = None) -> None:
    """Comment and properties of a table."""
    if comment is not None:
        spark.sql(f"COMMENT ON TABLE {table} IS {_quoted(comment)}")
    if properties:
        pairs = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def table_comment(spark: SparkSession, table: str) -> str | None:
    return spark.catalog.getTable(table).description


def vector_rows(chunk_vectors: DataFrame) -> DataFrame:
    """Stored shape of vectors: id, document, embedding and metadata with NULL as ''."""
    return chunk_vectors.select(
        F.col("chunk_id").alias("id"), F.col("chunk_text").alias("document"), "embedding",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in METADATA])


def write_vectors(chunk_vectors: DataFrame, path: str) -> None:
    """Vectors in folders per source, so that a search within one source reads only its own."""
    vector_rows(chunk_vectors).write.mode("overwrite").partitionBy("source_law").parquet(path)
