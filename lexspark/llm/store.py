"""Intermediate tables in the shared folder, and plain reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.session import remove_at_exit, scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back.

    This cuts the lineage: what follows survives the loss of any executor, and expensive Python
    steps are not run again when their result is used twice. The folder goes when the driver ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column, counted by Spark before anything is collected or broadcast."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
