"""Differences between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) with insert, update or delete; unchanged rows are left out.

    Only the key and a 64-bit hash of the other columns travel through the join. A column that one
    version lacks counts as NULL there; a value that moves to a neighbouring column is a change.
    """
    payload = sorted({*old.columns, *new.columns} - {key})

    def fingerprints(df: DataFrame, name: str) -> DataFrame:
        values = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string") for c in payload]
        return df.select(key, F.xxhash64(*[x for v in values for x in (v.isNull(), v)]).alias(name))

    both = fingerprints(old, "_old").join(fingerprints(new, "_new"), key, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old") != F.col("_new"), "update")
    )
    return both.select(key, change.alias("change")).where(F.col("change").isNotNull())


def new_files(incoming: DataFrame, stored: DataFrame, name: str = "filename") -> DataFrame:
    """Inputs whose name is not stored yet."""
    return incoming.join(stored.select(name), name, "left_anti")
