"""Counts, collections and ordered lists for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.operators.windows import global_row_number, top_k


def count_by(df: DataFrame, *keys: str, name: str = "row_count") -> DataFrame:
    """Rows per key, most first, ties by key."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys)


def collect_by_class(df: DataFrame, label: str, name: str, order_by: Sequence[str], names_per_class: int | None = None) -> DataFrame:
    """Per class the number of rows and its names in order: all of them, or the stated number of first ones."""
    counts = df.groupBy(label).agg(F.count("*").alias("scheme_count"))
    named = df.select(label, name, *[c for c in order_by if c != name])
    if names_per_class is not None:
        named = top_k(named, [label], order_by, names_per_class).drop("rank")
    lists = named.groupBy(label).agg(F.array_sort(F.collect_list(F.struct(*order_by, F.col(name).alias("_name")))).alias("_e"))
    named = lists.select(label, F.transform("_e", lambda e: e["_name"]).alias("schemes"))
    return counts.join(named, label).orderBy(F.desc("scheme_count"), label)


def paged_by_class(df: DataFrame, label: str, name: str, order_by: Sequence[str], page_size: int = 100) -> DataFrame:
    """Per class its names in order, as numbered pages of at most ``page_size``: (class, page, count, names).

    Rows are numbered per class by range partitioning (no task sees a whole class), so a page is the group of
    rows with the same (row - 1) div page_size; no list grows with the class. ``count`` is the class's row count.
    """
    numbered = global_row_number(df.select(label, name, *[c for c in order_by if c != name]), list(order_by), [label], "_row", "_total")
    pages = numbered.withColumn("page", ((F.col("_row") - 1) / page_size).cast("long") + 1)
    lists = pages.groupBy(label, "page").agg(
        F.max("_total").alias("scheme_count"), F.array_sort(F.collect_list(F.struct("_row", F.col(name).alias("_name")))).alias("_e"))
    return lists.select(label, "page", "scheme_count", F.transform("_e", lambda e: e["_name"]).alias("schemes"))


def collection_stats(vectors: DataFrame, model: str, source: str) -> DataFrame:
    """Number of vectors, their dimension, and what they were made with and from."""
    return vectors.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimension")).select(
        "vectors", "dimension", F.lit(model).alias("embedding_model"), F.lit(source).alias("source_table"))


def distinct_sources(results: DataFrame, key: str = "question_id") -> DataFrame:
    """Per question its distinct source laws (sorted) and cited ids in rank order; at most k rows each."""
    return results.groupBy(key).agg(
        F.sort_array(F.collect_set("source_law")).alias("source_laws"),
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("_e"),
    ).select(key, "source_laws", F.transform("_e", lambda e: e.chunk_id).alias("chunks_cited"))


def recent(logs: DataFrame, rows: int = 5) -> DataFrame:
    """Newest log rows."""
    return logs.orderBy(F.desc("timestamp"), "query_id").limit(rows)
