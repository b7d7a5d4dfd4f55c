"""Ranking and numbering that stay spread over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import use_checkpoints

_BROADCAST_ROWS = 100_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a task in its low 33 bits


def top_k(df: DataFrame, partition_by: Sequence[str | Column], order_by: Sequence[str | Column], k: int,
          name: str = "rank") -> DataFrame:
    """Best ``k`` rows per group; each task cuts its share to ``k`` before the shuffle."""
    window = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def global_row_number(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                      name: str = "row_id", total: str | None = None) -> DataFrame:
    """Dense 1..n numbering, over everything or per group, without one task seeing it all.

    Rows are range-partitioned and sorted by (group, order), checkpointed so that the cut points
    cannot move, and numbered by position: rows of the group in earlier partitions + own place.
    Give a unique last sort column to make ties stable and to let a hot key be split.
    ``total`` names a column for the number of rows of the group.
    """
    use_checkpoints(df.sparkSession)
    keys = [*partition_by, *order_by]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftrightunsigned("_place", _LOCAL_BITS))
        .checkpoint()
    )
    counts = placed.groupBy("_part", *partition_by).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    # One row per range partition and group, so these windows are as small as the partition count.
    group = Window.partitionBy(*partition_by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_part").alias("_p"),
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
        *[F.col(c).alias(f"_g_{c}") for c in partition_by],
    )
    # Ungrouped there is one row per range partition; groups are counted before they are broadcast.
    if not partition_by or starts.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS:
        starts = F.broadcast(starts)
    same = F.col("_part") == F.col("_p")
    for column in partition_by:
        same = same & F.col(column).eqNullSafe(F.col(f"_g_{column}"))
    row_id = F.col("_before") + F.col("_place") - F.col("_first") + 1
    numbered = placed.join(starts, same).withColumn(name, row_id)
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.select(*df.columns, name, *([total] if total else []))


def batch_number(df: DataFrame, order_by: Sequence[str], size: int, name: str = "batch_num") -> DataFrame:
    """1-based number of the batch of ``size`` rows that a row falls into."""
    numbered = global_row_number(df, order_by, name="_row")
    return numbered.withColumn(name, (F.floor((F.col("_row") - 1) / size) + 1).cast("bigint")).drop("_row")


def carry_forward(df: DataFrame, group: str, order: str, value: str, default: str, span: int = 1000) -> DataFrame:
    """Last non-null ``value`` at or before each row of its group.

    ``order`` is an integer position. A group is cut into spans of positions, so that a group
    holding most of the rows is still spread over tasks; only one row per span is chained.
    """
    spans = df.withColumn("_span", F.floor(F.col(order) / span))
    # One row per span: its last heading, NULL if it has none.
    last_of_span = spans.groupBy(group, "_span").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    entering = last_of_span.select(
        group, "_span", F.last("_last", ignorenulls=True).over(before).alias("_entering"))
    inside = Window.partitionBy(group, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = spans.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return (
        carried.join(entering, [group, "_span"])
        .withColumn(value, F.coalesce("_inside", "_entering", F.lit(default)))
        .select(*df.columns)
    )


def nearest_rank(df: DataFrame, value: str, unique: str, groups: Sequence[str] = (), fraction: float = 0.95,
                 name: str = "p95") -> DataFrame:
    """Per group the value at 0-based position floor(fraction * n) of the ascending order."""
    ranked = global_row_number(df.select(*groups, value, unique), [value, unique], groups, "_rank", "_total")
    target = F.floor(F.lit(fraction) * F.col("_total")) + 1
    return ranked.where(F.col("_rank") == target).select(*groups, F.col(value).alias(name))
