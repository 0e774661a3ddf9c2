"""Positions, ranks and first rows that hold up when one group holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import settle_in_order


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2 … in the given order.

    Rows are range-partitioned and sorted once and settled, so that partitions stay as they are;
    a row's position is its place in its partition plus the sizes of the partitions before it.
    No task sees more than one range partition.
    """
    ordered = settle_in_order(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ordered.select(
        "*",
        F.spark_partition_id().alias("_part"),
        # the low 33 bits count the rows of a partition
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row per partition, so a window over all of them is small
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return placed.join(offsets, "_part").select(
        *ordered.columns, (F.col("_offset") + F.col("_place")).alias(name)
    )


def rank_in_groups(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """Number the rows of each group 1, 2, 3 … without bringing a group into one task."""
    placed = with_position(df, [*(F.col(g) for g in group), *order], "_position")
    starts = placed.groupBy(*group).agg(F.min("_position").alias("_start"))
    return placed.join(starts, list(group)).select(
        *df.columns, (F.col("_position") - F.col("_start") + 1).alias(name)
    )


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, name: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1 in ``name`` if given.

    The constant bound lets Spark cut each group to ``n`` rows per map task before the shuffle.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    rank = name or "_rank"
    kept = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return kept if name else kept.drop(rank)


def dedup_by_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return first_per_group(df, key, order, 1)
