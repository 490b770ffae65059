"""Ranks within groups of any size: a group is cut into many parts, so none of it is one task's work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def ranked(rows: DataFrame, groups: list[str], part: Column, order: list[Column], rank: str = "_rank", size: str = "_size") -> DataFrame:
    """``rows`` with each row's rank from 1 in its group by ``order``, and the group's size.

    ``part`` must not fall as ``order`` rises and has a bounded number of values. Rows are counted by part (one row for each part and
    task is shuffled), which gives the rows before each part; within parts they are ranked by a window. Null groups are groups.
    """
    keys = [*groups, "_part"]
    cut = rows.withColumn("_part", part)
    of_group = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cut.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_before", before).withColumn(size, F.sum("_n").over(of_group))
    own = parts.select(*[F.col(k).alias(f"_own_{k}") for k in keys], "_before", size)
    placed = cut.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = placed.join(own, reduce(lambda a, b: a & b, [placed[k].eqNullSafe(own[f"_own_{k}"]) for k in keys]))
    return joined.withColumn(rank, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before", *[f"_own_{k}" for k in keys])


def hash_ranked(rows: DataFrame, groups: list[str], row_id: str, seed: str = "", rank: str = "_rank", size: str = "_size") -> DataFrame:
    """Ranks in the order of the SHA-1 of the id (after ``seed``), which deals rows evenly over 4,096 parts of a group."""
    digest = F.sha1(F.concat(F.lit(seed), F.col(row_id).cast("string")))
    return ranked(rows.withColumn("_digest", digest), groups, F.substring("_digest", 1, 3), [F.col("_digest"), F.col(row_id)], rank, size).drop("_digest")


def numbered(rows: DataFrame, order: list[Column], number: str, first: int = 0) -> DataFrame:
    """``rows`` numbered from ``first`` without gaps in a total order: ranges of it are numbered each by itself, after the rows before them."""
    held = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = held.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row for each range: there are no more than partitions.
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return held.withColumn(number, inside).join(F.broadcast(before), "_range").withColumn(number, (F.col(number) + F.col("_before") + first).cast("long")).drop("_range", "_before")
