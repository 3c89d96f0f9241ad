"""Scans along ordered rows of groups of any size: in two levels, so that a group is as many tasks as it needs.

Rows are dealt out by ranges of (group, order).  A range is a block; a large group lies in many, and many small groups
lie in one.  A scan first runs inside every block of a group.  What crosses the edges (counts, last values) is a row
a group and block, and is carried along these rows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklake.storage import checkpointed

#: Blocks of a table; with none Spark's own number of shuffle partitions, small ones of which it joins.
BLOCKS: int | None = None


def in_blocks(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with _block: the number of a row's range of (group, order), written once, as the ranges come from samples."""
    ranged = df.repartitionByRange(BLOCKS, group, *order) if BLOCKS else df.repartitionByRange(group, *order)
    return checkpointed(ranged.withColumn("_block", F.spark_partition_id()))


def inside(group: str, order: list[str] | None = None) -> WindowSpec:
    """The rows of a group's block, in order."""
    rows = Window.partitionBy(group, "_block")
    return rows.orderBy(*order) if order else rows


def along(group: str, backwards: bool = False) -> WindowSpec:
    """The blocks of a group, one row each, in order."""
    return Window.partitionBy(group).orderBy(F.col("_block").desc() if backwards else "_block")


def earlier(blocks: WindowSpec) -> WindowSpec:
    return blocks.rowsBetween(Window.unboundedPreceding, -1)


def joined(rows: DataFrame, ends: DataFrame, group: str) -> DataFrame:
    """``rows`` with the columns that ``ends`` has for their group and block."""
    named = ends.withColumnsRenamed({group: "_of_group", "_block": "_of_block"})
    return rows.join(named, rows[group].eqNullSafe(F.col("_of_group")) & (rows["_block"] == F.col("_of_block"))).drop("_of_group", "_of_block")


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with _block, _i (a row's number in its group, from 1) and _n (the group's rows)."""
    rows = in_blocks(df, group, order).withColumn("_local", F.row_number().over(inside(group, order)))
    sizes = rows.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    offset = F.coalesce(F.sum("_size").over(earlier(along(group))), F.lit(0))
    ends = sizes.select(group, "_block", offset.alias("_offset"), F.sum("_size").over(Window.partitionBy(group)).alias("_n"))
    return joined(rows, ends, group).withColumn("_i", F.col("_local") + F.col("_offset")).drop("_local", "_offset")
