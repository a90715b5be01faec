"""Consecutive row numbers within groups, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import store


def dense_positions(
    rows: DataFrame, unit: list[str], block: str | list[str], seq: str, name: str, of_block: dict[str, Column] | None = None
) -> DataFrame:
    """Number the rows of each unit from 0, in order of ``block`` and ``seq``.

    Within one block of a unit ``seq`` must rise by one from row to row, as
    ``monotonically_increasing_id`` does over a sorted partition or a file split.
    Only blocks are counted and put in order; a row's number is its distance from
    its block's first row plus the rows of the blocks before.  ``rows`` must be a
    stored table, as ids differ between runs of a plan.  ``of_block``: columns of ``unit``
    that follow from ``block``; they are made once a block and added to the rows.
    """
    block, of_block = [block] if isinstance(block, str) else block, of_block or {}
    keys = [*[column for column in unit if column not in of_block], *block]
    earlier = Window.partitionBy(*unit).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*keys)
        .agg(F.min(seq).alias("first_seq"), F.count("*").alias("n"))
        .withColumns(of_block)
        .withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select(*keys, *of_block, (F.col("base") - F.col("first_seq")).alias("shift"))
    )
    numbered = rows.join(store(blocks, "blocks"), keys)
    return numbered.withColumn(name, F.col(seq) + F.col("shift")).drop("shift")


def with_ordered_seq(rows: DataFrame, order: list[str]) -> DataFrame:
    """Store rows in the given global order with ``block`` and ``seq`` columns."""
    ordered = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("seq", F.monotonically_increasing_id())
    )
    return store(ordered, "ordered").withColumn("block", F.shiftright("seq", 33))
