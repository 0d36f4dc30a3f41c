"""Pages at any offset of a sorted table.

Rows are range-partitioned in their order and numbered; a block of ``BLOCK_ROWS`` neighbours is one folder
of the stored index, so a page opens one or two blocks, whatever its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 100_000


def page_index(rows: DataFrame, order: list[Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with ``position`` (from 0, in a total order) and ``block``.

    Each task numbers its own sorted rows; one count per task gives where it begins, so the offsets that are
    broadcast are as many as there are partitions.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = cut_lineage(
        rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_in_task": in_task})
    )
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    position = F.col("_start") + F.col("_in_task")
    return (
        numbered.join(F.broadcast(starts), "_part").withColumn("position", position)
        .withColumn("block", F.floor(F.col("position") / block_rows).cast("int"))
        .drop("_part", "_in_task", "_start")
    )


def page(index: DataFrame, limit: int, offset: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``limit`` rows from ``offset`` on, in order; only their blocks are read."""
    last = offset + limit - 1
    inside = F.col("block").between(offset // block_rows, last // block_rows) & F.col("position").between(offset, last)
    return index.filter(inside).orderBy("position")
