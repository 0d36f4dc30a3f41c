"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 500_000


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    *,
    spread_by: str,
    row_count: str | None = None,
    hot_rows: int = HOT_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Join many ``rows`` per key with the one ``table`` row of that key.

    Keys with more than ``hot_rows`` rows are split: their rows take one of ceil(n / hot_rows)
    splits and their single table row is copied to each. ``row_count`` names a table column that
    already holds rows per key; without it the counts come from a map-side combined aggregate.
    The list of hot keys has at most rows / hot_rows entries, and the adaptive planner broadcasts
    it only if its measured size allows.
    """
    if row_count is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = table.select(*keys, F.col(row_count).alias("_n"))
    hot = counts.filter(F.col("_n") > hot_rows).select(
        *keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_splits")
    )
    splits = F.coalesce(F.col("_splits"), F.lit(1))
    spread = (
        rows.join(hot, keys, "left")
        .withColumn("_split", F.pmod(F.xxhash64(spread_by), splits).cast("int"))
        .drop("_splits")
    )
    copied = (
        table.join(hot, keys, "left")
        .withColumn("_split", F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop("_splits")
    )
    return spread.join(copied, [*keys, "_split"], how).drop("_split")
