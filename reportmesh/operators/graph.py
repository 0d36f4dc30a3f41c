"""Connected components over confirmed edges.

Alternating large-star / small-star rounds (Kiveris et al., 2014): hub nodes are handled by the
split lookup, every round is a table in the shared folder that replaces the one before, and only one row of
sums per round, taken while its table is written, reaches the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..policy import AUTO_MATCH
from ..session import drop_stage, write_stage
from .skew import HOT_ROWS, lookup


def _star(pairs: DataFrame, keep_lower: bool, hot_rows: int | None) -> DataFrame:
    """Point neighbours at the smallest node of each neighbourhood. ``pairs`` is (u, v)."""
    if hot_rows is None:
        # no node is hot: its pairs meet in one task, so one shuffle gives both the minimum and the rows
        met = pairs.withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), "u"))
        moved = F.struct(F.col("v").alias("a"), F.col("m").alias("b"))
        own = F.struct(F.col("u").alias("a"), F.col("m").alias("b"))
        if keep_lower:
            found = met.select(F.inline_outer(F.array(moved, own)))
        else:
            found = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return found.filter(F.col("a") != F.col("b"))
    smallest = (
        pairs.groupBy("u")
        .agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n"))
        .select("u", F.least("_m", "u").alias("m"), "_n")
    )
    rows = pairs if keep_lower else pairs.filter(F.col("v") > F.col("u"))
    joined = lookup(rows, smallest, ["u"], spread_by="v", row_count="_n", hot_rows=hot_rows)
    moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep_lower:
        moved = moved.unionByName(smallest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b"))


def _large_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    way = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = edges.select(F.inline_outer(F.array(way("a", "b"), way("b", "a"))))
    return _star(both, False, hot_rows)


def _small_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    downhill = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    # one distinct per round is enough to keep the edge set from growing
    return _star(downhill, True, hot_rows).distinct()


def _write_stars(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The written edges, their folder, and an order-free signature of them, summed up during the write."""
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    sums = {
        "rows": F.count(F.lit(1)),
        "there": wide(F.xxhash64("a", "b")),
        "back": wide(F.xxhash64(F.lit(7), "b", "a")),
    }
    seen = Observation(f"stars-{uuid.uuid4().hex}")
    stars, path = write_stage(edges.observe(seen, *[total.alias(name) for name, total in sums.items()]))
    found = seen.get  # of an empty table nothing is seen
    return stars, path, (found.get("rows") or 0, found.get("there"), found.get("back"))


def connected_components(
    vertices: DataFrame, edges: DataFrame, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(id, component) for every vertex; a component is named by its smallest member id."""
    spark = edges.sparkSession
    stars, path, before = _write_stars(
        edges.filter(F.col("left_id") != F.col("right_id"))
        .select(F.greatest("left_id", "right_id").alias("a"), F.least("left_id", "right_id").alias("b"))
        .distinct()
    )
    while before[0]:  # every round that changes the stars brings labels closer to the smallest id
        # a star round works on at most two rows per edge: below that no node can be hot
        split = hot_rows if 2 * before[0] > hot_rows else None
        stars, next_path, after = _write_stars(_small_star(_large_star(stars, split), split))
        drop_stage(spark, path)
        path = next_path
        if after == before:
            break
        before = after
    return (
        vertices.select("id")
        .join(stars.select(F.col("a").alias("id"), F.col("b").alias("_root")), "id", "left")
        .select("id", F.coalesce("_root", "id").alias("component"))
    )


def confirmed_components(
    complaints: DataFrame, edges: DataFrame, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Components over auto_match edges only; review edges never bridge."""
    return connected_components(
        complaints.select("id"), edges.filter(F.col("decision") == AUTO_MATCH), hot_rows=hot_rows
    )
