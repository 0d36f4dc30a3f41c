"""Candidate pairs: a blocked distance / time / category self-join.

Each report sits in exactly one block. Probing rows visit every block that could hold a partner,
so the equi-join on the block key followed by the exact distance and gap test yields each
unordered pair once, without a distinct.

Block lists use explode_outer: they are never empty, and a plain explode would make the optimizer
compute every list twice (once more as a size filter).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import (
    EARTH_RADIUS_METRES,
    haversine_metres,
    valid_coordinate,
)
from ..policy import CATEGORIES, OTHER, MatchingPolicy

# Blocks are two radii (two windows) wide: a probe then touches about 2 blocks per axis.
BLOCK_WIDTH = 2.0
# Margin so that rounding in the block maths can never lose a pair; the exact test follows.
SLACK = 1e-6


class GeoGrid:
    """Latitude bands with band-specific longitude cells; wraps at 180 degrees, safe at poles."""

    def __init__(self, radius_metres: float, width: float = BLOCK_WIDTH) -> None:
        self.width = width
        self.delta = radius_metres / EARTH_RADIUS_METRES * (1 + SLACK)
        self.delta_degrees = math.degrees(self.delta)
        self.band_height = width * self.delta_degrees

    def band(self, latitude: Column) -> Column:
        return F.floor((latitude + 90) / self.band_height)

    def bands_near(self, latitude: Column) -> Column:
        return F.sequence(
            self.band(F.greatest(latitude - self.delta_degrees, F.lit(-90.0))),
            self.band(F.least(latitude + self.delta_degrees, F.lit(90.0))),
        )

    def _reach(self, latitude: Column) -> Column:
        """Largest longitude difference, in degrees, within the radius of ``latitude``."""
        phi = F.radians(F.abs(latitude))
        inside = F.asin(F.least(F.lit(1.0), math.sin(self.delta) / F.cos(phi))) * (1 + SLACK)
        covers_pole = phi + self.delta * (1 + SLACK) >= math.pi / 2
        return F.when(covers_pole, F.lit(180.0)).otherwise(F.degrees(inside))

    def cells_in(self, band: Column) -> Column:
        """Number of longitude cells in a band; 1 next to the poles."""
        south = band * self.band_height - 90
        widest = F.least(
            F.greatest(F.abs(south), F.abs(south + self.band_height)), F.lit(90.0)
        )
        width = self._reach(widest) * self.width
        return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("bigint")

    def cell(self, longitude: Column, cells: Column) -> Column:
        return F.pmod(F.floor((longitude + 180) / (F.lit(360.0) / cells)), cells)

    def cells_near(self, latitude: Column, longitude: Column, cells: Column) -> Column:
        reach = self._reach(latitude)
        width = F.lit(360.0) / cells
        low = F.floor((longitude - reach + 180) / width)
        high = F.floor((longitude + reach + 180) / width)
        whole_band = high - low + 1 >= cells
        return F.transform(
            F.sequence(
                F.when(whole_band, F.lit(0).cast("bigint")).otherwise(low),
                F.when(whole_band, cells - 1).otherwise(high),
            ),
            lambda c: F.pmod(c, cells),
        )


def _probe_categories(category: Column, *, also_other: bool) -> Column:
    """Known categories look among their own (and ``other`` if asked); ``other`` looks everywhere."""
    own = F.array(category, F.lit(OTHER)) if also_other else F.array(category)
    return F.when(category == OTHER, F.array(*[F.lit(c) for c in CATEGORIES])).otherwise(own)


def _bucket(micros: Column, width: int) -> Column:
    return F.floor(micros / F.lit(width)).cast("bigint")


def split_hot_blocks(build: DataFrame, probe: DataFrame, keys: list[str], row_id: str, hot_rows: int):
    """Spread crowded blocks over several tasks.

    A block with n > ``hot_rows`` build rows gets ceil(n / hot_rows) splits: build rows pick one,
    probe rows visit all. The list of crowded blocks has at most rows / ``hot_rows`` entries; the
    adaptive planner broadcasts it only when its measured size allows.
    """
    crowded = (
        build.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_splits"))
    )
    splits = F.coalesce(F.col("_splits"), F.lit(1))
    build = build.join(crowded, keys, "left").withColumn(
        "_split", F.pmod(F.xxhash64(row_id), splits).cast("int")
    )
    probe = probe.join(crowded, keys, "left").withColumn(
        "_split", F.explode(F.sequence(F.lit(0), splits - 1))
    )
    return build.drop("_splits"), probe.drop("_splits")


def candidate_pairs(
    complaints: DataFrame,
    policy: MatchingPolicy = MatchingPolicy(),
    *,
    probe_side: DataFrame | None = None,
    hot_rows: int = 5_000,
) -> DataFrame:
    """Unordered pairs with compatible category, distance <= radius and gap <= window.

    Returns ``left_id < right_id`` with categories, distance and gap. Only the narrow columns the
    predicate needs travel through the join; evidence is attached to the survivors afterwards.
    With ``probe_side`` (new reports, also contained in ``complaints``) only pairs touching a new
    report are produced.
    """
    grid = GeoGrid(policy.geographic_radius_metres)
    window_us = math.ceil(policy.window_seconds * 1_000_000)
    width_us = math.ceil(window_us * BLOCK_WIDTH)

    def narrow(df: DataFrame, prefix: str) -> DataFrame:
        # reports without a usable place or time pair with nothing
        usable = df.filter(
            valid_coordinate(F.col("latitude"), F.col("longitude"))
            & F.col("reported_at").isNotNull()
        )
        return usable.select(
            F.col("id").alias(f"{prefix}id"),
            F.coalesce("category", F.lit(OTHER)).alias(f"{prefix}category"),
            F.col("latitude").alias(f"{prefix}lat"),
            F.col("longitude").alias(f"{prefix}lon"),
            F.unix_micros("reported_at").alias(f"{prefix}us"),
        )

    build = (
        narrow(complaints, "b_")
        .withColumns(
            {
                "cat_key": F.col("b_category"),
                "bucket": _bucket(F.col("b_us"), width_us),
                "band": grid.band(F.col("b_lat")),
            }
        )
        .withColumn("cell", grid.cell(F.col("b_lon"), grid.cells_in(F.col("band"))))
    )
    probe = (
        narrow(complaints if probe_side is None else probe_side, "p_")
        .withColumn(
            "cat_key",
            F.explode_outer(
                _probe_categories(F.col("p_category"), also_other=probe_side is not None)
            ),
        )
        .withColumn(
            "bucket",
            F.explode_outer(
                F.sequence(
                    _bucket(F.col("p_us") - window_us, width_us),
                    _bucket(F.col("p_us") + window_us, width_us),
                )
            ),
        )
        .withColumn("band", F.explode_outer(grid.bands_near(F.col("p_lat"))))
        .withColumn(
            "cell",
            F.explode_outer(
                grid.cells_near(F.col("p_lat"), F.col("p_lon"), grid.cells_in(F.col("band")))
            ),
        )
    )
    if probe_side is not None:
        # new-to-old pairs are found from the new side only, so known categories must also look
        # among ``other``; new-to-new pairs are found from both sides and kept once.
        new_ids = probe_side.select(F.col("id").alias("b_id"), F.lit(True).alias("b_new"))
        build = build.join(new_ids, "b_id", "left")
        once = F.col("b_new").isNull() | (F.col("p_id") < F.col("b_id"))
    else:
        # pairs of ``other`` with a known category are found from the ``other`` side only
        mixed = (F.col("p_category") == OTHER) & (F.col("b_category") != OTHER)
        once = mixed | (F.col("p_id") < F.col("b_id"))

    keys = ["cat_key", "bucket", "band", "cell"]
    build, probe = split_hot_blocks(build, probe, keys, "b_id", hot_rows)
    distance = haversine_metres(F.col("p_lat"), F.col("p_lon"), F.col("b_lat"), F.col("b_lon"))
    gap_us = F.abs(F.col("p_us") - F.col("b_us"))
    forward = F.col("p_id") < F.col("b_id")
    return (
        # sort-merge, always: the planner sizes the probe side before its rows multiply
        probe.join(build.hint("merge"), [*keys, "_split"])
        .filter(
            once
            & (F.col("p_id") != F.col("b_id"))
            & (gap_us <= policy.window_seconds * 1e6)
            # a cheap necessary test keeps most false candidates away from the trigonometry
            & (F.abs(F.col("p_lat") - F.col("b_lat")) <= grid.delta_degrees)
        )
        .withColumn("distance_metres", distance)
        .filter(F.col("distance_metres") <= policy.geographic_radius_metres)
        .select(
            F.when(forward, F.col("p_id")).otherwise(F.col("b_id")).alias("left_id"),
            F.when(forward, F.col("b_id")).otherwise(F.col("p_id")).alias("right_id"),
            F.when(forward, F.col("p_category")).otherwise(F.col("b_category")).alias("left_category"),
            F.when(forward, F.col("b_category")).otherwise(F.col("p_category")).alias("right_category"),
            "distance_metres",
            (gap_us / F.lit(1e6)).alias("time_gap_seconds"),
        )
    )
