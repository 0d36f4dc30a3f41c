"""Where rows lie: time buckets and zones for reports, shards for keys.

A stored table laid out by ``bucket`` and ``zone`` is read by semi-join with the few cells a batch can
reach. Both are folder columns, so the planner prunes folders at run time (dynamic partition pruning)
while the cell list is small enough to broadcast; the bucket range is a plain filter in any case.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid_coordinate
from ..policy import MatchingPolicy
from .candidates import GeoGrid

#: Bucket of reports without a usable place or time: they pair with nothing.
NOWHERE = -(1 << 31)
CELL = ("bucket", "zone")


@dataclass(frozen=True)
class Layout:
    """Widths of the layout. A store keeps the layout it was made with."""

    bucket_days: float = 7.0
    tile_metres: float = 8_000.0
    zones: int = 16
    shards: int = 16

    def _bucket(self, micros: Column) -> Column:
        return F.floor(micros / F.lit(math.ceil(self.bucket_days * 86_400e6))).cast("int")

    def _zone(self, band: Column, cell: Column) -> Column:
        return F.pmod(F.xxhash64(band.cast("bigint"), cell.cast("bigint")), F.lit(self.zones)).cast("int")

    def located(self, reports: DataFrame) -> DataFrame:
        """Reports with the ``bucket`` and ``zone`` they are stored in."""
        grid = GeoGrid(self.tile_metres)
        usable = valid_coordinate(F.col("latitude"), F.col("longitude")) & F.col("reported_at").isNotNull()
        band = grid.band(F.col("latitude"))
        zone = self._zone(band, grid.cell(F.col("longitude"), grid.cells_in(band)))
        return reports.withColumns(
            {
                "bucket": F.when(usable, self._bucket(F.unix_micros("reported_at"))).otherwise(F.lit(NOWHERE)),
                "zone": F.when(usable, zone).otherwise(F.lit(0)),
            }
        )

    def cells_near(self, reports: DataFrame, policy: MatchingPolicy) -> DataFrame:
        """Distinct (bucket, zone) in which a partner of any of the reports can lie."""
        if self.tile_metres < policy.geographic_radius_metres:
            raise ValueError("tiles must be at least as wide as the radius of a pair")
        grid, margin = GeoGrid(self.tile_metres), math.ceil(policy.window_seconds * 1e6)
        us, lat, lon = F.unix_micros("reported_at"), F.col("latitude"), F.col("longitude")
        usable = reports.filter(valid_coordinate(lat, lon) & F.col("reported_at").isNotNull())
        # one row per place and bucket before the neighbours multiply them
        tile = usable.select(
            F.explode_outer(F.sequence(self._bucket(us - margin), self._bucket(us + margin))).alias("bucket"),
            F.explode_outer(grid.bands_near(lat)).alias("band"), "latitude", "longitude",
        )
        return (
            tile.withColumn("cell", F.explode_outer(grid.cells_near(lat, lon, grid.cells_in(F.col("band")))))
            .select("bucket", self._zone(F.col("band"), F.col("cell")).alias("zone"))
            .distinct()
        )

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")


def own_cells(located: DataFrame) -> DataFrame:
    """Distinct cells the rows themselves lie in."""
    return located.select(*CELL).distinct()


def in_cells(table: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of a table laid out by cells that lie in the given ones; ``cells`` is a written table."""
    low, high = cells.agg(F.min("bucket"), F.max("bucket")).first()
    if low is None:
        return table.limit(0)
    reach = F.col("bucket").between(low, high)
    return table.filter(reach).join(cells.filter(reach), list(CELL), "left_semi")


def with_keys(table: DataFrame, keys: DataFrame, column: str, layout: Layout) -> DataFrame:
    """Rows of a table laid out by ``shard`` whose ``column`` is among ``keys``, a written table of it."""
    wanted = keys.select(column).distinct().withColumn("shard", layout.shard(F.col(column)))
    wanted = wanted.filter(F.col("shard") >= 0)
    return table.join(wanted, ["shard", column], "left_semi")
