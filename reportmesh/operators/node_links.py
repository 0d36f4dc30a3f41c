"""Links between the nodes of the collapsed graph, found where the nodes lie.

A node travels once to its own block of place and time, and once to each block that it may have a partner in:
blocks are eight radii and eight windows wide, so most nodes go to one. What is shuffled grows with the nodes,
not with their pairs. A task compares the nodes of a block by sketches of their vectors with a bound on the
error, and hands on a forest of the links it is sure of. Pairs within the error of a threshold, with an odd
vector or decided by officers are handed on as pairs, for an exact decision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_METRES
from ..functions.locations import KINDS
from ..policy import MatchingPolicy
from ..session import write_stage
from .candidates import GeoGrid

#: Width of a block in radii and in windows.
BLOCK_RADII, BLOCK_WINDOWS = 8.0, 8
#: Rows that a task takes up before it compares them (whole groups), and pairs compared at a time.
CHUNK_ROWS, SLAB_PAIRS = 20_000, 100_000
#: Numbers of vectors that are multiplied at a time.
PRODUCTS = 4_000_000
#: Undecided pairs kept back while links may still join their ends.
KEPT_PAIRS = 1_000_000
#: Distances this near to the radius, in metres, are left to the exact test.
MARGIN_METRES = 1e-3
#: Place sets of a chunk up to which their comparisons are kept as a table.
TABLE_SETS = 1_000


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy(zero_copy_only=False)  # a null is NaN
        values = np.where(np.isnan(values), np.nan, values)
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        usable = np.zeros(len(lengths), bool)
        digests = [hashlib.sha256(values[o : o + n].tobytes()).digest() for o, n in zip(offsets.tolist(), lengths.tolist(), strict=False)]
        out: list[bytes | None] = [None] * len(lengths)
        for length in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == length)
            matrix = values[offsets[rows][:, None] + np.arange(length)]
            with np.errstate(all="ignore"):
                norm = np.sqrt((matrix * matrix).sum(1))
                finite = np.isfinite(matrix).all(1)
                plain = finite & (norm > 1e-100) & (norm < 1e100)
            usable[rows] = finite & (matrix != 0).any(1)
            rows, unit = rows[plain], matrix[plain] / norm[plain][:, None]
            step = np.abs(unit).max(1, initial=0) / 32767
            codes = np.rint(unit / step[:, None])
            error = np.sqrt(((unit - codes * step[:, None]) ** 2).sum(1)) + 1e-9
            head = np.column_stack([step, error]).astype("<f8").view(np.uint8)
            packed = np.concatenate([head, np.ascontiguousarray(codes.astype("<i2")).view(np.uint8)], 1)
            for row, one in zip(rows.tolist(), packed, strict=True):
                out[row] = one.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(usable), pa.array(digests, pa.binary()), pa.array(out, pa.binary())], ["id", "usable", "digest", "sketch"]
        )


def described(vectors: DataFrame) -> DataFrame:
    """(id, usable, digest, sketch). Usable vectors are those of ``is_usable``; equal vectors have equal digests.

    A sketch holds step, error and 16-bit codes of the unit vector; it is null where there is no plain direction.
    """
    kind = dict(vectors.dtypes)["id"]
    return vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
        _described, f"id {kind}, usable boolean, digest binary, sketch binary"
    )


def _compatible(left: tuple, right: tuple) -> bool:
    """As ``compare_location_sets``, from ``kind=value`` tokens. Sets with a null are left to the exact test."""
    if None in left or None in right:
        return True
    a, b = ({k: {t for t in side if t.startswith(f"{k}=")} for k in KINDS} for side in (left, right))
    both = [k for k in KINDS if a[k] and b[k]]
    return bool(both) and all(a[k] & b[k] for k in both)


class _Chunk:
    """Rows of whole groups, sorted by group and ``lo``; union-find over their sure links."""

    def __init__(self, table: pa.Table, radius: float, limit_us: float, threshold: float) -> None:
        self.limit_us, self.threshold = limit_us, threshold
        whole = lambda c: table.column(c).to_numpy()
        self.group, self.number, self.slice = whole("group"), whole("number"), whole("slice")
        self.crossed = whole("i") != whole("j")
        self.home, self.alone = whole("home"), whole("alone")
        self.lo, self.hi = whole("lo"), whole("hi")
        self.lat, self.lon = np.radians(whole("latitude")), np.radians(whole("longitude"))
        self.cos_lat = np.cos(self.lat)
        self.all_home, self.any_crossed = bool(self.home.all()), bool(self.crossed.any())
        # distances are compared as squared sines of half the angle; near the far side of the globe these say little
        half = lambda metres: min(max(metres, 0.0) / (2 * EARTH_RADIUS_METRES), math.pi / 2)
        self.near_h = math.sin(half(radius + MARGIN_METRES)) ** 2 if half(radius) < 1.2 else 1.0
        self.sure_h = math.sin(half(radius - MARGIN_METRES)) ** 2 if half(radius) < 1.2 else -1.0
        seen: dict[tuple, int] = {}
        named = [tuple(t) for t in table.column("tokens").to_pylist()]
        self.sets = np.array([seen.setdefault(t, len(seen)) for t in named], np.int64)
        self.places = list(seen)
        self.known: dict[int, bool] = {}
        n = len(self.places)
        self.table = np.full((n, n), -1, np.int8) if n <= TABLE_SETS else None
        odd_place = np.array([None in t for t in self.places], bool)
        raw = table.column("sketch").to_pylist()
        sizes = np.array([0 if x is None else len(x) for x in raw])
        size = int(np.bincount(sizes).argmax() if not sizes.any() else np.bincount(sizes[sizes > 0]).argmax())
        self.plain = (sizes == size) & (sizes > 0) & ~odd_place[self.sets]
        width = max(0, size - 16) // 2
        self.unit, self.error = np.zeros((len(raw), width), np.float32), np.zeros(len(raw))
        if self.plain.any():
            at = np.flatnonzero(self.plain)
            packed = np.frombuffer(b"".join(raw[x] for x in at), np.uint8).reshape(len(at), size)
            head = np.ascontiguousarray(packed[:, :16]).view("<f8")
            codes = np.ascontiguousarray(packed[:, 16:]).view("<i2")
            self.unit[at] = codes * head[:, :1]
            self.error[at] = head[:, 1]
        self.rounding = (width + 4) * 2.4e-7  # of sums and factors in 32 bits
        self.root = np.arange(len(raw), dtype=np.int32)
        self.open: list[tuple[np.ndarray, np.ndarray]] = []

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(self.root, further := self.root[self.root]):
                self.root = further

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the place sets of each pair are compatible."""
        a, b = self.sets[left], self.sets[right]
        n = len(self.places)
        if self.table is not None:
            unknown = np.unique((a * n + b)[self.table[a, b] < 0])
            for x, y in (divmod(int(c), n) for c in unknown):
                self.table[x, y] = _compatible(self.places[x], self.places[y])
            return self.table[a, b] == 1
        codes, back = np.unique(a * n + b, return_inverse=True)
        for c in codes.tolist():
            if c not in self.known:
                self.known[c] = _compatible(self.places[c // n], self.places[c % n])
        return np.array([self.known[c] for c in codes.tolist()], bool)[back]

    def slabs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one group within the window."""
        n = len(self.group)
        starts = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if n else np.array([], int)
        ends = np.r_[starts[1:], n]
        stop = np.arange(1, n + 1)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=False):
            if e - s > 1:
                # rows are sorted by lo, so the gap is the later lo less the earlier hi, if above zero
                stop[s:e] = np.maximum(np.searchsorted(self.lo[s:e], self.hi[s:e] + self.limit_us, "right") + s, stop[s:e])
        counts = stop - np.arange(1, n + 1)
        total = np.r_[0, np.cumsum(counts)]
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(total, total[at] + SLAB_PAIRS, "right")) - 1)
            left = np.repeat(np.arange(at, to), counts[at:to])
            right = np.arange(total[at], total[to]) - np.repeat(total[at:to], counts[at:to]) + left + 1
            if len(left):
                yield left, right
            at = to

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        meet = self.root[left] != self.root[right]
        if not self.all_home:
            meet &= self.home[left] | self.home[right]
        if self.any_crossed:
            meet &= ~self.crossed[left] | (self.slice[left] != self.slice[right])
        left, right = left[meet], right[meet]
        half_lat, half_lon = (self.lat[right] - self.lat[left]) / 2, (self.lon[right] - self.lon[left]) / 2
        h = np.sin(half_lat) ** 2 + self.cos_lat[left] * self.cos_lat[right] * np.sin(half_lon) ** 2
        near = h <= self.near_h
        left, right, h = left[near], right[near], h[near]
        near = self.agree(left, right) & (self.number[left] != self.number[right])
        left, right, doubtful = left[near], right[near], h[near] > self.sure_h
        plain = self.plain[left] & self.plain[right]
        cosine, piece = np.zeros(len(left)), max(1, PRODUCTS // max(1, self.unit.shape[1]))
        for at in range(0, len(left), piece):
            cosine[at : at + piece] = np.einsum("ij,ij->i", self.unit[left[at : at + piece]], self.unit[right[at : at + piece]])
        a, b = self.error[left], self.error[right]
        bound = a + b + a * b + self.rounding
        unlike = plain & (cosine + bound < self.threshold)
        doubtful |= ~plain | (cosine - bound < self.threshold) | (self.alone[left] & self.alone[right])
        self.unite(left[~unlike & ~doubtful], right[~unlike & ~doubtful])
        self.open.append((left[~unlike & doubtful], right[~unlike & doubtful]))

    def undecided(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs left open whose ends no link has joined meanwhile."""
        left, right = (np.concatenate([np.array([], int), *x]) for x in (zip(*self.open, strict=True) if self.open else ((), ())))
        apart = self.root[left] != self.root[right]
        self.open = [(left[apart], right[apart])]
        return self.open[0]

    def found(self) -> Iterator[pa.RecordBatch]:
        rows = lambda a, b, sure: pa.RecordBatch.from_arrays(
            [pa.array(self.number[a]), pa.array(self.number[b]), pa.array(np.full(len(a), sure))], ["left_id", "right_id", "sure"]
        )
        for left, right in self.slabs():
            self.compare(left, right)
            if sum(len(x) for x, _ in self.open) > KEPT_PAIRS and len(self.undecided()[0]) > KEPT_PAIRS // 2:
                yield rows(*self.open.pop(), False)
        yield rows(*self.undecided(), False)
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        yield rows(moved, self.root[moved], True)


KEYS = ["category", "token", "block", "band", "cell", "i", "j"]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups; a column ``group`` numbers them."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        kept = table if kept is None else pa.concat_tables([kept, table])
        if kept.num_rows < CHUNK_ROWS:
            continue
        numbered = _numbered(kept)
        last = int(np.searchsorted(numbered.column("group").to_numpy(), numbered.column("group")[-1].as_py()))
        if last:
            yield numbered.slice(0, last)
            kept = kept.slice(last)
    if kept is not None:
        yield _numbered(kept)


def _numbered(table: pa.Table) -> pa.Table:
    new = np.zeros(table.num_rows, bool)
    for key in KEYS:
        column = table.column(key)
        codes = column.combine_chunks().dictionary_encode().indices.to_numpy() if pa.types.is_string(column.type) else column.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return table.append_column("group", pa.array(np.cumsum(new)))


def node_links(nodes: DataFrame, policy: MatchingPolicy, hot_rows: int) -> DataFrame:
    """(left_id, right_id, sure) by the ``number`` of eligible nodes.

    Sure rows join the same nodes as all surely confirmed links would. The others are pairs that only the
    exact tests can decide, unless sure links already join their ends.
    """
    grid = GeoGrid(policy.geographic_radius_metres, BLOCK_RADII)
    window_us = math.ceil(policy.window_seconds * 1e6)
    block_of = lambda us: F.floor(us / F.lit(window_us * BLOCK_WINDOWS)).cast("bigint")
    own_band = grid.band(F.col("latitude"))
    own_cell = grid.cell(F.col("longitude"), grid.cells_in(F.col("band")))

    def dealt(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("token", F.explode("tokens"))
            .filter(F.col("token").isNotNull())
            .withColumn("block", F.explode_outer(F.sequence(block_of(F.col("lo") - window_us), block_of(F.col("hi") + window_us))))
            .withColumn("band", F.explode_outer(grid.bands_near(F.col("latitude"))))
            .withColumn("cell", F.explode_outer(grid.cells_near(F.col("latitude"), F.col("longitude"), grid.cells_in(F.col("band")))))
        )

    place = ["category", "token", "block", "band", "cell"]
    # written, so that the planner knows how small it is and the sketches need not be moved for it
    crowded, _ = write_stage(
        dealt(nodes.select("category", "tokens", "lo", "hi", "latitude", "longitude"))
        .groupBy(*place)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*place, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices"))
    )
    # officer-decided reports stay alone and keep their id as name; their pairs are looked up one by one
    carried = nodes.select(
        "number", "category", "tokens", "lo", "hi", "latitude", "longitude", "sketch", (F.col("node") == F.col("rep")).alias("alone")
    )
    slices = F.coalesce("_slices", F.lit(1))
    rows = (
        dealt(carried)
        .join(crowded, place, "left")
        .withColumn("slice", F.pmod(F.xxhash64("number"), slices).cast("int"))
        .withColumn("_other", F.explode_outer(F.sequence(F.lit(0), slices - 1)))
        .select(
            "category", "token", "block", "band", "cell",
            F.least("slice", "_other").alias("i"), F.greatest("slice", "_other").alias("j"), "slice",
            ((F.col("block") == block_of(F.col("lo"))) & (F.col("band") == own_band) & (F.col("cell") == own_cell)).alias("home"),
            "alone", "number", "lo", "hi", "latitude", "longitude", "tokens", "sketch",
        )
    )
    radius, limit_us = float(policy.geographic_radius_metres), policy.window_seconds * 1e6
    threshold = policy.strong_entity_semantic_threshold

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            yield from _Chunk(table, radius, limit_us, threshold).found()

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "lo").mapInArrow(compared, "left_id bigint, right_id bigint, sure boolean")
