"""Confirmed components without listing every confirmed pair.

Copies (same category, place, mentions and vector) inside one time window confirm each other by
definition, so they are one node of the graph from the start. A burst of identical reports, even a
third of all rows, is then a few rows instead of a quadratic number of pairs. Pairs of different
nodes are found through a shared place mention, which every confirmed pair has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_metres, temporal_gap_seconds, valid_coordinate
from ..functions.locations import compare_location_sets, location_sets, location_tokens
from ..functions.vectors import cosine_from_parts, norm
from ..policy import AUTO_MATCH, NO_MATCH, OTHER, MatchingPolicy
from ..session import release_shuffles, write_stage
from .candidates import GeoGrid, split_hot_blocks
from .graph import connected_components
from .matching import ordered_pair
from .node_links import described, node_links
from .skew import lookup

#: Nodes of a block from which on it is dealt out in slices.
HOT_NODES = 20_000
#: Pairs up to which both ends of an open pair are picked by broadcast.
FEW_PAIRS = 100_000


def _assign_nodes(complaints: DataFrame, vectors: DataFrame, policy: MatchingPolicy, reviews: DataFrame | None):
    """Complaint columns plus ``node``, ``eligible`` (can take part in a confirmed pair) and ``usable``
    (has a vector with a direction).

    Equal vectors have equal digests; a ``vector_key`` column of the complaints (for text embeddings a
    digest of the normalised text) stands for them where it exists. Officer-decided reports stay alone.
    """
    window_us = math.ceil(policy.window_seconds * 1e6)
    known = described(vectors).toDF("id", "_usable", "_digest", "_sketch")
    same_vector = F.col("vector_key") if "vector_key" in complaints.columns else F.base64("_digest")
    rows = complaints.join(known, "id", "left").select(
        "id",
        "category",
        "latitude",
        "longitude",
        F.unix_micros("reported_at").alias("us"),
        location_tokens(F.col("locations")).alias("tokens"),
        location_sets(F.col("locations")).alias("places"),
        F.coalesce(same_vector, "id").alias("vector_key"),
        F.coalesce("_usable", F.lit(False)).alias("usable"),
        F.col("_sketch").alias("sketch"),
    )
    if reviews is None:
        rows = rows.withColumn("decided", F.lit(False))
    else:
        decided = (
            reviews.filter(F.col("status") != "pending")
            .select(F.explode(F.array("left_id", "right_id")).alias("id"))
            .distinct()
            .withColumn("_decided", F.lit(True))
        )
        rows = rows.join(decided, "id", "left").withColumn(
            "decided", F.coalesce("_decided", F.lit(False))
        )
    # without a usable place or time a report is in no candidate pair
    placed = valid_coordinate(F.col("latitude"), F.col("longitude")) & F.col("us").isNotNull()
    eligible = F.coalesce(F.col("category") != OTHER, F.lit(False)) & (F.size("tokens") > 0) & placed
    bucket = F.floor(F.col("us") / F.lit(window_us)).cast("bigint")
    digest = F.sha2(
        F.concat_ws(
            "\u0001",
            "category",
            F.col("latitude").cast("string"),
            F.col("longitude").cast("string"),
            F.array_join("tokens", "\u0002"),
            "vector_key",
            bucket.cast("string"),
        ),
        256,
    )
    return rows.select(
        "id", "category", "latitude", "longitude", "us", "tokens", "places", "usable",
        bucket.alias("bucket"),
        eligible.alias("eligible"),
        F.when(eligible, F.col("sketch")).alias("sketch"),
        F.when(eligible & ~F.col("decided"), digest).otherwise(F.col("id")).alias("node"),
    )


def near_nodes(nodes: DataFrame, meeting: str, policy: MatchingPolicy, hot_rows: int, also: Column | None = None) -> DataFrame:
    """Columns ``p_...`` and ``b_...`` of two nodes of one category within radius and window, each pair
    once for each value of ``meeting`` that they share. ``also`` is tested before the distance."""
    grid = GeoGrid(policy.geographic_radius_metres)
    window_us = math.ceil(policy.window_seconds * 1e6)
    carried = ("node", "rep", "rows", "latitude", "longitude", "lo", "hi", "bucket", "tokens", "places")
    side = lambda p: nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in carried], "category", meeting)
    build = (
        side("b")
        .withColumn("band", grid.band(F.col("b_latitude")))
        .withColumn("cell", grid.cell(F.col("b_longitude"), grid.cells_in(F.col("band"))))
        .withColumn("bucket", F.col("b_bucket"))
    )
    bucket_of = lambda us: F.floor(us / F.lit(window_us)).cast("bigint")
    probe = (
        side("p")
        .withColumn(
            "bucket",
            F.explode_outer(
                F.sequence(bucket_of(F.col("p_lo") - window_us), bucket_of(F.col("p_hi") + window_us))
            ),
        )
        .withColumn("band", F.explode_outer(grid.bands_near(F.col("p_latitude"))))
        .withColumn(
            "cell",
            F.explode_outer(
                grid.cells_near(
                    F.col("p_latitude"), F.col("p_longitude"), grid.cells_in(F.col("band"))
                )
            ),
        )
    )
    keys = ["category", meeting, "bucket", "band", "cell"]
    build, probe = split_hot_blocks(build, probe, keys, "b_node", hot_rows)
    # both intervals lie inside one window-wide bucket, so the closest members are this far apart
    gap = F.greatest("p_lo", "b_lo") - F.least("p_hi", "b_hi")
    distance = haversine_metres(
        F.col("p_latitude"), F.col("p_longitude"), F.col("b_latitude"), F.col("b_longitude")
    )
    return (
        probe.join(build.hint("merge"), [*keys, "_split"])
        .filter((F.col("p_node") < F.col("b_node")) & (gap <= policy.window_seconds * 1e6))
        .filter(F.lit(True) if also is None else also)
        .filter(distance <= policy.geographic_radius_metres)
    )


def place_state() -> Column:
    """How the place mentions of two near nodes compare."""
    return compare_location_sets(F.col("p_places"), F.col("b_places"))["compatibility"]


def _exact_links(pairs: DataFrame, nodes: DataFrame, vectors: DataFrame, policy: MatchingPolicy, rejected: DataFrame | None) -> DataFrame:
    """Those of the given pairs of node numbers that are confirmed, by the tests of ``match_pairs``.

    Few pairs are expected, so their ends are picked from the nodes and vectors without moving these.
    """
    few = pairs.count() <= FEW_PAIRS
    small = lambda df: F.broadcast(df) if few else df
    carried = ("number", "node", "rep", "latitude", "longitude", "lo", "hi", "places")
    side = lambda p: nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in carried])
    ends = pairs.toDF("p_number", "b_number")
    ends = side("p").join(small(ends), "p_number")
    ends = side("b").join(small(ends), "b_number")
    gap = F.greatest("p_lo", "b_lo") - F.least("p_hi", "b_hi")
    distance = haversine_metres(F.col("p_latitude"), F.col("p_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    ends = ends.filter((gap <= policy.window_seconds * 1e6) & (distance <= policy.geographic_radius_metres)).filter(
        place_state() == "compatible"
    )
    if rejected is not None:
        ends = (
            ends.withColumns({"left_id": F.least("p_node", "b_node"), "right_id": F.greatest("p_node", "b_node")})
            .join(rejected, ["left_id", "right_id"], "left_anti")
        )
    ends, _ = write_stage(ends.select("p_number", "b_number", F.col("p_rep").alias("left_rep"), F.col("b_rep").alias("right_rep")))
    wanted = ends.select(F.explode(F.array("left_rep", "right_rep")).alias("id")).distinct()
    known = vectors.select("id", "vector").join(small(wanted), "id", "left_semi")
    if few:
        known, _ = write_stage(known)
    vector = lambda p: known.select(
        F.col("id").alias(f"{p}_rep"), F.col("vector").alias(f"{p}_vector"), norm(F.col("vector")).alias(f"{p}_norm")
    )
    similarity = cosine_from_parts(
        F.col("left_vector"), F.col("left_norm"), F.col("right_vector"), F.col("right_norm")
    )
    missing = F.raise_error(F.concat_ws(" ", F.lit("no usable vector for the pair"), "left_rep", "right_rep")).cast("double")
    return (
        ends.join(vector("left"), "left_rep", "left")
        .join(vector("right"), "right_rep", "left")
        .filter(F.coalesce(similarity, missing) >= policy.strong_entity_semantic_threshold)
        .select(F.col("p_number").alias("left_id"), F.col("b_number").alias("right_id"))
    )


def among_candidates(pairs: DataFrame, complaints: DataFrame, policy: MatchingPolicy) -> DataFrame:
    """The given pairs that are candidates: an approval overrides a decision, it makes no new pair."""
    side = lambda p: complaints.select(
        F.col("id").alias(f"{p}_id"),
        F.struct(
            F.coalesce("category", F.lit(OTHER)).alias("category"),
            "latitude",
            "longitude",
            "reported_at",
        ).alias(p),
    )
    near = haversine_metres(
        F.col("left.latitude"), F.col("left.longitude"), F.col("right.latitude"), F.col("right.longitude")
    )
    gap = temporal_gap_seconds(F.col("left.reported_at"), F.col("right.reported_at"))
    category = F.col("left.category")
    return (
        pairs.select("left_id", "right_id")
        .join(side("left"), "left_id")
        .join(side("right"), "right_id")
        .filter(
            (category == F.col("right.category")) | (category == OTHER) | (F.col("right.category") == OTHER)
        )
        .filter((near <= policy.geographic_radius_metres) & (gap <= policy.window_seconds))
        .select("left_id", "right_id")
    )


@dataclass(frozen=True)
class CollapsedGraph:
    """Confirmed components over nodes: ``assigned`` reports (id, node, us, ...), ``nodes`` with what their
    copies have in common, and ``labels`` (node, component, rows)."""

    assigned: DataFrame
    nodes: DataFrame
    labels: DataFrame

    @property
    def members(self) -> DataFrame:
        """(id, component)"""
        return lookup(
            self.assigned.select("id", "node"), self.labels, ["node"], spread_by="id", row_count="rows"
        ).select("id", "component")


def collapsed_components(
    complaints: DataFrame,
    vectors: DataFrame,
    policy: MatchingPolicy = MatchingPolicy(),
    reviews: DataFrame | None = None,
    *,
    hot_rows: int = HOT_NODES,
) -> DataFrame:
    """(id, component): equal to components over all confirmed pairs, officer decisions included."""
    return collapsed_graph(complaints, vectors, policy, reviews, hot_rows=hot_rows).members


def collapsed_graph(
    complaints: DataFrame,
    vectors: DataFrame,
    policy: MatchingPolicy = MatchingPolicy(),
    reviews: DataFrame | None = None,
    *,
    hot_rows: int = HOT_NODES,
) -> CollapsedGraph:
    """Components over all confirmed pairs, officer decisions included, without a list of the pairs.

    Needs ``strong_entity_semantic_threshold`` below 1, so that a vector confirms its own copy. Pairs
    without a usable vector fail the job, as in ``match_pairs``; pairs that share no place mention cannot
    confirm each other and are not looked at.
    """
    if policy.strong_entity_semantic_threshold >= 1:
        raise ValueError("copies only confirm each other below a similarity threshold of 1")
    assigned, _ = write_stage(_assign_nodes(complaints, vectors, policy, reviews))
    release_shuffles(assigned.sparkSession)
    several = assigned.groupBy("node").agg(
            F.min("id").alias("rep"),
            F.count(F.lit(1)).alias("rows"),
            F.min("us").alias("lo"),
            F.max("us").alias("hi"),
            F.min("usable").alias("usable"),
            F.min_by("sketch", "id").alias("sketch"),
            *[
                F.first(c).alias(c)
                for c in ("category", "latitude", "longitude", "bucket", "tokens", "places", "eligible")
            ],
        )
    # copies confirm each other only by vectors that can confirm anything
    sound = F.when((F.col("rows") > 1) & ~F.col("usable"), F.raise_error(F.concat(F.lit("no usable vector for copies of "), "rep")).cast("bigint"))
    # numbered as they are written: pairs of numbers are narrower than pairs of digests
    nodes, _ = write_stage(several.withColumn("rows", F.coalesce(sound, "rows")).withColumn("number", F.monotonically_increasing_id()))
    release_shuffles(nodes.sparkSession)
    found, _ = write_stage(node_links(nodes.filter("eligible"), policy, hot_rows))
    release_shuffles(nodes.sparkSession)
    rejected = approved = None
    if reviews is not None:
        resolved = ordered_pair(reviews.filter(F.col("status") != "pending"))
        final = F.col("final_relationship_state")
        # decided reports are their own nodes, so review pairs address nodes directly
        rejected = resolved.filter(final == NO_MATCH).select("left_id", "right_id")
        approved = among_candidates(resolved.filter(final == AUTO_MATCH), complaints, policy)
    links = found.filter("sure").select("left_id", "right_id")
    unsure = found.filter(~F.col("sure")).select("left_id", "right_id").distinct()
    links = links.unionByName(_exact_links(unsure, nodes, vectors, policy, rejected))
    if approved is not None:
        named = lambda end: nodes.select(F.col("node").alias(f"{end}_id"), F.col("number").alias(f"{end}_number"))
        links = links.unionByName(
            approved.join(named("left"), "left_id").join(named("right"), "right_id").select(
                F.col("left_number").alias("left_id"), F.col("right_number").alias("right_id")
            )
        )
    roots = connected_components(nodes.select(F.col("number").alias("id")), links).toDF("number", "root")
    rooted = nodes.select("number", "node", "rep", "rows").join(roots, "number")
    names = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    return CollapsedGraph(assigned, nodes, rooted.join(names, "root").select("node", "component", "rows"))
