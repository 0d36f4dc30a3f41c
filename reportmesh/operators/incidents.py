"""Incident snapshots: identity, summary, contradictions and candidate evidence."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_metres
from ..functions.ids import LANES, digest_lanes, set_digest, uuid5
from ..policy import AUTO_MATCH, NO_MATCH, OTHER, REVIEW_REQUIRED, IdentityPolicy
from .matching import ordered_pair
from .skew import lookup


def incident_ids(members: DataFrame, identity: IdentityPolicy = IdentityPolicy()) -> DataFrame:
    """(component, incident_id, report_count): the id changes exactly when membership changes.

    The name is a mergeable digest of the member set, at every size: map-side combined, and no task
    holds a member list.
    """
    return members.groupBy("component").agg(
        F.count(F.lit(1)).alias("report_count"), set_digest(F.sha2("id", 256)).alias("_digest")
    ).select(
        "component",
        uuid5(F.concat(F.lit(identity.incident_prefix), "_digest")).alias("incident_id"),
        "report_count",
    )


def _labelled(edges: DataFrame, members: DataFrame) -> DataFrame:
    left = members.select(F.col("id").alias("left_id"), F.col("component").alias("left_component"))
    right = members.select(
        F.col("id").alias("right_id"), F.col("component").alias("right_component")
    )
    return edges.join(left, "left_id").join(right, "right_id")


def conflicts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """no_match edges whose ends share a component: (component, left_id, right_id, reason)."""
    return (
        _labelled(edges.filter(F.col("decision") == NO_MATCH), members)
        .filter(F.col("left_component") == F.col("right_component"))
        .select(
            F.col("left_component").alias("component"),
            "left_id",
            "right_id",
            F.concat(
                F.lit("no_match contradicts confirmed component for "),
                F.col("left_id"),
                F.lit(" and "),
                F.col("right_id"),
                F.lit(": "),
                F.array_join("reasons", "; "),
            ).alias("reason"),
        )
    )


def confirmed_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """auto_match edges with the component they belong to (both ends share it by construction)."""
    left = members.select(F.col("id").alias("left_id"), "component")
    return edges.filter(F.col("decision") == AUTO_MATCH).join(left, "left_id")


def review_candidates(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (component, candidate_id): far ends of review edges touching the component.

    An edge inside one component contributes its right end only.
    """
    labelled = _labelled(edges.filter(F.col("decision") == REVIEW_REQUIRED), members)
    seen = F.array(
        F.struct(F.col("left_component").alias("component"), F.col("right_id").alias("candidate_id")),
        F.when(
            F.col("left_component") != F.col("right_component"),
            F.struct(
                F.col("right_component").alias("component"), F.col("left_id").alias("candidate_id")
            ),
        ),
    )
    return (
        labelled.select(F.explode(F.array_compact(seen)).alias("c")).select("c.*").distinct()
    )


def incident_summary(
    complaints: DataFrame,
    members: DataFrame,
    edges: DataFrame | None = None,
    identity: IdentityPolicy = IdentityPolicy(),
    *,
    conflict_counts: DataFrame | None = None,
) -> DataFrame:
    """One row per component. Unbounded lists (members, candidates, reasons) stay separate tables.

    With ``conflict_counts`` (component, conflict_count) no edges are needed; ``pending_count`` is null
    then, as candidates are known from pairs only.
    """
    rows = members.join(
        complaints.select("id", "latitude", "longitude", "reported_at", "category"), "id"
    )
    stats = rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.avg("latitude").alias("centroid_latitude"),
        F.avg("longitude").alias("centroid_longitude"),
        F.min("reported_at").alias("earliest_reported_at"),
        F.max("reported_at").alias("latest_reported_at"),
        F.array_sort(F.collect_set(F.coalesce("category", F.lit(OTHER)))).alias("category_summary"),
    )
    several = stats.filter(F.col("_rows") > 1).select(
        "component", "centroid_latitude", "centroid_longitude", "_rows"
    )
    radii = (
        lookup(rows, several, ["component"], spread_by="id", row_count="_rows")
        .groupBy("component")
        .agg(
            F.max(
                haversine_metres(
                    F.col("centroid_latitude"),
                    F.col("centroid_longitude"),
                    F.col("latitude"),
                    F.col("longitude"),
                )
            ).alias("radius_metres")
        )
    )
    out = (
        incident_ids(members, identity)
        .join(stats.drop("_rows"), "component")
        .join(radii, "component", "left")
        .withColumn("radius_metres", F.coalesce("radius_metres", F.lit(0.0)))
    )
    if conflict_counts is not None:
        counted = out.join(conflict_counts, "component", "left")
        return counted.withColumns(
            {"conflict_count": F.coalesce("conflict_count", F.lit(0).cast("bigint")), "pending_count": F.lit(None).cast("bigint")}
        ).withColumn("status", incident_status())
    if edges is None:
        return out.withColumns(
            {"conflict_count": F.lit(0).cast("bigint"), "pending_count": F.lit(0).cast("bigint")}
        ).withColumn("status", incident_status())
    clash = conflicts(edges, members).groupBy("component").agg(F.count(F.lit(1)).alias("conflict_count"))
    pending = (
        review_candidates(edges, members)
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("pending_count"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        out.join(clash, "component", "left")
        .join(pending, "component", "left")
        .withColumns(
            {
                "conflict_count": F.coalesce("conflict_count", zero),
                "pending_count": F.coalesce("pending_count", zero),
            }
        )
        .withColumn("status", incident_status())
    )


def incident_status() -> Column:
    """conflict beats confirmed beats isolated; more than one member means a confirmed edge."""
    return (
        F.when(F.col("conflict_count") > 0, F.lit("conflict"))
        .when(F.col("report_count") > 1, F.lit("confirmed"))
        .otherwise(F.lit("isolated"))
    )


def incident_members(members: DataFrame, ids: DataFrame) -> DataFrame:
    """(incident_id, id): the membership table."""
    return lookup(
        members,
        ids.select("component", "incident_id", "report_count"),
        ["component"],
        spread_by="id",
        row_count="report_count",
    ).select("incident_id", "id")


def _edge_digest() -> Column:
    return F.sha2(F.concat_ws(":", "left_id", "right_id", "decision"), 256)


def graph_version(edges: DataFrame) -> DataFrame:
    """One-row digest of the decided graph, independent of row order and edge direction."""
    return ordered_pair(edges).agg(
        set_digest(_edge_digest()).alias("graph_version"), F.count(F.lit(1)).alias("edge_count")
    )


@dataclass(frozen=True)
class GraphSums:
    """The sums behind a graph version: those of added edges are added, of removed ones taken away."""

    count: int = 0
    lanes: tuple[int, ...] = (0,) * LANES

    @classmethod
    def of(cls, stored: dict | None) -> GraphSums:
        return cls() if stored is None else cls(int(stored["count"]), tuple(int(x) for x in stored["lanes"]))

    def __add__(self, other: GraphSums) -> GraphSums:
        return GraphSums(self.count + other.count, tuple(a + b for a, b in zip(self.lanes, other.lanes)))

    def __sub__(self, other: GraphSums) -> GraphSums:
        return GraphSums(self.count - other.count, tuple(a - b for a, b in zip(self.lanes, other.lanes)))

    def version(self) -> str:
        """Equal to ``graph_version`` of the edges summed."""
        lanes = self.lanes if self.count else ()
        return hashlib.sha256(":".join(map(str, (self.count, *lanes))).encode()).hexdigest()


def graph_sums(edges: DataFrame) -> GraphSums:
    """Sums of the given edges; one row reaches the driver."""
    sums = [F.sum(lane) for lane in digest_lanes(_edge_digest())]
    row = ordered_pair(edges).agg(F.count(F.lit(1)), *sums).first()
    return GraphSums(row[0], tuple(int(x or 0) for x in row[1:]))
