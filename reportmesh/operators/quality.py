"""Integrity reports. Each check returns the violating rows; an empty result means sound data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import set_digest
from ..functions.vectors import is_usable


def row_digest(*columns: Column) -> Column:
    """SHA-256 of one row; NULL and empty text stay different."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def content_checksum(df: DataFrame, columns: list[Column]) -> DataFrame:
    """One-row checksum of a table, independent of row order, merged across partitions."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), set_digest(row_digest(*columns)).alias("checksum")
    )


def manifest_violations(manifest: DataFrame, expected: dict[str, str | int]) -> DataFrame:
    """(field, found, expected) for every manifest field that disagrees."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.col(name).cast("string").alias("found"),
                F.lit(str(value)).alias("expected"),
            )
            for name, value in expected.items()
        ]
    )
    return manifest.select(F.inline(rows)).filter(~F.col("found").eqNullSafe(F.col("expected")))


def require_empty(violations: DataFrame, message: str) -> None:
    """Fail the job before anything is published."""
    sample = violations.limit(1).collect()
    if sample:
        raise ValueError(f"{message}: {sample[0].asDict()}")


def check_coverage(members: DataFrame, complaints: DataFrame) -> DataFrame:
    """Every complaint in exactly one incident, every member known: (violation, id)."""
    known = complaints.select("id")
    tag = lambda df, name: df.select(F.lit(name).alias("violation"), "id")
    unknown = members.join(known, "id", "left_anti").distinct()
    uncovered = known.join(members, "id", "left_anti")
    repeated = members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        tag(unknown, "unknown_member")
        .unionByName(tag(uncovered, "uncovered_complaint"))
        .unionByName(tag(repeated, "member_of_several_incidents"))
    )


def check_edges(edges: DataFrame, complaints: DataFrame) -> DataFrame:
    """Self loops, unknown ends and contradictory duplicates: (violation, left_id, right_id)."""
    pairs = edges.select(
        F.least("left_id", "right_id").alias("left_id"),
        F.greatest("left_id", "right_id").alias("right_id"),
        "decision",
    )
    known = complaints.select("id")
    out = lambda df, name: df.select(
        F.lit(name).alias("violation"), "left_id", "right_id"
    )
    loops = (
        pairs.filter(F.col("left_id") == F.col("right_id")).select("left_id", "right_id").distinct()
    )
    ends = pairs.select("left_id", "right_id", F.explode(F.array("left_id", "right_id")).alias("id"))
    unknown = ends.join(known, "id", "left_anti").select("left_id", "right_id").distinct()
    contradictory = (
        pairs.groupBy("left_id", "right_id")
        .agg(F.min("decision").alias("lo"), F.max("decision").alias("hi"))
        .filter(F.col("lo") != F.col("hi"))
    )
    return (
        out(loops, "self_relationship")
        .unionByName(out(unknown, "unknown_endpoint"))
        .unionByName(out(contradictory, "contradictory_duplicate"))
    )


def check_embeddings(
    vectors: DataFrame, complaints: DataFrame, dimension: int | None = None
) -> DataFrame:
    """Unusable or wrongly sized vectors and id mismatches: (violation, id).

    Without ``dimension`` the smallest size present is the reference.
    """
    known, have = complaints.select("id"), vectors.select("id")
    sized = vectors.select(
        "id", F.size("vector").alias("size"), is_usable(F.col("vector")).alias("usable")
    )
    want = F.lit(dimension) if dimension is not None else sized.agg(F.min("size")).scalar()
    tag = lambda df, name: df.select(F.lit(name).alias("violation"), "id")
    return (
        tag(sized.filter(~F.col("usable")), "unusable_vector")
        .unionByName(tag(sized.filter(F.col("size") != want), "dimension_mismatch"))
        .unionByName(tag(known.join(have, "id", "left_anti"), "missing_vector"))
        .unionByName(tag(have.join(known, "id", "left_anti"), "vector_without_complaint"))
    )


def id_set_difference(left: DataFrame, right: DataFrame, column: str = "id") -> DataFrame:
    """Ids on one side only; empty means the sets are equal. Duplicates count."""
    a, b = left.select(F.col(column).alias("id")), right.select(F.col(column).alias("id"))
    only_left = a.exceptAll(b).withColumn("side", F.lit("left_only"))
    only_right = b.exceptAll(a).withColumn("side", F.lit("right_only"))
    return only_left.unionByName(only_right)


def table_health(
    complaints: DataFrame, incidents: DataFrame, *, policy_ok: bool, photos_ok: bool | None = None
) -> DataFrame:
    """One row: component states and the overall healthy / degraded / unavailable verdict."""
    counts = complaints.agg(F.count(F.lit(1)).alias("complaint_count")).select(
        "complaint_count", incidents.agg(F.count(F.lit(1))).scalar().alias("incident_count")
    )
    state = lambda ok: F.when(ok, F.lit("healthy")).otherwise(F.lit("unavailable"))
    seeded = (F.col("complaint_count") > 0) & (F.col("incident_count") > 0)
    core = seeded & F.lit(policy_ok)
    photo = "healthy" if photos_ok else "degraded"
    return counts.select(
        "complaint_count",
        "incident_count",
        state(seeded).alias("data_state"),
        state(F.lit(policy_ok)).alias("policy_state"),
        F.lit(photo).alias("photo_state"),
        core.alias("core_ready"),
        F.when(~core, F.lit("unavailable")).otherwise(F.lit(photo)).alias("status"),
    )
