"""Small fixtures shared by the tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmesh.functions.geo import haversine_metres, temporal_gap_seconds
from reportmesh.operators.intake import to_complaints
from reportmesh.policy import OTHER, MatchingPolicy

BASE = dt.datetime(2026, 7, 12, 8, 0, tzinfo=dt.timezone.utc)


def uid(n: int) -> str:
    return f"00000000-0000-0000-0000-{n:012d}"


def complaints(spark, rows) -> DataFrame:
    """rows: (n, text, lat, lon, hours, category[, photo])."""
    full = [
        (uid(r[0]), r[1], float(r[2]), float(r[3]), BASE + dt.timedelta(hours=r[4]), r[5],
         r[6] if len(r) > 6 else None)
        for r in rows
    ]
    schema = (
        "id string, text string, latitude double, longitude double, reported_at timestamp, "
        "category string, photo_path string"
    )
    return to_complaints(spark.createDataFrame(full, schema))


def edges(spark, rows) -> DataFrame:
    """rows: (left n, right n, decision)."""
    data = [(uid(a), uid(b), d) for a, b, d in rows]
    return spark.createDataFrame(data, "left_id string, right_id string, decision string").withColumns(
        {"reasons": F.array(F.lit("r")), "decision_source": F.lit("automated"),
         "matcher_recommendation": F.lit(None).cast("string")}
    )


def union_find(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def brute_force_pairs(complaints: DataFrame, policy=MatchingPolicy()) -> DataFrame:
    """Definition of the candidate join: every pair is tested. For small fixtures only."""
    a, b = complaints.alias("a"), complaints.alias("b")
    left_cat = F.coalesce(F.col("a.category"), F.lit(OTHER))
    right_cat = F.coalesce(F.col("b.category"), F.lit(OTHER))
    distance = haversine_metres(
        F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude")
    )
    gap = temporal_gap_seconds(F.col("a.reported_at"), F.col("b.reported_at"))
    return a.join(
        b,
        (F.col("a.id") < F.col("b.id"))
        & ((left_cat == right_cat) | (left_cat == OTHER) | (right_cat == OTHER))
        & (distance <= policy.geographic_radius_metres)
        & (gap <= policy.window_seconds),
    ).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))
