import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from helpers import BASE, complaints, edges, uid

from reportmesh.operators import graph, incidents, priority, read_models, spatial


def assess(spark, rows, links=(), places=(), hours=1):
    df = complaints(spark, rows)
    e = edges(spark, links) if links else edges(spark, [(998, 999, "no_match")]).limit(0)
    members = graph.confirmed_components(df, e).cache()
    place_df = spark.createDataFrame(
        list(places), "place_id string, kind string, latitude double, longitude double"
    )
    inputs = priority.priority_inputs(
        incidents.incident_summary(df, members, e), df, members, place_df,
        F.lit(BASE + dt.timedelta(hours=hours)),
    )
    return priority.assess_priority(inputs)


def levels(df):
    return [(r["priority_level"], r["triggered_rules"]) for r in df.orderBy("component").collect()]


def chain(n, text="nothing special"):
    rows = [(i, text, 3.0, 101.0, 0, "pothole") for i in range(1, n + 1)]
    return rows, [(i, i + 1, "auto_match") for i in range(1, n)]


@pytest.mark.parametrize(
    ("count", "level", "rule"),
    [
        (1, "low", "default_low_priority"),
        (2, "medium", "multi_report_incident"),
        (10, "high", "high_confirmed_report_volume"),
        (20, "critical", "critical_confirmed_report_volume"),
    ],
)
def test_volume(spark, count, level, rule):
    assert levels(assess(spark, *chain(count))) == [(level, [rule])]


@pytest.mark.parametrize(("hours", "level"), [(23.9, "low"), (24, "high"), (48, "critical")])
def test_persistence(spark, hours, level):
    assert levels(assess(spark, *chain(1), hours=hours))[0][0] == level


def test_safety_and_exposure(spark):
    near = [("p1", "Hospital", 3.002, 101.0)]
    rows = [(1, "exposed wire here", 3.0, 101.0, 0, "other")]
    assert levels(assess(spark, rows)) == [("critical", ["critical_safety_signal"])]
    rows = [(1, "jalan blocked", 3.0, 101.0, 0, "other")]
    assert levels(assess(spark, rows)) == [("high", ["high_safety_signal"])]
    rows = [(1, "road is flooding", 3.0, 101.0, 0, "flooding")]
    assert levels(assess(spark, rows, places=near)) == [
        ("critical", ["high_safety_signal", "flooding_near_hospital", "sensitive_location_exposure"])
    ]
    rows = [(1, "pothole", 3.0, 101.0, 0, "pothole")]
    assert levels(assess(spark, rows, places=near))[0][0] == "high"
    assert levels(assess(spark, rows, places=[("p1", "school", 3.003, 101.0)]))[0][0] == "low"


def test_conflict_has_no_operational_priority_and_sorts_last(spark):
    rows, links = chain(3)
    row = assess(spark, rows, [*links, (1, 3, "no_match")]).first()
    assert (row["priority_level"], row["points"], row["operational_priority"]) == (
        "review_required", 0, None,
    )


def test_queue_order_and_totals(spark):
    data = [
        ("i1", "low", 5), ("i2", None, 9), ("i3", "critical", 1), ("i4", "high", 2), ("i5", "low", 7),
        ("i0", "low", 7),
    ]
    df = spark.createDataFrame(data, "incident_id string, operational_priority string, h int")
    df = df.withColumns(
        {"latest_reported_at": F.timestamp_seconds("h"), "status": F.lit("isolated"),
         "category_summary": F.array(F.lit("pothole"))}
    )
    page = read_models.incident_queue(df, limit=4, offset=1).collect()
    assert [r["incident_id"] for r in page] == ["i4", "i0", "i5", "i1"]
    assert {r["total"] for r in page} == {6}
    assert read_models.incident_queue(df, priority="low").count() == 3
    with pytest.raises(ValueError):
        read_models.incident_queue(df, limit=101)


def test_heat_cells_eligibility_ties_and_quantising(spark):
    data = [
        ("a", 1.2349, 103.8769, 2, "confirmed", "low", ["pothole", "flooding"]),
        ("b", 1.2341, 103.8761, 1, "confirmed", "low", ["pothole"]),
        ("c", 1.2341, 103.8761, 9, "conflict", None, ["rubbish"]),
        ("d", -0.0001, 0.0001, 1, "isolated", "critical", ["other", "rubbish"]),
    ]
    df = spark.createDataFrame(
        data,
        "incident_id string, centroid_latitude double, centroid_longitude double, "
        "report_count long, status string, operational_priority string, category_summary array<string>",
    )
    got = {(r["latitude"], r["longitude"]): r for r in spatial.heat_cells(df).collect()}
    assert got[(1.234, 103.876)]["dominant_category"] == "pothole"
    assert got[(1.234, 103.876)]["intensity"] == 0.75
    assert got[(-0.001, 0.0)]["dominant_category"] == "rubbish"
    assert got[(-0.001, 0.0)]["intensity"] == 1.0
    only = spatial.heat_cells(df, category="flooding").collect()
    assert [(r["latitude"], r["intensity"]) for r in only] == [(1.234, 1.0)]


def test_review_order_and_defaults(spark):
    t = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    h = lambda n: t + dt.timedelta(hours=n)
    rows = [
        ("r1", "pending", h(1), None), ("r2", "approved", h(0), h(5)), ("r3", "pending", h(3), None),
        ("r4", "rejected", h(0), h(9)),
    ]
    df = spark.createDataFrame(
        rows, "review_id string, status string, created_at timestamp, resolved_at timestamp"
    )
    assert [r["review_id"] for r in read_models.review_queue(df).collect()] == [
        "r3", "r1", "r4", "r2",
    ]


def test_affected_areas(spark):
    rows = [(uid(1), 3.0, 101.0, 0.0), (uid(2), 3.0, 101.0, 120.0), (uid(3), 3.0, 101.0, -1.0)]
    df = spark.createDataFrame(
        rows,
        "incident_id string, centroid_latitude double, centroid_longitude double, radius_metres double",
    )
    got = {r["incident_id"]: (r["geometry_type"], len(r["ring"])) for r in spatial.affected_areas(df).collect()}
    assert got == {uid(1): ("Point", 1), uid(2): ("Polygon", 65)}


def test_cursor_pages_equal_offset_pages(spark):
    rng = random.Random(6)
    levels = ["critical", "high", "medium", "low", None]
    rows = [
        (f"i{n:03d}", rng.choice(levels), None if n % 7 == 0 else BASE + dt.timedelta(hours=rng.randrange(5)), "isolated", ["pothole"])
        for n in range(60)
    ]
    df = spark.createDataFrame(
        rows, "incident_id string, operational_priority string, latest_reported_at timestamp, status string, category_summary array<string>"
    )
    whole = [r["incident_id"] for r in read_models.incident_queue(df, limit=100).collect()]
    got, last = [], None
    while page := read_models.incident_queue(df, limit=7, after=last).collect():
        got += [r["incident_id"] for r in page]
        last = tuple(page[-1][c] for c in ("priority_rank", "latest_reported_at", "incident_id"))
    assert got == whole and len(got) == 60
    reviews = df.select(
        F.col("incident_id").alias("review_id"), F.when(F.col("operational_priority") == "low", F.lit("approved")).otherwise(F.lit("pending")).alias("status"),
        F.col("latest_reported_at").alias("created_at"), F.col("latest_reported_at").alias("resolved_at"),
    )
    whole = [r["review_id"] for r in read_models.review_queue(reviews, limit=100).collect()]
    got, last = [], None
    while page := read_models.review_queue(reviews, limit=7, after=last).collect():
        got += [r["review_id"] for r in page]
        last = tuple(page[-1][c] for c in ("queue_group", "queue_time", "review_id"))
    assert got == whole and len(got) == 60


def test_crowded_cells_are_split(spark):
    df = complaints(spark, [(n, "a pothole", 3.0 + n * 1e-5, 101.0, 0, "pothole") for n in range(40)])
    members = df.select("id", F.col("id").alias("component"))
    places = spark.createDataFrame([("p", "school", 3.0, 101.0)], "place_id string, kind string, latitude double, longitude double")
    one = priority.exposed_places(df, members, places).collect()
    many = priority.exposed_places(df, members, places, hot_rows=3).collect()
    assert sorted(one) == sorted(many) and len(one) == 40


def test_bad_samples_are_listed(spark):
    from reportmesh.operators import metrics

    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", -1.0), ("d", float("nan")), ("e", float("inf"))], "metric string, value double")
    assert {r["metric"] for r in metrics.invalid_samples(df).collect()} == {"b", "c", "d", "e"}
