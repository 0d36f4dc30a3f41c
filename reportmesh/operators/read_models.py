"""Read side: filters, ranked pages, evidence previews and view projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import OTHER
from .skew import lookup

PAGE_MIN, PAGE_MAX, PAGE_DEFAULT = 1, 100, 50
_SERVER_PHOTO = (
    r"^uploads/([0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})\.(?:jpg|png)$"
)
PHOTO_ROUTE = "/api/v1/photos/"


def photo_url(photo_path: Column) -> Column:
    """Public URL of a server-managed photo; free-text paths have none."""
    photo_id = F.regexp_extract(photo_path, _SERVER_PHOTO, 1)
    return F.when(photo_id != "", F.concat(F.lit(PHOTO_ROUTE), photo_id))


def filter_incidents(
    incidents: DataFrame,
    *,
    status: str | None = None,
    priority: str | None = None,
    category: str | None = None,
) -> DataFrame:
    """Optional filters; an incident without operational priority never matches a priority."""
    if status is not None:
        incidents = incidents.filter(F.col("status") == status)
    if priority is not None:
        incidents = incidents.filter(F.col("operational_priority") == priority)
    if category is not None:
        incidents = incidents.filter(F.array_contains("category_summary", category))
    return incidents


def filter_reviews(reviews: DataFrame, status: str | None = None) -> DataFrame:
    return reviews if status is None else reviews.filter(F.col("status") == status)


def priority_rank(level: Column) -> Column:
    return (
        F.when(level == "critical", 3)
        .when(level == "high", 2)
        .when(level == "medium", 1)
        .when(level == "low", 0)
        .otherwise(-1)
    )


def check_page(limit: int, offset: int) -> None:
    if not PAGE_MIN <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be between {PAGE_MIN} and {PAGE_MAX}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def beyond(order: list[tuple[Column, bool]], cursor: tuple) -> Column:
    """Rows that follow ``cursor`` in an order of (column, descending); nulls come last."""
    later, same = F.lit(False), F.lit(True)
    for (column, descending), value in zip(order, cursor, strict=True):
        if value is None:  # only nulls are left, and they are equal
            same = same & column.isNull()
            continue
        ahead = column < F.lit(value) if descending else column > F.lit(value)
        later = later | (same & F.coalesce(ahead, F.lit(True)))
        same = same & column.eqNullSafe(F.lit(value))
    return later


def incident_queue(
    incidents: DataFrame,
    *,
    limit: int = PAGE_DEFAULT,
    offset: int = 0,
    after: tuple | None = None,
    **filters: str | None,
) -> DataFrame:
    """One page of the ranked queue; ``total`` counts every row the filters keep.

    A small limit after a sort runs as a distributed top-k, not as a full sort. A deep page should
    name the last row of the page before, ``after`` = (priority_rank, latest_reported_at,
    incident_id): it costs no more than the first, while an ``offset`` gathers all rows it skips
    (``streaming/published.py`` has an index for pages at any offset).
    """
    check_page(limit, offset)
    kept = filter_incidents(incidents, **filters)
    total = kept.agg(F.count(F.lit(1))).scalar()
    ranked = kept.withColumn("priority_rank", priority_rank(F.col("operational_priority")))
    if after is not None:
        order = [(F.col("priority_rank"), True), (F.col("latest_reported_at"), True), (F.col("incident_id"), False)]
        ranked = ranked.filter(beyond(order, after))
    page = (
        ranked.orderBy(F.desc("priority_rank"), F.desc("latest_reported_at"), "incident_id")
        .offset(offset)
        .limit(limit)
    )
    return page.withColumn("total", total)


def review_queue(
    reviews: DataFrame,
    *,
    status: str | None = None,
    limit: int = PAGE_DEFAULT,
    offset: int = 0,
    after: tuple | None = None,
) -> DataFrame:
    """Pending first by creation, then resolved by resolution time, newest first.

    ``after`` = (queue_group, queue_time, review_id) of the last row before a deep page.
    """
    check_page(limit, offset)
    kept = filter_reviews(reviews, status)
    pending = F.col("status") == "pending"
    total = kept.agg(F.count(F.lit(1))).scalar()
    ranked = kept.withColumn("queue_group", F.when(pending, 0).otherwise(1)).withColumn(
        "queue_time", F.when(pending, F.col("created_at")).otherwise(F.col("resolved_at"))
    )
    if after is not None:
        order = [(F.col("queue_group"), False), (F.col("queue_time"), True), (F.col("review_id"), False)]
        ranked = ranked.filter(beyond(order, after))
    page = (
        ranked.orderBy("queue_group", F.desc_nulls_last("queue_time"), "review_id")
        .offset(offset)
        .limit(limit)
    )
    return page.withColumn("total", total)


def first_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per group.

    Spark cuts each map task's groups to ``n`` rows before the shuffle, so even a huge group
    reaches its reducer as a handful of rows.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def incident_evidence(
    incidents: DataFrame, members: DataFrame, complaints: DataFrame
) -> DataFrame:
    """(incident_id, complaint columns) for every member of the given incidents."""
    wanted = lookup(
        members,
        incidents.select("component", "incident_id", "report_count"),
        ["component"],
        spread_by="id",
        row_count="report_count",
    ).select("incident_id", "id")
    return wanted.join(complaints, "id").select(
        "incident_id",
        F.col("id").alias("complaint_id"),
        "text",
        F.coalesce("category", F.lit(OTHER)).alias("category"),
        "latitude",
        "longitude",
        "reported_at",
        F.col("photo_path").isNotNull().alias("photo_available"),
        photo_url(F.col("photo_path")).alias("photo_url"),
    )


def evidence_preview(
    incidents: DataFrame, members: DataFrame, complaints: DataFrame, limit: int = 3
) -> DataFrame:
    """First members per incident by id with total and has_more.

    Only ids are ranked; texts are joined to the few survivors.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    first = first_per_group(members, ["component"], [F.col("id")], limit)
    total = F.col("report_count")
    return (
        first.join(incidents.select("component", "incident_id", "report_count"), "component")
        .join(complaints.select("id", "text"), "id")
        .select(
            "incident_id",
            F.col("id").alias("complaint_id"),
            "position",
            "text",
            total.alias("total"),
            (total > limit).alias("has_more"),
        )
    )


def incident_summary_view(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        "incident_id",
        "status",
        F.array_join("category_summary", ",").alias("category_summary"),
        F.col("operational_priority").alias("priority"),
        F.col("report_count").alias("confirmed_report_count"),
        F.col("pending_count").alias("pending_candidate_count"),
        "centroid_latitude",
        "centroid_longitude",
        "radius_metres",
        "earliest_reported_at",
        "latest_reported_at",
        "conflict_count",
    )


def hotspots(incidents: DataFrame) -> DataFrame:
    """Confirmed incidents for the map."""
    return incidents.filter(F.col("status") == "confirmed").select(
        "incident_id",
        F.col("centroid_latitude").alias("latitude"),
        F.col("centroid_longitude").alias("longitude"),
        F.col("report_count").alias("confirmed_reports"),
        F.col("pending_count").alias("pending_candidates"),
        F.coalesce("operational_priority", F.lit("No operational priority")).alias("priority"),
    )


def review_view(reviews: DataFrame) -> DataFrame:
    """Reviewer-facing labels with their defaults."""
    return reviews.select(
        "review_id",
        "status",
        F.col("matcher_recommendation").alias("original_recommendation"),
        F.coalesce("final_relationship_state", F.lit("pending")).alias("final_relationship_state"),
        F.coalesce("decision_source", F.lit("matcher")).alias("decision_source"),
        F.coalesce("reviewed_by", F.lit("Unassigned")).alias("reviewer_id"),
        F.coalesce(F.date_format("resolved_at", "yyyy-MM-dd HH:mm:ss"), F.lit("Unresolved")).alias(
            "resolved_at"
        ),
        F.coalesce("review_note", F.lit("No note")).alias("review_note"),
    )


def review_read(reviews: DataFrame, complaints: DataFrame) -> DataFrame:
    """Reviews with both reports. A dangling review stays, with nulls (see ``dangling_reviews``)."""
    side = lambda p: complaints.select(
        F.col("id").alias(f"{p}_id"),
        F.col("text").alias(f"{p}_text"),
        F.coalesce("category", F.lit(OTHER)).alias(f"{p}_category"),
        F.col("latitude").alias(f"{p}_latitude"),
        F.col("longitude").alias(f"{p}_longitude"),
        F.col("reported_at").alias(f"{p}_reported_at"),
    )
    return reviews.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")


def dangling_reviews(reviews: DataFrame, complaints: DataFrame) -> DataFrame:
    ids = complaints.select("id")
    ends = reviews.select("review_id", F.explode(F.array("left_id", "right_id")).alias("id"))
    return ends.join(ids, "id", "left_anti")


def mutation_result_view(results: DataFrame) -> DataFrame:
    """Presentation of a resolved review: label, priority availability, id lists.

    Needs conflict (boolean), priorities (array), previous_ids and new_ids (arrays).
    """
    conflict = F.col("conflict")
    missing = conflict | F.exists("priorities", lambda p: p.isNull())
    return results.select(
        "review_id",
        F.when(conflict, F.lit("warning")).otherwise(F.lit("success")).alias("presentation"),
        F.when(
            conflict,
            F.lit("Review was recorded, but the resulting incident graph is conflicted."),
        )
        .otherwise(F.lit("Review resolution recorded."))
        .alias("message"),
        F.when(missing, F.lit("unavailable")).otherwise(F.lit("available")).alias("priority"),
        F.array_join("previous_ids", ",").alias("previous_snapshot_ids"),
        F.array_join("new_ids", ",").alias("new_snapshot_ids"),
    )


def submission_lookup(keys: DataFrame, complaints: DataFrame) -> DataFrame:
    """Stored submission records: key, fingerprint and the complaint it created."""
    return keys.join(complaints.withColumnRenamed("id", "complaint_id"), "complaint_id")
