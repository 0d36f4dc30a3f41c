"""Safety evidence, exposure to sensitive places, and the operational priority ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_metres
from ..functions.text import safety_hits
from ..policy import PRIORITY_LEVELS, PriorityPolicy
from .candidates import GeoGrid, split_hot_blocks

RANK_NAMES = ("low", "medium", "high", "critical")


def safety_matches(complaints: DataFrame, members: DataFrame) -> DataFrame:
    """(component, id, signal, term): one row per hit. Reports without hits stop before the join."""
    # outer: a plain explode would make the optimizer evaluate the hits twice, as a size filter too
    hits = complaints.select(
        "id", F.explode_outer(safety_hits(F.col("normalized_text"))).alias("h")
    ).filter(F.col("h").isNotNull())
    return hits.select("id", "h.signal", "h.term").join(members, "id")


def safety_signals(complaints: DataFrame, members: DataFrame) -> DataFrame:
    """Per component and signal: distinct reports and distinct terms (at most six)."""
    return (
        safety_matches(complaints, members)
        .groupBy("component", "signal")
        .agg(
            F.count_distinct("id").alias("complaint_count"),
            F.array_sort(F.collect_set("term")).alias("matched_terms"),
        )
    )


def exposed_places(
    complaints: DataFrame,
    members: DataFrame,
    places: DataFrame,
    policy: PriorityPolicy = PriorityPolicy(),
    hot_rows: int = 500_000,
) -> DataFrame:
    """Distinct (component, place_id, kind) within the radius of any member.

    Grid equi-join: every report sits in one cell, every place visits the cells around it. Crowded
    cells are split, as in the pair join.
    """
    radius = policy.sensitive_location_radius_metres
    grid = GeoGrid(radius)
    spots = (
        complaints.select("id", "latitude", "longitude")
        .withColumn("band", grid.band(F.col("latitude")))
        .withColumn("cell", grid.cell(F.col("longitude"), grid.cells_in(F.col("band"))))
    )
    around = (
        places.select(
            "place_id", "kind", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon")
        )
        .withColumn("band", F.explode_outer(grid.bands_near(F.col("p_lat"))))
        .withColumn(
            "cell",
            F.explode_outer(
                grid.cells_near(F.col("p_lat"), F.col("p_lon"), grid.cells_in(F.col("band")))
            ),
        )
    )
    spots, around = split_hot_blocks(spots, around, ["band", "cell"], "id", hot_rows)
    near = (
        spots.join(around, ["band", "cell", "_split"])
        .filter(
            haversine_metres(F.col("latitude"), F.col("longitude"), F.col("p_lat"), F.col("p_lon"))
            <= radius
        )
        .select("id", "place_id", "kind")
    )
    return near.join(members, "id").select("component", "place_id", "kind").distinct()


def sensitive_exposure(
    complaints: DataFrame,
    members: DataFrame,
    places: DataFrame,
    policy: PriorityPolicy = PriorityPolicy(),
) -> DataFrame:
    return (
        exposed_places(complaints, members, places, policy)
        .groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("sensitive_count"),
            F.max(F.lower("kind") == "hospital").alias("has_hospital"),
        )
    )


def priority_inputs(
    incidents: DataFrame,
    complaints: DataFrame,
    members: DataFrame,
    places: DataFrame,
    now: Column,
    policy: PriorityPolicy = PriorityPolicy(),
) -> DataFrame:
    """Incident rows with every number the ladder reads. ``now`` is explicit: priorities age."""
    safety = (
        safety_signals(complaints, members)
        .groupBy("component")
        .agg(F.array_sort(F.collect_set("signal")).alias("safety_names"))
    )
    photos = (
        complaints.filter(F.col("photo_path").isNotNull())
        .select("id")
        .join(members, "id")
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("photo_count"))
    )
    exposure = sensitive_exposure(complaints, members, places, policy)
    zero = F.lit(0).cast("bigint")
    elapsed = (F.unix_micros(now) - F.unix_micros("earliest_reported_at")) / F.lit(3.6e9)
    return (
        incidents.join(safety, "component", "left")
        .join(photos, "component", "left")
        .join(exposure, "component", "left")
        .withColumns(
            {
                "safety_names": F.coalesce("safety_names", F.array().cast("array<string>")),
                "photo_count": F.coalesce("photo_count", zero),
                "sensitive_count": F.coalesce("sensitive_count", zero),
                "has_hospital": F.coalesce("has_hospital", F.lit(False)),
                "unresolved_hours": F.greatest(F.lit(0.0), elapsed),
            }
        )
        .withColumn("evidence_completeness", F.col("photo_count") / F.col("report_count"))
    )


def priority_signals(inputs: DataFrame, policy: PriorityPolicy = PriorityPolicy()) -> DataFrame:
    """Long table: six signals per incident with value, normalised value, trigger and reasons."""
    count, hours = F.col("report_count"), F.col("unresolved_hours")
    pending, places = F.col("pending_count"), F.col("sensitive_count")
    safety, photos = F.size("safety_names"), F.col("evidence_completeness")

    def signal(name: str, value: Column, normalized: Column, triggered: Column, reasons=None):
        return F.struct(
            F.lit(name).alias("name"),
            value.cast("string").alias("value"),
            normalized.cast("double").alias("normalized_value"),
            triggered.alias("triggered"),
            (F.array().cast("array<string>") if reasons is None else reasons).alias("reasons"),
        )

    rows = F.array(
        signal(
            "confirmed_report_count",
            count,
            F.least(count / policy.critical_report_count, F.lit(1.0)),
            count >= policy.medium_report_count,
            F.array(F.lit("review candidates are excluded")),
        ),
        signal(
            "pending_candidate_count",
            pending,
            pending,
            F.lit(False),
            F.array(F.lit("candidate evidence is not scored")),
        ),
        signal(
            "unresolved_hours",
            F.format_string("%.1f", hours),
            F.least(hours / policy.critical_unresolved_hours, F.lit(1.0)),
            hours >= policy.high_unresolved_hours,
        ),
        signal(
            "safety_signal_count",
            safety,
            F.least(safety, F.lit(1)),
            safety > 0,
            F.col("safety_names"),
        ),
        signal("sensitive_location_count", places, F.least(places, F.lit(1)), places > 0),
        signal(
            "evidence_completeness",
            F.format_string("%.2f", photos),
            photos,
            photos >= policy.evidence_completeness_threshold,
            F.array(
                F.concat(
                    F.col("photo_count").cast("string"),
                    F.lit("/"),
                    count.cast("string"),
                    F.lit(" confirmed reports include photos"),
                )
            ),
        ),
    )
    return inputs.select("incident_id", F.inline(rows))


def assess_priority(inputs: DataFrame, policy: PriorityPolicy = PriorityPolicy()) -> DataFrame:
    """Level, points, rules and reasons. Candidates and photos never change the level."""
    count, hours = F.col("report_count"), F.col("unresolved_hours")
    names, places = F.col("safety_names"), F.col("sensitive_count")
    hours_text = F.concat(
        F.lit("incident unresolved for "), F.format_string("%.1f", hours), F.lit(" hours")
    )

    def overlap(signals: tuple[str, ...]) -> Column:
        return F.array_intersect(names, F.array(*[F.lit(s) for s in sorted(signals)]))

    def volume(tail: str) -> Column:
        return F.concat(count.cast("string"), F.lit(f" confirmed reports {tail}"))

    critical, high = overlap(policy.critical_safety_signals), overlap(policy.high_safety_signals)
    # Groups of (condition, rank, rule, reason); in a group the first condition wins.
    groups = [
        [
            (
                count >= policy.critical_report_count, 3, "critical_confirmed_report_volume",
                volume("reached the critical volume threshold"),
            ),
            (
                count >= policy.high_report_count, 2, "high_confirmed_report_volume",
                volume("reached the high volume threshold"),
            ),
            (
                count >= policy.medium_report_count, 1, "multi_report_incident",
                volume("indicate a multi-report incident"),
            ),
        ],
        [
            (hours >= policy.critical_unresolved_hours, 3, "critical_persistence", hours_text),
            (hours >= policy.high_unresolved_hours, 2, "high_persistence", hours_text),
        ],
        [
            (
                F.size(critical) > 0, 3, "critical_safety_signal",
                F.concat(F.lit("critical safety signal: "), F.array_join(critical, ", ")),
            ),
            (
                F.size(high) > 0, 2, "high_safety_signal",
                F.concat(F.lit("safety signal: "), F.array_join(high, ", ")),
            ),
        ],
        [
            (
                F.array_contains(names, "active_flooding") & F.col("has_hospital"), 3,
                "flooding_near_hospital",
                F.lit("active flooding signal is within the configured hospital exposure radius"),
            )
        ],
        [
            (
                places > 0, 2, "sensitive_location_exposure",
                F.concat(
                    F.lit("confirmed incident is near "), places.cast("string"),
                    F.lit(" sensitive location(s)"),
                ),
            )
        ],
    ]

    def first_of(group, pick) -> Column:
        out = F
        for row in group:
            value = pick(row)
            out = out.when(row[0], value)
        return out.otherwise(F.lit(None))

    ranks = [first_of(g, lambda r: F.lit(r[1])) for g in groups]
    rank = F.greatest(F.lit(-1), *ranks)
    escalated = rank >= 0
    rules = F.array_compact(F.array(*[first_of(g, lambda r: F.lit(r[2])) for g in groups]))
    reasons = F.array_compact(F.array(*[first_of(g, lambda r: r[3]) for g in groups]))
    info = F.array_compact(
        F.array(
            F.when(
                F.col("pending_count") > 0,
                F.concat(
                    F.col("pending_count").cast("string"),
                    F.lit(" review candidate(s) pending; excluded from priority"),
                ),
            ),
            F.when(
                F.col("evidence_completeness") >= policy.evidence_completeness_threshold,
                F.concat(
                    F.lit("evidence completeness is "),
                    F.format_string("%.2f", F.col("evidence_completeness")),
                    F.lit("; this is informational only"),
                ),
            ),
        )
    )
    conflict = F.col("status") == "conflict"
    points = F.greatest(rank, F.lit(0))
    level = F.element_at(F.array(*[F.lit(n) for n in RANK_NAMES]), points + 1)
    return inputs.withColumns(
        {
            "priority_level": F.when(conflict, F.lit("review_required")).otherwise(level),
            "priority_status": F.when(conflict, F.lit("review_required")).otherwise(F.lit("scored")),
            "points": F.when(conflict, F.lit(0)).otherwise(points),
            "triggered_rules": F.when(
                conflict, F.array(F.lit("clustering_conflict_requires_review"))
            )
            .when(escalated, rules)
            .otherwise(F.array(F.lit("default_low_priority"))),
            "priority_reasons": F.when(
                conflict,
                F.array(
                    F.lit("clustering conflict prevents normal priority assignment"),
                    F.concat(
                        F.col("conflict_count").cast("string"),
                        F.lit(" contradiction(s); see the conflict table"),
                    ),
                ),
            ).otherwise(
                F.concat(
                    F.when(escalated, reasons).otherwise(
                        F.array(F.lit("no configured escalation rule was triggered"))
                    ),
                    info,
                )
            ),
            "policy_version": F.lit(policy.policy_version),
            # read models show no operational priority for a contradicted incident
            "operational_priority": F.when(~conflict, level),
        }
    )


#: What ``assess_priority`` adds to its inputs, and what depends on the time of asking.
SCORED = (
    "priority_level", "priority_status", "points", "triggered_rules", "priority_reasons",
    "policy_version", "operational_priority",
)


def with_rises(assessed: DataFrame, policy: PriorityPolicy = PriorityPolicy()) -> DataFrame:
    """Assessed incidents with ``rises``: the times at which age alone raises their level, and to what.

    At most two; none for a contradicted incident. The level without age is that of age zero.
    """
    fresh = assess_priority(assessed.drop(*SCORED).withColumn("unresolved_hours", F.lit(0.0)), policy)
    steps = ((policy.high_unresolved_hours, 2), (policy.critical_unresolved_hours, 3))

    def step(hours: float, rank: int) -> Column:
        at = F.timestamp_micros((F.unix_micros("earliest_reported_at") + F.lit(round(hours * 3.6e9))).cast("bigint"))
        rise = F.struct(at.alias("at"), F.lit(RANK_NAMES[rank]).alias("level"))
        return F.when((F.col("status") != "conflict") & (F.col("points") < rank), rise)

    rises = F.array_compact(F.array(*[step(*s) for s in steps]))
    return assessed.join(fresh.select("component", rises.alias("rises")), "component")


def assess_at(stored: DataFrame, now: Column, policy: PriorityPolicy = PriorityPolicy()) -> DataFrame:
    """Stored incidents (inputs kept beside the verdict) as of ``now``: no report is read again."""
    elapsed = (F.unix_micros(now) - F.unix_micros("earliest_reported_at")) / F.lit(3.6e9)
    inputs = stored.drop(*SCORED).withColumn("unresolved_hours", F.greatest(F.lit(0.0), elapsed))
    return assess_priority(inputs, policy)


def risen(stored: DataFrame, since: Column, until: Column) -> DataFrame:
    """(component, at, level): incidents that age raised after ``since``, up to ``until``, by change points."""
    rises = stored.select("component", F.explode("rises").alias("r")).select("component", "r.at", "r.level")
    return rises.filter((F.col("at") > since) & (F.col("at") <= until))


def counts_over_domain(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Row counts per value of a fixed domain, zeros included, in one narrow aggregate."""
    sums = [F.count_if(F.col(column) == value).alias(value) for value in domain]
    pairs = F.array(
        *[F.struct(F.lit(v).alias("value"), F.col(v).alias("count")) for v in domain]
    )
    return df.agg(*sums).select(F.inline(pairs))


def priority_counts(assessed: DataFrame) -> DataFrame:
    return counts_over_domain(assessed, "priority_level", PRIORITY_LEVELS)
