"""Pair evidence, the ordered match decision, officer overrides, and edge hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_metres, temporal_gap_seconds
from ..functions.locations import compare_location_sets, location_sets
from ..functions.vectors import cosine_from_parts, norm
from ..policy import AUTO_MATCH, NO_MATCH, OTHER, REVIEW_REQUIRED, MatchingPolicy


def evidence_table(complaints: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Per-report evidence prepared once: place sets, and the vector with its norm.

    Reports without a vector keep their row: their pairs fail in ``match_pairs`` instead of vanishing.
    """
    df = complaints.select("id", location_sets(F.col("locations")).alias("places"))
    if vectors is not None:
        df = df.join(
            vectors.select("id", "vector", norm(F.col("vector")).alias("vector_norm")), "id", "left"
        )
    return df


def attach_evidence(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of both ends as ``left`` / ``right`` structs: two equi-joins on the id."""
    packed = F.struct(*[c for c in evidence.columns if c != "id"])
    left = evidence.select(F.col("id").alias("left_id"), packed.alias("left"))
    right = evidence.select(F.col("id").alias("right_id"), packed.alias("right"))
    return pairs.join(left, "left_id", "left").join(right, "right_id", "left")


def unusable_pairs(scored: DataFrame) -> DataFrame:
    """Scored pairs without a similarity: a vector is missing or unusable on one side."""
    return scored.filter(F.col("semantic_similarity").isNull()).select("left_id", "right_id")


def score_pairs(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pairs with cosine similarity and place comparison; wide evidence is dropped again."""
    wide = attach_evidence(pairs, evidence)
    return wide.select(
        *pairs.columns,
        cosine_from_parts(
            F.col("left.vector"),
            F.col("left.vector_norm"),
            F.col("right.vector"),
            F.col("right.vector_norm"),
        ).alias("semantic_similarity"),
        compare_location_sets(F.col("left.places"), F.col("right.places")).alias("location"),
    )


def _decimals(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def match_pairs(scored: DataFrame, policy: MatchingPolicy = MatchingPolicy()) -> DataFrame:
    """Ordered decision ladder over scored pairs; thresholds are inclusive.

    A pair without a similarity fails the job, also one that an earlier rung would decide: a missing or
    unusable vector is a fault of the data, whatever the pair. ``unusable_pairs`` lists such pairs.

    Needs left/right category, distance_metres, time_gap_seconds, semantic_similarity and location.
    """
    lc, rc = F.col("left_category"), F.col("right_category")
    distance, gap = F.col("distance_metres"), F.col("time_gap_seconds")
    similarity = F.coalesce(
        F.col("semantic_similarity"),
        F.raise_error(
            F.concat_ws(
                " ",
                F.lit("no usable vector for the pair"),
                *[c for c in ("left_id", "right_id") if c in scored.columns],
            )
        ).cast("double"),
    )
    place, place_reason = F.col("location.compatibility"), F.col("location.reason")
    radius, days = policy.geographic_radius_metres, policy.temporal_window_days
    threshold = F.when(
        place == "compatible", F.lit(policy.strong_entity_semantic_threshold)
    ).otherwise(F.lit(policy.semantic_threshold))

    other = (lc == OTHER) | (rc == OTHER)
    hours = _decimals(gap / 3600, 1)
    # (condition, decision, reasons) in the order they are tried
    ladder = [
        (other, REVIEW_REQUIRED, [F.lit("category requires officer review"), place_reason]),
        (
            lc != rc,
            NO_MATCH,
            [F.concat(F.lit("category mismatch: "), lc, F.lit(" vs "), rc), place_reason],
        ),
        (
            distance > radius,
            NO_MATCH,
            [
                F.concat(
                    F.lit("distance "),
                    _decimals(distance, 1),
                    F.lit(f"m exceeds {radius:.1f}m policy radius"),
                ),
                place_reason,
            ],
        ),
        (
            gap > policy.window_seconds,
            NO_MATCH,
            [
                F.concat(
                    F.lit("time gap "), hours, F.lit(f"h exceeds {days:.1f} day policy window")
                ),
                place_reason,
            ],
        ),
        (
            place == "conflicting",
            NO_MATCH,
            [place_reason, F.lit("explicit location conflict prevents auto-match")],
        ),
        (
            similarity < threshold,
            REVIEW_REQUIRED,
            [
                F.concat(
                    F.lit("semantic similarity "),
                    _decimals(similarity, 3),
                    F.lit(" is below "),
                    _decimals(threshold, 3),
                    F.lit(" threshold"),
                ),
                place_reason,
            ],
        ),
        (
            place == "unknown",
            REVIEW_REQUIRED,
            [place_reason, F.lit("missing explicit location evidence prevents auto-match")],
        ),
    ]
    auto_reasons = [
        F.concat(F.lit("same category: "), lc),
        F.concat(F.lit("distance "), _decimals(distance, 1), F.lit("m within policy radius")),
        F.concat(F.lit("time gap "), hours, F.lit("h within policy window")),
        F.concat(
            F.lit("semantic similarity "), _decimals(similarity, 3), F.lit(" meets threshold")
        ),
        place_reason,
    ]

    def with_final(state: str, reasons: list[Column]) -> Column:
        return F.array(*reasons, F.lit(f"final decision: {state}"))

    decision, reasons = F, F
    for condition, state, texts in ladder:
        decision = decision.when(condition, F.lit(state))
        reasons = reasons.when(condition, with_final(state, texts))
    usable = similarity.between(-1, 1)
    decision = F.when(usable, decision.otherwise(F.lit(AUTO_MATCH)))
    return scored.withColumns(
        {
            "decision": decision,
            "category_compatible": ~other & (lc == rc),
            "reasons": F.when(
                usable, reasons.otherwise(with_final(AUTO_MATCH, auto_reasons))
            ).otherwise(F.array(F.lit("semantic similarity must be finite and between -1 and 1"))),
            "decision_source": F.lit("automated"),
            "matcher_recommendation": F.lit(None).cast("string"),
        }
    )


def decide_explicit_pairs(
    pairs: DataFrame, policy: MatchingPolicy = MatchingPolicy()
) -> DataFrame:
    """Decide given pairs of full reports (structs ``a`` and ``b`` plus semantic_similarity).

    Unlike candidate pairs these may break every gate, so all rungs of the ladder can fire.
    """
    a, b = F.col("a"), F.col("b")
    return match_pairs(
        pairs.withColumns(
            {
                "left_category": F.coalesce(a["category"], F.lit(OTHER)),
                "right_category": F.coalesce(b["category"], F.lit(OTHER)),
                "distance_metres": haversine_metres(
                    a["latitude"], a["longitude"], b["latitude"], b["longitude"]
                ),
                "time_gap_seconds": temporal_gap_seconds(a["reported_at"], b["reported_at"]),
                "location": compare_location_sets(
                    location_sets(a["locations"]), location_sets(b["locations"])
                ),
            }
        ),
        policy,
    )


def ordered_pair(df: DataFrame) -> DataFrame:
    """Canonical direction: left_id < right_id (binary string order)."""
    return df.withColumns(
        {
            "left_id": F.least("left_id", "right_id"),
            "right_id": F.greatest("left_id", "right_id"),
        }
    )


def without_overrides(edges: DataFrame) -> DataFrame:
    """Edges as the matcher left them: its decision and reasons, no officer's."""
    if "automated_decision" not in edges.columns:
        return edges
    overridden = F.col("decision_source") == "officer_review"
    return edges.withColumns(
        {
            "decision": F.coalesce("automated_decision", "decision"),
            "decision_source": F.when(overridden, F.lit("automated")).otherwise(F.col("decision_source")),
            "matcher_recommendation": F.when(~overridden, F.col("matcher_recommendation")),
            "reasons": F.when(overridden, F.slice("reasons", 1, F.size("reasons") - 1)).otherwise(F.col("reasons")),
        }
    ).drop("automated_decision")


def apply_overrides(edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """Resolved reviews replace the decision on their pair; automated evidence stays visible.

    Edges that carry overrides already start again from the matcher's decision, so applying all
    resolved reviews in every round gives what applying them once gives.
    """
    edges = without_overrides(edges)
    resolved = (
        ordered_pair(reviews)
        .filter((F.col("status") != "pending") & F.col("final_relationship_state").isNotNull())
        .select("left_id", "right_id", F.col("final_relationship_state").alias("_final"))
    )
    final = F.col("_final")
    overridden = final.isNotNull()
    return (
        edges.join(resolved, ["left_id", "right_id"], "left")
        .withColumns(
            {
                "automated_decision": F.col("decision"),
                "decision": F.coalesce(final, F.col("decision")),
                "decision_source": F.when(overridden, F.lit("officer_review")).otherwise(
                    F.col("decision_source")
                ),
                "matcher_recommendation": F.when(overridden, F.lit(REVIEW_REQUIRED)).otherwise(
                    F.col("matcher_recommendation")
                ),
                "reasons": F.when(
                    overridden,
                    F.concat(
                        F.col("reasons"),
                        F.array(F.concat(F.lit("officer final decision: "), final)),
                    ),
                ).otherwise(F.col("reasons")),
            }
        )
        .drop("_final")
    )


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One row per unordered pair and decision; contradictions are reported by ``check_edges``."""
    return ordered_pair(edges).dropDuplicates(["left_id", "right_id", "decision"])
