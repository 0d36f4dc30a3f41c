"""Review records: creation, upsert, officer resolution, and seeded resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import review_id
from ..policy import AUTO_MATCH, NO_MATCH, REVIEW_REQUIRED
from .matching import ordered_pair
from .skew import lookup

REVIEW_COLUMNS = (
    "review_id", "left_id", "right_id", "matcher_recommendation", "matcher_reasons", "status",
    "created_at", "resolved_at", "reviewed_by", "review_note", "final_relationship_state",
    "decision_source", "graph_version_at_creation", "version",
)


def new_reviews(edges: DataFrame, created_at: Column, graph_version: Column) -> DataFrame:
    """Pending reviews for the review_required edges."""
    null_text = F.lit(None).cast("string")
    return ordered_pair(edges.filter(F.col("decision") == REVIEW_REQUIRED)).select(
        review_id(F.col("left_id"), F.col("right_id")).alias("review_id"),
        "left_id",
        "right_id",
        F.lit(REVIEW_REQUIRED).alias("matcher_recommendation"),
        F.array_join("reasons", "; ").alias("matcher_reasons"),
        F.lit("pending").alias("status"),
        created_at.alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        null_text.alias("reviewed_by"),
        null_text.alias("review_note"),
        null_text.alias("final_relationship_state"),
        null_text.alias("decision_source"),
        graph_version.alias("graph_version_at_creation"),
        F.lit(1).alias("version"),
    )


def upsert_reviews(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One review per pair; evidence and graph version refresh only while pending."""
    s = stored.select(*[F.col(c).alias(f"s_{c}") for c in REVIEW_COLUMNS])
    i = incoming.select(*[F.col(c).alias(f"i_{c}") for c in REVIEW_COLUMNS])
    joined = s.join(i, F.col("s_review_id") == F.col("i_review_id"), "full_outer")
    refreshed = ("matcher_recommendation", "matcher_reasons", "graph_version_at_creation")
    is_new = F.col("s_review_id").isNull()
    take_new = F.col("i_review_id").isNotNull() & (is_new | (F.col("s_status") == "pending"))

    def pick(c: str) -> Column:
        when = take_new if c in refreshed else is_new
        return F.when(when, F.col(f"i_{c}")).otherwise(F.col(f"s_{c}")).alias(c)

    return joined.select(*[pick(c) for c in REVIEW_COLUMNS])


def resolution_outcomes(commands: DataFrame, reviews: DataFrame, graph_version: Column) -> DataFrame:
    """Typed outcome per command: invalid, unknown, already_resolved, stale, or approved / rejected.

    Of several commands for one review the lowest ``sequence`` acts; later ones find it resolved. A
    command without sequence or verdict is invalid, one without a review id knows no review.
    """
    complete = F.col("sequence").isNotNull() & F.col("approve").isNotNull()
    first = commands.groupBy("review_id").agg(
        F.min(F.when(complete, F.col("sequence"))).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    known = reviews.select(
        "review_id", "left_id", "right_id", "status", "version",
        (F.col("graph_version_at_creation") == graph_version).alias("fresh"),
    )
    ranked = lookup(
        commands,
        first.join(known, "review_id", "left"),
        ["review_id"],
        spread_by="sequence",
        row_count="_rows",
        how="left",
    )
    decided = F.when(F.col("approve"), F.lit("approved")).otherwise(F.lit("rejected"))
    acts = (F.col("status") == "pending") & F.col("fresh")
    outcome = (
        F.when(~complete, F.lit("invalid"))
        .when(F.col("status").isNull(), F.lit("unknown_review"))
        .when(F.col("status") != "pending", F.lit("already_resolved"))
        .when(~F.col("fresh"), F.lit("stale"))
        .when(F.col("sequence") != F.col("_first"), F.lit("already_resolved"))
        .otherwise(decided)
    )
    final = F.when(F.col("approve"), F.lit(AUTO_MATCH)).otherwise(F.lit(NO_MATCH))
    done = complete & acts & (F.col("sequence") == F.col("_first"))
    return ranked.select(
        "sequence",
        "review_id",
        "left_id",
        "right_id",
        "reviewer_id",
        "note",
        "resolved_at",
        outcome.alias("outcome"),
        F.when(done, final).alias("final_relationship_state"),
        F.when(done, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
    )


def apply_resolutions(reviews: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Reviews after the accepted commands."""
    acted = outcomes.filter(F.col("final_relationship_state").isNotNull()).select(
        "review_id",
        F.col("outcome").alias("n_status"),
        F.col("resolved_at").alias("n_resolved_at"),
        F.col("reviewer_id").alias("n_reviewed_by"),
        F.col("note").alias("n_review_note"),
        F.col("final_relationship_state").alias("n_final_relationship_state"),
    )
    changed = F.col("n_status").isNotNull()
    out = reviews.join(acted, "review_id", "left")
    updates = {
        c: F.when(changed, F.col(f"n_{c}")).otherwise(F.col(c))
        for c in ("status", "resolved_at", "reviewed_by", "review_note", "final_relationship_state")
    }
    updates["decision_source"] = F.when(changed, F.lit("officer_review")).otherwise(
        F.col("decision_source")
    )
    updates["version"] = F.when(changed, F.col("version") + 1).otherwise(F.col("version"))
    return out.withColumns(updates).select(*REVIEW_COLUMNS)


def seed_resolutions(
    resolutions: DataFrame, keys: DataFrame, review_edges: DataFrame, created_at: Column
) -> tuple[DataFrame, DataFrame]:
    """Seeded officer decisions joined to candidate edges: (reviews, violations).

    ``keys`` maps seed_key to id. Violations: unknown key, self pair, duplicate pair, pair that is
    no review candidate, bad state.
    """
    left = keys.select(F.col("seed_key").alias("left_seed_key"), F.col("id").alias("left_id"))
    right = keys.select(F.col("seed_key").alias("right_seed_key"), F.col("id").alias("right_id"))
    linked = resolutions.join(left, "left_seed_key", "left").join(right, "right_seed_key", "left")
    linked = linked.withColumns(
        {
            "pair_left": F.least("left_id", "right_id"),
            "pair_right": F.greatest("left_id", "right_id"),
        }
    )
    edges = ordered_pair(review_edges).select("left_id", "right_id", "reasons")
    pair = ["pair_left", "pair_right"]
    complete = F.col("left_id").isNotNull() & F.col("right_id").isNotNull()
    candidates = edges.select(
        F.col("left_id").alias("pair_left"), F.col("right_id").alias("pair_right")
    )
    tag = lambda df, name: df.select(
        F.lit(name).alias("violation"), "left_seed_key", "right_seed_key"
    )
    repeated = linked.filter(complete).groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("left_seed_key").alias("left_seed_key"),
        F.min("right_seed_key").alias("right_seed_key"),
    )
    not_self = F.col("left_seed_key") != F.col("right_seed_key")
    violations = (
        tag(linked.filter(~complete), "unknown_seed_key")
        .unionByName(tag(linked.filter(~not_self), "self_pair"))
        .unionByName(tag(repeated.filter("n > 1"), "duplicate_resolution"))
        .unionByName(
            tag(
                linked.filter(complete & not_self).join(candidates, pair, "left_anti"),
                "not_a_review_candidate",
            )
        )
        .unionByName(
            tag(linked.filter(~F.col("final_state").isin(AUTO_MATCH, NO_MATCH)), "bad_final_state")
        )
    )
    decided = linked.filter(complete).select(
        F.col("pair_left").alias("left_id"),
        F.col("pair_right").alias("right_id"),
        "final_state",
        "reviewer_id",
        "note",
    )
    known = F.col("final_state").isNotNull()
    reviews = edges.join(decided, ["left_id", "right_id"], "left").select(
        review_id(F.col("left_id"), F.col("right_id")).alias("review_id"),
        "left_id",
        "right_id",
        F.lit(REVIEW_REQUIRED).alias("matcher_recommendation"),
        F.array_join("reasons", "; ").alias("matcher_reasons"),
        F.when(F.col("final_state") == AUTO_MATCH, F.lit("approved"))
        .when(known, F.lit("rejected"))
        .otherwise(F.lit("pending"))
        .alias("status"),
        created_at.alias("created_at"),
        F.when(known, created_at).alias("resolved_at"),
        F.col("reviewer_id").alias("reviewed_by"),
        F.col("note").alias("review_note"),
        F.col("final_state").alias("final_relationship_state"),
        F.when(known, F.lit("officer_review")).alias("decision_source"),
        F.lit(None).cast("string").alias("graph_version_at_creation"),
        F.when(known, F.lit(2)).otherwise(F.lit(1)).alias("version"),
    )
    return reviews, violations
