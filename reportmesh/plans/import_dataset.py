"""Batch import: seed documents to a published snapshot of every table.

Nothing is published until all checks passed, and readers then switch in one step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..operators import incidents, intake, priority, quality, reviews
from ..policy import Policies
from ..session import cut_lineage
from ..sources import documents
from ..sources.store import SnapshotStore
from ..streaming.live import publish_state
from .flow import Flow
from .incremental import ClusterState


def seed_to_complaints(seed: DataFrame, seed_version: str, policies: Policies) -> DataFrame:
    """Typed seed rows to complaints whose id is named by the seed key."""
    typed = seed.withColumns(
        {
            "id": uuid5(
                F.concat(F.lit(f"{policies.identity.seed_prefix}{seed_version}:"), F.col("seed_key"))
            ),
            "reported_at": intake.to_utc(F.col("reported_at")),
        }
    )
    return intake.to_complaints(typed)


def seed_checksum(complaints: DataFrame, resolutions: DataFrame | None = None) -> str:
    """Checksum of a seed's reports and, where given, of its review resolutions."""
    parts = []
    for table in (complaints, resolutions):
        if table is not None:
            columns = [F.col(c) for c in table.columns]
            parts.append(quality.content_checksum(table, columns).first()["checksum"])
    return parts[0] if len(parts) == 1 else hashlib.sha256(":".join(parts).encode()).hexdigest()


def seed_rejections(seed: DataFrame) -> DataFrame:
    """Seed rows that break a rule of intake, with the rules: range, length, time, category."""
    typed = seed.withColumn("reported_at", intake.to_utc(F.col("reported_at")))
    for missing in ("photo_id",):
        if missing not in typed.columns:
            typed = typed.withColumn(missing, F.lit(None).cast("string"))
    # a seed may hold old and future reports: only the clock's own rule is left out
    checked = intake.validate_complaints(typed, F.lit("9999-01-01").cast("timestamp"))
    return checked.filter(F.size("rejections") > 0).select("seed_key", "rejections")


def resolution_rejections(resolutions: DataFrame) -> DataFrame:
    """Resolutions without a pair, a known state or a reviewer."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bad = blank("left_seed_key") | blank("right_seed_key") | blank("reviewer_id")
    return resolutions.filter(bad | ~F.coalesce(F.col("final_state").isin("auto_match", "no_match"), F.lit(False)))


def import_dataset(
    store: SnapshotStore,
    seed_documents: DataFrame,
    vectors_of: Callable[[DataFrame], DataFrame],
    places: DataFrame,
    policies: Policies = Policies(),
    *,
    check_manifest: bool = True,
) -> str:
    """Import everything and return the new snapshot id.

    ``vectors_of`` maps complaints to (id, vector). Priorities are scored at the latest report.
    """
    quality.require_empty(documents.place_violations(places), "sensitive place is invalid")
    manifests, seed, resolutions = documents.parse_seed(seed_documents)
    seed = cut_lineage(seed)
    quality.require_empty(documents.seed_violations(seed), "seed_key values must be unique")
    if seed.limit(1).count() == 0:
        raise ValueError("seed must contain at least one complaint")
    quality.require_empty(seed_rejections(seed), "seed complaint is invalid")
    resolutions = cut_lineage(resolutions)
    quality.require_empty(resolution_rejections(resolutions), "seed review resolution is invalid")
    manifest = cut_lineage(manifests.distinct())
    named = manifest.filter(F.col("seed_version").isNotNull()).select("seed_version").distinct().limit(2).collect()
    if len(named) != 1:
        raise ValueError("seed manifest does not match: all documents must agree on one seed_version")
    version = named[0][0]
    if check_manifest:
        if manifest.limit(2).count() != 1:
            raise ValueError("seed manifest does not match: all documents need the same manifest")
        expected = {
            "content_sha256": seed_checksum(seed, resolutions),
            "normalization_version": policies.matching.normalization_version,
            "embedding_model": policies.matching.model_name,
            "matching_policy_version": policies.matching.policy_version,
            "priority_policy_version": policies.priority.policy_version,
        }
        quality.require_empty(
            quality.manifest_violations(manifest, expected), "seed manifest does not match"
        )
    complaints = cut_lineage(seed_to_complaints(seed, version, policies))
    vectors = cut_lineage(vectors_of(complaints))
    if check_manifest:
        sizes = {"embedding_dimension": vectors.agg(F.max(F.size("vector"))).first()[0]}
        quality.require_empty(quality.manifest_violations(manifest, sizes), "seed manifest does not match")
    quality.require_empty(
        quality.check_embeddings(vectors, complaints), "seed embeddings are unusable"
    )

    keys = complaints.select("seed_key", "id")
    created = complaints.agg(F.min("reported_at")).scalar()

    def records(matched: DataFrame, _complaints: DataFrame) -> DataFrame:
        edges = matched.filter(F.col("decision") == "review_required")
        found, violations = reviews.seed_resolutions(resolutions, keys, edges, created)
        quality.require_empty(violations, "seed review resolution is invalid")
        version_row = incidents.graph_version(matched).first()
        return cut_lineage(
            found.withColumn(
                "graph_version_at_creation", F.lit(version_row["graph_version"])
            ).select(*reviews.REVIEW_COLUMNS)
        )

    flow = Flow(complaints, vectors, places, records, policies)
    assessed = cut_lineage(flow.assessed())
    quality.require_empty(
        quality.check_coverage(flow.members, complaints), "incidents must cover every complaint"
    )
    state = ClusterState(complaints, vectors, flow.edges, flow.members, flow.reviews)
    keys = intake.with_fingerprint(complaints).select(
        F.concat(F.lit(f"seed:{version}:"), "id").alias("idempotency_key"),
        "request_fingerprint",
        F.col("id").alias("complaint_id"),
    )
    return publish_state(store, state, assessed, keys)


def import_counts(store: SnapshotStore) -> DataFrame:
    """Review and priority counts of the published snapshot, zeros included."""
    from ..policy import REVIEW_STATUSES

    by_review = priority.counts_over_domain(store.read("reviews"), "status", REVIEW_STATUSES)
    by_level = priority.priority_counts(store.read("incidents"))
    tag = lambda df, name: df.select(F.lit(name).alias("domain"), "value", "count")
    return tag(by_review, "review").unionByName(tag(by_level, "priority"))
