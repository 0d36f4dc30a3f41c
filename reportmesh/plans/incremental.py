"""Incremental clustering: new reports against history, touching only the incidents they reach.

A pair's decision depends on that pair alone and new reports only add edges, so components can only
grow and merge. New confirmed edges are contracted to edges between current components; labels
of the merged components are rewritten and everything else keeps its id.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, graph, incidents, matching, priority
from ..operators.skew import lookup
from ..policy import AUTO_MATCH, Policies
from ..session import cut_lineage


@dataclass(frozen=True)
class ClusterState:
    """Stored tables of one snapshot. ``edges`` carry decisions after overrides."""

    complaints: DataFrame
    vectors: DataFrame
    edges: DataFrame
    members: DataFrame
    reviews: DataFrame | None = None


@dataclass(frozen=True)
class ClusterStep:
    state: ClusterState
    new_edges: DataFrame
    moved: DataFrame  # (id, previous_component, component) for members whose label changed
    touched: DataFrame  # (component): incidents whose members, candidates or conflicts changed


def history_near(history: DataFrame, fresh: DataFrame, policies: Policies) -> DataFrame:
    """History inside the time window of the new reports; the bounds prune the stored scan."""
    bounds = fresh.agg(F.min("reported_at"), F.max("reported_at")).first()
    if bounds[0] is None:
        return history.limit(0)
    margin = dt.timedelta(seconds=policies.matching.window_seconds)
    return history.filter(F.col("reported_at").between(bounds[0] - margin, bounds[1] + margin))


def add_reports(
    state: ClusterState,
    fresh: DataFrame,
    fresh_vectors: DataFrame,
    policies: Policies = Policies(),
) -> ClusterStep:
    """Cluster ``fresh`` complaints (already stripped of stored ids) into ``state``."""
    near = history_near(state.complaints, fresh, policies)
    # the columns must line up by name; history may carry more
    shared = [c for c in fresh.columns if c in near.columns]
    local = near.select(*shared).unionByName(fresh.select(*shared))
    pairs = cut_lineage(candidates.candidate_pairs(local, policies.matching, probe_side=fresh))
    involved = pairs.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
    evidence = matching.evidence_table(
        local.join(involved, "id", "left_semi"),
        state.vectors.unionByName(fresh_vectors).join(involved, "id", "left_semi"),
    )
    decided = matching.match_pairs(matching.score_pairs(pairs, evidence), policies.matching)
    if state.reviews is not None:
        decided = matching.apply_overrides(decided, state.reviews)
    new_edges = cut_lineage(decided)

    # confirmed edges between current components; a new report is its own component so far
    labels = state.members.select("id", "component").unionByName(
        fresh.select("id", F.col("id").alias("component"))
    )
    confirmed = new_edges.filter(F.col("decision") == AUTO_MATCH).select("left_id", "right_id")
    bridges = (
        confirmed.join(labels.toDF("left_id", "left_label"), "left_id")
        .join(labels.toDF("right_id", "right_label"), "right_id")
        .select(F.col("left_label").alias("left_id"), F.col("right_label").alias("right_id"))
        .filter(F.col("left_id") != F.col("right_id"))
    )
    bridges = cut_lineage(bridges)
    nodes = bridges.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
    merged = graph.connected_components(nodes, bridges)
    renamed = cut_lineage(
        merged.filter(F.col("id") != F.col("component")).select(
            F.col("id").alias("component"), F.col("component").alias("new_component")
        )
    )
    moved = lookup(labels, renamed, ["component"], spread_by="id").select(
        "id",
        F.col("component").alias("previous_component"),
        F.col("new_component").alias("component"),
    )
    relabelled = lookup(labels, renamed, ["component"], spread_by="id", how="left")
    members = cut_lineage(
        relabelled.select("id", F.coalesce("new_component", "component").alias("component"))
    )
    ends = new_edges.select(F.explode(F.array("left_id", "right_id")).alias("id")).unionByName(
        fresh.select("id")
    )
    touched = cut_lineage(
        members.join(ends.distinct(), "id", "left_semi").select("component").distinct()
    )
    everything = state.complaints.select(*shared).unionByName(fresh.select(*shared))
    after = replace(
        state,
        complaints=everything,
        vectors=state.vectors.unionByName(fresh_vectors),
        edges=state.edges.unionByName(new_edges, allowMissingColumns=True),
        members=members,
    )
    return ClusterStep(after, new_edges, moved, touched)


def edges_at(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among the ids, each once. Both ends are marked in passing: edges are read once."""
    known = ids.select("id").distinct()
    mark = lambda end: known.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
    marked = edges.join(mark("left_id"), "left_id", "left").join(mark("right_id"), "right_id", "left")
    return marked.filter(F.coalesce("_left_id", "_right_id")).select(*edges.columns)


def touched_incidents(
    step: ClusterStep, policies: Policies = Policies(), *, near: DataFrame | None = None
) -> DataFrame:
    """Recomputed incident rows of the touched components only.

    ``near`` are the edges with an end in one of them, where they are known already.
    """
    members = step.state.members.join(step.touched, "component", "left_semi")
    ids = members.select("id")
    complaints = step.state.complaints.join(ids, "id", "left_semi")
    if near is None:
        near = edges_at(step.state.edges, ids)
    summary = incidents.incident_summary(complaints, members, None, policies.identity)
    # conflicts and candidates need labels of far ends outside the touched set as well
    clash = incidents.conflicts(near, step.state.members)
    pending = incidents.review_candidates(near, step.state.members)
    count = lambda df, name: df.groupBy("component").agg(F.count(F.lit(1)).alias(name))
    zero = F.lit(0).cast("bigint")
    return (
        summary.drop("conflict_count", "pending_count", "status")
        .join(count(clash, "conflict_count"), "component", "left")
        .join(count(pending, "pending_count"), "component", "left")
        .withColumns(
            {
                "conflict_count": F.coalesce("conflict_count", zero),
                "pending_count": F.coalesce("pending_count", zero),
            }
        )
        .withColumn("status", incidents.incident_status())
    )


def submission_results(
    before: ClusterState,
    step: ClusterStep,
    fresh: DataFrame,
    places: DataFrame,
    now,
    policies: Policies = Policies(),
    scored: DataFrame | None = None,
) -> DataFrame:
    """Per new complaint: its incident, priority, what its incident replaced, and its decisions.

    ``scored`` are the touched incidents with priorities, where they are known already.
    """
    members = step.state.members.join(step.touched, "component", "left_semi")
    if scored is None:
        rows = cut_lineage(touched_incidents(step, policies))
        complaints = step.state.complaints.join(members.select("id"), "id", "left_semi")
        scored = priority.assess_priority(
            priority.priority_inputs(rows, complaints, members, places, now, policies.priority),
            policies.priority,
        )
    # incidents that existed before and whose members now belong to the touched components
    earlier = before.members.select("id", F.col("component").alias("previous_component"))
    replaced = (
        members.join(earlier, "id")
        .select("component", "previous_component")
        .distinct()
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("previous_incident_count"))
    )
    decisions = (
        step.new_edges.filter(F.col("decision") != "no_match")
        .select(F.explode(F.array("left_id", "right_id")).alias("id"))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("decision_count"))
    )
    zero = F.lit(0).cast("bigint")
    own = fresh.select("id").join(members, "id")
    per_incident = scored.join(replaced, "component", "left").select(
        "component",
        "incident_id",
        "report_count",
        "status",
        "priority_level",
        F.coalesce("previous_incident_count", zero).alias("previous_incident_count"),
    )
    return (
        lookup(own, per_incident, ["component"], spread_by="id", row_count="report_count")
        .join(decisions, "id", "left")
        .select(
            F.col("id").alias("complaint_id"),
            "incident_id",
            "report_count",
            "status",
            "priority_level",
            "previous_incident_count",
            F.coalesce("decision_count", zero).alias("decision_count"),
        )
    )


def apply_review_decisions(
    state: ClusterState, reviews_after: DataFrame
) -> tuple[ClusterState, DataFrame]:
    """State after officer decisions: (state, affected ids).

    Approvals add confirmed edges and rejections can only add contradictions, so components merge
    and never split; the merge runs over component labels like a batch of new edges.
    """
    edges = cut_lineage(matching.apply_overrides(state.edges, reviews_after))
    previous = state.edges.select(
        "left_id", "right_id", F.col("decision").alias("previous_decision")
    )
    changed = edges.join(previous, ["left_id", "right_id"]).filter(
        F.col("decision") != F.col("previous_decision")
    )
    label = state.members
    bridges = cut_lineage(
        changed.filter(F.col("decision") == AUTO_MATCH)
        .join(label.toDF("left_id", "left_label"), "left_id")
        .join(label.toDF("right_id", "right_label"), "right_id")
        .select(F.col("left_label").alias("left_id"), F.col("right_label").alias("right_id"))
        .filter(F.col("left_id") != F.col("right_id"))
    )
    nodes = bridges.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
    merged = graph.connected_components(nodes, bridges).toDF("component", "new_component")
    members = cut_lineage(
        lookup(label, merged, ["component"], spread_by="id", how="left").select(
            "id", F.coalesce("new_component", "component").alias("component")
        )
    )
    affected = changed.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
    return replace(state, edges=edges, members=members, reviews=reviews_after), affected


def mutation_results(
    before: ClusterState, after: ClusterState, resolved: DataFrame, assessed: DataFrame
) -> DataFrame:
    """Per resolved review: ids of its incidents before and after, conflict flag, priorities.

    At most two incidents touch a review, so the arrays hold one or two entries. ``resolved`` has
    review_id, left_id, right_id; ``assessed`` holds incident rows of ``after``.
    """
    ends = resolved.select("review_id", F.explode(F.array("left_id", "right_id")).alias("id"))
    # only the incidents of these reviews are named, not all of the history
    reached = before.members.join(ends.select("id"), "id", "left_semi").select("component").distinct()
    members = before.members.join(reached, "component", "left_semi")
    old_ids = incidents.incident_members(members, incidents.incident_ids(members))
    old = (
        ends.join(old_ids, "id")
        .groupBy("review_id")
        .agg(F.array_sort(F.collect_set("incident_id")).alias("previous_ids"))
    )
    new = (
        ends.join(after.members, "id")
        .select("review_id", "component")
        .distinct()
        .join(
            assessed.select("component", "incident_id", "status", "operational_priority"),
            "component",
        )
        .groupBy("review_id")
        .agg(
            F.array_sort(F.collect_set("incident_id")).alias("new_ids"),
            F.max(F.col("status") == "conflict").alias("conflict"),
            # collect_list skips NULLs; the struct keeps a missing priority visible
            F.collect_list(F.struct("operational_priority")).alias("_p"),
        )
        .withColumn("priorities", F.transform("_p", lambda p: p["operational_priority"]))
        .drop("_p")
    )
    return old.join(new, "review_id")


__all__ = [
    "ClusterState", "ClusterStep", "add_reports", "apply_review_decisions", "history_near",
    "mutation_results", "submission_results", "touched_incidents",
]
