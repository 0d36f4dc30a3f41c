"""The batch flow from reports to prioritised incidents, one lazily built table per step."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, collapse, contradictions, graph, incidents, matching, priority
from ..policy import Policies
from ..session import cut_lineage


@dataclass
class Flow:
    """Complaints and vectors in; pairs, edges, components, incidents and priorities out.

    Nothing is read until a table is used. ``reviews`` may be a table, or a function of the
    automated edges and complaints.
    """

    complaints: DataFrame
    vectors: DataFrame | None = None
    places: DataFrame | None = None
    reviews_of: object = None
    policies: Policies = field(default_factory=Policies)

    @cached_property
    def pairs(self) -> DataFrame:
        return candidates.candidate_pairs(self.complaints, self.policies.matching)

    @cached_property
    def scored(self) -> DataFrame:
        evidence = matching.evidence_table(self.complaints, self.vectors)
        return matching.score_pairs(self.pairs, evidence)

    @cached_property
    def matched(self) -> DataFrame:
        """Automated decisions. Written once: the graph, conflicts and candidates all read it."""
        return cut_lineage(matching.match_pairs(self.scored, self.policies.matching))

    @cached_property
    def reviews(self) -> DataFrame | None:
        if callable(self.reviews_of):
            return self.reviews_of(self.matched, self.complaints)
        return self.reviews_of

    @cached_property
    def edges(self) -> DataFrame:
        """Decisions after officer overrides."""
        if self.reviews is None:
            return self.matched
        return cut_lineage(matching.apply_overrides(self.matched, self.reviews))

    @cached_property
    def automated_members(self) -> DataFrame:
        """Components before officer decisions, over the same table of decided pairs."""
        return cut_lineage(graph.confirmed_components(self.complaints, self.matched))

    @cached_property
    def members(self) -> DataFrame:
        return cut_lineage(graph.confirmed_components(self.complaints, self.edges))

    @cached_property
    def incidents(self) -> DataFrame:
        return cut_lineage(
            incidents.incident_summary(
                self.complaints, self.members, self.edges, self.policies.identity
            )
        )

    @cached_property
    def now(self) -> Column:
        """Reference time of a batch import: the latest report."""
        return self.complaints.agg(F.max("reported_at")).scalar()

    def priority_inputs(self, now: Column | None = None) -> DataFrame:
        return priority.priority_inputs(
            self.incidents,
            self.complaints,
            self.members,
            self.places,
            self.now if now is None else now,
            self.policies.priority,
        )

    def assessed(self, now: Column | None = None) -> DataFrame:
        return priority.assess_priority(self.priority_inputs(now), self.policies.priority)


class CollapsedFlow(Flow):
    """What the ranked queue and the heat grid need, without a table of report pairs.

    Members and contradictions come from the collapsed graph; ``reviews_of`` is a table or None. The number
    of pending candidates is null: it is a property of pairs, which the review queue alone lists.
    """

    @property
    def matched(self) -> DataFrame:
        raise ValueError("this flow lists no pairs")

    @cached_property
    def collapsed(self) -> collapse.CollapsedGraph:
        found = collapse.collapsed_graph(self.complaints, self.vectors, self.policies.matching, self.reviews)
        return replace(found, labels=cut_lineage(found.labels))

    @cached_property
    def members(self) -> DataFrame:
        return cut_lineage(self.collapsed.members)

    @cached_property
    def conflict_counts(self) -> DataFrame:
        return contradictions.conflict_counts(self.collapsed, self.complaints, self.policies.matching, self.reviews)

    @cached_property
    def incidents(self) -> DataFrame:
        return cut_lineage(
            incidents.incident_summary(
                self.complaints, self.members, None, self.policies.identity, conflict_counts=self.conflict_counts
            )
        )
