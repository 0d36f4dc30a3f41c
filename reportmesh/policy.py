"""Versioned policies. They are small, fixed driver-side values that become literals in plans."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

# Fixed values of the published policies.
CATEGORIES = ("pothole", "blocked_drain", "flooding", "rubbish", "street_light", "other")
OTHER = "other"
PRIORITY_LEVELS = ("critical", "high", "medium", "low", "review_required")
REVIEW_STATUSES = ("pending", "approved", "rejected")
AUTO_MATCH = "auto_match"
REVIEW_REQUIRED = "review_required"
NO_MATCH = "no_match"
NORMALIZATION_VERSION = "normalization-v1"


@dataclass(frozen=True)
class MatchingPolicy:
    policy_version: str = "matching-v1"
    geographic_radius_metres: float = 500.0
    temporal_window_days: float = 7.0
    semantic_threshold: float = 0.88
    strong_entity_semantic_threshold: float = 0.92
    model_name: str = "intfloat/multilingual-e5-small"
    normalization_version: str = NORMALIZATION_VERSION

    def __post_init__(self) -> None:
        for name in ("geographic_radius_metres", "temporal_window_days"):
            value = getattr(self, name)
            if not math.isfinite(value) or value <= 0:
                raise ValueError(f"{name} must be positive and finite")
        for name in ("semantic_threshold", "strong_entity_semantic_threshold"):
            if not -1 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between -1 and 1")

    @property
    def window_seconds(self) -> float:
        return self.temporal_window_days * 86400

    def with_semantic_threshold(self, value: float) -> "MatchingPolicy":
        return replace(self, semantic_threshold=value)


@dataclass(frozen=True)
class PriorityPolicy:
    policy_version: str = "priority-v1"
    medium_report_count: int = 2
    high_report_count: int = 10
    critical_report_count: int = 20
    high_unresolved_hours: float = 24.0
    critical_unresolved_hours: float = 48.0
    sensitive_location_radius_metres: float = 250.0
    evidence_completeness_threshold: float = 0.5
    critical_safety_signals: tuple[str, ...] = ("accident_injury", "exposed_electrical_hazard")
    high_safety_signals: tuple[str, ...] = ("active_flooding", "blocked_road")


@dataclass(frozen=True)
class IdentityPolicy:
    """Name prefixes for derived ids; keep a former system's prefixes to keep its ids."""

    incident_prefix: str = "incident-v1:"
    review_prefix: str = "review-v1:"
    seed_prefix: str = "seed:"


@dataclass(frozen=True)
class PerformanceBudget:
    """Limits of the published budget file (fixed values)."""

    application_composition_seconds_max: float = 5.0
    warm_readiness_seconds_max: float = 2.0
    cold_cached_model_initialization_seconds_max: float = 25.0
    incident_list_p95_ms_max: float = 250.0
    incident_detail_p95_ms_max: float = 200.0
    submission_p95_ms_max: float = 2500.0
    review_resolution_p95_ms_max: float = 2000.0
    reset_seconds_max: float = 45.0
    ready_rss_mb_max: float = 1536.0
    mutation_memory_growth_percent_max: float = 15.0
    dashboard_first_usable_seconds_max: float = 5.0


@dataclass(frozen=True)
class Policies:
    matching: MatchingPolicy = field(default_factory=MatchingPolicy)
    priority: PriorityPolicy = field(default_factory=PriorityPolicy)
    identity: IdentityPolicy = field(default_factory=IdentityPolicy)
