"""Metric samples: nearest-rank summaries, budget gates, startup and memory figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import PerformanceBudget
from .ranks import running_sums
from .skew import lookup

# Metric names, the budget field that limits each, and composed gates.
METRIC_LIMITS = {
    "application_composition_seconds": "application_composition_seconds_max",
    "warm_readiness_seconds": "warm_readiness_seconds_max",
    "cold_cached_model_initialization_seconds": "cold_cached_model_initialization_seconds_max",
    "incident_list_p95_ms": "incident_list_p95_ms_max",
    "incident_detail_p95_ms": "incident_detail_p95_ms_max",
    "reset_seconds": "reset_seconds_max",
    "ready_rss_mb": "ready_rss_mb_max",
    "dashboard_first_usable_seconds": "dashboard_first_usable_seconds_max",
}
COMPOSED_GATES = {
    "submission_p95_ms": (
        "submission_isolated_p95_ms",
        "submission_auto_match_p95_ms",
        "submission_review_required_p95_ms",
    ),
    "review_resolution_p95_ms": (
        "review_approve_p95_ms",
        "review_reject_p95_ms",
        "review_merge_p95_ms",
    ),
}
COMPOSED_LIMITS = {
    "submission_p95_ms": "submission_p95_ms_max",
    "review_resolution_p95_ms": "review_resolution_p95_ms_max",
}
APPLICATION_SPANS = (
    "settings_and_policy_loading",
    "database_and_seed_initialization",
    "app_composition",
)
MODEL_SPANS = ("model_provider_load", "readiness_probe")


def invalid_samples(samples: DataFrame) -> DataFrame:
    """Samples that are NULL, NaN, infinite or negative; a summary needs this to be empty."""
    value = F.col("value")
    return samples.filter(
        value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf"))
    )


def metric_summary(samples: DataFrame, partitions: int | None = None) -> DataFrame:
    """count, nearest-rank p50 / p95 and maximum per metric, exact at any size.

    Samples collapse to one counter per distinct value before they are ordered, and running
    counts are kept per range partition, so a dominant metric never lands in one task.
    """
    counted = samples.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("c"))
    totals = samples.groupBy("metric").agg(
        F.count(F.lit(1)).alias("count"), F.max("value").alias("maximum")
    )
    ranked = lookup(
        running_sums(counted, ["metric"], "value", ["c"], partitions=partitions),
        totals,
        ["metric"],
        spread_by="value",
        row_count="count",
    )

    def at(share: float):
        rank = F.greatest(F.lit(1), F.ceil(F.col("count") * F.lit(share)))
        hit = (F.col("upto_c") >= rank) & (F.col("upto_c") - F.col("c") < rank)
        return F.min(F.when(hit, F.col("value")))

    return ranked.groupBy("metric").agg(
        F.first("count").alias("count"),
        at(0.5).alias("p50"),
        at(0.95).alias("p95"),
        F.first("maximum").alias("maximum"),
    )


def _limits(budget: PerformanceBudget) -> dict[str, float]:
    fields = {**METRIC_LIMITS, **COMPOSED_LIMITS}
    return {metric: getattr(budget, name) for metric, name in fields.items()}


def evaluate_budget(
    summaries: DataFrame, rss_growth_percent: float, budget: PerformanceBudget = PerformanceBudget()
) -> DataFrame:
    """(metric, observed, limit, hard, passed) for each metric and composed gate.

    A composed gate appears only when all of its scenarios were measured.
    """
    limits = _limits(budget)
    spark = summaries.sparkSession
    base = summaries.select("metric", F.col("p95").alias("observed"))
    gate = F
    for name, parts in COMPOSED_GATES.items():
        gate = gate.when(F.col("metric").isin(*parts), F.lit(name))
    composed = (
        base.withColumn("gate", gate.otherwise(F.lit(None)))
        .filter(F.col("gate").isNotNull())
        .groupBy("gate")
        .agg(F.count_distinct("metric").alias("seen"), F.max("observed").alias("observed"))
        .filter(F.col("seen") == 3)
        .select(F.col("gate").alias("metric"), "observed")
    )
    growth = spark.range(1).select(
        F.lit("mutation_memory_growth_percent").alias("metric"),
        F.lit(float(rss_growth_percent)).alias("observed"),
    )
    limits["mutation_memory_growth_percent"] = budget.mutation_memory_growth_percent_max
    limit: Column = F
    for name, value in limits.items():
        limit = limit.when(F.col("metric") == name, F.lit(value))
    limit = limit.otherwise(F.lit(None).cast("double"))
    return (
        base.unionByName(composed)
        .unionByName(growth)
        .withColumn("limit", limit)
        .withColumn("hard", F.col("limit").isNotNull())
        .withColumn("passed", F.col("limit").isNull() | (F.col("observed") <= F.col("limit")))
    )


def budget_passed(evaluation: DataFrame) -> DataFrame:
    return evaluation.agg(F.bool_and(~F.col("hard") | F.col("passed")).alias("passed"))


def startup_profile(spans: DataFrame, run: str = "run") -> DataFrame:
    """Seconds spent composing the application and loading the model, per run."""
    total = lambda names: F.sum(
        F.when(F.col("span").isin(*names), F.col("seconds")).otherwise(F.lit(0.0))
    )
    return spans.groupBy(run).agg(
        total(APPLICATION_SPANS).alias("application_seconds"),
        total(MODEL_SPANS).alias("cold_model_seconds"),
    )


def rss_growth(samples: DataFrame) -> DataFrame:
    """Absolute and percentage growth per run; NULL where the starting figure is not positive."""
    grown = F.col("post_rss_mb") - F.col("ready_rss_mb")
    ok = F.col("ready_rss_mb") > 0
    return samples.withColumns(
        {
            "growth_mb": F.when(ok, grown),
            "growth_percent": F.when(ok, grown / F.col("ready_rss_mb") * 100),
        }
    )
