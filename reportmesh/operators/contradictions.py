"""Contradictions inside confirmed components, counted on the collapsed graph.

A pair contradicts its component when both reports are near in place and time but name different places,
or when an officer rejected it. Such pairs are found between nodes, which stand for all copies of a report,
and only in components that name two different places of one kind. No table of report pairs is made.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..policy import AUTO_MATCH, NO_MATCH, MatchingPolicy
from .collapse import CollapsedGraph, among_candidates, near_nodes, place_state
from .matching import ordered_pair

#: Slices of a time window in which rows of two nodes are compared one by one.
SLICES = 64


def _disagreeing(nodes: DataFrame) -> DataFrame:
    """Components that name two values of one kind of place: all others hold no contradiction."""
    mention = F.split("token", "=", 2)
    named = nodes.select("component", F.explode("tokens").alias("token")).select("component", mention[0].alias("kind"), "token").distinct()
    several = named.groupBy("component", "kind").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return several.select("component").distinct()


def _pairs_in_window(partial: DataFrame, times: DataFrame, window_us: int, limit_us: float) -> DataFrame:
    """(component, n): rows of ``early`` and ``late`` nodes at most the window apart.

    The rows of a pair of nodes are counted by running sums: whole slices by their totals, rows of the
    slice in which the window ends one by one. Each slice is a group of its own, so no task holds a pair.
    """
    pair, width = ["component", "early", "late"], math.ceil(window_us / SLICES)
    rows = lambda end, at, early, late: partial.join(times.withColumnRenamed("node", end), end).select(
        *pair, at.alias("at"), early.alias("early_rows"), late.alias("late_rows")
    )
    none, n = F.lit(0).cast("bigint"), F.col("n")
    both = rows("early", F.col("us") + F.lit(math.floor(limit_us)), n, none).unionByName(rows("late", F.col("us"), none, n))
    sliced = both.withColumn("slice", F.floor(F.col("at") / F.lit(width)).cast("bigint"))
    in_slice = Window.partitionBy(*pair, "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cells = (
        sliced.withColumn("reached", F.sum("late_rows").over(in_slice))
        .groupBy(*pair, "slice")
        .agg(F.sum("late_rows").alias("late_rows"), F.sum("early_rows").alias("early_rows"), F.sum(F.col("early_rows") * F.col("reached")).alias("inside"))
    )
    before = Window.partitionBy(*pair).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("late_rows").over(before), none)
    return cells.select("component", (F.col("inside") + F.col("early_rows") * earlier).alias("n"))


def conflict_counts(
    graph: CollapsedGraph,
    complaints: DataFrame,
    policy: MatchingPolicy = MatchingPolicy(),
    reviews: DataFrame | None = None,
    *,
    hot_rows: int = 5_000,
) -> DataFrame:
    """(component, conflict_count): as many rows as ``incidents.conflicts`` lists for each component.

    ``reviews`` must be those that the graph was built with. Components without a contradiction have no row.
    """
    window_us = math.ceil(policy.window_seconds * 1e6)
    limit_us = policy.window_seconds * 1e6
    nodes = graph.nodes.filter("eligible").join(graph.labels.select("node", "component"), "node")
    clashing = near_nodes(nodes.join(_disagreeing(nodes), "component", "left_semi"), "component", policy, hot_rows).filter(
        place_state() == "conflicting"
    )
    resolved = None
    if reviews is not None:
        final = F.col("final_relationship_state")
        resolved = ordered_pair(reviews.filter((F.col("status") != "pending") & final.isin(AUTO_MATCH, NO_MATCH)))
        # decided reports are their own nodes: a decided pair is a pair of nodes
        decided = resolved.select(F.col("left_id").alias("p_node"), F.col("right_id").alias("b_node"))
        clashing = clashing.join(decided, ["p_node", "b_node"], "left_anti")
    span = F.greatest("p_hi", "b_hi") - F.least("p_lo", "b_lo")
    first = F.col("p_lo") <= F.col("b_lo")
    found = clashing.select(
        "component", (span <= limit_us).alias("whole"), (F.col("p_rows") * F.col("b_rows")).alias("n"),
        F.when(first, F.col("p_node")).otherwise(F.col("b_node")).alias("early"),
        F.when(first, F.col("b_node")).otherwise(F.col("p_node")).alias("late"),
    )
    partial = found.filter(~F.col("whole")).select("component", "early", "late")
    times = graph.assigned.groupBy("node", "us").agg(F.count(F.lit(1)).alias("n"))
    counts = found.filter("whole").select("component", "n").unionByName(_pairs_in_window(partial, times, window_us, limit_us))
    if resolved is not None:
        label = lambda end: graph.labels.select(F.col("node").alias(f"{end}_id"), F.col("component").alias(f"{end}_component"))
        rejected = among_candidates(resolved.filter(final == NO_MATCH), complaints, policy)
        inside = rejected.join(label("left"), "left_id").join(label("right"), "right_id").filter("left_component = right_component")
        counts = counts.unionByName(inside.select(F.col("left_component").alias("component"), F.lit(1).cast("bigint").alias("n")))
    return counts.groupBy("component").agg(F.sum("n").alias("conflict_count")).filter("conflict_count > 0")
