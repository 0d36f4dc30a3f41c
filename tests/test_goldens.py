"""Published results of the matcher on forty labelled pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reportmesh.functions.geo import haversine_metres
from reportmesh.functions.text import normalize_text
from reportmesh.operators import evaluation, matching, sets
from reportmesh.policy import MatchingPolicy, PerformanceBudget, PriorityPolicy

# Pair, split, expectation, kind of positive, categories, coordinates of both reports, hours between
# them, similarity, place comparison, published decision.
PAIRS = [
    ("P01", "calibration", "match", None, "blocked_drain", "blocked_drain", 3.139, 101.6869, 3.1402, 101.6875, 2.0, 0.9205415569, "unknown", "review_required"),
    ("P02", "calibration", "match", None, "flooding", "flooding", 3.145, 101.69, 3.146, 101.691, 24.0, 0.8842052969, "conflicting", "no_match"),
    ("P03", "calibration", "match", None, "pothole", "pothole", 3.15, 101.695, 3.151, 101.6955, 3.0, 0.9265776027, "unknown", "review_required"),
    ("P04", "calibration", "match", None, "rubbish", "rubbish", 3.155, 101.7, 3.156, 101.7005, 24.0, 0.9537846554, "compatible", "auto_match"),
    ("P05", "calibration", "match", None, "street_light", "street_light", 3.16, 101.705, 3.161, 101.7055, 3.0, 0.9108763628, "unknown", "review_required"),
    ("P06", "calibration", "match", None, "blocked_drain", "blocked_drain", 3.165, 101.71, 3.166, 101.7105, 24.0, 0.9022280992, "unknown", "review_required"),
    ("P07", "calibration", "match", None, "blocked_drain", "blocked_drain", 3.17, 101.715, 3.171, 101.7155, 3.0, 0.9428658757, "unknown", "review_required"),
    ("P08", "calibration", "match", None, "flooding", "flooding", 3.175, 101.72, 3.176, 101.7205, 24.0, 0.8854288306, "unknown", "review_required"),
    ("P09", "calibration", "match", None, "pothole", "pothole", 3.18, 101.725, 3.181, 101.7255, 3.0, 0.9252728545, "compatible", "auto_match"),
    ("P10", "calibration", "match", None, "rubbish", "rubbish", 3.185, 101.73, 3.186, 101.7305, 24.0, 0.9142749398, "unknown", "review_required"),
    ("P11", "holdout", "match", None, "street_light", "street_light", 3.19, 101.735, 3.191, 101.7355, 3.0, 0.9196982351, "unknown", "review_required"),
    ("P12", "holdout", "match", None, "blocked_drain", "blocked_drain", 3.195, 101.74, 3.196, 101.7405, 24.0, 0.9166339865, "unknown", "review_required"),
    ("P13", "holdout", "match", None, "pothole", "pothole", 3.2, 101.745, 3.201, 101.7455, 3.0, 0.8952597694, "unknown", "review_required"),
    ("P14", "holdout", "match", None, "flooding", "flooding", 3.205, 101.75, 3.206, 101.7505, 24.0, 0.9632857295, "unknown", "review_required"),
    ("P15", "holdout", "match", None, "pothole", "pothole", 3.21, 101.755, 3.211, 101.7555, 3.0, 0.9065671511, "unknown", "review_required"),
    ("P16", "holdout", "match", "clear", "rubbish", "rubbish", 3.215, 101.76, 3.2153, 101.7602, 1.0, 0.9232639621, "compatible", "auto_match"),
    ("P17", "holdout", "match", "clear", "pothole", "pothole", 3.216, 101.761, 3.2163, 101.7612, 1.0, 0.9563698087, "compatible", "auto_match"),
    ("P18", "holdout", "match", "clear", "street_light", "street_light", 3.217, 101.762, 3.2173, 101.7622, 1.0, 0.9567293125, "compatible", "auto_match"),
    ("P19", "holdout", "match", "clear", "blocked_drain", "blocked_drain", 3.218, 101.763, 3.2183, 101.7632, 1.0, 0.9116038855, "compatible", "review_required"),
    ("P20", "holdout", "match", "ambiguous", "pothole", "pothole", 3.219, 101.764, 3.2193, 101.7642, 1.0, 0.9256731087, "unknown", "review_required"),
    ("N01", "calibration", "non_match", None, "pothole", "pothole", 3.22, 101.765, 3.235, 101.78, 1.0, 0.8881452218, "conflicting", "no_match"),
    ("N02", "calibration", "non_match", None, "blocked_drain", "street_light", 3.225, 101.77, 3.2252, 101.7702, 1.0, 0.9312191631, "unknown", "no_match"),
    ("N03", "calibration", "non_match", None, "rubbish", "rubbish", 3.23, 101.775, 3.2302, 101.7752, 1.0, 0.9883089171, "conflicting", "no_match"),
    ("N04", "calibration", "non_match", None, "flooding", "flooding", 3.235, 101.78, 3.25, 101.795, 1.0, 0.9515068526, "unknown", "no_match"),
    ("N05", "calibration", "non_match", None, "pothole", "pothole", 3.24, 101.785, 3.2402, 101.7852, 1.0, 0.9629210042, "unknown", "review_required"),
    ("N06", "calibration", "non_match", None, "blocked_drain", "street_light", 3.245, 101.79, 3.2452, 101.7902, 1.0, 0.9139733382, "unknown", "no_match"),
    ("N07", "calibration", "non_match", None, "pothole", "pothole", 3.25, 101.795, 3.2502, 101.7952, 1.0, 0.9286737445, "unknown", "review_required"),
    ("N08", "calibration", "non_match", None, "flooding", "flooding", 3.255, 101.8, 3.2552, 101.8002, 1.0, 0.9655974928, "conflicting", "no_match"),
    ("N09", "calibration", "non_match", None, "street_light", "street_light", 3.26, 101.805, 3.2602, 101.8052, 1488.0, 0.9552572566, "compatible", "no_match"),
    ("N10", "calibration", "non_match", None, "rubbish", "rubbish", 3.265, 101.81, 3.2652, 101.8102, 1.0, 0.9833822504, "unknown", "review_required"),
    ("N11", "holdout", "non_match", None, "pothole", "pothole", 3.27, 101.815, 3.285, 101.83, 1.0, 0.9259541177, "conflicting", "no_match"),
    ("N12", "holdout", "non_match", None, "blocked_drain", "rubbish", 3.275, 101.82, 3.2752, 101.8202, 1.0, 0.9632974496, "unknown", "no_match"),
    ("N13", "holdout", "non_match", None, "street_light", "street_light", 3.28, 101.825, 3.2802, 101.8252, 1.0, 0.9112843901, "compatible", "review_required"),
    ("N14", "holdout", "non_match", None, "pothole", "pothole", 3.285, 101.83, 3.2852, 101.8302, 1.0, 0.9646468424, "conflicting", "no_match"),
    ("N15", "holdout", "non_match", None, "blocked_drain", "blocked_drain", 3.29, 101.835, 3.2902, 101.8352, 3672.0, 0.9614841693, "unknown", "no_match"),
    ("N16", "holdout", "non_match", None, "pothole", "pothole", 3.22, 101.765, 3.2203, 101.7652, 1.0, 0.9635791426, "conflicting", "no_match"),
    ("N17", "holdout", "non_match", None, "pothole", "pothole", 3.221, 101.766, 3.2213, 101.7662, 1.0, 0.9780029768, "conflicting", "no_match"),
    ("N18", "holdout", "non_match", None, "flooding", "flooding", 3.222, 101.767, 3.2223, 101.7672, 1.0, 0.9735642615, "conflicting", "no_match"),
    ("N19", "holdout", "non_match", None, "street_light", "street_light", 3.223, 101.768, 3.2233, 101.7682, 1.0, 0.9555031795, "conflicting", "no_match"),
    ("N20", "holdout", "non_match", None, "blocked_drain", "blocked_drain", 3.224, 101.769, 3.2243, 101.7692, 1.0, 0.9792433325, "conflicting", "no_match"),
]
THRESHOLD = 0.98831
HOLDOUT = {
    "false_auto_merges": 0, "auto_matches": 3, "review_required": 8, "no_matches": 9, "positive_no_matches": 0, "clear_positive_count": 4,
    "clear_auto_matches": 3, "clear_positive_no_matches": 0, "clear_positive_auto_rate": 0.75, "positive_count": 10, "negative_count": 10, "passed": True,
}


@pytest.fixture(scope="module")
def pairs(spark):
    schema = (
        "pair_id string, split string, incident_expected string, positive_type string, left_category string, right_category string, lat_a double, "
        "lon_a double, lat_b double, lon_b double, hours double, semantic_similarity double, place string, published string"
    )
    df = spark.createDataFrame(PAIRS, schema)
    return df.select(
        "*",
        haversine_metres(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("distance_metres"),
        (F.col("hours") * 3600).alias("time_gap_seconds"),
        F.struct(F.col("place").alias("compatibility"), F.lit("place").alias("reason")).alias("location"),
        F.col("semantic_similarity").alias("score"), F.col("incident_expected").alias("label"),
    ).cache()


def test_published_threshold_and_decisions(pairs):
    policy = evaluation.calibrated_policy(pairs, MatchingPolicy())
    assert policy.semantic_threshold == pytest.approx(THRESHOLD, abs=5e-6)
    decided = matching.match_pairs(pairs, policy)
    assert {r["pair_id"]: r["decision"] for r in decided.collect()} == {p[0]: p[-1] for p in PAIRS}
    report = evaluation.holdout_report(decided).first().asDict()
    assert {k: report[k] for k in HOLDOUT} == HOLDOUT


# Fixed values of the published policies, stated once more: queries and their SQL both read the code's.
MATCHING = {
    "policy_version": "matching-v1", "geographic_radius_metres": 500, "temporal_window_days": 7, "semantic_threshold": 0.88,
    "strong_entity_semantic_threshold": 0.92, "model_name": "intfloat/multilingual-e5-small", "normalization_version": "normalization-v1",
}
PRIORITY = {
    "policy_version": "priority-v1", "sensitive_location_radius_metres": 250, "medium_report_count": 2, "high_report_count": 10,
    "critical_report_count": 20, "high_unresolved_hours": 24, "critical_unresolved_hours": 48, "evidence_completeness_threshold": 0.5,
    "critical_safety_signals": ("accident_injury", "exposed_electrical_hazard"), "high_safety_signals": ("active_flooding", "blocked_road"),
}
BUDGET = {
    "application_composition_seconds_max": 5.0, "warm_readiness_seconds_max": 2.0, "cold_cached_model_initialization_seconds_max": 25.0,
    "incident_list_p95_ms_max": 250.0, "incident_detail_p95_ms_max": 200.0, "submission_p95_ms_max": 2500.0,
    "review_resolution_p95_ms_max": 2000.0, "reset_seconds_max": 45.0, "ready_rss_mb_max": 1536.0,
    "mutation_memory_growth_percent_max": 15.0, "dashboard_first_usable_seconds_max": 5.0,
}
ALIASES = {
    "longkang sumbat": "longkang tersumbat", "lampu jln": "lampu jalan", "jln": "jalan", "tmn": "taman", "lrng": "lorong",
    "blk": "blok", "sek": "sekolah", "smk": "sekolah menengah kebangsaan", "sk": "sekolah kebangsaan", "kg": "kampung",
    "dpn": "depan", "skolah": "sekolah", "kat": "dekat", "sampah tak kutip": "sampah tidak dikutip",
}


@pytest.mark.parametrize(("policy", "stated"), [(MatchingPolicy(), MATCHING), (PriorityPolicy(), PRIORITY), (PerformanceBudget(), BUDGET)])
def test_published_values(policy, stated):
    assert vars(policy) == stated


def test_published_aliases(spark):
    df = spark.createDataFrame(list(ALIASES.items()), "short string, long string")
    got = df.select("short", normalize_text(F.col("short")).alias("alone"), normalize_text(F.concat(F.lit("x "), "short", F.lit(" y"))).alias("inside"))
    assert {r["short"]: r["alone"] for r in got.collect()} == ALIASES
    assert {r["short"]: r["inside"] for r in got.collect()} == {k: f"x {v} y" for k, v in ALIASES.items()}


def test_deletion_cascades_to_both_ends(spark):
    """Rows that name a deleted report in any id column go; null references and unknown tombstones touch nothing."""
    tables = {
        "complaints": spark.createDataFrame([("a",), ("b",), ("c",)], "id string"),
        "keys": spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", None)], "idempotency_key string, complaint_id string"),
        "edges": spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c")], "left_id string, right_id string"),
        "places": spark.createDataFrame([("a",)], "place_id string"),
    }
    gone = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    left = {k: sorted(map(str, map(list, map(tuple, df.select(*tables[k].columns).collect())))) for k, df in sets.cascade_delete(tables, gone).items()}
    assert left == {
        "complaints": ["['b']", "['c']"], "keys": ["['k2', 'b']", "['k3', None]"],
        "edges": ["['b', 'c']", "['c', 'c']"], "places": ["['a']"],
    }
