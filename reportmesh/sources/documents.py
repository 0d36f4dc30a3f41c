"""Readers of JSON documents: complaint seeds, place lists, alias maps, benchmark pair files.

Reading a path and parsing a text column share the same code; a folder of many documents is read
in parallel, one row per document, and exploded to typed rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..policy import NORMALIZATION_VERSION

SEED_SCHEMA = """manifest STRUCT<seed_version STRING, content_sha256 STRING,
    normalization_version STRING, embedding_model STRING, embedding_dimension INT,
    matching_policy_version STRING, priority_policy_version STRING>,
  complaints ARRAY<STRUCT<seed_key STRING, text STRING, latitude DOUBLE, longitude DOUBLE,
    reported_at STRING, category STRING, photo_path STRING>>,
  review_resolutions ARRAY<STRUCT<left_seed_key STRING, right_seed_key STRING,
    final_state STRING, reviewer_id STRING, note STRING>>"""
PLACES_SCHEMA = "ARRAY<STRUCT<id STRING, kind STRING, latitude DOUBLE, longitude DOUBLE>>"
TEXT_PAIR_SCHEMA = """id STRING, `group` STRING, expected STRING, positive_type STRING,
    incident_expected STRING, complaint_a STRING, complaint_b STRING, rationale STRING"""
PAIR_METADATA_SCHEMA = """id STRING, category_a STRING, category_b STRING, latitude_a DOUBLE,
    longitude_a DOUBLE, latitude_b DOUBLE, longitude_b DOUBLE, reported_at_a STRING,
    reported_at_b STRING, split STRING, incident_expected STRING"""


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per document."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")


def parse_seed(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests, complaints, resolutions) from a ``document`` column of seed JSON."""
    parsed = documents.select(
        F.from_json("document", f"STRUCT<{_struct(SEED_SCHEMA)}>", {"mode": "FAILFAST"}).alias("d")
    )
    return (
        parsed.select("d.manifest.*"),
        parsed.select(F.inline("d.complaints")),
        parsed.select(F.inline("d.review_resolutions")),
    )


def _struct(ddl: str) -> str:
    """Top-level ``name TYPE`` pairs as ``name: TYPE`` for use inside STRUCT<...>."""
    for name in ("manifest", "complaints", "review_resolutions"):
        ddl = ddl.replace(f"{name} ", f"{name}: ", 1)
    return ddl


def read_complaint_seed(spark: SparkSession, path: str):
    return parse_seed(read_texts(spark, path))


def seed_violations(complaints: DataFrame) -> DataFrame:
    """Repeated seed keys; a seed must also hold at least one complaint."""
    repeated = complaints.groupBy("seed_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.select("seed_key", "n")


def parse_places(documents: DataFrame) -> DataFrame:
    """Sensitive places from JSON arrays; malformed documents fail the read."""
    return documents.select(
        F.inline(F.from_json("document", PLACES_SCHEMA, {"mode": "FAILFAST"}))
    ).withColumnRenamed("id", "place_id")


def place_violations(places: DataFrame) -> DataFrame:
    inside = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    named = (F.length("place_id") > 0) & (F.length("kind") > 0)
    return places.filter(~F.coalesce(inside & named, F.lit(False)))


def read_sensitive_locations(spark: SparkSession, path: str) -> DataFrame:
    return parse_places(read_texts(spark, path))


def read_aliases(spark: SparkSession, path: str) -> dict[str, str]:
    """Versioned alias map: a small driver-side config that becomes literals in the plan."""
    payload = json.loads(read_texts(spark, path).first()["document"])
    if payload.get("version") != NORMALIZATION_VERSION:
        raise ValueError(f"expected {NORMALIZATION_VERSION}, got {payload.get('version')}")
    aliases = payload.get("aliases")
    if set(payload) != {"version", "aliases"} or not aliases:
        raise ValueError("alias file needs exactly a version and a non-empty alias map")
    return dict(aliases)


def read_pair_files(spark: SparkSession, text_path: str, metadata_path: str):
    """(texts, metadata) of a labelled benchmark."""
    texts = spark.read.schema(TEXT_PAIR_SCHEMA).json(text_path, multiLine=True)
    metadata = spark.read.schema(PAIR_METADATA_SCHEMA).json(metadata_path, multiLine=True)
    return texts, metadata
