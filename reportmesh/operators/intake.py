"""Intake: validation with typed rejections, UTC times, categories, fingerprints, idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import request_fingerprint
from ..functions.locations import extract_locations
from ..functions.text import classify_category, collapse_spaces, normalize_text
from ..policy import CATEGORIES, OTHER

TEXT_MIN, TEXT_MAX = 3, 2000
PHOTO_PATH_MAX = 255
RESERVED_PREFIX = "uploads/"
FUTURE_TOLERANCE = "5 minutes"
_EDGE_SPACE = r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$"
_OFFSET = r"(?i)(?:Z|[+-]\d{2}:?\d{2})$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def to_utc(text: Column) -> Column:
    """ISO-8601 text with an offset to a timestamp; naive or malformed text gives NULL."""
    return F.when(F.trim(text).rlike(_OFFSET), F.try_to_timestamp(F.trim(text)))


def rejection_reasons(now: Column) -> Column:
    """Array of every rule a raw report breaks; empty when it is acceptable.

    Late reports are accepted: there is no lower bound on time. ``now`` is explicit and truncated
    to the second.
    """
    length = F.length(F.col("text"))
    latest = F.date_trunc("second", now) + F.expr(f"interval {FUTURE_TOLERANCE}")
    inside = lambda c, bound: F.coalesce(F.col(c).between(-bound, bound), F.lit(False))
    checks = [
        (F.col("text").isNull() | (F.length(strip(F.col("text"))) < TEXT_MIN), "text_too_short"),
        (length > TEXT_MAX, "text_too_long"),
        (~inside("latitude", 90), "latitude_out_of_range"),
        (~inside("longitude", 180), "longitude_out_of_range"),
        (F.col("reported_at").isNull(), "reported_at_missing_or_naive"),
        (F.col("reported_at") > latest, "reported_at_in_future"),
        (~F.col("category").isin(*CATEGORIES), "unknown_category"),
        (F.col("photo_path").startswith(RESERVED_PREFIX), "photo_path_reserved"),
        (F.length("photo_path") > PHOTO_PATH_MAX, "photo_path_too_long"),
        (F.col("photo_path").isNotNull() & F.col("photo_id").isNotNull(), "photo_fields_conflict"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))


IDENTITY = ("idempotency_key", "sequence", "complaint_id")


def identity_rejections() -> Column:
    """Array of the identity fields a command lacks."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in IDENTITY]))


def validate_commands(commands: DataFrame) -> DataFrame:
    """Commands with ``rejections``; those without a key, a sequence or a complaint id have some."""
    earlier = F.col("rejections") if "rejections" in commands.columns else F.array().cast("array<string>")
    return commands.withColumn("rejections", F.concat(earlier, identity_rejections()))


def validate_complaints(raw: DataFrame, now: Column) -> DataFrame:
    """Raw rows with stripped text and ``rejections``; valid rows have none."""
    return raw.withColumn("rejections", rejection_reasons(now)).withColumn(
        "text", strip(F.col("text"))
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.size("rejections") == 0
    return validated.filter(ok).drop("rejections"), validated.filter(~ok)


def resolve_category(explicit: Column, predicted: Column) -> Column:
    return F.coalesce(explicit, predicted, F.lit(OTHER))


def to_complaints(valid: DataFrame) -> DataFrame:
    """Valid reports to full complaints: normalised text, places, category, matched terms."""
    df = valid.withColumn("normalized_text", normalize_text(F.col("text")))
    df = df.withColumn("prediction", classify_category(F.col("normalized_text")))
    return df.select(
        *[c for c in valid.columns if c != "category"],
        "normalized_text",
        resolve_category(F.col("category"), F.col("prediction.category")).alias("category"),
        F.col("prediction.matched_terms").alias("matched_terms"),
        extract_locations(F.col("normalized_text")).alias("locations"),
    )


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "request_fingerprint",
        request_fingerprint(
            *[
                F.col(c)
                for c in (
                    "normalized_text", "latitude", "longitude", "reported_at", "category",
                    "photo_path",
                )
            ]
        ),
    )


def idempotent_outcomes(submissions: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Outcome per command: first of a key is created, equal repeats replay, others conflict.

    The first command of a key has its lowest (sequence, complaint_id), so commands that share a
    sequence never both count as first. Commands in ``history`` (first commands of earlier batches)
    come before all of ``submissions`` and get no outcome themselves. A command without key, sequence or
    complaint id is ``invalid`` and counts for no key. The first is a map-side combined minimum; commands of a very frequent key are then compared against it in several tasks.
    """
    from .skew import lookup

    columns = ("idempotency_key", "sequence", "complaint_id", "request_fingerprint")
    known = F.size(identity_rejections()) == 0
    rows = submissions.filter(known).select(*columns, F.lit(True).alias("_new"))
    invalid = submissions.filter(~known).select(
        "idempotency_key", "sequence", F.lit("invalid").alias("outcome"), F.lit(None).cast("string").alias("complaint_id")
    )
    if history is not None:
        rows = history.select(
            "idempotency_key", F.lit(None).cast("bigint").alias("sequence"), "complaint_id",
            "request_fingerprint", F.lit(False).alias("_new"),
        ).unionByName(rows)
    first = rows.groupBy("idempotency_key").agg(
        F.min(F.struct("_new", "sequence", "complaint_id", "request_fingerprint")).alias("first"),
        F.count(F.lit(1)).alias("_rows"),
    )
    joined = lookup(rows, first, ["idempotency_key"], spread_by="sequence", row_count="_rows")
    is_first = F.col("first._new")
    for c in ("sequence", "complaint_id"):
        is_first = is_first & F.col(c).eqNullSafe(F.col(f"first.{c}"))
    outcome = (
        F.when(is_first, F.lit("created"))
        .when(F.col("request_fingerprint") == F.col("first.request_fingerprint"), F.lit("replayed"))
        .otherwise(F.lit("conflict"))
    )
    return joined.filter("_new").select(
        "idempotency_key",
        "sequence",
        outcome.alias("outcome"),
        F.when(outcome != "conflict", F.col("first.complaint_id")).alias("complaint_id"),
    ).unionByName(invalid)


def claim_complaints(outcomes: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Outcomes in which one command at most creates a complaint.

    Of several keys that name one complaint id the lowest (sequence, key) creates it; the others, and all
    for an id of ``stored_ids``, are ``complaint_id_taken``. Replays of such a key share its outcome.
    """
    from .skew import lookup

    created = outcomes.filter("outcome = 'created'")
    owner = created.groupBy("complaint_id").agg(
        F.min(F.struct("sequence", "idempotency_key")).alias("_owner"), F.count(F.lit(1)).alias("_rows")
    ).join(stored_ids.select(F.col("id").alias("complaint_id")).distinct().withColumn("_stored", F.lit(True)), "complaint_id", "left")
    checked = lookup(created, owner, ["complaint_id"], spread_by="sequence", row_count="_rows")
    lost = checked.filter(
        F.col("_stored").isNotNull() | (F.col("_owner") != F.struct("sequence", "idempotency_key"))
    ).select("idempotency_key", F.lit(True).alias("_taken"))
    taken = F.col("_taken").isNotNull() & F.col("outcome").isin("created", "replayed")
    return lookup(outcomes, lost, ["idempotency_key"], spread_by="sequence", how="left").select(
        "idempotency_key", "sequence",
        F.when(taken, F.lit("complaint_id_taken")).otherwise(F.col("outcome")).alias("outcome"),
        F.when(~taken, F.col("complaint_id")).alias("complaint_id"),
    )
