"""Deterministic identifiers and request fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 4122 URL namespace.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
LANES = 8


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based (SHA-1) UUID as canonical lowercase text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    high = F.substring(digest, 17, 1)
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab"]),
        (F.pmod(F.instr(F.lit("0123456789abcdef"), high) - 1, F.lit(4)) + 1).cast("int"),
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def review_id(left_id: Column, right_id: Column, prefix: str = "review-v1:") -> Column:
    """One review per unordered pair."""
    return uuid5(
        F.concat(F.lit(prefix), F.least(left_id, right_id), F.lit(":"), F.greatest(left_id, right_id))
    )


def request_fingerprint(
    normalized_text: Column,
    latitude: Column,
    longitude: Column,
    reported_at: Column,
    category: Column,
    photo_path: Column,
) -> Column:
    """SHA-256 identity of a request; equal content gives equal fingerprints."""
    parts = [
        normalized_text,
        latitude.cast("string"),
        longitude.cast("string"),
        F.unix_micros(reported_at).cast("string"),
        F.coalesce(category, F.lit("other")),
        F.coalesce(photo_path, F.lit("\u0000")),
    ]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def digest_lanes(row_digest: Column) -> list[Column]:
    """Split a 64-hex digest into eight 32-bit numbers.

    Their sums identify a *set* of rows whatever the order, merge across partitions, and need no
    group to be gathered in one place.
    """
    return [
        F.conv(F.substring(row_digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
        for i in range(LANES)
    ]


def set_digest(row_digest: Column) -> Column:
    """Aggregate: order-independent SHA-256 over the multiset of row digests."""
    sums = [F.sum(lane).cast("string") for lane in digest_lanes(row_digest)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256)
