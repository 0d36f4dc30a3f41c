"""Vector columns: cosine similarity, integrity, and a feature-hashing text encoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def is_usable(vector: Column) -> Column:
    """Non-empty, finite in every element, and not all zero."""
    return F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def cosine_from_parts(left: Column, left_norm: Column, right: Column, right_norm: Column) -> Column:
    """Cosine with norms already known per vector, clamped; NULL on bad input."""
    value = dot(left, right) / (left_norm * right_norm)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
    return F.when(
        (F.size(left) == F.size(right)) & (left_norm > 0) & (right_norm > 0) & ~F.isnan(value),
        clamped,
    )


def cosine_similarity(left: Column, right: Column) -> Column:
    usable = is_usable(left) & is_usable(right)
    return F.when(usable, cosine_from_parts(left, norm(left), right, norm(right)))


def hashed_bag_of_words(normalized: Column, dimension: int = 64) -> Column:
    """Deterministic unit-length embedding of the words of a text, as column expressions."""
    words = F.filter(F.split(normalized, " "), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int"))
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"),
    )
    length = norm(counts)
    return F.transform(
        counts, lambda c: F.when(length > 0, c / length).otherwise(c).cast("float")
    )
