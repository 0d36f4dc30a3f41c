"""Explicit place mentions in normalised text, and their tri-state comparison."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, let

# --- fixed values -----------------------------------------------------------------------------

STOP_WORDS = (
    "after", "ada", "again", "at", "banjir", "blocked", "blinking", "blink", "crossing", "dekat",
    "dengan", "flood", "flooded", "hujan", "junction", "jalan", "keeps", "lagi", "malam", "mati",
    "near", "on", "parking", "area", "pothole", "road", "rosak", "school", "selepas", "tersumbat",
    "the", "tadi", "then", "zebra",
)

LANDMARKS = {
    "sekolah menengah kebangsaan": "school",
    "sekolah kebangsaan": "school",
    "sekolah": "school",
    "school": "school",
    "hospital": "hospital",
    "clinic": "clinic",
    "stesen": "station",
    "station": "station",
    "mall": "mall",
    "pasar": "market",
    "market": "market",
    "park": "park",
    "taman permainan": "park",
}

# Comparison order of kinds.
KINDS = ("block", "landmark", "street", "unit")

ENTITY_TYPE = "array<struct<kind:string,value:string,raw:string>>"

BLOCK_PATTERN = rf"(?<!{WORD})(?:block|blok)(?:\s+|[-#]\s*)([a-z0-9]+)(?!{WORD})"
UNIT_PATTERN = rf"(?<!{WORD})unit\s*[-#]?\s*([a-z0-9]+)(?!{WORD})"
STREET_PATTERN = (
    rf"(?<!{WORD})(?:jalan|lorong|taman|kampung)\s+([a-z0-9]+(?:\s+[a-z0-9]+){{0,2}})"
)
# The words after a landmark are captured without being consumed: they may start the next match.
LANDMARK_PATTERN = (
    rf"(?<!{WORD})({'|'.join(re.escape(p) for p in LANDMARKS)})(?!{WORD})"
    r"(?=\s*((?:\S+\s*){0,4}))"
)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _entity(kind: str, value: Column, raw: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.trim(value).alias("value"), F.trim(raw).alias("raw")
    )


def _until_stop_word(words: Column, limit: int) -> Column:
    """Leading words up to the first stop word, at most ``limit``."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])

    def cut(tokens: Column) -> Column:
        # first stop word among the tokens, else one past the end
        stop_at = F.array_min(
            F.transform(
                tokens,
                lambda w, i: F.when(F.array_contains(stops, w), i).otherwise(F.size(tokens)),
            )
        )
        return F.array_join(F.slice(tokens, F.lit(1), F.coalesce(stop_at, F.lit(0))), " ")

    tokens = F.filter(F.split(F.trim(words), r"\s+"), lambda w: w != "")
    return let(F.slice(tokens, 1, limit), cut)


def _mentions(text: Column, guard: tuple[str, ...], found: Column) -> Column:
    """Run an extraction only on texts holding one of its trigger words."""
    triggered = text.contains(guard[0])
    for word in guard[1:]:
        triggered = triggered | text.contains(word)
    return F.coalesce(F.when(triggered, found), F.array().cast(ENTITY_TYPE))


def extract_locations(normalized: Column) -> Column:
    """ARRAY<STRUCT<kind, value, raw>> in block, unit, street, landmark order.

    Repeated (kind, value) mentions keep the first position and the last raw text.
    """
    blocks = F.zip_with(
        _all(normalized, BLOCK_PATTERN, 1),
        _all(normalized, BLOCK_PATTERN, 0),
        lambda v, raw: _entity("block", v, raw),
    )
    units = F.zip_with(
        _all(normalized, UNIT_PATTERN, 1),
        _all(normalized, UNIT_PATTERN, 0),
        lambda v, raw: _entity("unit", v, raw),
    )
    streets = F.zip_with(
        _all(normalized, STREET_PATTERN, 1),
        _all(normalized, STREET_PATTERN, 0),
        lambda v, raw: _entity("street", _until_stop_word(v, 3), raw),
    )
    kind_of = F.create_map(*[F.lit(x) for pair in LANDMARKS.items() for x in pair])
    named = F.zip_with(
        _all(normalized, LANDMARK_PATTERN, 1),
        _all(normalized, LANDMARK_PATTERN, 2),
        lambda prefix, after: F.struct(
            prefix.alias("prefix"), _until_stop_word(after, 4).alias("name")
        ),
    )
    landmarks = F.transform(
        F.filter(named, lambda m: m["name"] != ""),
        lambda m: _entity(
            "landmark", F.concat(F.element_at(kind_of, m["prefix"]), F.lit(":"), m["name"]), m["prefix"]
        ),
    )
    found = F.concat(
        _mentions(normalized, ("block", "blok"), blocks),
        _mentions(normalized, ("unit",), units),
        _mentions(
            normalized,
            ("jalan", "lorong", "taman", "kampung"),
            F.filter(streets, lambda e: e["value"] != ""),
        ),
        _mentions(
            normalized,
            ("sekolah", "school", "hospital", "clinic", "stesen", "station", "mall", "pasar",
             "market", "park", "taman"),
            landmarks,
        ),
    )

    def last_raw(entities: Column) -> Column:
        def same(k: Column):
            return lambda e: (e["kind"] == k["kind"]) & (e["value"] == k["value"])

        keys = F.array_distinct(
            F.transform(
                entities, lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"))
            )
        )
        return F.transform(keys, lambda k: F.element_at(F.filter(entities, same(k)), -1))

    return let(found, last_raw).cast(ENTITY_TYPE)


def location_sets(entities: Column) -> Column:
    """STRUCT of one value array per kind: computed once per report, compared per pair."""

    def values(kind: str) -> Column:
        of_kind = F.filter(entities, lambda e: e["kind"] == kind)
        return F.array_distinct(F.transform(of_kind, lambda e: e["value"]))

    return F.struct(*[values(kind).alias(kind) for kind in KINDS])


def location_tokens(entities: Column) -> Column:
    """Sorted ``kind:value`` tokens; two compatible reports always share at least one."""
    return F.array_sort(
        F.array_distinct(F.transform(entities, lambda e: F.concat(e["kind"], F.lit("="), e["value"])))
    )


def compare_location_sets(left: Column, right: Column) -> Column:
    """STRUCT<compatibility, reason>: conflicting, unknown or compatible."""
    both = {k: (F.size(left[k]) > 0) & (F.size(right[k]) > 0) for k in KINDS}
    empty = lambda side: sum((F.size(side[k]) for k in KINDS), F.lit(0)) == 0
    shared = both[KINDS[0]]
    for kind in KINDS[1:]:
        shared = shared | both[kind]
    state, reason = F, F
    for kind in KINDS:
        clash = both[kind] & ~F.arrays_overlap(left[kind], right[kind])
        state = state.when(clash, F.lit("conflicting"))
        reason = reason.when(clash, F.lit(f"conflicting {kind} entities"))
    missing = empty(left) | empty(right)
    state = state.when(missing, F.lit("unknown")).when(shared, F.lit("compatible"))
    reason = reason.when(
        missing, F.lit("one or both complaints lack explicit comparable location entities")
    ).when(shared, F.lit("at least one explicit location entity agrees"))
    return F.struct(
        state.otherwise(F.lit("unknown")).alias("compatibility"),
        reason.otherwise(F.lit("explicit entities exist but have no comparable kind")).alias(
            "reason"
        ),
    )


def compare_locations(left: Column, right: Column) -> Column:
    """Tri-state comparison straight from entity arrays."""
    return compare_location_sets(location_sets(left), location_sets(right))
