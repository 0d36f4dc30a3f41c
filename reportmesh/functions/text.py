"""Text columns: normalisation, category lexicon, negation-aware term hits.

Everything is a column expression except NFKC + case folding of rows holding non-ASCII
characters, which Spark has no built-in for.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policy import OTHER

# --- fixed values -----------------------------------------------------------------------------

# Spelling aliases, normalization-v1.
ALIASES: dict[str, str] = {
    "longkang sumbat": "longkang tersumbat",
    "lampu jln": "lampu jalan",
    "jln": "jalan",
    "tmn": "taman",
    "lrng": "lorong",
    "blk": "blok",
    "sek": "sekolah",
    "smk": "sekolah menengah kebangsaan",
    "sk": "sekolah kebangsaan",
    "kg": "kampung",
    "dpn": "depan",
    "skolah": "sekolah",
    "kat": "dekat",
    "sampah tak kutip": "sampah tidak dikutip",
}

# Category lexicon.
CATEGORY_TERMS: dict[str, tuple[str, ...]] = {
    "pothole": ("pothole", "jalan berlubang", "lubang jalan", "road hole"),
    "blocked_drain": ("longkang tersumbat", "drain blocked", "blocked drain", "saliran tersumbat"),
    "flooding": ("banjir", "flood", "flooding", "flooded", "air naik", "flash flood"),
    "rubbish": (
        "sampah tidak dikutip",
        "sampah tak kutip",
        "garbage",
        "rubbish",
        "overflowing bin",
    ),
    "street_light": ("lampu jalan", "street light", "streetlight", "lampu rosak"),
}

# Safety lexicon.
SAFETY_TERMS: dict[str, tuple[str, ...]] = {
    "active_flooding": ("banjir", "flood", "flooding", "flooded", "air naik", "flash flood"),
    "accident_injury": (
        "accident",
        "kemalangan",
        "injury",
        "cedera",
        "motor hampir jatuh",
    ),
    "blocked_road": (
        "blocked road",
        "jalan blocked",
        "jalan terhalang",
        "road obstruction",
        "tutup jalan",
    ),
    "exposed_electrical_hazard": (
        "exposed wire",
        "wayar terdedah",
        "kabel terdedah",
        "live wire",
    ),
}
NEGATION_WORDS = ("no", "not", "tak", "tiada", "tidak", "tanpa")
RESOLUTION_WORDS = ("ended", "receded", "resolved", "subsided", "surut")
CLEAR_WORDS = ("clear", "cleared")
HISTORICAL_WORDS = ("previously", "was", "were")

# --- patterns ---------------------------------------------------------------------------------

# Java's \w, \s and \b are ASCII-only, so word and space classes are spelled out.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def whole_word(term: str) -> str:
    return rf"(?<!{WORD}){re.escape(term)}(?!{WORD})"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(column: Column, pattern: str) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


# --- normalisation ----------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _fold_unicode(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC").str.casefold()


def fold_case(text: Column) -> Column:
    """NFKC + case fold. ASCII rows stay in the JVM: the Python side sees NULL for them."""
    non_ascii = text.rlike(r"[^\x00-\x7f]")
    folded = _fold_unicode(F.when(non_ascii, text))
    return F.when(non_ascii, folded).otherwise(F.lower(text))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def normalize_text(text: Column, aliases: Mapping[str, str] = ALIASES) -> Column:
    """Canonical spelling: fold, punctuation to spaces, collapse, whole-word aliases in order.

    Longer aliases go first and each replacement is visible to the ones after it.
    """
    out = collapse_spaces(F.regexp_replace(fold_case(text), r"\p{P}", " "))
    for source in sorted(aliases, key=len, reverse=True):
        target = aliases[source].replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, whole_word(source), target)
    return collapse_spaces(out)


# --- category ---------------------------------------------------------------------------------


def contains_term(text: Column, term: str) -> Column:
    # the substring test is a cheap guard: most rows never reach the regex
    return text.contains(term) & text.rlike(whole_word(term))


def classify_category(normalized: Column) -> Column:
    """STRUCT<category, matched_terms, review_required>; a tie or no hit means ``other``."""
    found = F.struct(
        *[
            F.array_compact(
                F.array(*[F.when(contains_term(normalized, t), F.lit(t)) for t in terms])
            ).alias(name)
            for name, terms in CATEGORY_TERMS.items()
        ]
    )

    def decide(hits: Column) -> Column:
        counts = {name: F.size(hits[name]) for name in CATEGORY_TERMS}
        best = F.greatest(*counts.values())
        winners = sum((F.when(c == best, 1).otherwise(0) for c in counts.values()), F.lit(0))
        decided = (best > 0) & (winners == 1)
        category = F.lit(OTHER)
        terms = F.concat(*[hits[name] for name in CATEGORY_TERMS])
        for name, count in counts.items():
            won = decided & (count == best)
            category = F.when(won, F.lit(name)).otherwise(category)
            terms = F.when(won, hits[name]).otherwise(terms)
        return F.struct(
            category.alias("category"),
            F.array_sort(terms).alias("matched_terms"),
            (~decided).alias("review_required"),
        )

    return let(found, decide)


# --- negation-aware hits ----------------------------------------------------------------------


def _last(words: Column, n: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - (n - 1), F.lit(1)), n)


def _any_in(words: Column, vocabulary: Sequence[str]) -> Column:
    return F.arrays_overlap(words, _strings(vocabulary))


def _occurrence_exists(text: Column, term: str, accept) -> Column:
    """True when ``accept(prefix, suffix)`` holds for some whole-word occurrence of ``term``.

    Splitting on the term yields n + 1 pieces for n occurrences; gluing the pieces on either side
    of a cut back together gives that occurrence's exact prefix and suffix.
    """

    def scan(pieces: Column) -> Column:
        def at(i: Column) -> Column:
            prefix = F.array_join(F.slice(pieces, F.lit(1), i), term)
            suffix = F.array_join(F.slice(pieces, i + 1, F.size(pieces)), term)
            return accept(prefix, suffix)

        return F.exists(F.sequence(F.lit(1), F.size(pieces) - 1), at)

    found = F.when(
        contains_term(text, term), let(F.split(text, whole_word(term), -1), scan)
    )
    return F.coalesce(found, F.lit(False))


def term_hit(normalized: Column, term: str) -> Column:
    """Whole-word hit with no negation among the two whitespace words before it."""

    def accept(prefix: Column, _suffix: Column) -> Column:
        words = _words(prefix, r"[^\t-\r\x1c-\x20\x85\p{Z}]+")
        return ~let(words, lambda w: _any_in(_last(w, 2), NEGATION_WORDS))

    return _occurrence_exists(normalized, term, accept)


def active_flooding_hit(normalized: Column, term: str) -> Column:
    """Hit that is not negated, not resolved, not a complaint count, not cleared history."""

    def accept(prefix: Column, suffix: Column) -> Column:
        def judge(w: Column) -> Column:
            before, after = w["before"], w["after"]
            historical = _any_in(before, HISTORICAL_WORDS) | _any_in(
                F.slice(after, 1, 3), ("last", "yesterday")
            )
            return (
                ~_any_in(before, NEGATION_WORDS)
                & (F.array_join(F.slice(after, 1, 2), " ") != "with complaints")
                & ~_any_in(F.slice(after, 1, 3), RESOLUTION_WORDS)
                & ~(historical & _any_in(F.slice(after, 1, 6), CLEAR_WORDS))
            )

        words = F.struct(
            let(_words(prefix, f"{WORD}+"), lambda w: _last(w, 2)).alias("before"),
            F.slice(_words(suffix, f"{WORD}+"), 1, 6).alias("after"),
        )
        return let(words, judge)

    return _occurrence_exists(normalized, term, accept)


def _hit_array(normalized: Column, terms: Sequence[str], test) -> Column:
    return F.array_compact(F.array(*[F.when(test(normalized, t), F.lit(t)) for t in terms]))


def term_hits(normalized: Column, terms: Sequence[str]) -> Column:
    return _hit_array(normalized, terms, term_hit)


def active_flooding_hits(normalized: Column) -> Column:
    return _hit_array(normalized, SAFETY_TERMS["active_flooding"], active_flooding_hit)


def safety_hits(normalized: Column) -> Column:
    """ARRAY<STRUCT<signal, term>> of every safety hit in one report."""
    parts = []
    for signal, terms in SAFETY_TERMS.items():
        test = active_flooding_hit if signal == "active_flooding" else term_hit
        parts.append(
            F.array(
                *[
                    F.when(
                        test(normalized, t),
                        F.struct(F.lit(signal).alias("signal"), F.lit(t).alias("term")),
                    )
                    for t in terms
                ]
            )
        )
    return F.array_compact(F.concat(*parts))
