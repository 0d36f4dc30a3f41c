"""Licence scans by sentence rules.

A text is cut into sentences at sentence ends and blank lines; a line break within is a blank, and the
leaders of comment lines ('#', '*', '//') are no text. Sentences are normalised (lower case, quotes and
marks out, one blank between words). Known licence sentences get an identifier, one for each part that a
pattern knows, so that one-line notices without an end are found one by one; the sequence of identifiers
in the text is then matched against ordered rules, longest first: each match names a licence and uses its
identifiers up. Identifiers left over and sentences that speak of a licence without being known are
reported too.

A part that stands behind a negation ("not licensed under ...") is no known sentence.

Null and empty texts have no sentences; whole texts of any length are read. Every row is judged by itself,
repeated ones alike; an empty table gives an empty one. Of equally long rules that meet at one place the
first in the table wins. Only doc_id and text are read. Only texts with a cue word are cut; every
known sentence has one, so nothing is missed (a test holds the patterns to that).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .flat import flat_blocks, lower_ascii
from .frames import documents, map_arrow, read

#: Single words, where a known sentence has no other cue: lines may break between two.
CUES = (b"licen", b"copyright", b"permission", b"distribut", b"warrant", b"as is", b"as-is", b"domain", b"spdx", b"endorse", b"cc0", b"commons", b"misrepresent", b"altered", b"gpl")

_UNDER = r"(?:released|licensed|available|distributed|provided|published|made available|is|are) under (?:the )?(?:terms (?:and conditions )?of the )?"
_GNU = r"gnu (?P<name>general|lesser general|library general|affero general) public licen[cs]e"
_VERSION = r"(?:,? version)? ?v?\.? ?(?P<version>[0-9]+(?:\.[0-9]+)*)?"
#: Names that a line such as "License: MIT" may give, with the licence it stands for.
_NAMED = {
    "MIT": r"mit", "ISC": r"isc", "Zlib": r"zlib", "Unlicense": r"unlicense", "Apache": r"apache(?: software)?(?: licen[cs]e)?" + _VERSION,
    "BSD": r"(?P<name>bsd [0-9] clause|[0-9] clause bsd|bsd)", "MPL": r"(?:mozilla public licen[cs]e|mpl)" + _VERSION,
}

#: Known sentences: identifier and pattern of a part of the normalised sentence (public licence texts).
SENTENCES = [
    ("spdx", r"spdx license identifier (?P<name>[a-z0-9.+ -]+)"),
    ("cc", r"licensed under (?:a |the )?(?:creative commons|cc)[ -](?P<name>by(?:[ -](?:nc|sa|nd))*)(?: license)?(?: version)? ?v?(?P<version>[0-9.]+)?"),
    ("cc_full", r"creative commons (?P<name>attribution(?: (?:non ?commercial|share ?alike|no ?deriv(?:ative)?s))*) (?P<version>[0-9.]+)"),
    ("cc0", r"\b(?:cc0|creative commons zero)\b"),
    ("apache_by", _UNDER + r"apache (?:software )?licen[cs]e" + _VERSION),
    ("apache_except", r"you may not use this file except in compliance with the license"),
    ("apache_copy", r"you may obtain a copy of the license at"),
    ("apache_basis", r"distributed under the license is distributed on an as is basis"),
    ("apache_see", r"see the license for the specific language governing permissions and limitations"),
    ("apache_head", r"^apache license version (?P<version>[0-9.]+) january 2004"),
    ("mit_by", _UNDER + r"mit licen[cs]e"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc_grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("as_is", r"the software is provided as is (?:without warranty of any kind|and the author disclaims all warranties)"),
    ("bsd_by", _UNDER + r"(?P<name>(?:[0-9] clause |new |simplified )?bsd(?: [0-9] clause)?) licen[cs]e"),
    ("bsd_pre", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_names", r"neither the name of .*? nor the names of .*? may be used to endorse or promote products"),
    ("bsd_as_is", r"this software is provided by the .*? as is and any express or implied warranties"),
    ("gpl_by", _UNDER + _GNU + r"(?: version)? ?v?(?P<version>[0-9.]+)?"),
    ("gpl_head", r"^" + _GNU + r" version (?P<version>[0-9.]+) (?:[0-9]+ )?[a-z]+ [0-9]{4}"),
    ("gpl_short", r"\b(?P<name>[al]?gpl)(?: ?v(?:ersion)?)? ?\.?(?P<version>[0-9](?:\.[0-9]+)?)\b"),
    ("gpl_terms", r"you can redistribute it and or modify it under the terms of the gnu (?P<name>general|lesser general|library general|affero general) public license"),
    ("gpl_version", r"either version (?P<version>[0-9.]+) of the license or at your option any later version"),
    ("gpl_hope", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl_copy", r"you should have received a copy of the gnu .*? public license"),
    ("mpl", r"subject to the terms of the mozilla public license v(?:ersion)?\.? ?(?P<version>[0-9.]+)"),
    ("mpl_head", r"^mozilla public license version (?P<version>[0-9.]+)$"),
    ("mpl_by", _UNDER + r"mozilla public license(?: version)? ?v?\.? ?(?P<version>[0-9.]+)?"),
    ("isc_by", _UNDER + r"isc licen[cs]e"),
    ("epl_by", r"under the (?:terms (?:and conditions )?of the )?eclipse public license(?: version| v\.?)? ?v?(?P<version>[0-9.]+)?"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense_any", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense_by", r"(?:released|licensed|available|dedicated) (?:under|to) the unlicense"),
    ("zlib_as_is", r"this software is provided as is without any express or implied warranty"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib_origin", r"the origin of this software must not be misrepresented"),
    ("zlib_altered", r"altered source versions must be plainly marked as such"),
    ("zlib_notice", r"this notice may not be removed or altered from any source distribution"),
    ("zlib_by", _UNDER + r"zlib licen[cs]e"),
    ("boost_by", _UNDER + r"boost software license(?: version)? ?v?(?P<version>[0-9.]+)?"),
    ("boost_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("public_domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    *[(f"named_{licence.lower()}", rf"^licen[cs]e {pattern}(?: licen[cs]e)?$") for licence, pattern in _NAMED.items()],
]

#: The licence and its sequence of identifiers. Longer rules are tried first, equally long ones in this order.
_RULES = [
    ("BSD-3-Clause", ["bsd_pre", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is"]),
    ("Apache", ["apache_by", "apache_except", "apache_copy", "apache_basis", "apache_see"]),
    ("GPL-or-later", ["gpl_terms", "gpl_version", "gpl_hope", "gpl_copy"]),
    ("BSD-2-Clause", ["bsd_pre", "bsd_source", "bsd_binary", "bsd_as_is"]),
    ("BSD-3-Clause", ["bsd_pre", "bsd_source", "bsd_binary", "bsd_names"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("BSD-2-Clause", ["bsd_pre", "bsd_source", "bsd_binary"]),
    ("GPL-or-later", ["gpl_terms", "gpl_version"]),
    ("ISC", ["isc_grant", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("Zlib", ["zlib_as_is", "zlib_grant", "zlib_origin", "zlib_altered", "zlib_notice"]),
    ("Unlicense", ["unlicense", "unlicense_any"]),
    ("BSL", ["boost_grant", "as_is"]),
    ("Apache", ["apache_by"]),
    ("GPL", ["gpl_by"]),
    ("GPL", ["gpl_terms"]),
    ("MIT", ["mit_by"]),
    ("BSD", ["bsd_by"]),
    ("CC", ["cc"]),
    ("CC0", ["cc0"]),
    ("MPL", ["mpl"]),
    ("MPL", ["mpl_by"]),
    ("EPL", ["epl_by"]),
    ("ISC", ["isc_by"]),
    ("ISC", ["isc_grant"]),
    ("MIT", ["mit_grant"]),
    ("Unlicense", ["unlicense"]),
    ("Unlicense", ["unlicense_by"]),
    ("Zlib", ["zlib_grant"]),
    ("Zlib", ["zlib_by"]),
    ("BSL", ["boost_by"]),
    ("BSL", ["boost_grant"]),
    ("BSD", ["bsd_pre"]),
    ("SPDX", ["spdx"]),
    ("public-domain", ["public_domain"]),
    ("CC", ["cc_full"]),
    ("Apache", ["apache_head"]),
    ("GPL", ["gpl_head"]),
    ("GPL", ["gpl_short"]),
    ("MPL", ["mpl_head"]),
    *[(licence, [f"named_{licence.lower()}"]) for licence in _NAMED],
]
RULES = sorted(_RULES, key=lambda rule: -len(rule[1]))

#: How short and long names of variants are written.
_SHORT = {"gpl": "general", "lgpl": "lesser-general", "agpl": "affero-general"}
_CC_PARTS = (("attribution", "by"), ("noncommercial", "nc"), ("non commercial", "nc"), ("sharealike", "sa"), ("share alike", "sa"),
             ("noderivatives", "nd"), ("no derivatives", "nd"), ("noderivs", "nd"), ("no derivs", "nd"))
_NOT = re.compile(r"\b(?:not(?! only)|never|isn t|aren t|wasn t|cannot|can t)(?: \w+){0,4} $")

_KNOWN = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
_LINES = re.compile(r"\r\n?|\n")
_LEADER = re.compile(r"""(?:[^\w"'“‘(]|_)*(?:(?:dnl|rem|REM|[Cc])(?=\s)(?:[^\w"'“‘(]|_)*)?""")
_WORD = re.compile(r"[^\W_]")
_SPDX = re.compile(r"spdx-license-identifier", re.IGNORECASE)
#: Sentence ends; a version's abbreviation is none.
_ENDS = re.compile(r"(?<=[.!?;])(?<!\b[vV]\.)(?<!\b[vV]er\.)\s+")
_MARKS = re.compile(r"[^\w.+]+|_+")
_SPEAKS = re.compile(r"\b(?:licen[cs]ed?|copyright)\b")
_OPENS = re.compile(r"[A-Z][^A-Z]")


def normalise(part: str) -> str:
    return _MARKS.sub(" ", part.lower()).strip(" ")


def sentences(text: str) -> Iterator[list[str]]:
    """The sentences of a text, as lists of the parts that stand in one line each."""
    lines: list[str] = []
    for line in [*_LINES.split(text), ""]:
        line = line[_LEADER.match(line).end() :] if _WORD.search(line) else ""
        alone = bool(_SPDX.match(line))
        if lines and (alone or not line):
            yield from (sentence.split("\n") for sentence in _ENDS.split("\n".join(lines)))
            lines = []
        if alone:  # such an expression ends with its line
            yield [line]
        elif line:
            lines.append(line)


def _variant(identifier: str, name: str | None) -> str | None:
    if name and identifier == "cc_full":
        for long, short in _CC_PARTS:
            name = name.replace(long, short)
    if name and "bsd" in identifier and (clause := re.search(r"[0-9] clause", name)):
        name = clause[0]
    return _SHORT.get(name, name) if name else None


def identify(parts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """Identifiers and variants (such as a version) of a sentence in text order, and the number of its
    statements that speak of a licence and are not known. A statement ends where a line begins anew."""
    plain, starts, at = [], [], 0
    for part in parts:
        plain.append(normalise(part))
        starts.append(at)
        at += len(plain[-1]) + 1
    sentence = " ".join(plain)
    taken, seen, found = bytearray(len(sentence)), set(), []
    for name, pattern in _KNOWN:
        for match in pattern.finditer(sentence):
            low, high = match.span()
            if taken.find(1, low, high) >= 0 or _NOT.search(sentence, 0, low):
                continue
            taken[low:high] = b"\1" * (high - low)
            groups = match.groupdict()
            version = groups.get("version")
            if version and "." not in version.strip(".") and match.start("version") in starts and not sentence[low : match.start("version")].endswith("version "):
                version = None  # a number that begins the next line
            variant = "-".join(p.strip(" .").replace(" ", "-") for p in (_variant(name, groups.get("name")), version) if p)
            if (once := (bisect_right(starts, low), name, variant)) not in seen:
                seen.add(once)
                found.append((low, name, variant))
    heads = [k for k, part in enumerate(parts) if not k or _OPENS.match(part)]
    unknown = 0
    for k, end in zip(heads, [*heads[1:], len(parts)]):
        low, high = starts[k], starts[end] if end < len(parts) else at
        if taken.find(1, low, high) < 0:
            unknown += bool(_SPEAKS.search(sentence[low:high]))
    return [f[1:] for f in sorted(found)], unknown


def licences(found: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Licences of a sequence of identifiers, and the identifiers no rule used."""
    names, variants = [f[0] for f in found], [f[1] for f in found]
    out: list[tuple[int, str]] = []
    for licence, rule in RULES:
        k = 0
        while k + len(rule) <= len(names):
            if names[k : k + len(rule)] == rule:
                detail = "-".join(v for v in variants[k : k + len(rule)] if v)
                out.append((k, f"{licence}:{detail}" if detail else licence))
                names[k : k + len(rule)] = [""] * len(rule)
                k += len(rule)
            else:
                k += 1
    return [name for _, name in sorted(out)], [n for n in names if n]


def scan(text: str) -> dict:
    found, unknown = [], 0
    for parts in sentences(text):
        low = " ".join(parts).lower().encode()
        if any(cue in low for cue in CUES):
            known, others = identify(parts)
            found += known
            unknown += others
    names, left = licences(found)
    return {"sentence_ids": [f[0] for f in found], "licences": names, "unused_ids": left, "n_unknown": unknown}


def licence_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licences, unused_ids, n_unknown) of every row, in text order."""
    nothing = {"sentence_ids": [], "licences": [], "unused_ids": [], "n_unknown": 0}
    kinds = pa.struct([(k, pa.list_(pa.string())) for k in ("sentence_ids", "licences", "unused_ids")] + [("n_unknown", pa.int64())])

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text")
        for i, j, data, offsets in flat_blocks(texts):
            low = lower_ascii(data).tobytes()
            cued = np.zeros(j - i, bool)
            for cue in CUES:
                at = low.find(cue)
                while at >= 0:
                    row = int(np.searchsorted(offsets, at, "right")) - 1
                    cued[row] = True
                    at = low.find(cue, int(offsets[row + 1]))
            results = [scan(texts[i + k].as_py()) if cued[k] else nothing for k in range(j - i)]
            rows = pa.array(results, kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *rows.flatten()], ["doc_id", *(f.name for f in kinds)])

    return map_arrow(documents(docs), one, "doc_id long, sentence_ids array<string>, licences array<string>, unused_ids array<string>, n_unknown long")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(read(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "cast(size(sentence_ids) as long) as n_sentences", "array_join(sentence_ids, ',') as sentence_ids",
        "array_join(licences, ',') as licences", "array_join(unused_ids, ',') as unused_ids", "n_unknown",
    )


QUERIES = {"op5_licence_scan": op5_licence_scan}
