"""Reference SQL (DuckDB dialect) for the registered queries, composed from shared CTEs.

The SQL follows the definitions directly: plain distance predicates, a recursive closure for
components, whole tables everywhere.
"""

from __future__ import annotations

from ..functions.locations import STOP_WORDS
from ..functions.text import (
    ALIASES,
    CATEGORY_TERMS,
    CLEAR_WORDS,
    HISTORICAL_WORDS,
    NEGATION_WORDS,
    RESOLUTION_WORDS,
    SAFETY_TERMS,
)
from ..operators import metrics
from ..policy import CATEGORIES, PRIORITY_LEVELS, REVIEW_STATUSES, PerformanceBudget
from ..sources.fixtures import PHRASES, PREFIXES

NS = "6ba7b8119dad11d180b400c04fd430c8"


def sql_list(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def norm(expr: str) -> str:
    """ASCII normalisation: lower, punctuation to spaces, collapse, whole-word aliases."""
    out = f"trim(regexp_replace(regexp_replace(lower({expr}), '[[:punct:]]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for source in sorted(ALIASES, key=len, reverse=True):
        out = f"regexp_replace({out}, '\\b{source}\\b', '{ALIASES[source]}', 'g')"
    return out


def uuid5(expr: str) -> str:
    h = f"sha1(unhex('{NS}') || ({expr})::BLOB)"
    return (
        f"(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||"
        f"substr('89ab', ((strpos('0123456789abcdef', substr(h,17,1))-1)%4)+1, 1)||substr(h,18,3)||'-'||substr(h,21,12)"
        f" FROM (SELECT {h} AS h))"
    )


def hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"2*6371008.8*asin(sqrt(least(1.0, sin(radians({c}-{a})/2)*sin(radians({c}-{a})/2)"
        f"+cos(radians({a}))*cos(radians({c}))*sin(radians({d}-{b})/2)*sin(radians({d}-{b})/2))))"
    )


def tail(c: str) -> str:
    return f"substr({c},25,12)::BIGINT"


def hits(text: str, term: str, accept: str) -> str:
    """Exists an occurrence whose prefix p and suffix s satisfy ``accept``."""
    parts = f"regexp_split_to_array({text}, '\\b{term}\\b')"
    return (
        f"len(list_filter(range(1, len({parts})), lambda i: {accept.replace('$p', f'array_to_string(list_slice({parts},1,i),$t)').replace('$s', f'array_to_string(list_slice({parts},i+1,len({parts})),$t)').replace('$t', chr(39) + term + chr(39))})) > 0"
    )


def last_two(words: str) -> str:
    return f"list_slice({words}, -2, -1)"


NEG = f"list_has_any(list_slice(regexp_extract_all($p, '\\S+'), -2, -1), {sql_list(NEGATION_WORDS)})"
W = "regexp_extract_all({}, '\\w+')"
_before = f"list_slice({W.format('$p')}, -2, -1)"
_after = W.format("$s")
FLOOD = (
    f"NOT list_has_any({_before}, {sql_list(NEGATION_WORDS)})"
    f" AND array_to_string(list_slice({_after},1,2),' ') <> 'with complaints'"
    f" AND NOT list_has_any(list_slice({_after},1,3), {sql_list(RESOLUTION_WORDS)})"
    f" AND NOT ((list_has_any({_before}, {sql_list(HISTORICAL_WORDS)})"
    f" OR list_has_any(list_slice({_after},1,3), ['last','yesterday']))"
    f" AND list_has_any(list_slice({_after},1,6), {sql_list(CLEAR_WORDS)}))"
)


def hit_list(text: str, terms, accept: str) -> str:
    cases = ",".join(f"CASE WHEN {hits(text, t, accept)} THEN '{t}' END" for t in terms)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


# --- shared CTEs: name -> (dependencies, body) -------------------------------------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in CTES[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    # recursive parts cannot be marked materialised
    parts = parts.replace("AS MATERIALIZED (/*recursive*/", "AS (")
    return f"WITH RECURSIVE {parts}\n{body}"


_h = "(((event_id % 2147483648) * {m}) % 4294967296) // 4096"
cte(
    "hashed",
    (),
    f"SELECT event_id, ts, {_h.format(m=2654435761)} h1, {_h.format(m=2246822519)} h2,"
    f" {_h.format(m=3266489917)} h3 FROM events",
)
cte(
    "keyed",
    ("hashed",),
    "SELECT *, h1 % 400 z, CASE WHEN h2 % 20 = 19 THEN 5 ELSE h2 % 5 END cat FROM hashed",
)
cte(
    "reports",
    ("keyed",),
    f"""SELECT event_id, '00000000-0000-0000-0000-' || lpad(event_id::VARCHAR, 12, '0') id, z, cat,
 ((h2 // 20) % 4) * 0.25::DOUBLE w,
 {sql_list(PREFIXES)}[((h2 // 80) % 8) + 1] || {sql_list([p for g in PHRASES for p in g])}[cat*3 + (h1 // 400) % 3 + 1]
 || CASE WHEN event_id % 7 < 4 THEN (CASE WHEN event_id % 2 = 0 THEN ' at Block ' ELSE ' at Blk ' END)
      || ['A','B','C'][(h3 // 8633) % 3 + 1] ELSE '' END
 || CASE WHEN event_id % 10 = 0 THEN ' unit ' || (event_id % 3)::VARCHAR ELSE '' END AS text,
 3.0::DOUBLE + (z // 20) * 0.02::DOUBLE + (h3 % 97) * 0.00008::DOUBLE latitude,
 101.4::DOUBLE + (z % 20) * 0.02::DOUBLE + ((h3 // 97) % 89) * 0.00008::DOUBLE longitude,
 ts::TIMESTAMP reported_at, {sql_list(CATEGORIES)}[cat + 1] category,
 CASE WHEN event_id % 4 = 0 THEN 'photo.jpg' END photo_path FROM keyed""",
)
cte("complaints", ("reports",), f"SELECT *, {norm('text')} AS nt FROM reports")
cte(
    "raw",
    ("reports",),
    """SELECT event_id, id,
 CASE WHEN event_id % 31 = 0 THEN '  x  ' WHEN event_id % 37 = 0 THEN repeat('flood ', 400)
   ELSE '  ' || text || ' ' END AS text,
 CASE WHEN event_id % 41 = 0 THEN 91.5::DOUBLE WHEN event_id % 43 = 0 THEN 'NaN'::DOUBLE ELSE latitude END latitude,
 CASE WHEN event_id % 47 = 0 THEN -180.5::DOUBLE ELSE longitude END longitude,
 CASE WHEN event_id % 53 = 0 THEN reported_at + INTERVAL 400 DAY WHEN event_id % 59 = 0 THEN NULL ELSE reported_at END reported_at,
 CASE WHEN event_id % 61 = 0 THEN 'volcano' WHEN event_id % 3 = 0 THEN NULL ELSE category END category,
 CASE WHEN event_id % 67 = 0 THEN 'uploads/' || id || '.jpg' WHEN event_id % 4 = 0 THEN 'photo.jpg' END photo_path,
 CASE WHEN event_id % 71 = 0 THEN id END photo_id FROM reports""",
)
cte(
    "vec",
    ("reports",),
    """SELECT r.id, list_transform(range(1, len(a.embedding) + 1),
   lambda i: a.embedding[i]::DOUBLE + r.w * b.embedding[i]::DOUBLE) AS v
 FROM reports r
 JOIN embeddings a ON a.vec_id = (r.z * 6 + r.cat) % (SELECT count(*) FROM embeddings)
 JOIN embeddings b ON b.vec_id = (r.event_id * 11) % (SELECT count(*) FROM embeddings)""",
)
cte(
    "pairs",
    ("reports",),
    f"""SELECT * FROM (SELECT a.id left_id, b.id right_id, a.category left_category, b.category right_category,
 {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS dist,
 abs(epoch_us(a.reported_at) - epoch_us(b.reported_at)) / 1e6 AS gap
 FROM reports a JOIN reports b ON a.latitude BETWEEN b.latitude - 0.0046 AND b.latitude + 0.0046
  AND a.longitude BETWEEN b.longitude - 0.0046 AND b.longitude + 0.0046
 WHERE a.id < b.id AND (a.category = b.category OR a.category = 'other' OR b.category = 'other'))
 WHERE dist <= 500 AND gap <= 604800""",
)
_stop = sql_list(STOP_WORDS)
_cut = (
    "array_to_string(list_slice(t, 1, coalesce(list_min(list_filter(list_transform(t, lambda w, i:"
    f" CASE WHEN list_contains({_stop}, w) THEN i END), lambda x: x IS NOT NULL)) - 1, len(t))), ' ')"
)
cte(
    "mentions",
    ("complaints",),
    f"""SELECT id, 1 AS grp, 'block' AS kind, unnest(regexp_extract_all(nt, '\\b(?:block|blok)(?:\\s+|[-#]\\s*)([a-z0-9]+)\\b', 1)) AS value,
   unnest(regexp_extract_all(nt, '\\b(?:block|blok)(?:\\s+|[-#]\\s*)([a-z0-9]+)\\b', 0)) AS raw FROM complaints
 UNION ALL SELECT id, 2, 'unit', unnest(regexp_extract_all(nt, '\\bunit\\s*[-#]?\\s*([a-z0-9]+)\\b', 1)),
   unnest(regexp_extract_all(nt, '\\bunit\\s*[-#]?\\s*([a-z0-9]+)\\b', 0)) FROM complaints
 UNION ALL SELECT id, 3, 'street', value, raw FROM (SELECT id, raw, {_cut} AS value FROM (
   SELECT id, string_split(unnest(regexp_extract_all(nt, '\\b(?:jalan|lorong|taman|kampung)\\s+([a-z0-9]+(?:\\s+[a-z0-9]+){{0,2}})', 1)), ' ') AS t,
   unnest(regexp_extract_all(nt, '\\b(?:jalan|lorong|taman|kampung)\\s+([a-z0-9]+(?:\\s+[a-z0-9]+){{0,2}})', 0)) AS raw FROM complaints)) WHERE value <> ''""",
)
cte(
    "locs",
    ("complaints", "mentions"),
    """SELECT c.id,
 coalesce(list(DISTINCT m.value) FILTER (WHERE kind = 'block'), []) AS block,
 coalesce(list(DISTINCT m.value) FILTER (WHERE kind = 'street'), []) AS street,
 coalesce(list(DISTINCT m.value) FILTER (WHERE kind = 'unit'), []) AS unit
 FROM complaints c LEFT JOIN mentions m ON m.id = c.id GROUP BY c.id""",
)
_clash = lambda k: f"(len(a.{k}) > 0 AND len(b.{k}) > 0 AND NOT list_has_any(a.{k}, b.{k}))"
_none = "(len(a.block)+len(a.street)+len(a.unit) = 0 OR len(b.block)+len(b.street)+len(b.unit) = 0)"
_shared = " OR ".join(f"(len(a.{k}) > 0 AND len(b.{k}) > 0)" for k in ("block", "street", "unit"))
cte(
    "placed",
    ("pairs", "locs"),
    f"""SELECT p.*, CASE WHEN {_clash('block')} OR {_clash('street')} OR {_clash('unit')} THEN 'conflicting'
   WHEN {_none} THEN 'unknown' WHEN {_shared} THEN 'compatible' ELSE 'unknown' END AS compat,
 CASE WHEN {_clash('block')} THEN 'conflicting block entities' WHEN {_clash('street')} THEN 'conflicting street entities'
   WHEN {_clash('unit')} THEN 'conflicting unit entities'
   WHEN {_none} THEN 'one or both complaints lack explicit comparable location entities'
   WHEN {_shared} THEN 'at least one explicit location entity agrees'
   ELSE 'explicit entities exist but have no comparable kind' END AS place_reason
 FROM pairs p JOIN locs a ON a.id = p.left_id JOIN locs b ON b.id = p.right_id""",
)
cte(
    "scored",
    ("placed", "vec"),
    """SELECT p.*, least(1.0, greatest(-1.0, list_dot_product(a.v, b.v)
   / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))) AS sim
 FROM placed p JOIN vec a ON a.id = p.left_id JOIN vec b ON b.id = p.right_id""",
)


def decision(threshold: str) -> str:
    return f"""CASE WHEN left_category = 'other' OR right_category = 'other' THEN 'review_required'
 WHEN left_category <> right_category OR dist > 500 OR gap > 604800 OR compat = 'conflicting' THEN 'no_match'
 WHEN sim < CASE WHEN compat = 'compatible' THEN 0.92 ELSE {threshold} END THEN 'review_required'
 WHEN compat = 'unknown' THEN 'review_required' ELSE 'auto_match' END"""


cte("matched", ("scored",), f"SELECT *, {decision('0.88')} AS decision FROM scored")
cte(
    "rev",
    ("matched", "reports"),
    f"""SELECT {uuid5("'review-v1:' || m.left_id || ':' || m.right_id")} AS review_id, m.left_id, m.right_id,
 ({tail('m.left_id')} + {tail('m.right_id')}) AS n,
 CASE n % 12 WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'pending' END AS status,
 greatest(a.reported_at, b.reported_at) AS created_at,
 CASE WHEN n % 12 IN (1, 2) THEN greatest(a.reported_at, b.reported_at) + INTERVAL 1 HOUR END AS resolved_at,
 CASE WHEN n % 12 IN (1, 2) THEN 'officer-' || ({tail('m.left_id')} % 5) END AS reviewed_by,
 CASE WHEN n % 12 IN (1, 2) AND {tail('m.right_id')} % 2 = 0 THEN 'checked on site' END AS review_note,
 CASE n % 12 WHEN 1 THEN 'auto_match' WHEN 2 THEN 'no_match' END AS final_state,
 CASE WHEN n % 12 IN (1, 2) THEN 2 ELSE 1 END AS version
 FROM matched m JOIN reports a ON a.id = m.left_id JOIN reports b ON b.id = m.right_id
 WHERE m.decision = 'review_required'""",
)
cte(
    "edges",
    ("matched", "rev"),
    """SELECT m.left_id, m.right_id, m.decision AS automated_decision, coalesce(r.final_state, m.decision) AS decision,
 CASE WHEN r.final_state IS NULL THEN 'automated' ELSE 'officer_review' END AS decision_source,
 CASE WHEN r.final_state IS NOT NULL THEN 'review_required' END AS matcher_recommendation
 FROM matched m LEFT JOIN rev r ON r.left_id = m.left_id AND r.right_id = m.right_id""",
)
#: Eight 32-bit sums over the digests ``d`` of a group's rows.
_lanes = "||':'||".join(f"sum(('0x'||substr(d,{1 + 8 * i},8))::BIGINT)::VARCHAR" for i in range(8))
for _name, _src in (("auto", "matched"), ("final", "edges")):
    cte(
        f"{_name}_links",
        (_src,),
        f"""SELECT left_id AS a, right_id AS b FROM {_src} WHERE decision = 'auto_match'
 UNION ALL SELECT right_id, left_id FROM {_src} WHERE decision = 'auto_match'""",
    )
    cte(
        f"{_name}_reach",
        (f"{_name}_links",),
        f"""/*recursive*/SELECT DISTINCT a AS id, a AS root FROM {_name}_links
 UNION SELECT l.b, r.root FROM {_name}_reach r JOIN {_name}_links l ON l.a = r.id""",
    )
    cte(
        f"{_name}_comp",
        (f"{_name}_reach", "reports"),
        f"""SELECT p.id, coalesce(c.component, p.id) AS component FROM reports p
 LEFT JOIN (SELECT id, min(root) AS component FROM {_name}_reach GROUP BY id) c ON c.id = p.id""",
    )
    cte(
        f"{_name}_ids",
        (f"{_name}_comp",),
        f"""SELECT component, {uuid5("'incident-v1:' || digest")} AS incident_id, report_count FROM (
 SELECT component, sha256(count(*)::VARCHAR||':'||{_lanes}) AS digest, count(*) AS report_count
 FROM (SELECT component, sha256(id) AS d FROM {_name}_comp) GROUP BY component)""",
    )
cte(
    "labelled",
    ("edges", "final_comp"),
    """SELECT e.*, a.component AS ac, b.component AS bc FROM edges e
 JOIN final_comp a ON a.id = e.left_id JOIN final_comp b ON b.id = e.right_id""",
)
cte(
    "clashes",
    ("labelled",),
    "SELECT ac AS component, left_id, right_id FROM labelled WHERE decision = 'no_match' AND ac = bc",
)
cte(
    "pending",
    ("labelled",),
    """SELECT DISTINCT component, candidate_id FROM (
 SELECT ac AS component, right_id AS candidate_id FROM labelled WHERE decision = 'review_required'
 UNION ALL SELECT bc, left_id FROM labelled WHERE decision = 'review_required' AND ac <> bc)""",
)
cte(
    "inc_base",
    ("final_comp", "reports"),
    """SELECT component, count(*) AS report_count, avg(latitude) AS clat, avg(longitude) AS clon,
 min(reported_at) AS earliest, max(reported_at) AS latest, list_sort(list(DISTINCT category)) AS cats,
 count(photo_path) AS photos
 FROM final_comp JOIN reports USING (id) GROUP BY component""",
)
cte(
    "inc",
    ("inc_base", "final_ids", "final_comp", "reports", "clashes", "pending"),
    f"""SELECT i.*, f.incident_id,
 CASE WHEN i.report_count = 1 THEN 0.0 ELSE x.radius END AS radius,
 coalesce(k.n, 0) AS conflicts, coalesce(p.n, 0) AS pend,
 CASE WHEN coalesce(k.n, 0) > 0 THEN 'conflict' WHEN i.report_count > 1 THEN 'confirmed' ELSE 'isolated' END AS status
 FROM inc_base i JOIN final_ids f USING (component)
 JOIN (SELECT b.component, max({hav('b.clat', 'b.clon', 'r.latitude', 'r.longitude')}) AS radius
   FROM inc_base b JOIN final_comp m USING (component) JOIN reports r USING (id) GROUP BY b.component) x USING (component)
 LEFT JOIN (SELECT component, count(*) AS n FROM clashes GROUP BY component) k USING (component)
 LEFT JOIN (SELECT component, count(*) AS n FROM pending GROUP BY component) p USING (component)""",
)
_signal_rows = " UNION ALL ".join(
    f"SELECT id, '{s}' AS signal, unnest({hit_list('nt', ts, FLOOD if s == 'active_flooding' else 'NOT ' + NEG)}) AS term FROM complaints"
    for s, ts in SAFETY_TERMS.items()
)
cte("safety_rows", ("complaints",), _signal_rows)
cte(
    "safety",
    ("safety_rows", "final_comp"),
    """SELECT component, signal, count(DISTINCT id) AS complaint_count, list_sort(list(DISTINCT term)) AS terms
 FROM safety_rows JOIN final_comp USING (id) GROUP BY component, signal""",
)
cte(
    "places",
    ("reports",),
    """SELECT DISTINCT 'place-' || z AS place_id, CASE WHEN (z // 10) % 2 = 0 THEN 'school' ELSE 'Hospital' END AS kind,
 3.0::DOUBLE + (z // 20) * 0.02::DOUBLE + 0.0035::DOUBLE AS latitude,
 101.4::DOUBLE + (z % 20) * 0.02::DOUBLE + 0.0035::DOUBLE AS longitude FROM reports WHERE z % 10 = 0""",
)
cte(
    "exposure",
    ("places", "reports", "final_comp"),
    f"""SELECT component, count(DISTINCT place_id) AS sensitive_count, bool_or(lower(kind) = 'hospital') AS has_hospital
 FROM reports r JOIN places p ON abs(r.latitude - p.latitude) < 0.01 AND abs(r.longitude - p.longitude) < 0.01
 JOIN final_comp USING (id)
 WHERE {hav('r.latitude', 'r.longitude', 'p.latitude', 'p.longitude')} <= 250 GROUP BY component""",
)
cte(
    "pin",
    ("inc", "safety", "exposure", "reports"),
    """SELECT i.*, coalesce(s.names, []) AS names, coalesce(e.sensitive_count, 0) AS sens, coalesce(e.has_hospital, false) AS hospital,
 greatest(0.0, (epoch_us((SELECT max(reported_at) FROM reports)) - epoch_us(i.earliest)) / 3.6e9) AS hours,
 i.photos / i.report_count AS complete
 FROM inc i LEFT JOIN (SELECT component, list_sort(list(signal)) AS names FROM safety GROUP BY component) s USING (component)
 LEFT JOIN exposure e USING (component)""",
)
_crit = "list_has_any(names, ['accident_injury','exposed_electrical_hazard'])"
_high = "list_has_any(names, ['active_flooding','blocked_road'])"
cte(
    "prio",
    ("pin",),
    f"""SELECT *, CASE WHEN status = 'conflict' THEN NULL ELSE ['low','medium','high','critical'][pts + 1] END AS operational,
 CASE WHEN status = 'conflict' THEN 'review_required' ELSE ['low','medium','high','critical'][pts + 1] END AS level FROM (
 SELECT *, greatest(0,
  CASE WHEN report_count >= 20 THEN 3 WHEN report_count >= 10 THEN 2 WHEN report_count >= 2 THEN 1 ELSE 0 END,
  CASE WHEN hours >= 48 THEN 3 WHEN hours >= 24 THEN 2 ELSE 0 END,
  CASE WHEN {_crit} THEN 3 WHEN {_high} THEN 2 ELSE 0 END,
  CASE WHEN list_contains(names, 'active_flooding') AND hospital THEN 3 ELSE 0 END,
  CASE WHEN sens > 0 THEN 2 ELSE 0 END) AS pts,
 list_filter([
  CASE WHEN report_count >= 20 THEN 'critical_confirmed_report_volume' WHEN report_count >= 10 THEN 'high_confirmed_report_volume'
   WHEN report_count >= 2 THEN 'multi_report_incident' END,
  CASE WHEN hours >= 48 THEN 'critical_persistence' WHEN hours >= 24 THEN 'high_persistence' END,
  CASE WHEN {_crit} THEN 'critical_safety_signal' WHEN {_high} THEN 'high_safety_signal' END,
  CASE WHEN list_contains(names, 'active_flooding') AND hospital THEN 'flooding_near_hospital' END,
  CASE WHEN sens > 0 THEN 'sensitive_location_exposure' END], lambda x: x IS NOT NULL) AS rules FROM pin)""",
)
cte(
    "subs",
    ("reports",),
    """SELECT event_id * 3 AS seq, 'key-' || event_id AS k, * FROM reports
 UNION ALL SELECT event_id * 3 + 1, 'key-' || event_id, * FROM reports WHERE event_id % 10 = 0
 UNION ALL SELECT event_id * 3 + 2, 'key-' || event_id, * REPLACE (text || ' updated' AS text) FROM reports WHERE event_id % 25 = 0""",
)
cte(
    "lab",
    ("scored", "reports"),
    f"""SELECT s.left_id || ':' || s.right_id AS pair_id, s.*, round(s.sim, 6) AS score,
 CASE WHEN a.z * 6 + a.cat = b.z * 6 + b.cat THEN 'match' ELSE 'non_match' END AS label,
 CASE WHEN {tail('s.left_id')} % 2 = 0 THEN 'calibration' ELSE 'holdout' END AS split,
 CASE WHEN {tail('s.right_id')} % 3 = 0 THEN 'clear' ELSE 'ambiguous' END AS positive_type
 FROM scored s JOIN reports a ON a.id = s.left_id JOIN reports b ON b.id = s.right_id""",
)


def thresholds(source: str) -> str:
    """Metrics at each score and midpoint from cumulative counts."""
    return f"""SELECT threshold, fp::BIGINT AS false_merges, (tot - tp)::BIGINT AS false_splits,
 CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
 CASE WHEN tot > 0 THEN tp / tot ELSE 0.0 END AS recall,
 CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + tot) ELSE 0.0 END AS f1 FROM (
  SELECT c.threshold, (SELECT count(*) FROM {source} WHERE label = 'match') AS tot,
   sum(CASE WHEN s.score >= c.threshold THEN pos ELSE 0 END) AS tp,
   sum(CASE WHEN s.score >= c.threshold THEN neg ELSE 0 END) AS fp
  FROM (SELECT score AS threshold FROM (SELECT DISTINCT score FROM {source})
   UNION ALL SELECT (score + nxt) / 2 FROM (SELECT score, lead(score) OVER (ORDER BY score) AS nxt
     FROM (SELECT DISTINCT score FROM {source})) WHERE nxt IS NOT NULL) c,
   (SELECT score, count(*) FILTER (WHERE label = 'match') AS pos, count(*) FILTER (WHERE label = 'non_match') AS neg
    FROM {source} GROUP BY score) s
  GROUP BY c.threshold)"""


# --- one statement per query ------------------------------------------------------------------

ORACLES: dict[str, str] = {}


def add(name: str, body: str, *ctes: str) -> None:
    ORACLES[name] = with_ctes(body, *ctes)


add(
    "read_complaint_seed",
    """SELECT id AS seed_key, text, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
 epoch_us(reported_at) AS reported_us, category, photo_path FROM reports""",
    "reports",
)
_digest = (
    "sha256('='||id||chr(1)||'='||text||chr(1)||'='||category||chr(1)||coalesce('='||photo_path,'~')||chr(1)||"
    "'='||epoch_us(reported_at)||chr(1)||'='||round(latitude*100000)::BIGINT||chr(1)||'='||round(longitude*100000)::BIGINT)"
)


def set_digest(digest: str, source: str) -> str:
    return f"SELECT count(*) AS n, sha256(count(*)::VARCHAR||':'||{_lanes}) AS digest FROM (SELECT {digest} AS d FROM {source})"


add(
    "content_checksum",
    f"SELECT n AS row_count, digest AS checksum FROM ({set_digest(_digest, 'reports')})",
    "reports",
)
add(
    "manifest_contract_check",
    """SELECT * FROM (
 SELECT 'embedding_dimension' AS field, max(len(embedding))::VARCHAR AS found, '384' AS expected FROM embeddings
 UNION ALL SELECT 'normalization_version', 'normalization-v1', 'normalization-v1'
 UNION ALL SELECT 'embedding_model', 'model-' || count(*), 'intfloat/multilingual-e5-small' FROM embeddings)
 WHERE found <> expected""",
)
add(
    "read_sensitive_locations",
    "SELECT place_id, kind, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM places",
    "places",
)
add(
    "join_benchmark_pairs",
    f"""SELECT id, CASE WHEN NOT in_meta THEN 'text_without_metadata' WHEN NOT in_text THEN 'metadata_without_text'
 WHEN text_label IS NOT NULL AND text_label <> meta_label THEN 'label_contradiction' ELSE 'joined' END AS violation FROM (
 SELECT left_id || ':' || right_id AS id, {tail('left_id')} % 13 <> 0 AS in_text, {tail('right_id')} % 17 <> 0 AS in_meta,
 CASE WHEN {tail('left_id')} % 11 = 0 THEN 'match' END AS text_label,
 CASE WHEN {tail('right_id')} % 2 = 0 THEN 'match' ELSE 'non_match' END AS meta_label FROM pairs)
 WHERE in_text OR in_meta""",
    "pairs",
)
add(
    "publish_snapshot",
    "SELECT incident_id, id, report_count FROM auto_comp JOIN auto_ids USING (component)",
    "auto_comp",
    "auto_ids",
)
add(
    "check_coverage",
    f"""SELECT 'uncovered_complaint' AS violation, id FROM reports WHERE {tail('id')} % 19 = 0 AND {tail('id')} % 23 <> 0
 UNION ALL SELECT 'member_of_several_incidents', id FROM reports WHERE {tail('id')} % 23 = 0 AND {tail('id')} % 19 <> 0
 UNION ALL SELECT 'unknown_member', 'x' || id FROM reports WHERE {tail('id')} % 29 = 0""",
    "reports",
)
add(
    "check_edges",
    """SELECT 'self_relationship' AS violation, id AS left_id, id AS right_id FROM reports WHERE event_id % 31 = 0
 UNION ALL SELECT 'unknown_endpoint', id, '00000000-0000-0000-0000-' || lpad((event_id + 3)::VARCHAR, 12, '0')
 FROM reports WHERE event_id % 31 <> 0 AND event_id + 3 NOT IN (SELECT event_id FROM reports)
 UNION ALL SELECT 'contradictory_duplicate', id,
  CASE WHEN event_id % 31 = 0 THEN id ELSE '00000000-0000-0000-0000-' || lpad((event_id + 3)::VARCHAR, 12, '0') END
 FROM reports WHERE event_id % 37 = 0""",
    "reports",
)
add(
    "check_embeddings",
    """SELECT 'unusable_vector' AS violation, vec_id AS id FROM embeddings WHERE vec_id % 19 <> 0
  AND (vec_id % 23 = 0 OR (vec_id % 29 <> 0 AND vec_id % 31 = 0))
 UNION ALL SELECT 'dimension_mismatch', vec_id FROM embeddings WHERE vec_id % 19 <> 0 AND (vec_id % 23 = 0 OR vec_id % 29 = 0)
 UNION ALL SELECT 'missing_vector', vec_id FROM embeddings WHERE vec_id % 37 <> 0 AND vec_id % 19 = 0
 UNION ALL SELECT 'vector_without_complaint', vec_id FROM embeddings WHERE vec_id % 19 <> 0 AND vec_id % 37 = 0""",
)
add(
    "photo_manifest",
    """SELECT 'photo-' || event_id AS path,
 CASE WHEN event_id % 997 = 0 THEN 8388611 WHEN event_id % 3 = 0 THEN length(text) + 3 WHEN event_id % 3 = 1 THEN length(text) + 8
  ELSE length(text) + 6 END::BIGINT AS byte_size,
 CASE WHEN event_id % 997 = 0 OR event_id % 3 = 0 THEN 'image/jpeg' WHEN event_id % 3 = 1 THEN 'image/png' END AS media_type,
 CASE WHEN event_id % 997 = 0 THEN 'photo_too_large' WHEN event_id % 3 = 2 THEN 'unsupported_photo_type' END AS rejection
 FROM reports""",
    "reports",
)
add(
    "photo_url",
    """SELECT id, CASE WHEN event_id % 5 = 0 THEN '/api/v1/photos/00000000-0000-4000-8000-' || lpad(event_id::VARCHAR, 12, '0') END AS photo_url
 FROM reports""",
    "reports",
)
add(
    "read_complaints",
    "SELECT id, nt AS normalized_text, category, epoch_us(reported_at) AS reported_us FROM complaints ORDER BY id",
    "complaints",
)
add(
    "table_health",
    """SELECT (SELECT count(*) FROM reports) AS complaint_count, (SELECT count(*) FROM auto_ids) AS incident_count,
 'healthy' AS data_state, 'healthy' AS policy_state, 'degraded' AS photo_state, true AS core_ready, 'degraded' AS status""",
    "reports",
    "auto_ids",
)
add("append_tables", "SELECT id, text, category FROM reports", "reports")
add(
    "validate_complaints",
    f"""SELECT id, trim(text) AS text, array_to_string(list_filter([
 CASE WHEN length(trim(text)) < 3 THEN 'text_too_short' END, CASE WHEN length(text) > 2000 THEN 'text_too_long' END,
 CASE WHEN isnan(latitude) OR latitude NOT BETWEEN -90 AND 90 THEN 'latitude_out_of_range' END,
 CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 'longitude_out_of_range' END,
 CASE WHEN reported_at IS NULL THEN 'reported_at_missing_or_naive' END,
 CASE WHEN reported_at > TIMESTAMP '2024-06-01 00:05:00' THEN 'reported_at_in_future' END,
 CASE WHEN category IS NOT NULL AND NOT list_contains({sql_list(CATEGORIES)}, category) THEN 'unknown_category' END,
 CASE WHEN photo_path LIKE 'uploads/%' THEN 'photo_path_reserved' END,
 CASE WHEN photo_path IS NOT NULL AND photo_id IS NOT NULL THEN 'photo_fields_conflict' END], lambda x: x IS NOT NULL), ',') AS rejections FROM raw""",
    "raw",
)
add(
    "to_utc",
    """SELECT id, CASE WHEN event_id % 4 <> 3 THEN epoch_us(date_trunc('second', reported_at)) END AS utc_us FROM reports""",
    "reports",
)
_cls = ",".join(
    f"list_filter({sql_list(ts)}, lambda t: regexp_matches(nt, '\\b' || t || '\\b'))"
    for ts in CATEGORY_TERMS.values()
)
CTES["cls"] = (
    ("complaints",),
    f"""SELECT *, CASE WHEN best > 0 AND len(list_filter(found, lambda f: len(f) = best)) = 1 THEN
   {sql_list(CATEGORY_TERMS)}[list_position(list_transform(found, lambda f: len(f)), best)] ELSE 'other' END AS predicted,
 CASE WHEN best > 0 AND len(list_filter(found, lambda f: len(f) = best)) = 1 THEN
   list_sort(found[list_position(list_transform(found, lambda f: len(f)), best)]) ELSE list_sort(flatten(found)) END AS matched
 FROM (SELECT *, list_max(list_transform(found, lambda f: len(f))) AS best FROM (SELECT *, [{_cls}] AS found FROM complaints))""",
)
add(
    "resolve_category",
    """SELECT id, CASE WHEN event_id % 3 <> 0 THEN category ELSE predicted END AS category,
 array_to_string(matched, ',') AS matched_terms FROM cls""",
    "cls",
)
add(
    "classify_category",
    """SELECT id, predicted AS category, array_to_string(matched, ',') AS matched_terms,
 NOT (best > 0 AND len(list_filter(found, lambda f: len(f) = best)) = 1) AS review_required FROM cls""",
    "cls",
)
_content = f"{norm('text')}, latitude, longitude, reported_at, category, photo_path"
add(
    "request_fingerprint",
    f"""SELECT min(seq) AS first_sequence, count(*) AS command_count, count(DISTINCT k) AS key_count
 FROM subs GROUP BY {_content}""",
    "subs",
)
# lower-casing and NFC equal NFKC case folding on these languages, apart from sharp s
_folded = "replace(lower(nfc_normalize(text)), 'ß', 'ss')"
_documents = f"trim(regexp_replace(regexp_replace({_folded}, '\\p{{P}}', ' ', 'g'), '\\s+', ' ', 'g'))"
for _source in sorted(ALIASES, key=len, reverse=True):
    _documents = f"regexp_replace({_documents}, '\\b{_source}\\b', '{ALIASES[_source]}', 'g')"
add("normalize_documents", f"SELECT doc_id, {_documents} AS normalized_text FROM documents")
add("read_aliases", "SELECT id, nt AS normalized_text FROM complaints", "complaints")
add("normalize_text", "SELECT id, nt AS normalized_text FROM complaints", "complaints")
add(
    "extract_locations",
    """SELECT id, (row_number() OVER (PARTITION BY id ORDER BY grp) - 1)::INTEGER AS position, kind, value, raw FROM mentions""",
    "mentions",
)
add(
    "compare_locations",
    "SELECT left_id, right_id, compat AS compatibility, place_reason AS reason FROM placed",
    "placed",
)
_plain = [t for s, ts in SAFETY_TERMS.items() if s != "active_flooding" for t in ts]
add(
    "term_hits",
    f"SELECT id, array_to_string({hit_list('nt', _plain, 'NOT ' + NEG)}, ',') AS hits FROM complaints",
    "complaints",
)
add(
    "active_flooding_hits",
    f"SELECT id, array_to_string({hit_list('nt', SAFETY_TERMS['active_flooding'], FLOOD)}, ',') AS hits FROM complaints",
    "complaints",
)
add("uuid5", f"SELECT id, {uuid5('text')} AS text_uuid FROM reports", "reports")
add(
    "haversine_metres",
    f"""SELECT id, CASE WHEN NOT isnan(latitude) AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
 THEN round({hav('latitude', 'longitude', '3.1::DOUBLE', '101.5::DOUBLE')}, 4) END AS metres FROM raw""",
    "raw",
)
_gap = "abs(epoch_us(reported_at) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 1e6"
add("temporal_gap_seconds", f"SELECT id, round({_gap}, 6) AS gap_seconds FROM reports", "reports")
add("within_time_window", f"SELECT id, {_gap} <= 604800 AS inside FROM reports", "reports")
add(
    "cosine_similarity",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
 FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""",
)
_cell = lambda c: f"round(floor(({c}) / 0.001::DOUBLE) * 0.001::DOUBLE, 3) + 0.0"
add(
    "quantize_cell",
    f"SELECT id, {_cell('latitude - 3.2::DOUBLE')} AS cell_lat, {_cell('longitude')} AS cell_lon FROM reports",
    "reports",
)
add(
    "radius_ring",
    """SELECT id, vertex, round(CASE WHEN radius = 0 THEN longitude ELSE degrees(lam + atan2(sin(b)*sin(d)*cos(phi), cos(d) - sin(phi)*sin(lat2))) END, 6) AS lon,
 round(CASE WHEN radius = 0 THEN latitude ELSE degrees(lat2) END, 6) AS lat FROM (
 SELECT *, asin(sin(phi)*cos(d) + cos(phi)*sin(d)*cos(b)) AS lat2 FROM (
 SELECT *, unnest(CASE WHEN radius = 0 THEN range(0, 1) ELSE range(0, 65) END)::INTEGER AS vertex, vertex / 64.0::DOUBLE * 2 * pi() AS b,
  radius / 6371008.8::DOUBLE AS d, radians(latitude) AS phi, radians(longitude) AS lam FROM (
 SELECT *, CASE WHEN event_id % 9 = 0 THEN 0.0::DOUBLE ELSE (event_id % 8 - 1) * 100.0::DOUBLE END AS radius FROM raw)
 WHERE radius >= 0 AND NOT isnan(latitude)))""",
    "raw",
)
_scale = "CASE WHEN {r} = 0 THEN 1.0 ELSE {r} END"
_lo = lambda c: f"least(a.{c}, b.{c})"
_rg = lambda c: f"(greatest(a.{c}, b.{c}) - least(a.{c}, b.{c}))"
_x = lambda t: f"18 + ({t}.longitude - {_lo('longitude')}) / ({_scale.format(r=_rg('longitude'))}) * 64"
_y = lambda t: f"82 - ({t}.latitude - {_lo('latitude')}) / ({_scale.format(r=_rg('latitude'))}) * 64"
_same = f"{_rg('latitude')} = 0 AND {_rg('longitude')} = 0"
add(
    "evidence_projection",
    f"""SELECT review_id, round(CASE WHEN {_same} THEN 28.0 ELSE {_x('a')} END, 6) AS xa, round(CASE WHEN {_same} THEN 50.0 ELSE {_y('a')} END, 6) AS ya,
 round(CASE WHEN {_same} THEN 72.0 ELSE {_x('b')} END, 6) AS xb, round(CASE WHEN {_same} THEN 50.0 ELSE {_y('b')} END, 6) AS yb
 FROM rev JOIN reports a ON a.id = rev.left_id JOIN reports b ON b.id = rev.right_id""",
    "rev",
    "reports",
)
add(
    "candidate_pairs",
    "SELECT left_id, right_id, round(dist, 4) AS distance_metres, round(gap, 6) AS time_gap_seconds FROM pairs",
    "pairs",
)
add(
    "score_pairs",
    "SELECT left_id, right_id, round(sim, 6) AS semantic_similarity FROM scored",
    "scored",
)
add(
    "match_pairs",
    """SELECT left_id, right_id, decision, left_category <> 'other' AND left_category = right_category AS category_compatible,
 compat AS location_compatibility, CASE WHEN decision = 'auto_match' THEN 6 ELSE 3 END::BIGINT AS reason_count,
 'final decision: ' || decision AS last_reason FROM matched""",
    "matched",
)
add("apply_overrides", "SELECT * FROM edges", "edges")
add(
    "review_read",
    """SELECT review_id, status, a.text AS left_text, b.text AS right_text, a.category AS left_category, b.category AS right_category
 FROM rev JOIN reports a ON a.id = rev.left_id JOIN reports b ON b.id = rev.right_id""",
    "rev",
    "reports",
)
add(
    "incident_evidence",
    """SELECT incident_id, id AS complaint_id, text, category, photo_path IS NOT NULL AS photo_available, NULL::VARCHAR AS photo_url,
 epoch_us(reported_at) AS reported_us FROM final_comp JOIN final_ids USING (component) JOIN reports USING (id)""",
    "final_comp",
    "final_ids",
    "reports",
)
add("sensitive_exposure", "SELECT * FROM exposure", "exposure")
add(
    "submission_lookup",
    "SELECT DISTINCT k AS idempotency_key, id AS complaint_id, nt AS normalized_text, c.category FROM subs JOIN complaints c USING (id)",
    "subs",
    "complaints",
)
CTES["seeds"] = (
    ("matched",),
    f"""SELECT 'seed-' || {tail('left_id')} AS l, CASE WHEN n % 60 = 1 THEN 'seed-unknown' WHEN n % 60 = 2 THEN 'seed-' || {tail('left_id')}
   ELSE 'seed-' || {tail('right_id')} END AS r,
 CASE WHEN n % 84 = 1 THEN 'review_required' WHEN n % 12 = 1 THEN 'auto_match' ELSE 'no_match' END AS state,
 n, decision, left_id, right_id FROM (SELECT *, {tail('left_id')} + {tail('right_id')} AS n FROM matched) WHERE n % 12 IN (1, 2)""",
)
CTES["seeds_all"] = (
    ("seeds",),
    f"""SELECT l, r, state, n, decision, 0 AS swapped, n % 60 IN (1, 2) AS broken, left_id, right_id FROM seeds
 UNION ALL SELECT 'seed-' || {tail('right_id')}, 'seed-' || {tail('left_id')}, 'auto_match', n, decision, 1, false, left_id, right_id FROM seeds WHERE n % 36 = 1""",
)
add(
    "seed_resolution_violations",
    """SELECT violation, left_seed_key, right_seed_key, count(*) AS n FROM (
 SELECT 'unknown_seed_key' AS violation, l AS left_seed_key, r AS right_seed_key FROM seeds_all WHERE r = 'seed-unknown'
 UNION ALL SELECT 'self_pair', l, r FROM seeds_all WHERE l = r
 UNION ALL SELECT 'bad_final_state', l, r FROM seeds_all WHERE state NOT IN ('auto_match', 'no_match')
 UNION ALL SELECT 'not_a_review_candidate', l, r FROM seeds_all WHERE l <> r AND r <> 'seed-unknown' AND decision <> 'review_required'
 UNION ALL SELECT 'duplicate_resolution', min(l), min(r) FROM seeds_all WHERE r <> 'seed-unknown'
  GROUP BY least(l, r), greatest(l, r) HAVING count(*) > 1) GROUP BY ALL""",
    "seeds_all",
)
add(
    "seed_resolutions",
    f"""SELECT {uuid5("'review-v1:' || m.left_id || ':' || m.right_id")} AS review_id, m.left_id, m.right_id,
 CASE s.state WHEN 'auto_match' THEN 'approved' WHEN 'no_match' THEN 'rejected' ELSE 'pending' END AS status,
 s.state AS final_relationship_state, CASE WHEN s.state IS NOT NULL THEN 'officer-1' END AS reviewed_by,
 CASE WHEN s.state IS NOT NULL THEN 'officer_review' END AS decision_source, CASE WHEN s.state IS NULL THEN 1 ELSE 2 END::BIGINT AS version
 FROM matched m LEFT JOIN (SELECT * FROM seeds WHERE n % 60 NOT IN (1, 2) AND state <> 'review_required' AND decision = 'review_required') s
 USING (left_id, right_id) WHERE m.decision = 'review_required'""",
    "matched",
    "seeds",
)
add(
    "affected_incidents",
    f"SELECT DISTINCT incident_id FROM auto_comp JOIN auto_ids USING (component) WHERE {tail('id')} % 97 = 0",
    "auto_comp",
    "auto_ids",
)
_alive = lambda c: f"{tail(c)} % 97 <> 0"
add(
    "cascade_delete",
    f"""SELECT t AS table_name, count(*) AS rows_left FROM reports, (SELECT unnest(['complaints','embeddings','incident_members','submission_keys']) AS t)
 WHERE {_alive('id')} GROUP BY t
 UNION ALL SELECT 'match_edges', count(*) FROM edges WHERE {_alive('left_id')} AND {_alive('right_id')}
 UNION ALL SELECT 'reviews', count(*) FROM rev WHERE {_alive('left_id')} AND {_alive('right_id')}""",
    "reports",
    "edges",
    "rev",
)
add(
    "cascade_delete_rows",
    f"""SELECT t AS table_name, id, '' AS more FROM reports, (SELECT unnest(['complaints','embeddings','incident_members']) AS t) WHERE {_alive('id')}
 UNION ALL SELECT 'submission_keys', id, 'key-' || event_id FROM reports WHERE {_alive('id')}
 UNION ALL SELECT 'match_edges', left_id, right_id FROM edges WHERE {_alive('left_id')} AND {_alive('right_id')}
 UNION ALL SELECT 'reviews', left_id, right_id FROM rev WHERE {_alive('left_id')} AND {_alive('right_id')}""",
    "reports",
    "edges",
    "rev",
)
add(
    "attach_photos",
    """SELECT id, CASE WHEN event_id % 2 = 1 THEN 'photo.jpg' WHEN (event_id % 50) % 8 <> 0 THEN 'uploads/stored-' || (event_id % 50) || '.png' END AS photo_path,
 CASE WHEN event_id % 2 = 0 AND (event_id % 50) % 8 = 0 THEN 'unknown_photo' ELSE 'attached' END AS outcome FROM reports""",
    "reports",
)
add("connected_components", "SELECT id, component FROM auto_comp", "auto_comp")
add(
    "connected_components_collapsed_reviewed", "SELECT id, component FROM final_comp", "final_comp"
)
add("connected_components_reviewed", "SELECT id, component FROM final_comp", "final_comp")
add(
    "incident_summary",
    """SELECT incident_id, report_count, round(clat, 6) AS centroid_latitude, round(clon, 6) AS centroid_longitude, round(radius, 4) AS radius_metres,
 epoch_us(earliest) AS earliest_us, epoch_us(latest) AS latest_us, array_to_string(cats, ',') AS category_summary,
 conflicts AS conflict_count, pend AS pending_count, status FROM inc""",
    "inc",
)
add("incident_id", "SELECT * FROM final_ids", "final_ids")
add("conflict_detection", "SELECT * FROM clashes", "clashes")
add(
    "confirmed_edges",
    """SELECT component, left_id, right_id, decision_source FROM edges JOIN final_comp ON id = left_id WHERE decision = 'auto_match'""",
    "edges",
    "final_comp",
)
add("review_candidates", "SELECT * FROM pending", "pending")
add("dedupe_edges", "SELECT left_id, right_id, decision FROM matched", "matched")
add(
    "graph_version",
    f"""SELECT digest AS graph_version, n AS edge_count FROM ({set_digest("sha256(left_id||':'||right_id||':'||decision)", 'matched')})""",
    "matched",
)
add(
    "safety_signals",
    "SELECT component, signal, complaint_count, array_to_string(terms, ',') AS matched_terms FROM safety",
    "safety",
)
add(
    "priority_signals",
    """SELECT incident_id, 'confirmed_report_count' AS name, round(least(report_count / 20, 1.0), 6) AS normalized_value, report_count >= 2 AS triggered FROM pin
 UNION ALL SELECT incident_id, 'pending_candidate_count', pend, false FROM pin
 UNION ALL SELECT incident_id, 'unresolved_hours', round(least(hours / 48, 1.0), 6), hours >= 24 FROM pin
 UNION ALL SELECT incident_id, 'safety_signal_count', least(len(names), 1), len(names) > 0 FROM pin
 UNION ALL SELECT incident_id, 'sensitive_location_count', least(sens, 1), sens > 0 FROM pin
 UNION ALL SELECT incident_id, 'evidence_completeness', round(complete, 6), complete >= 0.5 FROM pin""",
    "pin",
)
add(
    "assess_priority",
    """SELECT incident_id, level AS priority_level, CASE WHEN status = 'conflict' THEN 'review_required' ELSE 'scored' END AS priority_status,
 CASE WHEN status = 'conflict' THEN 0 ELSE pts END::BIGINT AS points,
 CASE WHEN status = 'conflict' THEN 'clustering_conflict_requires_review' WHEN len(rules) = 0 THEN 'default_low_priority' ELSE array_to_string(rules, ',') END AS triggered_rules
 FROM prio""",
    "prio",
)
add(
    "status_counts",
    f"""SELECT 'review' AS domain, v AS value, (SELECT count(*) FROM rev WHERE status = v) AS count FROM (SELECT unnest({sql_list(REVIEW_STATUSES)}) AS v)
 UNION ALL SELECT 'priority', v, (SELECT count(*) FROM prio WHERE level = v) FROM (SELECT unnest({sql_list(PRIORITY_LEVELS)}) AS v)""",
    "rev",
    "prio",
)


def heat(where: str) -> str:
    return f"""SELECT latitude, longitude, round(total / max(total) OVER (), 6) AS intensity, category AS dominant_category FROM (
 SELECT *, row_number() OVER (PARTITION BY latitude, longitude ORDER BY total DESC,
   list_position(['flooding','blocked_drain','pothole','rubbish','street_light','other'], category)) AS rn FROM (
 SELECT latitude, longitude, category, sum(contribution)::DOUBLE AS total FROM (
 SELECT {_cell('clat')} AS latitude, {_cell('clon')} AS longitude, unnest(cats) AS category,
  report_count * (CASE operational WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS contribution
 FROM prio WHERE status <> 'conflict') {where} GROUP BY ALL)) WHERE rn = 1"""


add("heat_cells", heat(""), "prio")
add("heat_cells_category", heat("WHERE category = 'flooding'"), "prio")
add(
    "filter_incidents",
    """SELECT incident_id, status, operational AS operational_priority FROM prio
 WHERE status = 'isolated' AND operational = 'critical' AND list_contains(cats, 'flooding')""",
    "prio",
)
add(
    "filter_reviews",
    "SELECT review_id, left_id, right_id, status FROM rev WHERE status = 'rejected'",
    "rev",
)
add(
    "incident_summary_view",
    """SELECT incident_id, status, array_to_string(cats, ',') AS category_summary, operational AS priority, report_count AS confirmed_report_count,
 pend AS pending_candidate_count, conflicts AS conflict_count FROM prio""",
    "prio",
)
add(
    "hotspots",
    """SELECT incident_id, round(clat, 6) AS latitude, round(clon, 6) AS longitude, report_count AS confirmed_reports, pend AS pending_candidates,
 coalesce(operational, 'No operational priority') AS priority FROM prio WHERE status = 'confirmed'""",
    "prio",
)
add(
    "review_view",
    """SELECT review_id, status, 'review_required' AS original_recommendation, coalesce(final_state, 'pending') AS final_relationship_state,
 CASE WHEN final_state IS NULL THEN 'matcher' ELSE 'officer_review' END AS decision_source, coalesce(reviewed_by, 'Unassigned') AS reviewer_id,
 coalesce(strftime(resolved_at, '%Y-%m-%d %H:%M:%S'), 'Unresolved') AS resolved_at, coalesce(review_note, 'No note') AS review_note FROM rev""",
    "rev",
)
add(
    "affected_areas",
    """SELECT incident_id, CASE WHEN radius = 0 THEN 'Point' ELSE 'Polygon' END AS geometry_type,
 CASE WHEN radius = 0 THEN 1 ELSE 65 END::BIGINT AS vertex_count FROM inc""",
    "inc",
)
QUEUE = """SELECT incident_id, operational AS operational_priority, epoch_us(latest) AS latest_us, (SELECT count(*) FROM prio) AS total FROM prio
 ORDER BY CASE operational WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END DESC, latest DESC, incident_id
 LIMIT 100 OFFSET 10"""
add("incident_queue", QUEUE, "prio")
_rq = "CASE WHEN status = 'pending' THEN created_at ELSE resolved_at END"
add(
    "review_queue",
    f"""SELECT review_id, status, epoch_us({_rq}) AS queue_us, (SELECT count(*) FROM rev) AS total FROM rev
 ORDER BY CASE WHEN status = 'pending' THEN 0 ELSE 1 END, {_rq} DESC, review_id LIMIT 100 OFFSET 20""",
    "rev",
)
add(
    "review_queue_resolved",
    """SELECT review_id, status, epoch_us(resolved_at) AS queue_us, (SELECT count(*) FROM rev WHERE status = 'approved') AS total
 FROM rev WHERE status = 'approved' ORDER BY resolved_at DESC, review_id LIMIT 50""",
    "rev",
)
add(
    "evidence_preview",
    """SELECT incident_id, id AS complaint_id, position, text, report_count AS total, report_count > 3 AS has_more FROM (
 SELECT *, row_number() OVER (PARTITION BY component ORDER BY id) AS position FROM final_comp JOIN final_ids USING (component) JOIN reports USING (id))
 WHERE position <= 3""",
    "final_comp",
    "final_ids",
    "reports",
)
add("deterministic_order", "SELECT component, incident_id FROM final_ids ORDER BY component", "final_ids")
add(
    "union_new",
    """SELECT id, CASE WHEN event_id % 3 <> 0 THEN text ELSE text || ' again' END AS text, category FROM reports
 WHERE event_id % 3 <> 0 OR event_id % 2 = 0""",
    "reports",
)
add(
    "snapshot_changes",
    """SELECT coalesce(a.incident_id, b.incident_id) AS incident_id,
 CASE WHEN a.incident_id IS NULL THEN 'added' WHEN b.incident_id IS NULL THEN 'removed' ELSE 'kept' END AS change
 FROM auto_ids a FULL JOIN final_ids b ON a.incident_id = b.incident_id""",
    "auto_ids",
    "final_ids",
)
add(
    "snapshot_transition",
    """SELECT previous_id, count(DISTINCT current_id) AS successor_count, CASE WHEN count(DISTINCT current_id) = 1 THEN min(current_id) END AS followed_id FROM (
 SELECT i.incident_id AS previous_id, j.incident_id AS current_id FROM auto_comp a JOIN auto_ids i USING (component)
 JOIN final_comp f ON f.id = a.id JOIN final_ids j ON j.component = f.component) GROUP BY previous_id""",
    "auto_comp",
    "auto_ids",
    "final_comp",
    "final_ids",
)
add(
    "id_set_equality",
    """SELECT id, 'left_only' AS side FROM reports WHERE event_id % 41 <> 0 AND event_id % 43 = 0
 UNION ALL SELECT id, 'right_only' FROM reports WHERE event_id % 41 = 0 AND event_id % 43 <> 0""",
    "reports",
)
_summary = "count(*) AS count, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS maximum"
add(
    "metric_summary",
    f"SELECT event_type AS metric, {_summary} FROM events GROUP BY event_type",
)
_names = [*metrics.METRIC_LIMITS, *[p for ps in metrics.COMPOSED_GATES.values() for p in ps]]
CTES["budget_rows"] = (
    (),
    f"SELECT {sql_list(_names)}[event_id % {len(_names)} + 1] AS metric, quantile_disc(value, 0.95) AS observed FROM events GROUP BY 1",
)
_b = PerformanceBudget()
_limit_cases = " ".join(
    f"WHEN '{m}' THEN {getattr(_b, f)}::DOUBLE"
    for m, f in {**metrics.METRIC_LIMITS, **metrics.COMPOSED_LIMITS}.items()
)
CTES["budget"] = (
    ("budget_rows",),
    f"""SELECT metric, observed, lim AS "limit", lim IS NOT NULL AS hard, lim IS NULL OR observed <= lim AS passed FROM (
 SELECT *, CASE metric {_limit_cases} WHEN 'mutation_memory_growth_percent' THEN 15.0::DOUBLE END AS lim FROM (
 SELECT * FROM budget_rows
 UNION ALL SELECT 'submission_p95_ms', max(observed) FROM budget_rows WHERE metric IN {tuple(metrics.COMPOSED_GATES['submission_p95_ms'])} HAVING count(*) = 3
 UNION ALL SELECT 'review_resolution_p95_ms', max(observed) FROM budget_rows WHERE metric IN {tuple(metrics.COMPOSED_GATES['review_resolution_p95_ms'])} HAVING count(*) = 3
 UNION ALL SELECT 'mutation_memory_growth_percent', 7.5::DOUBLE))""",
)
add("budget_evaluation", "SELECT * FROM budget", "budget")
add("budget_passed", "SELECT bool_and(NOT hard OR passed) AS passed FROM budget", "budget")
_spans = [*metrics.APPLICATION_SPANS, *metrics.MODEL_SPANS, "warm_up"]
add(
    "startup_profile",
    """SELECT user_id AS run, round(sum(CASE WHEN event_id % 6 < 3 THEN value ELSE 0.0 END), 4) AS application_seconds,
 round(sum(CASE WHEN event_id % 6 IN (3, 4) THEN value ELSE 0.0 END), 4) AS cold_model_seconds FROM events GROUP BY user_id""",
)
add(
    "rss_growth",
    """SELECT event_id, CASE WHEN ready > 0 THEN round(post - ready, 4) END AS growth_mb,
 CASE WHEN ready > 0 THEN round((post - ready) / ready * 100, 4) END AS growth_percent FROM (
 SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE value END AS ready, value + event_id % 7 AS post FROM events)""",
)
_rounded = """round(threshold, 7) AS threshold, false_merges, false_splits, round(precision, 6) AS precision,
 round(recall, 6) AS recall, round(f1, 6) AS f1"""
CTES["cand"] = (("lab",), thresholds("lab"))
add("threshold_candidates", f"SELECT {_rounded} FROM cand", "cand")
add(
    "best_threshold",
    f"SELECT {_rounded} FROM cand ORDER BY cand.false_merges, cand.f1 DESC, cand.precision DESC, cand.threshold DESC LIMIT 1",
    "cand",
)
add(
    "similarity_distribution",
    """SELECT label, count(*) AS pair_count, min(score) AS min_score, round(avg(score), 6) AS mean_score, max(score) AS max_score
 FROM lab GROUP BY label""",
    "lab",
)
add(
    "hardest_pairs",
    """SELECT label, pair_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY label
 ORDER BY CASE WHEN label = 'non_match' THEN -score ELSE score END, pair_id) AS position FROM lab) WHERE position <= 5""",
    "lab",
)
CTES["cal"] = (("lab",), "SELECT * FROM lab WHERE split = 'calibration'")
CTES["cal_cand"] = (("cal",), thresholds("cal"))
CTES["hold"] = (
    ("cal_cand", "lab"),
    f"""SELECT *, {decision('(SELECT threshold FROM cal_cand ORDER BY false_merges, f1 DESC, precision DESC, threshold DESC LIMIT 1)')} AS decision
 FROM lab WHERE split = 'holdout'""",
)
CTES["hold_counts"] = (
    ("hold",),
    """SELECT count(*) FILTER (WHERE decision = 'auto_match' AND label = 'non_match') AS false_auto_merges,
 count(*) FILTER (WHERE decision = 'auto_match' AND label = 'match') AS auto_matches,
 count(*) FILTER (WHERE decision = 'review_required') AS review_required,
 count(*) FILTER (WHERE decision = 'no_match') AS no_matches,
 count(*) FILTER (WHERE decision = 'no_match' AND label = 'match') AS positive_no_matches,
 count(*) FILTER (WHERE label = 'match' AND positive_type = 'clear') AS clear_positive_count,
 count(*) FILTER (WHERE label = 'match' AND positive_type = 'clear' AND decision = 'auto_match') AS clear_auto_matches,
 count(*) FILTER (WHERE label = 'match' AND positive_type = 'clear' AND decision = 'no_match') AS clear_positive_no_matches,
 count(*) FILTER (WHERE label = 'match') AS positive_count, count(*) FILTER (WHERE label = 'non_match') AS negative_count FROM hold""",
)
add(
    "holdout_report",
    """SELECT *, CASE WHEN clear_positive_count > 0 THEN round(clear_auto_matches / clear_positive_count, 6) ELSE 0.0 END AS clear_positive_auto_rate,
 false_auto_merges = 0 AND positive_no_matches = 0 AND clear_positive_no_matches = 0
 AND (CASE WHEN clear_positive_count > 0 THEN clear_auto_matches / clear_positive_count ELSE 0.0 END) >= 0.75 AS passed FROM hold_counts""",
    "hold_counts",
)
add(
    "idempotent_submissions",
    """SELECT k AS idempotency_key, seq AS sequence, CASE seq % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'replayed' ELSE 'conflict' END AS outcome,
 CASE WHEN seq % 3 < 2 THEN id END AS complaint_id FROM subs""",
    "subs",
)
add(
    "upsert_reviews",
    f"""SELECT review_id, CASE WHEN n % 3 <> 0 THEN status ELSE 'pending' END AS status, refreshed,
 CASE WHEN refreshed THEN 'graph-2' ELSE 'graph-1' END AS graph_version_at_creation,
 epoch_us(CASE WHEN n % 3 <> 0 THEN created_at ELSE TIMESTAMP '2024-06-01 00:00:00' END) AS created_us,
 CASE WHEN n % 3 <> 0 THEN version ELSE 1 END::BIGINT AS version FROM (
 SELECT *, n % 7 <> 0 AND (n % 3 = 0 OR status = 'pending') AS refreshed FROM rev WHERE n % 3 <> 0 OR n % 7 <> 0)""",
    "rev",
)
CTES["cmds"] = (
    ("rev",),
    f"""SELECT review_id AS rid, CASE WHEN n % 41 = 0 THEN 'missing-' || review_id ELSE review_id END AS review_id, n % 2 = 0 AS approve, 1::BIGINT AS sequence,
  n, status, version, {tail('left_id')} % 6 <> 0 AS fresh FROM rev
 UNION ALL SELECT review_id, review_id, true, 2, n, status, version, {tail('left_id')} % 6 <> 0 FROM rev WHERE n % 5 = 0""",
)
CTES["outs"] = (
    ("cmds",),
    """SELECT *, CASE WHEN rid <> review_id THEN 'unknown_review' WHEN status <> 'pending' THEN 'already_resolved' WHEN NOT fresh THEN 'stale'
 WHEN sequence = 2 AND n % 41 <> 0 THEN 'already_resolved' WHEN approve THEN 'approved' ELSE 'rejected' END AS outcome FROM cmds""",
)
add(
    "resolve_reviews",
    """SELECT review_id, sequence, outcome, CASE outcome WHEN 'approved' THEN 'auto_match' WHEN 'rejected' THEN 'no_match' END AS final_relationship_state,
 CASE WHEN outcome = 'unknown_review' THEN NULL WHEN outcome IN ('approved', 'rejected') THEN version + 1 ELSE version END::BIGINT AS version FROM outs""",
    "outs",
)
add(
    "resolved_reviews",
    """SELECT r.review_id, coalesce(o.outcome, r.status) AS status, CASE WHEN o.outcome IS NOT NULL THEN 'officer-9' ELSE r.reviewed_by END AS reviewed_by,
 CASE o.outcome WHEN 'approved' THEN 'auto_match' WHEN 'rejected' THEN 'no_match' ELSE r.final_state END AS final_relationship_state,
 (r.version + CASE WHEN o.outcome IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS version
 FROM rev r LEFT JOIN (SELECT * FROM outs WHERE outcome IN ('approved', 'rejected')) o ON o.review_id = r.review_id""",
    "rev",
    "outs",
)


# --- command side -----------------------------------------------------------------------------

add("incremental_cluster", "SELECT id, component FROM auto_comp", "auto_comp")
add("resolve_and_publish", "SELECT component, incident_id, report_count, level AS priority_level FROM prio", "prio")
ORACLES["resolve_in_rounds"] = ORACLES["resolve_and_publish"]
ORACLES["resolve_in_rounds_edges"] = ORACLES["apply_overrides"]
add("stream_cluster", "SELECT id, component FROM auto_comp", "auto_comp")
add("incremental_review", "SELECT id, component FROM final_comp", "final_comp")
CTES["auto_inc"] = (
    ("auto_comp", "auto_ids", "reports", "matched"),
    """SELECT i.component, i.incident_id, i.report_count, c.cats, coalesce(k.n, 0) AS conflicts, coalesce(p.n, 0) AS pend,
 CASE WHEN coalesce(k.n, 0) > 0 THEN 'conflict' WHEN i.report_count > 1 THEN 'confirmed' ELSE 'isolated' END AS status FROM auto_ids i
 JOIN (SELECT component, list_sort(list(DISTINCT category)) AS cats FROM auto_comp JOIN reports USING (id) GROUP BY component) c USING (component)
 LEFT JOIN (SELECT a.component, count(*) AS n FROM matched e JOIN auto_comp a ON a.id = e.left_id JOIN auto_comp b ON b.id = e.right_id
  WHERE e.decision = 'no_match' AND a.component = b.component GROUP BY a.component) k USING (component)
 LEFT JOIN (SELECT component, count(DISTINCT candidate) AS n FROM (
  SELECT a.component, e.right_id AS candidate FROM matched e JOIN auto_comp a ON a.id = e.left_id WHERE e.decision = 'review_required'
  UNION ALL SELECT b.component, e.left_id FROM matched e JOIN auto_comp a ON a.id = e.left_id JOIN auto_comp b ON b.id = e.right_id
  WHERE e.decision = 'review_required' AND a.component <> b.component) GROUP BY component) p USING (component)""",
)
_is_late = lambda c: f"{tail(c)} % 10 = 0"
CTES["auto_touched"] = (
    ("auto_comp", "matched"),
    f"""SELECT DISTINCT component FROM auto_comp WHERE {_is_late('id')} OR id IN (
  SELECT left_id FROM matched WHERE {_is_late('right_id')} UNION SELECT right_id FROM matched WHERE {_is_late('left_id')})""",
)
add(
    "incremental_touched_incidents",
    """SELECT incident_id, report_count, pend AS pending_count, conflicts AS conflict_count, status, array_to_string(cats, ',') AS category_summary
 FROM auto_inc WHERE component IN (SELECT component FROM auto_touched)""",
    "auto_inc",
    "auto_touched",
)
# priorities over the automated graph: the same ladder with the automated components
CTES["auto_prio"] = (
    ("auto_inc", "auto_comp", "reports", "safety_rows", "places"),
    f"""SELECT *, CASE WHEN status = 'conflict' THEN 'review_required' ELSE ['low','medium','high','critical'][greatest(0,
  CASE WHEN report_count >= 20 THEN 3 WHEN report_count >= 10 THEN 2 WHEN report_count >= 2 THEN 1 ELSE 0 END,
  CASE WHEN hours >= 48 THEN 3 WHEN hours >= 24 THEN 2 ELSE 0 END,
  CASE WHEN {_crit} THEN 3 WHEN {_high} THEN 2 ELSE 0 END,
  CASE WHEN list_contains(names, 'active_flooding') AND hospital THEN 3 ELSE 0 END,
  CASE WHEN sens > 0 THEN 2 ELSE 0 END) + 1] END AS level FROM (
 SELECT i.*, t.hours, coalesce(s.names, []) AS names, coalesce(e.sens, 0) AS sens, coalesce(e.hospital, false) AS hospital FROM auto_inc i
 JOIN (SELECT component, (epoch_us((SELECT max(reported_at) FROM reports)) - epoch_us(min(reported_at))) / 3.6e9 AS hours
   FROM auto_comp JOIN reports USING (id) GROUP BY component) t USING (component)
 LEFT JOIN (SELECT component, list(DISTINCT signal) AS names FROM safety_rows JOIN auto_comp USING (id) GROUP BY component) s USING (component)
 LEFT JOIN (SELECT component, count(DISTINCT place_id) AS sens, bool_or(lower(kind) = 'hospital') AS hospital
   FROM reports r JOIN places p ON abs(r.latitude - p.latitude) < 0.01 AND abs(r.longitude - p.longitude) < 0.01 JOIN auto_comp USING (id)
   WHERE {hav('r.latitude', 'r.longitude', 'p.latitude', 'p.longitude')} <= 250 GROUP BY component) e USING (component))""",
)
# components of the history alone, to know what a late report's incident replaced
CTES["old_links"] = (
    ("matched",),
    f"""SELECT left_id AS a, right_id AS b FROM matched WHERE decision = 'auto_match' AND NOT {_is_late('left_id')} AND NOT {_is_late('right_id')}
 UNION ALL SELECT right_id, left_id FROM matched WHERE decision = 'auto_match' AND NOT {_is_late('left_id')} AND NOT {_is_late('right_id')}""",
)
CTES["old_reach"] = (
    ("old_links",),
    """/*recursive*/SELECT DISTINCT a AS id, a AS root FROM old_links
 UNION SELECT l.b, r.root FROM old_reach r JOIN old_links l ON l.a = r.id""",
)
add(
    "submission_result",
    f"""SELECT m.id AS complaint_id, p.incident_id, p.report_count, p.status, p.level AS priority_level,
 coalesce(o.n, 0) AS previous_incident_count, coalesce(x.n, 0) AS decision_count
 FROM auto_comp m JOIN auto_prio p USING (component)
 LEFT JOIN (SELECT c.component, count(DISTINCT coalesce(r.root, c.id)) AS n FROM auto_comp c
   LEFT JOIN (SELECT id, min(root) AS root FROM old_reach GROUP BY id) r ON r.id = c.id WHERE NOT {_is_late('c.id')} GROUP BY c.component) o USING (component)
 LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT left_id AS id FROM matched WHERE decision <> 'no_match'
   UNION ALL SELECT right_id FROM matched WHERE decision <> 'no_match') GROUP BY id) x ON x.id = m.id
 WHERE {_is_late('m.id')}""",
    "auto_comp",
    "auto_prio",
    "old_reach",
    "matched",
)
add(
    "mutation_result_view",
    """SELECT review_id, CASE WHEN conflict THEN 'warning' ELSE 'success' END AS presentation,
 CASE WHEN conflict THEN 'Review was recorded, but the resulting incident graph is conflicted.' ELSE 'Review resolution recorded.' END AS message,
 CASE WHEN conflict THEN 'unavailable' ELSE 'available' END AS priority, previous_snapshot_ids, new_snapshot_ids FROM (
 SELECT e.review_id, bool_or(p.status = 'conflict') AS conflict,
  array_to_string(list_sort(list(DISTINCT i.incident_id)), ',') AS previous_snapshot_ids,
  array_to_string(list_sort(list(DISTINCT p.incident_id)), ',') AS new_snapshot_ids
 FROM (SELECT review_id, unnest([left_id, right_id]) AS id FROM rev WHERE status <> 'pending') e
 JOIN auto_comp a ON a.id = e.id JOIN auto_ids i ON i.component = a.component
 JOIN final_comp f ON f.id = e.id JOIN inc p ON p.component = f.component GROUP BY e.review_id)""",
    "rev",
    "auto_comp",
    "auto_ids",
    "final_comp",
    "inc",
)
add(
    "import_dataset",
    "SELECT id AS seed_key, report_count, status, level AS priority_level FROM auto_comp JOIN auto_prio USING (component)",
    "auto_comp",
    "auto_prio",
)
add(
    "incremental_embed",
    """SELECT sha256('intfloat/multilingual-e5-small' || chr(1) || 'normalization-v1' || chr(1) || nt) AS text_key,
 'intfloat/multilingual-e5-small' AS model_version, 64::BIGINT AS dimension
 FROM (SELECT nt FROM complaints GROUP BY nt HAVING bool_and(event_id % 3 <> 0))""",
    "complaints",
)
add("stream_submit", "SELECT component, incident_id, report_count, level AS priority_level FROM auto_prio", "auto_prio")
cte("alive", ("reports",), f"SELECT * FROM reports WHERE {_alive('id')}")
cte(
    "alive_links",
    ("edges",),
    f"""SELECT left_id AS a, right_id AS b FROM edges WHERE decision = 'auto_match' AND {_alive('left_id')} AND {_alive('right_id')}
 UNION ALL SELECT right_id, left_id FROM edges WHERE decision = 'auto_match' AND {_alive('left_id')} AND {_alive('right_id')}""",
)
cte(
    "alive_reach",
    ("alive_links",),
    """/*recursive*/SELECT DISTINCT a AS id, a AS root FROM alive_links
 UNION SELECT l.b, r.root FROM alive_reach r JOIN alive_links l ON l.a = r.id""",
)
cte(
    "alive_comp",
    ("alive_reach", "alive"),
    """SELECT p.id, coalesce(c.component, p.id) AS component FROM alive p
 LEFT JOIN (SELECT id, min(root) AS component FROM alive_reach GROUP BY id) c ON c.id = p.id""",
)
cte(
    "alive_ids",
    ("alive_comp",),
    f"""SELECT component, {uuid5("'incident-v1:' || digest")} AS incident_id, report_count FROM (
 SELECT component, sha256(count(*)::VARCHAR||':'||{_lanes}) AS digest, count(*) AS report_count
 FROM (SELECT component, sha256(id) AS d FROM alive_comp) GROUP BY component)""",
)
add("delete_and_publish", "SELECT id, component, incident_id, report_count FROM alive_comp JOIN alive_ids USING (component)", "alive_comp", "alive_ids")
add(
    "import_with_resolutions",
    "SELECT id AS seed_key, report_count, status, level AS priority_level FROM final_comp JOIN prio USING (component)",
    "final_comp",
    "prio",
)
for _name, _same in (("published_queue", "incident_queue"), ("published_queue_page", "incident_queue"), ("published_heat", "heat_cells")):
    ORACLES[_name] = ORACLES[_same]
add(
    "conflict_counts_collapsed",
    """SELECT 'automated' AS graph, component, conflicts AS conflict_count FROM auto_inc WHERE conflicts > 0
 UNION ALL SELECT 'reviewed', component, conflicts FROM inc WHERE conflicts > 0""",
    "auto_inc",
    "inc",
)
# without officer decisions the edges are the matcher's
_decided = CTES["edges"]
CTES["edges"] = (("matched",), "SELECT * FROM matched")
add("incident_queue_collapsed", QUEUE, "prio")
add("heat_cells_collapsed", heat(""), "prio")
CTES["edges"] = _decided
ORACLES["live_submission_result"] = ORACLES["submission_result"]
ORACLES["stream_validate"] = ORACLES["validate_complaints"]
ORACLES["stream_submissions"] = ORACLES["idempotent_submissions"]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
