"""Registered queries: one per operator, over whole tables derived from the given ones."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, ids, locations, text, vectors
from ..operators import (
    candidates,
    collapse,
    evaluation,
    graph,
    incidents,
    intake,
    matching,
    metrics,
    priority,
    quality,
    read_models,
    reviews,
    sets,
    spatial,
)
from ..policy import NORMALIZATION_VERSION, REVIEW_STATUSES, MatchingPolicy
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import documents, photos
from ..sources import fixtures as fx
from ..sources.store import SnapshotStore, read_complaints
from .flow import CollapsedFlow, Flow

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        REGISTRY[name] = fn
        return fn

    return register


# --- shared inputs ----------------------------------------------------------------------------


def automated(spark: SparkSession, d: str) -> Flow:
    """Flow without officer decisions. Text work on the reports runs once, into a stored table."""
    return Flow(
        cut_lineage(fx.complaints(spark, d)), fx.vectors(spark, d), fx.sensitive_locations(spark, d)
    )


def reviewed(spark: SparkSession, d: str) -> Flow:
    """Flow with officer decisions on a sixth of the reviews."""
    return replace(automated(spark, d), reviews_of=fx.reviews)


def us(column) -> Column:
    return F.unix_micros(column)


def r6(column) -> Column:
    return F.round(column, 6)


def joined(column) -> Column:
    return F.array_join(column, ",")


def big(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def tail(column) -> Column:
    """Number at the end of a derived id."""
    return F.substring(column, 25, 12).cast("bigint")


# --- sources and integrity --------------------------------------------------------------------


@query("read_complaint_seed")
def q_read_complaint_seed(spark, d):
    """Seed documents (one per zone and category) are built as JSON text and read back."""
    rows = fx.reports(spark, d).select(
        "z",
        "cat",
        F.struct(
            F.col("id").alias("seed_key"),
            "text",
            "latitude",
            "longitude",
            F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("reported_at"),
            "category",
            "photo_path",
        ).alias("c"),
    )
    # one document per report keeps documents bounded whatever the zone sizes are
    docs = rows.select(
        F.to_json(
            F.struct(
                F.struct(F.lit("v1").alias("seed_version")).alias("manifest"),
                F.array("c").alias("complaints"),
            )
        ).alias("document")
    )
    _, complaints, _ = documents.parse_seed(docs)
    return complaints.select(
        "seed_key",
        "text",
        r6("latitude").alias("latitude"),
        r6("longitude").alias("longitude"),
        us(intake.to_utc(F.col("reported_at"))).alias("reported_us"),
        "category",
        "photo_path",
    )


def _checksum_columns() -> list[Column]:
    micro = lambda c: F.round(F.col(c) * 100000).cast("bigint")
    return [
        F.col("id"), F.col("text"), F.col("category"), F.col("photo_path"), us("reported_at"),
        micro("latitude"), micro("longitude"),
    ]


@query("content_checksum")
def q_content_checksum(spark, d):
    return quality.content_checksum(fx.reports(spark, d), _checksum_columns())


@query("manifest_contract_check")
def q_manifest(spark, d):
    manifest = fx.table(spark, d, "embeddings").agg(
        F.max(F.size("embedding")).alias("embedding_dimension"),
        F.lit("normalization-v1").alias("normalization_version"),
        F.concat(F.lit("model-"), F.count(F.lit(1)).cast("string")).alias("embedding_model"),
    )
    return quality.manifest_violations(
        manifest,
        {
            "embedding_dimension": 384,
            "normalization_version": "normalization-v1",
            "embedding_model": MatchingPolicy().model_name,
        },
    )


@query("read_sensitive_locations")
def q_read_places(spark, d):
    docs = fx.sensitive_locations(spark, d).select(
        F.to_json(
            F.array(F.struct(F.col("place_id").alias("id"), "kind", "latitude", "longitude"))
        ).alias("document")
    )
    places = documents.parse_places(docs)
    return places.select(
        "place_id", "kind", r6("latitude").alias("latitude"), r6("longitude").alias("longitude")
    )


def _labelled_pairs(spark, d) -> DataFrame:
    """Candidate pairs as a labelled benchmark: same anchor means match, even left ids calibrate."""
    flow = automated(spark, d)
    anchor = fx.anchors(spark, d)
    left = anchor.toDF("left_id", "left_anchor")
    right = anchor.toDF("right_id", "right_anchor")
    label = F.when(F.col("left_anchor") == F.col("right_anchor"), F.lit("match")).otherwise(
        F.lit("non_match")
    )
    return cut_lineage(
        flow.scored.join(left, "left_id")
        .join(right, "right_id")
        .select(
            F.concat_ws(":", "left_id", "right_id").alias("pair_id"),
            "left_id",
            "right_id",
            "left_category",
            "right_category",
            "distance_metres",
            "time_gap_seconds",
            "semantic_similarity",
            "location",
            # rounding makes equal scores equal in every engine
            r6("semantic_similarity").alias("score"),
            label.alias("label"),
            F.when(tail("left_id") % 2 == 0, F.lit("calibration"))
            .otherwise(F.lit("holdout"))
            .alias("split"),
            F.when(tail("right_id") % 3 == 0, F.lit("clear"))
            .otherwise(F.lit("ambiguous"))
            .alias("positive_type"),
        )
    )


@query("join_benchmark_pairs")
def q_join_benchmark(spark, d):
    pairs = automated(spark, d).pairs.select(
        F.concat_ws(":", "left_id", "right_id").alias("id"), "left_id", "right_id"
    )
    l, r = tail("left_id"), tail("right_id")
    texts = pairs.filter(l % 13 != 0).select(
        "id", F.when(l % 11 == 0, F.lit("match")).alias("incident_expected")
    )
    metadata = pairs.filter(r % 17 != 0).select(
        "id",
        F.when(r % 2 == 0, F.lit("match")).otherwise(F.lit("non_match")).alias("incident_expected"),
    )
    ok, bad = evaluation.join_benchmark_pairs(texts, metadata)
    return bad.unionByName(ok.select("id", F.lit("joined").alias("violation")))


def _store(spark) -> SnapshotStore:
    return SnapshotStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")


@query("publish_snapshot")
def q_publish(spark, d):
    flow = automated(spark, d)
    named = incidents.incident_ids(flow.members)
    store = _store(spark)
    store.publish(
        replaced={
            "incidents": named.select("incident_id", "report_count"),
            "incident_members": incidents.incident_members(flow.members, named),
        }
    )
    return store.read("incident_members").join(store.read("incidents"), "incident_id").select(
        "incident_id", "id", "report_count"
    )


def _damaged_members(spark, d) -> DataFrame:
    own = fx.reports(spark, d).select("id", F.col("id").alias("component"))
    n = tail("id")
    kept = own.filter(n % 19 != 0)
    repeated = own.filter(n % 23 == 0).withColumn("component", F.lit("elsewhere"))
    strangers = own.filter(n % 29 == 0).withColumn("id", F.concat(F.lit("x"), F.col("id")))
    return kept.unionByName(repeated).unionByName(strangers)


@query("check_coverage")
def q_check_coverage(spark, d):
    return quality.check_coverage(_damaged_members(spark, d), fx.reports(spark, d).select("id"))


@query("check_edges")
def q_check_edges(spark, d):
    """Edges between reports 3 apart, with self loops, strangers and contradictions mixed in."""
    n = tail("id")
    base = fx.reports(spark, d).select("id", n.alias("n"))
    other = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad((F.col("n") + 3).cast("string"), 12, "0"))
    edges = base.select(
        F.col("id").alias("left_id"),
        F.when(F.col("n") % 31 == 0, F.col("id")).otherwise(other).alias("right_id"),
        F.lit("auto_match").alias("decision"),
        "n",
    )
    reverse = edges.filter(F.col("n") % 37 == 0).select(
        F.col("right_id").alias("left_id"),
        F.col("left_id").alias("right_id"),
        F.lit("no_match").alias("decision"),
    )
    return quality.check_edges(edges.drop("n").unionByName(reverse), base.select("id"))


@query("check_embeddings")
def q_check_embeddings(spark, d):
    emb = fx.table(spark, d, "embeddings")
    m = F.col("vec_id")
    broken = emb.filter(m % 19 != 0).select(
        m.alias("id"),
        F.when(m % 23 == 0, F.array().cast("array<float>"))
        .when(m % 29 == 0, F.slice("embedding", 1, 63))
        .when(m % 31 == 0, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float")))
        .otherwise(F.col("embedding"))
        .alias("vector"),
    )
    known = emb.filter(m % 37 != 0).select(m.alias("id"))
    return quality.check_embeddings(broken, known, 64)


@query("photo_manifest")
def q_photo_manifest(spark, d):
    """Photo bytes derived per report: JPEG, PNG, GIF and oversized JPEG content."""
    e = F.col("event_id")
    body = F.encode("text", "UTF-8")
    magic = lambda x: F.unhex(F.lit(x))
    files = fx.reports(spark, d).select(
        F.concat(F.lit("photo-"), e.cast("string")).alias("path"),
        F.when(
            e % 997 == 0,
            F.concat(magic("FFD8FF"), F.encode(F.repeat(F.lit("x"), 8 * 1024 * 1024), "UTF-8")),
        )
        .when(e % 3 == 0, F.concat(magic("FFD8FF"), body))
        .when(e % 3 == 1, F.concat(magic("89504E470D0A1A0A"), body))
        .otherwise(F.concat(F.encode(F.lit("GIF89a"), "UTF-8"), body))
        .alias("content"),
    )
    return photos.classify_photos(files)


@query("photo_url")
def q_photo_url(spark, d):
    e = F.col("event_id")
    v4 = F.concat(
        F.lit("00000000-0000-4000-8000-"), F.lpad(e.cast("string"), 12, "0")
    )
    path = (
        F.when(e % 5 == 0, F.concat(F.lit("uploads/"), v4, F.lit(".jpg")))
        .when(e % 5 == 1, F.concat(F.lit("uploads/"), v4, F.lit(".gif")))
        .when(e % 5 == 2, F.concat(F.lit("uploads/"), F.col("id"), F.lit(".png")))
        .when(e % 5 == 3, F.lit("photo.jpg"))
    )
    return fx.reports(spark, d).select("id", read_models.photo_url(path).alias("photo_url"))


@query("read_complaints")
def q_read_complaints(spark, d):
    return read_complaints(fx.complaints(spark, d, with_locations=False), ordered=True).select(
        "id", "normalized_text", "category", us("reported_at").alias("reported_us")
    )


@query("table_health")
def q_table_health(spark, d):
    flow = automated(spark, d)
    named = incidents.incident_ids(flow.members)
    return quality.table_health(flow.complaints, named, policy_ok=True).select(
        "complaint_count", "incident_count", "data_state", "policy_state", "photo_state",
        "core_ready", "status",
    )


@query("append_tables")
def q_append(spark, d):
    base = fx.reports(spark, d).select("id", "text", "category")
    late = tail("id") % 5 == 0
    store = _store(spark)
    store.publish(replaced={"complaints": base.filter(~late)})
    store.publish(appended={"complaints": base.filter(late)})
    return store.read("complaints")


# --- intake -----------------------------------------------------------------------------------

NOW = "2024-06-01 00:00:00"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


@query("validate_complaints")
def q_validate(spark, d):
    checked = intake.validate_complaints(fx.raw_reports(spark, d), _now())
    return checked.select("id", "text", joined("rejections").alias("rejections"))


@query("to_utc")
def q_to_utc(spark, d):
    """Report times rewritten as local text with and without offsets."""
    e = F.col("event_id")
    local = lambda h: F.date_format(
        F.col("reported_at") + F.expr(f"interval {h} hours"), "yyyy-MM-dd'T'HH:mm:ss"
    )
    written = (
        F.when(e % 4 == 0, F.concat(local(8), F.lit("+08:00")))
        .when(e % 4 == 1, F.concat(local(-3), F.lit("-03:00")))
        .when(e % 4 == 2, F.concat(local(0), F.lit("Z")))
        .otherwise(local(0))
    )
    return fx.reports(spark, d).select(
        "id", us(intake.to_utc(written)).alias("utc_us")
    )


@query("resolve_category")
def q_resolve_category(spark, d):
    """A third of the reports name no category and take the predicted one."""
    raw = fx.reports(spark, d).withColumn(
        "category", F.when(F.col("event_id") % 3 != 0, F.col("category"))
    )
    return intake.to_complaints(raw).select(
        "id", "category", joined("matched_terms").alias("matched_terms")
    )


def _submissions(spark, d) -> DataFrame:
    subs = fx.submissions(spark, d).withColumn(
        "normalized_text", text.normalize_text(F.col("text"))
    )
    return intake.with_fingerprint(subs)


@query("request_fingerprint")
def q_fingerprint(spark, d):
    """How many commands carry the same content, and how many keys each content has."""
    return (
        _submissions(spark, d)
        .groupBy("request_fingerprint")
        .agg(
            F.min("sequence").alias("first_sequence"),
            F.count(F.lit(1)).alias("command_count"),
            F.count_distinct("idempotency_key").alias("key_count"),
        )
        .drop("request_fingerprint")
    )


# --- text -------------------------------------------------------------------------------------


@query("read_aliases")
def q_aliases(spark, d):
    """Reports normalised with an alias file read back from the shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/aliases-{uuid.uuid4().hex}"
    payload = json.dumps({"version": NORMALIZATION_VERSION, "aliases": text.ALIASES})
    spark.createDataFrame([(payload,)], "document string").coalesce(1).write.text(path)
    aliases = documents.read_aliases(spark, path)
    return fx.reports(spark, d).select(
        "id", text.normalize_text(F.col("text"), aliases).alias("normalized_text")
    )


@query("normalize_text")
def q_normalize(spark, d):
    return fx.complaints(spark, d, with_locations=False).select("id", "normalized_text")


@query("normalize_documents")
def q_normalize_documents(spark, d):
    """Whole multilingual documents, including non-ASCII ones."""
    return fx.table(spark, d, "documents").select(
        "doc_id", text.normalize_text(F.col("text")).alias("normalized_text")
    )


@query("classify_category")
def q_classify(spark, d):
    c = fx.complaints(spark, d, with_locations=False)
    p = text.classify_category(F.col("normalized_text"))
    return c.withColumn("p", p).select(
        "id",
        "p.category",
        joined("p.matched_terms").alias("matched_terms"),
        "p.review_required",
    )


@query("extract_locations")
def q_extract(spark, d):
    c = fx.complaints(spark, d)
    # outer, then filter: keeps the optimizer from evaluating the extraction twice
    mentions = c.select("id", F.posexplode_outer("locations").alias("position", "e"))
    return mentions.filter(F.col("e").isNotNull()).select(
        "id", "position", "e.kind", "e.value", "e.raw"
    )


@query("compare_locations")
def q_compare(spark, d):
    flow = automated(spark, d)
    pairs = matching.attach_evidence(flow.pairs, matching.evidence_table(flow.complaints))
    c = locations.compare_location_sets(F.col("left.places"), F.col("right.places"))
    return pairs.withColumn("c", c).select("left_id", "right_id", "c.compatibility", "c.reason")


@query("term_hits")
def q_term_hits(spark, d):
    c = fx.complaints(spark, d, with_locations=False)
    terms = [t for s, ts in text.SAFETY_TERMS.items() if s != "active_flooding" for t in ts]
    return c.select("id", joined(text.term_hits(F.col("normalized_text"), terms)).alias("hits"))


@query("active_flooding_hits")
def q_flood_hits(spark, d):
    c = fx.complaints(spark, d, with_locations=False)
    return c.select("id", joined(text.active_flooding_hits(F.col("normalized_text"))).alias("hits"))


@query("uuid5")
def q_uuid5(spark, d):
    return fx.reports(spark, d).select("id", ids.uuid5(F.col("text")).alias("text_uuid"))


# --- maths ------------------------------------------------------------------------------------


@query("haversine_metres")
def q_haversine(spark, d):
    """Distance of each raw report from a fixed point; invalid coordinates give NULL."""
    raw = fx.raw_reports(spark, d)
    metres = geo.haversine_metres(
        F.col("latitude"), F.col("longitude"), F.lit(3.1), F.lit(101.5)
    )
    return raw.select("id", F.round(metres, 4).alias("metres"))


def _reference_time() -> Column:
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


@query("temporal_gap_seconds")
def q_gap(spark, d):
    gap = geo.temporal_gap_seconds(F.col("reported_at"), _reference_time())
    return fx.reports(spark, d).select("id", r6(gap).alias("gap_seconds"))


@query("within_time_window")
def q_window(spark, d):
    inside = geo.within_time_window(F.col("reported_at"), _reference_time(), 7)
    return fx.reports(spark, d).select("id", inside.alias("inside"))


@query("cosine_similarity")
def q_cosine(spark, d):
    """Each stored vector against the next one by id."""
    emb = fx.table(spark, d, "embeddings").select("vec_id", "embedding")
    n = emb.agg(F.count(F.lit(1))).scalar()
    left = emb.withColumn("next_id", (F.col("vec_id") + 1) % n)
    right = emb.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("other"))
    cos = vectors.cosine_similarity(F.col("embedding"), F.col("other"))
    return left.join(right, "next_id").select("vec_id", r6(cos).alias("cosine"))


@query("quantize_cell")
def q_quantize(spark, d):
    r = fx.reports(spark, d)
    return r.select(
        "id",
        geo.quantize_cell(F.col("latitude") - 3.2).alias("cell_lat"),
        geo.quantize_cell(F.col("longitude")).alias("cell_lon"),
    )


@query("radius_ring")
def q_ring(spark, d):
    """Outlines of raw reports with radius 0, positive and negative by id."""
    raw = fx.raw_reports(spark, d).withColumn(
        "radius", F.when(F.col("event_id") % 9 == 0, F.lit(0.0)).otherwise(
            (F.col("event_id") % 8 - 1) * 100.0
        )
    )
    ring = geo.radius_ring(F.col("latitude"), F.col("longitude"), F.col("radius"))
    out = raw.select("id", F.posexplode_outer(ring).alias("vertex", "p"))
    return out.filter(F.col("p").isNotNull()).select("id", "vertex", r6("p.lon").alias("lon"), r6("p.lat").alias("lat"))


@query("evidence_projection")
def q_projection(spark, d):
    flow = reviewed(spark, d)
    points = spatial.evidence_points(read_models.review_read(flow.reviews, flow.complaints))
    return points.select("review_id", *[r6(c).alias(c) for c in ("xa", "ya", "xb", "yb")])


# --- pairs ------------------------------------------------------------------------------------


@query("candidate_pairs")
def q_pairs(spark, d):
    return candidates.candidate_pairs(fx.reports(spark, d)).select(
        "left_id",
        "right_id",
        F.round("distance_metres", 4).alias("distance_metres"),
        r6("time_gap_seconds").alias("time_gap_seconds"),
    )


@query("score_pairs")
def q_score(spark, d):
    return automated(spark, d).scored.select(
        "left_id", "right_id", r6("semantic_similarity").alias("semantic_similarity")
    )


@query("match_pairs")
def q_match(spark, d):
    flow = automated(spark, d)
    return matching.match_pairs(flow.scored, flow.policies.matching).select(
        "left_id",
        "right_id",
        "decision",
        "category_compatible",
        F.col("location.compatibility").alias("location_compatibility"),
        big(F.size("reasons")).alias("reason_count"),
        F.element_at("reasons", -1).alias("last_reason"),
    )


@query("apply_overrides")
def q_overrides(spark, d):
    return reviewed(spark, d).edges.select(
        "left_id",
        "right_id",
        "automated_decision",
        "decision",
        "decision_source",
        "matcher_recommendation",
    )


@query("review_read")
def q_review_read(spark, d):
    flow = reviewed(spark, d)
    return read_models.review_read(flow.reviews, flow.complaints).select(
        "review_id", "status", "left_text", "right_text", "left_category", "right_category"
    )


@query("incident_evidence")
def q_evidence(spark, d):
    flow = reviewed(spark, d)
    named = incidents.incident_ids(flow.members)
    rows = read_models.incident_evidence(named, flow.members, flow.complaints)
    return rows.select(
        "incident_id", "complaint_id", "text", "category", "photo_available", "photo_url",
        us("reported_at").alias("reported_us"),
    )


@query("sensitive_exposure")
def q_exposure(spark, d):
    flow = reviewed(spark, d)
    return priority.sensitive_exposure(flow.complaints, flow.members, flow.places)


@query("submission_lookup")
def q_submission_lookup(spark, d):
    keys = (
        fx.submissions(spark, d)
        .groupBy("idempotency_key")
        .agg(F.min_by("complaint_id", "sequence").alias("complaint_id"))
    )
    found = read_models.submission_lookup(keys, fx.complaints(spark, d, with_locations=False))
    return found.select("idempotency_key", "complaint_id", "normalized_text", "category")


def _seed_inputs(spark, d):
    """Seed keys, and resolutions over candidate pairs with every kind of mistake mixed in."""
    flow = automated(spark, d)
    keys = flow.complaints.select(
        F.concat(F.lit("seed-"), tail("id").cast("string")).alias("seed_key"), "id"
    )
    seed = lambda c: F.concat(F.lit("seed-"), tail(c).cast("string"))
    n = tail("left_id") + tail("right_id")
    base = flow.matched.select("left_id", "right_id", "decision", n.alias("n"))
    chosen = base.filter((F.col("n") % 12 == 1) | (F.col("n") % 12 == 2))
    state = (
        F.when(F.col("n") % 84 == 1, F.lit("review_required"))
        .when(F.col("n") % 12 == 1, F.lit("auto_match"))
        .otherwise(F.lit("no_match"))
    )
    right = (
        F.when(F.col("n") % 60 == 1, F.lit("seed-unknown"))
        .when(F.col("n") % 60 == 2, seed("left_id"))
        .otherwise(seed("right_id"))
    )
    resolutions = chosen.select(
        seed("left_id").alias("left_seed_key"),
        right.alias("right_seed_key"),
        state.alias("final_state"),
        F.lit("officer-1").alias("reviewer_id"),
        F.lit(None).cast("string").alias("note"),
    )
    swapped = chosen.filter(F.col("n") % 36 == 1).select(
        seed("right_id").alias("left_seed_key"),
        seed("left_id").alias("right_seed_key"),
        F.lit("auto_match").alias("final_state"),
        F.lit("officer-2").alias("reviewer_id"),
        F.lit(None).cast("string").alias("note"),
    )
    review_edges = flow.matched.filter(F.col("decision") == "review_required")
    return resolutions, resolutions.unionByName(swapped), keys, review_edges, flow


@query("seed_resolution_violations")
def q_seed_violations(spark, d):
    _, dirty, keys, edges, _ = _seed_inputs(spark, d)
    _, violations = reviews.seed_resolutions(dirty, keys, edges, _now())
    return violations.groupBy("violation", "left_seed_key", "right_seed_key").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("seed_resolutions")
def q_seed_resolutions(spark, d):
    """Clean resolutions only: those the violation report does not name."""
    clean, _, keys, edges, _ = _seed_inputs(spark, d)
    _, violations = reviews.seed_resolutions(clean, keys, edges, _now())
    named = violations.select("left_seed_key", "right_seed_key").distinct()
    clean = clean.join(named, ["left_seed_key", "right_seed_key"], "left_anti")
    records, _ = reviews.seed_resolutions(clean, keys, edges, _now())
    return records.select(
        "review_id", "left_id", "right_id", "status", "final_relationship_state", "reviewed_by",
        "decision_source", big("version").alias("version"),
    )


def _touched(spark, d) -> DataFrame:
    return fx.reports(spark, d).select("id").filter(tail("id") % 97 == 0)


@query("affected_incidents")
def q_affected(spark, d):
    flow = automated(spark, d)
    named = incidents.incident_ids(flow.members)
    return sets.affected_incidents(
        incidents.incident_members(flow.members, named), _touched(spark, d)
    )


def _after_deletion(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    flow = reviewed(spark, d)
    keys = fx.submissions(spark, d).select("idempotency_key", "complaint_id").distinct()
    return sets.cascade_delete(
        {
            "complaints": flow.complaints.select("id"),
            "embeddings": flow.vectors.select("id"),
            "incident_members": flow.members.select("id"),
            "match_edges": flow.edges.select("left_id", "right_id"),
            "submission_keys": keys,
            "reviews": flow.reviews.select("left_id", "right_id"),
        },
        _touched(spark, d),
    )


@query("cascade_delete")
def q_cascade(spark, d):
    out = None
    for name, df in _after_deletion(spark, d).items():
        row = df.agg(F.count(F.lit(1)).alias("rows_left")).select(
            F.lit(name).alias("table_name"), "rows_left"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("cascade_delete_rows")
def q_cascade_rows(spark, d):
    """The rows themselves that a deletion leaves in every table."""
    out = None
    for name, df in _after_deletion(spark, d).items():
        pair = "left_id" in df.columns
        first = "left_id" if pair else "complaint_id" if "complaint_id" in df.columns else "id"
        more = F.col("right_id") if pair else F.col("idempotency_key") if "idempotency_key" in df.columns else F.lit("")
        rows = df.select(F.lit(name).alias("table_name"), F.col(first).alias("id"), more.alias("more"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("attach_photos")
def q_attach_photos(spark, d):
    e = F.col("event_id")
    raw = fx.reports(spark, d).select(
        "id",
        F.when(e % 2 == 0, F.concat(F.lit("photo-"), (e % 50).cast("string"))).alias("photo_id"),
        F.when(e % 2 == 1, F.lit("photo.jpg")).alias("photo_path"),
    )
    manifest = (
        fx.reports(spark, d)
        .select((e % 50).alias("p"))
        .distinct()
        .filter(F.col("p") % 8 != 0)
        .select(
            F.concat(F.lit("photo-"), F.col("p").cast("string")).alias("photo_id"),
            F.concat(F.lit("stored-"), F.col("p").cast("string"), F.lit(".png")).alias("stored_name"),
        )
    )
    ok, unknown = photos.attach_photos(raw, manifest)
    return ok.select("id", "photo_path", F.lit("attached").alias("outcome")).unionByName(
        unknown.select("id", "photo_path", F.lit("unknown_photo").alias("outcome"))
    )


# --- graph and incidents ----------------------------------------------------------------------


@query("connected_components")
def q_components(spark, d):
    """Copies collapse before pairing; no list of confirmed pairs is made."""
    flow = automated(spark, d)
    return collapse.collapsed_components(flow.complaints, flow.vectors)


@query("connected_components_reviewed")
def q_components_reviewed(spark, d):
    return reviewed(spark, d).members


@query("connected_components_collapsed_reviewed")
def q_components_collapsed_reviewed(spark, d):
    flow = reviewed(spark, d)
    return collapse.collapsed_components(
        flow.complaints, flow.vectors, reviews=cut_lineage(flow.reviews)
    )


@query("incident_summary")
def q_incident_summary(spark, d):
    rows = reviewed(spark, d).incidents
    return rows.select(
        "incident_id",
        "report_count",
        r6("centroid_latitude").alias("centroid_latitude"),
        r6("centroid_longitude").alias("centroid_longitude"),
        F.round("radius_metres", 4).alias("radius_metres"),
        us("earliest_reported_at").alias("earliest_us"),
        us("latest_reported_at").alias("latest_us"),
        joined("category_summary").alias("category_summary"),
        "conflict_count",
        "pending_count",
        "status",
    )


@query("incident_id")
def q_incident_id(spark, d):
    return incidents.incident_ids(reviewed(spark, d).members)


@query("conflict_detection")
def q_conflicts(spark, d):
    flow = reviewed(spark, d)
    return incidents.conflicts(flow.edges, flow.members).select("component", "left_id", "right_id")


@query("conflict_counts_collapsed")
def q_conflict_counts(spark, d):
    """Contradictions per component of the automated and of the reviewed graph, found between nodes."""
    flow = reviewed(spark, d)
    before = CollapsedFlow(flow.complaints, flow.vectors)
    after = CollapsedFlow(flow.complaints, flow.vectors, None, cut_lineage(flow.reviews))
    rows = lambda f, name: f.conflict_counts.select(F.lit(name).alias("graph"), "component", "conflict_count")
    return rows(before, "automated").unionByName(rows(after, "reviewed"))


@query("confirmed_edges")
def q_confirmed_edges(spark, d):
    flow = reviewed(spark, d)
    return incidents.confirmed_edges(flow.edges, flow.members).select(
        "component", "left_id", "right_id", "decision_source"
    )


@query("review_candidates")
def q_review_candidates(spark, d):
    flow = reviewed(spark, d)
    return incidents.review_candidates(flow.edges, flow.members)


@query("dedupe_edges")
def q_dedupe(spark, d):
    """Every edge stored in both directions collapses to one."""
    edges = automated(spark, d).matched.select("left_id", "right_id", "decision")
    both = edges.unionByName(edges.toDF("right_id", "left_id", "decision"))
    return matching.dedupe_edges(both)


@query("graph_version")
def q_graph_version(spark, d):
    return incidents.graph_version(automated(spark, d).matched)


@query("safety_signals")
def q_safety(spark, d):
    flow = reviewed(spark, d)
    return priority.safety_signals(flow.complaints, flow.members).withColumn(
        "matched_terms", joined("matched_terms")
    )


@query("priority_signals")
def q_priority_signals(spark, d):
    """Text values with decimals are compared as numbers."""
    rows = priority.priority_signals(reviewed(spark, d).priority_inputs())
    return rows.select(
        "incident_id", "name", r6("normalized_value").alias("normalized_value"), "triggered"
    )


@query("assess_priority")
def q_assess(spark, d):
    return reviewed(spark, d).assessed().select(
        "incident_id",
        "priority_level",
        "priority_status",
        big("points").alias("points"),
        joined("triggered_rules").alias("triggered_rules"),
    )


@query("status_counts")
def q_status_counts(spark, d):
    flow = reviewed(spark, d)


    by_review = priority.counts_over_domain(flow.reviews, "status", REVIEW_STATUSES)
    by_level = priority.priority_counts(flow.assessed())
    tag = lambda df, name: df.select(F.lit(name).alias("domain"), "value", "count")
    return tag(by_review, "review").unionByName(tag(by_level, "priority"))


def _heat(df: DataFrame) -> DataFrame:
    return df.select("latitude", "longitude", "intensity", "dominant_category")


@query("heat_cells")
def q_heat(spark, d):
    return _heat(spatial.heat_cells(reviewed(spark, d).assessed()))


@query("heat_cells_category")
def q_heat_category(spark, d):
    return _heat(spatial.heat_cells(reviewed(spark, d).assessed(), category="flooding"))


# --- read models ------------------------------------------------------------------------------


@query("filter_incidents")
def q_filter_incidents(spark, d):
    rows = read_models.filter_incidents(
        reviewed(spark, d).assessed(), status="isolated", priority="critical", category="flooding"
    )
    return rows.select("incident_id", "status", "operational_priority")


@query("filter_reviews")
def q_filter_reviews(spark, d):
    return read_models.filter_reviews(reviewed(spark, d).reviews, "rejected").select(
        "review_id", "left_id", "right_id", "status"
    )


@query("incident_summary_view")
def q_summary_view(spark, d):
    rows = read_models.incident_summary_view(reviewed(spark, d).assessed())
    return rows.select(
        "incident_id", "status", "category_summary", "priority", "confirmed_report_count",
        "pending_candidate_count", "conflict_count",
    )


@query("hotspots")
def q_hotspots(spark, d):
    rows = read_models.hotspots(reviewed(spark, d).assessed())
    return rows.select(
        "incident_id",
        r6("latitude").alias("latitude"),
        r6("longitude").alias("longitude"),
        "confirmed_reports",
        "pending_candidates",
        "priority",
    )


@query("review_view")
def q_review_view(spark, d):
    return read_models.review_view(reviewed(spark, d).reviews)


@query("affected_areas")
def q_areas(spark, d):
    areas = spatial.affected_areas(reviewed(spark, d).incidents)
    return areas.select(
        "incident_id", "geometry_type", big(F.size("ring")).alias("vertex_count")
    )


@query("incident_queue")
def q_queue(spark, d):
    page = read_models.incident_queue(reviewed(spark, d).assessed(), limit=100, offset=10)
    return page.select(
        "incident_id", "operational_priority", us("latest_reported_at").alias("latest_us"),
        "total",
    )


def _without_pairs(spark: SparkSession, d: str) -> CollapsedFlow:
    flow = automated(spark, d)
    return CollapsedFlow(flow.complaints, flow.vectors, flow.places)


@query("incident_queue_collapsed")
def q_queue_collapsed(spark, d):
    """The ranked queue before officer decisions; no table of pairs is made on the way."""
    page = read_models.incident_queue(_without_pairs(spark, d).assessed(), limit=100, offset=10)
    return page.select(
        "incident_id", "operational_priority", us("latest_reported_at").alias("latest_us"),
        "total",
    )


@query("heat_cells_collapsed")
def q_heat_collapsed(spark, d):
    return _heat(spatial.heat_cells(_without_pairs(spark, d).assessed()))


@query("review_queue")
def q_review_queue(spark, d):
    page = read_models.review_queue(reviewed(spark, d).reviews, limit=100, offset=20)
    return page.select("review_id", "status", us("queue_time").alias("queue_us"), "total")


@query("review_queue_resolved")
def q_review_queue_resolved(spark, d):
    page = read_models.review_queue(reviewed(spark, d).reviews, status="approved", limit=50)
    return page.select("review_id", "status", us("queue_time").alias("queue_us"), "total")


@query("evidence_preview")
def q_preview(spark, d):
    flow = reviewed(spark, d)
    named = incidents.incident_ids(flow.members)
    rows = read_models.evidence_preview(named, flow.members, flow.complaints)
    return rows.select(
        "incident_id", "complaint_id", big("position").alias("position"), "text", "total",
        "has_more",
    )


@query("deterministic_order")
def q_order(spark, d):
    flow = reviewed(spark, d)
    return sets.ordered_incidents(incidents.incident_ids(flow.members)).select(
        "component", "incident_id"
    )


# --- sets -------------------------------------------------------------------------------------


@query("union_new")
def q_union_new(spark, d):
    rows = fx.reports(spark, d).select("id", "text", "category")
    n = tail("id")
    stored = rows.filter(n % 3 != 0)
    incoming = rows.filter(n % 2 == 0).withColumn("text", F.concat(F.col("text"), F.lit(" again")))
    return sets.union_new(stored, incoming)


def _two_snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    """Membership before and after officer decisions."""
    flow = reviewed(spark, d)
    before = cut_lineage(graph.confirmed_components(flow.complaints, flow.matched))
    table = lambda m: incidents.incident_members(m, incidents.incident_ids(m))
    return table(before), table(flow.members)


@query("snapshot_changes")
def q_snapshot_changes(spark, d):
    return sets.snapshot_changes(*_two_snapshots(spark, d))


@query("snapshot_transition")
def q_snapshot_transition(spark, d):
    return sets.snapshot_transition(*_two_snapshots(spark, d))


@query("id_set_equality")
def q_id_sets(spark, d):
    n = tail("id")
    rows = fx.reports(spark, d).select("id")
    return quality.id_set_difference(rows.filter(n % 41 != 0), rows.filter(n % 43 != 0))


# --- evaluation and metrics -------------------------------------------------------------------


def _samples(spark, d) -> DataFrame:
    return fx.table(spark, d, "events").select(F.col("event_type").alias("metric"), "value")


@query("metric_summary")
def q_metric_summary(spark, d):
    return metrics.metric_summary(_samples(spark, d))


def _named_summaries(spark, d) -> DataFrame:
    """Event values read as samples of the budgeted metrics."""
    names = [*metrics.METRIC_LIMITS, *[p for ps in metrics.COMPOSED_GATES.values() for p in ps]]
    name = F.element_at(
        F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int")
    )
    return metrics.metric_summary(
        fx.table(spark, d, "events").select(name.alias("metric"), "value")
    )


@query("budget_evaluation")
def q_budget(spark, d):
    return metrics.evaluate_budget(_named_summaries(spark, d), 7.5)


@query("budget_passed")
def q_budget_passed(spark, d):
    return metrics.budget_passed(metrics.evaluate_budget(_named_summaries(spark, d), 7.5))


@query("startup_profile")
def q_startup(spark, d):
    spans = [*metrics.APPLICATION_SPANS, *metrics.MODEL_SPANS, "warm_up"]
    span = F.element_at(
        F.array(*[F.lit(s) for s in spans]), (F.col("event_id") % len(spans) + 1).cast("int")
    )
    rows = fx.table(spark, d, "events").select(
        F.col("user_id").alias("run"), span.alias("span"), F.col("value").alias("seconds")
    )
    out = metrics.startup_profile(rows)
    return out.select(
        "run",
        F.round("application_seconds", 4).alias("application_seconds"),
        F.round("cold_model_seconds", 4).alias("cold_model_seconds"),
    )


@query("rss_growth")
def q_rss(spark, d):
    rows = fx.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("ready_rss_mb"),
        (F.col("value") + F.col("event_id") % 7).alias("post_rss_mb"),
    )
    out = metrics.rss_growth(rows)
    return out.select(
        "event_id",
        F.round("growth_mb", 4).alias("growth_mb"),
        F.round("growth_percent", 4).alias("growth_percent"),
    )


@query("best_threshold")
def q_best_threshold(spark, d):
    best = evaluation.best_threshold(_labelled_pairs(spark, d))
    return best.select(
        F.round("threshold", 7).alias("threshold"), "false_merges", "false_splits",
        r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
    )


@query("threshold_candidates")
def q_threshold_candidates(spark, d):
    rows = evaluation.threshold_candidates(_labelled_pairs(spark, d))
    return rows.select(
        F.round("threshold", 7).alias("threshold"), "false_merges", "false_splits",
        r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
    )


@query("similarity_distribution")
def q_distribution(spark, d):
    rows = evaluation.similarity_distribution(_labelled_pairs(spark, d))
    return rows.select(
        "label", "pair_count", "min_score", r6("mean_score").alias("mean_score"), "max_score"
    )


@query("hardest_pairs")
def q_hardest(spark, d):
    rows = evaluation.hardest_pairs(_labelled_pairs(spark, d))
    return rows.select("label", "pair_id", "score", big("position").alias("position"))


@query("holdout_report")
def q_holdout(spark, d):
    labelled = _labelled_pairs(spark, d)
    policy = evaluation.calibrated_policy(labelled, MatchingPolicy())
    decided = matching.match_pairs(labelled, policy).withColumn(
        "incident_expected", F.col("label")
    )
    report = evaluation.holdout_report(decided)
    return report.withColumn("clear_positive_auto_rate", r6("clear_positive_auto_rate"))


# --- commands ---------------------------------------------------------------------------------


@query("idempotent_submissions")
def q_idempotent(spark, d):
    return intake.idempotent_outcomes(_submissions(spark, d))


@query("upsert_reviews")
def q_upsert(spark, d):
    """A later run recreates all but a seventh of the reviews; a third had not been stored."""
    flow = reviewed(spark, d)
    n = tail("left_id") + tail("right_id")
    stored = flow.reviews.filter(n % 3 != 0)
    incoming = reviews.new_reviews(
        flow.matched.filter(n % 7 != 0), _now(), F.lit("graph-2")
    ).withColumn("matcher_reasons", F.lit("refreshed"))
    merged = reviews.upsert_reviews(stored, incoming)
    return merged.select(
        "review_id",
        "status",
        (F.col("matcher_reasons") == "refreshed").alias("refreshed"),
        "graph_version_at_creation",
        us("created_at").alias("created_us"),
        big("version").alias("version"),
    )


def _resolution_commands(flow: Flow) -> DataFrame:
    n = tail("left_id") + tail("right_id")
    base = flow.reviews.select("review_id", n.alias("n"), tail("left_id").alias("l"))
    first = base.select(
        F.when(F.col("n") % 41 == 0, F.concat(F.lit("missing-"), F.col("review_id")))
        .otherwise(F.col("review_id"))
        .alias("review_id"),
        (F.col("n") % 2 == 0).alias("approve"),
        F.lit(1).cast("bigint").alias("sequence"),
    )
    second = base.filter(F.col("n") % 5 == 0).select(
        "review_id", F.lit(True).alias("approve"), F.lit(2).cast("bigint").alias("sequence")
    )
    return first.unionByName(second).select(
        "*",
        F.lit("officer-9").alias("reviewer_id"),
        F.lit(None).cast("string").alias("note"),
        _now().alias("resolved_at"),
    )


def _current_graph() -> Column:
    return F.when(tail("left_id") % 6 == 0, F.lit("graph-0")).otherwise(F.lit("graph-1"))


@query("resolve_reviews")
def q_resolve(spark, d):
    """Outcomes of officer commands; a sixth of the reviews was created against another graph."""
    flow = reviewed(spark, d)
    current = flow.reviews.withColumn("graph_version_at_creation", _current_graph())
    out = reviews.resolution_outcomes(_resolution_commands(flow), current, F.lit("graph-1"))
    return out.select(
        "review_id", "sequence", "outcome", "final_relationship_state",
        big("version").alias("version"),
    )


@query("resolved_reviews")
def q_resolved(spark, d):
    flow = reviewed(spark, d)
    current = flow.reviews.withColumn("graph_version_at_creation", _current_graph())
    out = reviews.resolution_outcomes(_resolution_commands(flow), current, F.lit("graph-1"))
    return reviews.apply_resolutions(current, out).select(
        "review_id", "status", "reviewed_by", "final_relationship_state",
        big("version").alias("version"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import command_queries  # noqa: F401  (registers the command and streaming queries)

    return dict(REGISTRY)



