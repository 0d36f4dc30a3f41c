"""Registered queries of the command side: imports, incremental clustering, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import intake, read_models, reviews
from ..operators.layout import Layout
from ..policy import MatchingPolicy, Policies
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import documents
from ..sources import fixtures as fx
from ..streaming import embed, published
from ..streaming.cluster import cluster_stream
from ..streaming.intake import submission_stream, validate_stream
from ..streaming.ledger import Ledger
from ..streaming.live import delete_and_publish, incident_members, load_state, publish_state, resolve_and_publish, submit_stream
from . import incremental
from .flow import Flow
from .import_dataset import import_dataset, seed_checksum
from .incremental import ClusterState
from .queries import _heat as heat_columns
from .queries import _now, _store, automated, big, joined, query, reviewed, tail, us


#: These ledgers are small: few folders, so that files hold more than a handful of rows.
LAYOUT = Layout(bucket_days=28.0, zones=2, shards=2)


def _late(column) -> Column:
    return tail(column) % 10 == 0


def _history_and_fresh(spark, d) -> tuple[ClusterState, DataFrame, DataFrame]:
    """Every tenth report arrives later than the others."""
    complaints, vectors = cut_lineage(fx.complaints(spark, d)), fx.vectors(spark, d)
    old = Flow(complaints.filter(~_late("id")), vectors.filter(~_late("id")))
    state = ClusterState(old.complaints, old.vectors, old.matched, old.members)
    return state, complaints.filter(_late("id")), vectors.filter(_late("id"))


@query("incremental_cluster")
def q_incremental(spark, d):
    """History plus late reports; must equal clustering everything at once."""
    state, fresh, vectors = _history_and_fresh(spark, d)
    return incremental.add_reports(state, fresh, vectors).state.members


@query("incremental_touched_incidents")
def q_touched(spark, d):
    state, fresh, vectors = _history_and_fresh(spark, d)
    rows = incremental.touched_incidents(incremental.add_reports(state, fresh, vectors))
    return rows.select(
        "incident_id", "report_count", "pending_count", "conflict_count", "status",
        joined("category_summary").alias("category_summary"),
    )


@query("submission_result")
def q_submission_result(spark, d):
    state, fresh, vectors = _history_and_fresh(spark, d)
    step = incremental.add_reports(state, fresh, vectors)
    now = fx.reports(spark, d).agg(F.max("reported_at")).scalar()
    return incremental.submission_results(
        state, step, fresh, fx.sensitive_locations(spark, d), now
    )


@query("incremental_review")
def q_incremental_review(spark, d):
    """Officer decisions merged into the automated clustering."""
    flow = reviewed(spark, d)
    state = ClusterState(flow.complaints, flow.vectors, flow.matched, flow.automated_members)
    after, _ = incremental.apply_review_decisions(state, flow.reviews)
    return after.members


@query("mutation_result_view")
def q_mutation_view(spark, d):
    """Presentation of each officer decision, taken together."""
    flow = reviewed(spark, d)
    before = ClusterState(flow.complaints, flow.vectors, flow.matched, flow.automated_members)
    after = ClusterState(flow.complaints, flow.vectors, flow.edges, flow.members)
    resolved = flow.reviews.filter(F.col("status") != "pending")
    results = incremental.mutation_results(before, after, resolved, flow.assessed())
    return read_models.mutation_result_view(results)


@query("import_dataset")
def q_import(spark, d):
    """Seed documents to a published snapshot, read back by seed key."""
    reports = fx.reports(spark, d)
    docs = reports.select(
        F.to_json(
            F.struct(
                F.struct(F.lit("v1").alias("seed_version")).alias("manifest"),
                F.array(
                    F.struct(
                        F.col("id").alias("seed_key"),
                        "text",
                        "latitude",
                        "longitude",
                        F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(
                            "reported_at"
                        ),
                        "category",
                        "photo_path",
                    )
                ).alias("complaints"),
            )
        ).alias("document")
    )
    vectors = fx.vectors(spark, d).withColumnRenamed("id", "seed_key")

    def vectors_of(complaints: DataFrame) -> DataFrame:
        return complaints.select("id", "seed_key").join(vectors, "seed_key").select("id", "vector")

    store = _store(spark)
    import_dataset(
        store,
        docs,
        vectors_of,
        fx.sensitive_locations(spark, d),
        Policies(),
        check_manifest=False,
    )
    members = incident_members(store)
    rows = store.read("incidents").select("incident_id", "report_count", "status", "priority_level")
    return (
        members.join(rows, "incident_id")
        .join(store.read("complaints").select("id", "seed_key"), "id")
        .select("seed_key", "report_count", "status", "priority_level")
    )


@query("import_with_resolutions")
def q_import_with_resolutions(spark, d):
    """Documents under one checked manifest, with officer resolutions; must equal the reviewed batch job."""
    reports, policies = fx.reports(spark, d), Policies()
    flow = automated(spark, d)
    decided = fx.reviews(flow.matched, flow.complaints).filter(F.col("status") != "pending")
    at = F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("reported_at")
    seed = F.struct(F.col("id").alias("seed_key"), "text", "latitude", "longitude", at, "category", "photo_path")
    resolution = F.struct(
        F.col("left_id").alias("left_seed_key"), F.col("right_id").alias("right_seed_key"), F.col("final_relationship_state").alias("final_state"),
        F.col("reviewed_by").alias("reviewer_id"), F.col("review_note").alias("note"),
    )
    parts = cut_lineage(
        reports.select(F.array(seed).alias("complaints")).unionByName(
            decided.select(F.array(resolution).alias("review_resolutions")), allowMissingColumns=True
        )
    )

    def under(**manifest) -> DataFrame:
        stated = F.struct(*[F.lit(v).alias(k) for k, v in manifest.items()]).alias("manifest")
        return parts.select(F.to_json(F.struct(stated, "complaints", "review_resolutions")).alias("document"))

    _, seeds, resolutions = documents.parse_seed(under(seed_version="v1"))
    docs = under(
        seed_version="v1", content_sha256=seed_checksum(seeds, resolutions), normalization_version=policies.matching.normalization_version,
        embedding_model=policies.matching.model_name, embedding_dimension=64, matching_policy_version=policies.matching.policy_version,
        priority_policy_version=policies.priority.policy_version,
    )
    vectors = fx.vectors(spark, d).withColumnRenamed("id", "seed_key")

    def vectors_of(complaints: DataFrame) -> DataFrame:
        return complaints.select("id", "seed_key").join(vectors, "seed_key").select("id", "vector")

    store = _store(spark)
    import_dataset(store, docs, vectors_of, fx.sensitive_locations(spark, d), policies)
    rows = store.read("incidents").select("incident_id", "report_count", "status", "priority_level")
    named = incident_members(store).join(store.read("complaints").select("id", "seed_key"), "id")
    return named.join(rows, "incident_id").select("seed_key", "report_count", "status", "priority_level")


@query("incremental_embed")
def q_embed(spark, d):
    """Distinct texts absent from a cache that holds the texts of every third report."""
    policy = MatchingPolicy()
    texts = fx.complaints(spark, d, with_locations=False).select(
        "id", F.col("normalized_text").alias("text")
    )
    cached = embed.incremental_embed(
        texts.filter(tail("id") % 3 == 0).select("text"),
        spark.createDataFrame([], "text_key string"),
        policy.model_name,
        policy.normalization_version,
    )
    fresh = embed.incremental_embed(
        texts.select("text"), cached, policy.model_name, policy.normalization_version
    )
    return fresh.select(
        "text_key", "model_version", F.size("vector").cast("bigint").alias("dimension")
    )


def _as_stream(spark, df: DataFrame, parts: int) -> DataFrame:
    """The rows as a file stream of ``parts`` micro-batches of several files each."""
    files = spark.sparkContext.defaultParallelism
    path = f"{ensure_checkpoint_dir(spark)}/stream-{_unique()}"
    df.repartition(files * parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _unique() -> str:
    import uuid

    return uuid.uuid4().hex


def _drain(spark, writer) -> None:
    path = f"{ensure_checkpoint_dir(spark)}/progress-{_unique()}"
    writer.option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()


@query("stream_validate")
def q_stream_validate(spark, d):
    store = _store(spark)
    stream = _as_stream(spark, fx.raw_reports(spark, d), 3)
    _drain(spark, validate_stream(stream, store, _now()))
    ok = store.read("accepted").select("id", "text", F.lit("").alias("rejections"))
    bad = store.read("quarantine").select("id", "text", joined("rejections").alias("rejections"))
    return ok.unionByName(bad)


@query("stream_submissions")
def q_stream_submissions(spark, d):
    """The command log cut into three consecutive batches."""
    subs = fx.submissions(spark, d).withColumn(
        "normalized_text", text.normalize_text(F.col("text"))
    )
    subs = cut_lineage(subs)
    path = f"{ensure_checkpoint_dir(spark)}/stream-{_unique()}"
    files = spark.sparkContext.defaultParallelism
    for part in range(3):
        rows = subs.filter(F.col("sequence") % 3 == part)
        rows.repartition(files).write.mode("append").parquet(path)
    stream = spark.readStream.schema(subs.schema).option("maxFilesPerTrigger", files).parquet(path)
    store = _store(spark)
    _drain(spark, submission_stream(stream, store))
    return store.read("outcomes")


@query("stream_cluster")
def q_stream_cluster(spark, d):
    """Reports arriving in two micro-batches; must equal clustering everything at once."""
    store = _store(spark)
    vectors = cut_lineage(fx.vectors(spark, d))
    stream = _as_stream(spark, fx.complaints(spark, d), 2)

    def vectors_of(complaints: DataFrame) -> DataFrame:
        return vectors.join(complaints.select("id"), "id", "left_semi")

    _drain(spark, cluster_stream(stream, store, vectors_of))
    return store.read("members")


def _stored_incidents(store) -> DataFrame:
    rows = store.read("incidents")
    return rows.select("component", "incident_id", big("report_count").alias("report_count"), "priority_level")


def _submissions(reports: DataFrame) -> DataFrame:
    """Raw reports as commands, each under a key of its own."""
    return reports.select(
        F.concat(F.lit("key-"), "id").alias("idempotency_key"), tail("id").alias("sequence"), F.col("id").alias("complaint_id"),
        "id", "text", "latitude", "longitude", "reported_at", "category", "photo_path",
        F.lit(None).cast("string").alias("photo_id"),
    )


def _vectors_of(vectors: DataFrame):
    return lambda complaints: vectors.join(complaints.select("id"), "id", "left_semi")


@query("stream_submit")
def q_stream_submit(spark, d):
    """Submissions in micro-batches, through to priorities; must equal the batch job on all of them."""
    store = _store(spark)
    vectors = cut_lineage(fx.vectors(spark, d))
    now = fx.reports(spark, d).agg(F.max("reported_at")).scalar()
    stream = _as_stream(spark, cut_lineage(_submissions(fx.reports(spark, d))), 3)
    _drain(spark, submit_stream(stream, store, _vectors_of(vectors), fx.sensitive_locations(spark, d), now, layout=LAYOUT))
    return _stored_incidents(store)


def _published(spark, flow: Flow) -> SnapshotStore:
    """A clustering as a published ledger; without officer decisions all its reviews are pending."""
    found = flow.reviews
    if found is None:
        found = reviews.new_reviews(flow.matched, flow.now, F.lit(None).cast("string"))
    state = ClusterState(flow.complaints, flow.vectors, flow.edges, flow.members, found)
    keys = intake.with_fingerprint(flow.complaints).select(
        F.col("id").alias("idempotency_key"), "request_fingerprint", F.col("id").alias("complaint_id")
    )
    store = _store(spark)
    publish_state(store, state, flow.assessed(), keys, layout=LAYOUT)
    return store


@query("live_submission_result")
def q_live_submission_result(spark, d):
    """Late reports submitted to the published ledger of all others: one stored result per report."""
    now = fx.reports(spark, d).agg(F.max("reported_at")).scalar()
    complaints, vectors = cut_lineage(fx.complaints(spark, d)), cut_lineage(fx.vectors(spark, d))
    places = fx.sensitive_locations(spark, d)
    store = _published(spark, Flow(complaints.filter(~_late("id")), vectors.filter(~_late("id")), places))
    late = cut_lineage(_submissions(fx.reports(spark, d).filter(_late("id"))))
    _drain(spark, submit_stream(_as_stream(spark, late, 1), store, _vectors_of(vectors), places, now, layout=LAYOUT))
    return store.read("results")


def _officer_commands(found: DataFrame) -> DataFrame:
    """The resolved ones of the given reviews as commands."""
    return found.filter(F.col("status") != "pending").select(
        F.xxhash64("review_id").alias("sequence"), "review_id",
        (F.col("final_relationship_state") == "auto_match").alias("approve"),
        F.col("reviewed_by").alias("reviewer_id"), F.col("review_note").alias("note"), "resolved_at",
    )


def _after_rounds(spark, d, rounds: int) -> SnapshotStore:
    """A published automated clustering after officer decisions in several publishes."""
    flow = automated(spark, d)
    commands = cut_lineage(_officer_commands(fx.reviews(flow.matched, flow.complaints)))
    store = _published(spark, flow)
    for part in range(rounds):
        some = commands.filter(F.pmod("sequence", F.lit(rounds)) == part)
        resolve_and_publish(store, some, fx.sensitive_locations(spark, d), flow.now)
    return store


@query("resolve_and_publish")
def q_resolve_and_publish(spark, d):
    """Officer decisions on a published automated clustering; must equal the reviewed batch job."""
    return _stored_incidents(_after_rounds(spark, d, 1))


@query("resolve_in_rounds")
def q_resolve_in_rounds(spark, d):
    """The same decisions in three publishes; each finds the reviews that the others left pending."""
    return _stored_incidents(_after_rounds(spark, d, 3))


@query("resolve_in_rounds_edges")
def q_resolve_in_rounds_edges(spark, d):
    """Decided pairs after three rounds: the matcher's own decision stays beside the officer's."""
    return load_state(_after_rounds(spark, d, 3)).edges.select(
        "left_id", "right_id", "automated_decision", "decision", "decision_source", "matcher_recommendation"
    )


@query("published_queue")
def q_published_queue(spark, d):
    """The ranked queue read from a published ledger, scored for a time given when reading."""
    flow = reviewed(spark, d)
    page = published.queue(_published(spark, flow), flow.now, limit=100, offset=10)
    return page.select("incident_id", "operational_priority", us("latest_reported_at").alias("latest_us"), "total")


@query("published_queue_page")
def q_published_queue_page(spark, d):
    """The same page from the published page index."""
    flow = reviewed(spark, d)
    store = _published(spark, flow)
    published.index_queue(store, flow.now, block_rows=64)
    page = published.indexed_page(store, 100, 10)
    return page.select("incident_id", "operational_priority", us("latest_reported_at").alias("latest_us"), "total")


@query("published_heat")
def q_published_heat(spark, d):
    flow = reviewed(spark, d)
    return heat_columns(published.heat(_published(spark, flow), flow.now))


@query("delete_and_publish")
def q_delete_and_publish(spark, d):
    """Every 97th report deleted from a published ledger; incidents that lost one are clustered anew."""
    flow = reviewed(spark, d)
    store = _published(spark, flow)
    gone = fx.reports(spark, d).select("id").filter(tail("id") % 97 == 0)
    delete_and_publish(store, gone, fx.sensitive_locations(spark, d), flow.now)
    rows = store.read("incidents").select("component", "incident_id", big("report_count").alias("report_count"))
    return Ledger(store).members().join(rows, "component").select("id", "component", "incident_id", "report_count")
