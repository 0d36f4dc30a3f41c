"""The incident ledger: bounded reads and writes, decisions over rounds, no silent loss."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reportmesh.operators import incidents, intake, layout, matching, pages, read_models, reviews
from reportmesh.plans.flow import Flow
from reportmesh.session import cut_lineage, ensure_checkpoint_dir, stage_scope
from reportmesh.sources.store import CheckFailed, SnapshotStore
from reportmesh.streaming import live, published
from reportmesh.streaming.intake import created_keys
from reportmesh.streaming.ledger import SPECS, Ledger, broken_checks, write_checks

from helpers import BASE, brute_force_pairs, complaints, uid
from test_sources_and_streams import vectors_of

SMALL = layout.Layout(zones=4, shards=4)


def _now(hours=900):
    return F.lit(BASE + dt.timedelta(hours=hours))


def _places(spark):
    return spark.createDataFrame([("p", "school", 3.01, 101.0)], "place_id string, kind string, latitude double, longitude double")


def _reports(spark, n, seed, hours=600):
    rng = random.Random(seed)
    order = rng.sample(range(n), n)
    rows = [
        (k, f"pothole {rng.choice(['block a', 'near the school', 'block b'])}", 3 + rng.uniform(0, 0.02), 101.0, rng.uniform(0, hours), "pothole")
        for k in order
    ]
    return complaints(spark, rows).cache()


def _commands(df, salt=""):
    return df.select(
        F.concat(F.lit(f"key-{salt}"), "id").alias("idempotency_key"), F.lit(1).cast("bigint").alias("sequence"), F.col("id").alias("complaint_id"),
        "id", "text", "latitude", "longitude", "reported_at", "category", "photo_path", F.lit(None).cast("string").alias("photo_id"),
    )


def _submit(spark, store, commands, places, base=None):
    with stage_scope(spark):
        appended, metadata = Ledger(store, layout=SMALL).submit(commands, vectors_of, places, _now())
        store.publish(
            appended=appended, metadata=metadata, base=base or store.current(), specs=SPECS, metrics=write_checks(), verify=broken_checks
        )


def _incidents(table):
    return {(r["component"], r["incident_id"], r["report_count"], r["pending_count"], r["conflict_count"], r["status"], r["priority_level"]) for r in table.collect()}


def _members(table):
    return {(r["id"], r["component"]) for r in table.collect()}


def _decided(edges):
    return {(r["left_id"], r["right_id"], r["decision"], r["automated_decision"], r["decision_source"], tuple(r["reasons"])) for r in edges.collect()}


def _resolve(spark, store, part):
    """Officer decisions on some pending reviews, and again on all that were decided before."""
    found = Ledger(store).reviews()
    some = found.filter((F.pmod(F.xxhash64("review_id"), F.lit(3)) == part) | (F.col("status") != "pending"))
    commands = some.select(
        F.xxhash64("review_id").alias("sequence"), "review_id", (F.pmod(F.xxhash64("left_id"), F.lit(3)) > 0).alias("approve"),
        F.lit("officer").alias("reviewer_id"), F.lit(None).cast("string").alias("note"), _now().alias("resolved_at"), "status",
    )
    commands = cut_lineage(commands)
    results = live.resolve_and_publish(store, commands.drop("status"), _places(spark), _now()).collect()
    return {r["review_id"]: r["status"] for r in commands.collect()}, results


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """A ledger after submissions, decisions, submissions, decisions, and the batch job on the same reports.

    Ids and times of the two batches are mixed; the second also holds reports far from all others. Also: the
    stages left after each step, rows of tables before the second batch, and the decisions with their results.
    """
    df = _reports(spark, 80, 4)
    far = complaints(spark, [(5_000 + k, "pothole block a", -40.0, 20.0, k, "pothole") for k in range(3)])
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("ledger") / "store"))
    halves = [df.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == part) for part in range(2)]
    stages, rows, rounds = [], {}, []
    for part, batch in enumerate([halves[0], halves[1].unionByName(far)]):
        rows = {t: store.read_rows(t)[0].count() for t in store.tables()}
        _submit(spark, store, _commands(batch), _places(spark))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/stage-*")
        stages.append(len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)))
        added = {t: store.read_rows(t)[0].count() - n for t, n in rows.items()}
        if part == 0:
            rounds.append(_resolve(spark, store, part))
            stages.clear()
            stages.append(len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)))
    before_last = store.current()
    rounds.append(_resolve(spark, store, 1))
    assert store.current() != before_last
    everything = df.unionByName(far).cache()
    whole = Flow(everything, vectors_of(everything), _places(spark), cut_lineage(Ledger(store).reviews()))
    return everything, store, whole, stages, added, rounds


def test_steps_equal_the_batch_job(filled):
    _, store, whole, *_ = filled
    ledger = Ledger(store)
    assert ledger.layout == SMALL
    assert _members(ledger.members()) == _members(whole.members)
    assert _incidents(store.read("incidents")) == _incidents(whole.assessed(_now()))
    assert store.read("redirects").count() > 0 and store.read("results").count() == 83
    pending = {(r["left_id"], r["right_id"]) for r in whole.matched.filter("decision = 'review_required'").collect()}
    assert {(r["left_id"], r["right_id"]) for r in ledger.reviews().collect()} == pending and pending
    assert _decided(live.load_state(store).edges) == _decided(whole.edges)


def test_no_decision_is_stale(filled):
    """A round accepts what is pending, whatever was decided or submitted before, and nothing twice."""
    for status, results in filled[-1]:
        assert len(results) == len(status) > 0
        for r in results:
            accepted = {"approved", "rejected"} if status[r["review_id"]] == "pending" else {"already_resolved"}
            assert r["outcome"] in accepted and (r["new_ids"] is not None) == (r["outcome"] != "already_resolved")
    assert "already_resolved" in {r["outcome"] for r in filled[-1][1][1]}


def test_running_digest_equals_a_recount(filled):
    _, store, whole, *_ = filled
    want = incidents.graph_version(whole.matched).first()["graph_version"]
    assert Ledger(store).version().version() == want
    pending = Ledger(store).reviews().filter("status = 'pending'")
    assert {r["graph_version_at_creation"] for r in pending.collect()} == {want}
    empty = incidents.graph_version(whole.matched.limit(0)).first()["graph_version"]
    assert incidents.GraphSums().version() == empty
    half = whole.matched.filter(F.pmod(F.xxhash64("left_id"), F.lit(2)) == 0)
    rest = incidents.graph_sums(whole.matched) - incidents.graph_sums(half)
    other = whole.matched.filter(F.pmod(F.xxhash64("left_id"), F.lit(2)) != 0)
    assert rest.version() == incidents.graph_version(other).first()["graph_version"]


def test_stages_are_dropped_after_each_publish(filled):
    assert len(set(filled[3])) == 1


def test_scopes_drop_their_stages_only(spark):
    def alive(df):
        try:
            return df.count() == 3
        except Exception:
            return False

    with stage_scope(spark):
        outer = cut_lineage(spark.range(3))
        with pytest.raises(KeyError), stage_scope(spark):
            inner, kept = cut_lineage(spark.range(3)), cut_lineage(spark.range(3), beyond_scope=True)
            raise KeyError
        assert alive(outer) and alive(kept) and not alive(inner)
    assert alive(cut_lineage(spark.range(3))) and not alive(outer) and not alive(kept)


def test_a_batch_reads_its_own_cells(spark, filled):
    """A back-dated report opens the folders of its weeks and tiles; the plan prunes them at run time."""
    df, store, *_ = filled
    some = SMALL.located(df.filter("latitude > 0").orderBy("reported_at").limit(1))
    cells = cut_lineage(SMALL.cells_near(some, matching.MatchingPolicy()))
    rows = store.read_rows("complaints")[0]
    near = layout.in_cells(rows, cells)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "bucket#" in plan.split("PartitionFilters")[1]
    reach = cells.agg(F.max("bucket")).first()[0]
    assert {r["bucket"] for r in near.select("bucket").distinct().collect()} <= set(range(reach - 2, reach + 1))
    assert 0 < near.count() < rows.count()
    far = SMALL.located(complaints(spark, [(9_000, "pothole", 50.0, 7.0, 90_000, "pothole")]))
    assert layout.in_cells(rows, cut_lineage(SMALL.cells_near(far, matching.MatchingPolicy()))).count() == 0


def test_cells_hold_every_partner(spark):
    """Also at 180 degrees, at the poles, and for reports without a usable place or time."""
    rng = random.Random(2)
    spots = [(0, 179.9995), (0, -179.9995), (89.9999, 10), (89.9999, -170), (-90, 0), (3, 101), (3.0719, 101), (3.0721, 101.0003)]
    rows = [(k, "pothole block a", lat + rng.uniform(-1e-4, 1e-4) if abs(lat) < 89 else lat, lon, rng.uniform(0, 500), "pothole") for k, (lat, lon) in enumerate(spots * 8)]
    df = complaints(spark, rows)
    bad = spark.createDataFrame([(uid(900), None, 1.0), (uid(901), float("nan"), 1.0)], "id string, latitude double, longitude double")
    bad = bad.withColumn("reported_at", F.lit(BASE))
    located = cut_lineage(SMALL.located(df))
    assert {r["bucket"] for r in SMALL.located(bad).collect()} == {layout.NOWHERE}
    assert SMALL.cells_near(bad, matching.MatchingPolicy()).count() == 0
    pairs = brute_force_pairs(df).collect()
    assert len(pairs) > 20
    for pair in pairs[::25]:
        one = df.filter(F.col("id") == pair["left_id"])
        near = layout.in_cells(located, cut_lineage(SMALL.cells_near(one, matching.MatchingPolicy())))
        assert near.filter(F.col("id") == pair["right_id"]).count() == 1


def test_overrides_applied_again_change_nothing(spark):
    df = _reports(spark, 40, 1, hours=100)
    flow = Flow(df, vectors_of(df), _places(spark))
    found = reviews.new_reviews(flow.matched, _now(), F.lit("v")).withColumns(
        {"status": F.lit("approved"), "final_relationship_state": F.lit("auto_match")}
    )
    once = matching.apply_overrides(flow.matched, found)
    assert _decided(matching.apply_overrides(once, found)) == _decided(once)
    restored = matching.without_overrides(once)
    want = {(r["left_id"], r["right_id"], r["decision"], tuple(r["reasons"])) for r in flow.matched.collect()}
    assert {(r["left_id"], r["right_id"], r["decision"], tuple(r["reasons"])) for r in restored.collect()} == want


def test_nothing_without_identity_vanishes(spark, tmp_path):
    """A null key, sequence or complaint id is rejected with its reason; a stored report is not created again."""
    df = complaints(spark, [(k, "pothole block a", 3.0, 101.0, k, "pothole") for k in range(7)])
    commands = _commands(df)
    missing = {uid(1): "idempotency_key", uid(2): "sequence", uid(3): "complaint_id"}
    for i, column in missing.items():
        commands = commands.withColumn(column, F.when(F.col("id") != i, F.col(column)))
    commands = commands.withColumn("complaint_id", F.when(F.col("id") == uid(6), F.lit(uid(5))).otherwise(F.col("complaint_id")))
    valid, rejected = intake.split_valid(intake.validate_commands(intake.validate_complaints(commands, _now())))
    assert {r["id"]: r["rejections"] for r in rejected.collect()} == {i: [f"missing_{c}"] for i, c in missing.items()}
    outcomes = intake.idempotent_outcomes(intake.with_fingerprint(intake.to_complaints(commands)))
    assert sorted(r["outcome"] for r in outcomes.collect()) == ["created"] * 4 + ["invalid"] * 3
    store = SnapshotStore(spark, str(tmp_path / "store"))
    ready = cut_lineage(intake.with_fingerprint(intake.to_complaints(valid)))
    first = Ledger(store, layout=SMALL).outcomes(ready)
    assert sorted((r["outcome"], r["complaint_id"] or "") for r in first.collect()) == [
        ("complaint_id_taken", ""), ("created", uid(0)), ("created", uid(4)), ("created", uid(5))
    ]
    ledger = Ledger(store, layout=SMALL)
    created = first.filter("outcome = 'created'")
    tables = {"keys": ledger.shard(created_keys(ready, first), "idempotency_key"), "ids": ledger.shard(created.select(F.col("complaint_id").alias("id")), "id")}
    store.publish(appended=tables, specs=SPECS)
    # the same commands again, as another stream delivers them, and a new key for a stored report
    good = ready.filter(F.col("id").isin(uid(0), uid(4)))
    again = good.unionByName(good.filter(F.col("id") == uid(4)).withColumn("idempotency_key", F.lit("other")))
    got = Ledger(store, layout=SMALL).outcomes(again).collect()
    assert sorted((r["outcome"], r["complaint_id"] or "") for r in got) == [("complaint_id_taken", ""), ("replayed", uid(0)), ("replayed", uid(4))]


def test_a_complaint_id_is_created_once(spark):
    rows = [("a", 5, "created", "c1"), ("b", 3, "created", "c1"), ("b", 4, "replayed", "c1"), ("a", 6, "replayed", "c1"), ("a", 7, "conflict", None),
            ("d", 1, "created", "c2"), ("e", 1, "created", "c3"), (None, 9, "invalid", None)]
    outcomes = spark.createDataFrame(rows, "idempotency_key string, sequence bigint, outcome string, complaint_id string")
    got = {tuple(r) for r in intake.claim_complaints(outcomes, spark.createDataFrame([("c3",)], "id string")).collect()}
    taken = "complaint_id_taken"
    assert got == {("a", 5, taken, None), ("b", 3, "created", "c1"), ("b", 4, "replayed", "c1"), ("a", 6, taken, None), ("a", 7, "conflict", None),
                   ("d", 1, "created", "c2"), ("e", 1, taken, None), (None, 9, "invalid", None)}


def test_incomplete_decisions_have_an_outcome(spark):
    known = spark.createDataFrame([("r", uid(1), uid(2), "pending", 1, "v")], "review_id string, left_id string, right_id string, status string, version int, graph_version_at_creation string")
    rows = [(None, "r", True), (2, "r", None), (3, None, True), (4, "r", True), (5, "r", False)]
    commands = spark.createDataFrame(rows, "sequence bigint, review_id string, approve boolean").withColumns(
        {"reviewer_id": F.lit("o"), "note": F.lit(None).cast("string"), "resolved_at": _now()}
    )
    got = {(r["sequence"], r["outcome"], r["final_relationship_state"]) for r in reviews.resolution_outcomes(commands, known, F.lit("v")).collect()}
    assert got == {(None, "invalid", None), (2, "invalid", None), (3, "unknown_review", None), (4, "approved", "auto_match"), (5, "already_resolved", None)}


def test_writes_follow_the_batch(filled):
    """The second batch appended its own rows; what it merged are a few rows per label."""
    _, store, _, _, added, _ = filled
    own = store.read("complaints").count() - added["complaints"]
    assert 25 < own < 60
    assert added["complaints"] == added["members"] == added["ids"] == added["vectors"] == added["results"] == 83 - own
    assert added["redirects"] == added["parts"] <= own and added["decisions"] == 0


@pytest.mark.parametrize("hours", [0, 130, 700, 5_000])
def test_priorities_at_any_time(spark, filled, hours):
    """Stored incidents, asked for a time, equal a full scoring at that time; change points tell who rose."""
    _, store, whole, *_ = filled
    columns = ["component", "priority_level", "points", "triggered_rules", "priority_reasons", "operational_priority", "unresolved_hours"]
    of = lambda df: {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect()}
    now, later = _now(hours), _now(hours + 36)
    assert of(published.incidents_at(store, now)) == of(whole.assessed(now))
    level = lambda at: {r["component"]: r["priority_level"] for r in published.incidents_at(store, at).collect()}
    before, after = level(now), level(later)
    rose = {r["component"] for r in published.risen(store, now, later).collect()}
    assert rose == {c for c in before if before[c] != after[c]}
    plan = published.incidents_at(store, now)._jdf.queryExecution().executedPlan().toString()
    assert "normalized_text" not in plan and "/complaints" not in plan


def test_pages_of_the_published_queue(spark, filled):
    _, store, whole, *_ = filled
    ranked = [r["incident_id"] for r in published.queue(store, _now(), limit=100).collect()]
    assert ranked == [r["incident_id"] for r in read_models.incident_queue(whole.assessed(_now()), limit=100).collect()]
    published.index_queue(store, _now(), block_rows=7)
    for offset, limit in ((0, 5), (5, 4), (6, 20), (len(ranked) - 2, 10), (len(ranked) + 5, 3)):
        rows = published.indexed_page(store, limit, offset).collect()
        assert [r["incident_id"] for r in rows] == ranked[offset : offset + limit]
        assert {r["total"] for r in rows} <= {len(ranked)}
    plan = published.indexed_page(store, 3, 8)._jdf.queryExecution().executedPlan().toString()
    assert "(block#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert published.indexed_page(store, 3, 8).select("block").distinct().count() == 1


def test_page_index_numbers_rows_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), k) for k in range(1_000)]
    index = pages.page_index(spark.createDataFrame(rows, "a int, id int").repartition(6), [F.desc("a"), F.asc("id")], 64)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    got = sorted(index.collect(), key=lambda r: r["position"])
    assert [(r["a"], r["id"]) for r in got] == want and [r["position"] for r in got] == list(range(1_000))
    assert all(r["block"] == r["position"] // 64 for r in got)
    assert pages.page_index(index.limit(0).drop("position", "block"), [F.asc("id")]).count() == 0


def test_a_bad_table_is_not_published(spark, tmp_path):
    """Counts come from the write itself; what breaks them leaves the snapshot as it was."""
    store = SnapshotStore(spark, str(tmp_path / "store"))
    good = {"complaints": spark.createDataFrame([("a", "a")], "id string, label string"), "members": spark.createDataFrame([("a", "a")], "id string, label string"),
            "vectors": spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<double>"),
            "edges": spark.createDataFrame([], "left_id string, right_id string, decision string")}
    publish = lambda tables: store.publish(appended=tables, metrics=write_checks(), verify=broken_checks)
    first = publish(good)
    worse = {
        "members": good["members"].limit(0), "complaints": spark.createDataFrame([("a", None)], "id string, label string"),
        "edges": spark.createDataFrame([("b", "a", "no_match")], "left_id string, right_id string, decision string"),
        "vectors": spark.createDataFrame([("a", [0.0, 0.0])], "id string, vector array<double>"),
    }
    for table, rows in worse.items():
        with pytest.raises(CheckFailed, match=table):
            publish({**good, table: rows})
    with pytest.raises(CheckFailed, match="1 to 2 numbers"):
        two = {t: df.union(df) for t, df in good.items()}
        publish({**two, "vectors": good["vectors"].union(spark.createDataFrame([("a", [1.0])], "id string, vector array<double>"))})
    assert store.current() == first and store.read("members").count() == 1


def test_removed_reports(spark, filled):
    """What is left equals a batch job without them: split components, pairs, reviews, digest. Runs last, as it
    goes on with the store the other tests read."""
    df, store, whole, *_ = filled
    sizes = whole.members.groupBy("component").count().orderBy(F.desc("count"), "component")
    large = sizes.first()["component"]
    inside = whole.members.filter(F.col("component") == large).orderBy("id")
    hubs = whole.edges.filter("decision = 'auto_match'").select(F.explode(F.array("left_id", "right_id")).alias("id")).groupBy("id").count()
    gone = inside.join(hubs, "id").orderBy(F.desc("count"), "id").limit(6).select("id").union(df.select("id").orderBy("id").limit(2))
    gone = cut_lineage(gone.union(spark.createDataFrame([("nobody",), (None,)], "id string")).distinct())
    removed = live.delete_and_publish(store, gone, _places(spark), _now()).collect()
    assert {r["id"] for r in removed} == {r["id"] for r in gone.collect()} - {"nobody", None}
    rest = df.join(gone, "id", "left_anti").cache()
    ledger = Ledger(store)
    after = Flow(rest, vectors_of(rest), _places(spark), cut_lineage(ledger.reviews()))
    assert _members(ledger.members()) == _members(after.members)
    assert _incidents(store.read("incidents")) == _incidents(after.assessed(_now()))
    assert ledger.version().version() == incidents.graph_version(after.matched).first()["graph_version"]
    assert _decided(ledger.state().edges) == _decided(after.edges) and ledger.state().complaints.count() == rest.count()
    assert store.read("keys").count() == rest.count()
    # reports that come later meet what is left; ids of removed ones stay taken
    late = complaints(spark, [(300 + k, "pothole block a", 3.01 + 0.002 * k, 101.0, 200, "pothole") for k in range(2)])
    again = df.join(gone, "id", "left_semi").limit(1)
    _submit(spark, store, _commands(late).unionByName(_commands(again, "again-")), _places(spark))
    everything = rest.unionByName(late).cache()
    after = Flow(everything, vectors_of(everything), _places(spark), cut_lineage(Ledger(store).reviews()))
    assert _members(Ledger(store).members()) == _members(after.members)
    assert _incidents(store.read("incidents")) == _incidents(after.assessed(_now()))
    assert store.read("outcomes").filter("outcome = 'complaint_id_taken'").count() == 1


def test_queries_of_decisions_decide_pairs_once(spark, tmp_path, monkeypatch):
    """Both graphs, before and after officer decisions, come from one table of decided pairs."""
    from reportmesh.plans import command_queries

    base = dt.datetime(2024, 1, 1)
    rows = [(n, base + dt.timedelta(hours=n % 200)) for n in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    vectors = [(n, [float(1 + (n * 7 + k) % 5) for k in range(4)]) for n in range(40)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    decided, match = [], matching.match_pairs
    monkeypatch.setattr(matching, "match_pairs", lambda *args: decided.append(1) or match(*args))
    for run in (command_queries.q_incremental_review, command_queries.q_mutation_view):
        decided.clear()
        run(spark, str(tmp_path))
        assert len(decided) == 1
