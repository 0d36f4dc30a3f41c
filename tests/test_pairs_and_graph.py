import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import brute_force_pairs, complaints, edges, uid, union_find

from reportmesh.functions import vectors as vectors_of
from reportmesh.operators import candidates, collapse, contradictions, graph, incidents, matching, node_links
from reportmesh.operators.skew import lookup
from reportmesh.plans import incremental
from reportmesh.policy import MatchingPolicy
from reportmesh.session import configure


def random_reports(seed, n=220):
    rng = random.Random(seed)
    rows = []
    centres = [(3.1, 101.5), (0.0, 180.0), (0.001, -179.9995), (89.9985, 10.0), (-89.9999, -70.0),
               (60.0, 0.0), (-45.0, 179.999)]
    for i in range(n):
        lat, lon = rng.choice(centres)
        wide = 180 if abs(lat) > 89 else 0.012 / max(0.05, abs(1 - abs(lat) / 90))
        lat = max(-90, min(90, lat + rng.uniform(-0.008, 0.008)))
        lon = (lon + rng.uniform(-wide, wide) + 180) % 360 - 180
        category = rng.choice(["pothole", "flooding", "other", None])
        rows.append((i, "text here", lat, lon, rng.uniform(0, 500), category))
    return rows


@pytest.mark.parametrize(("seed", "hot_rows"), [(1, 3), (2, 5000), (3, 3)])
def test_blocked_join_equals_brute_force(spark, seed, hot_rows):
    df = complaints(spark, random_reports(seed)).cache()
    want = {(r[0], r[1]) for r in brute_force_pairs(df).collect()}
    got = [(r["left_id"], r["right_id"]) for r in candidates.candidate_pairs(df, hot_rows=hot_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want and len(want) > 100


def test_new_side_probe_finds_exactly_the_pairs_touching_new_reports(spark):
    df = complaints(spark, random_reports(7)).cache()
    fresh = df.filter(F.substring("id", 34, 3).cast("int") % 4 == 0)
    ids = {r["id"] for r in fresh.select("id").collect()}
    want = {
        (r[0], r[1])
        for r in brute_force_pairs(df).collect()
        if r[0] in ids or r[1] in ids
    }
    got = [tuple(r)[:2] for r in candidates.candidate_pairs(df, probe_side=fresh).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_gates_are_inclusive(spark):
    week = 7 * 24
    df = complaints(
        spark,
        [(1, "abc", 0, 0, 0, "pothole"), (2, "abc", 0, 0, week, "pothole"),
         (3, "abc", 0, 0, week + 1 / 3600, "pothole")],
    )
    got = {(r["left_id"], r["right_id"]) for r in candidates.candidate_pairs(df).collect()}
    assert got == {(uid(1), uid(2)), (uid(2), uid(3))}


@pytest.mark.parametrize("hot_rows", [2, 500_000])
def test_components_equal_union_find(spark, hot_rows):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(0, n) for n in range(300, 360)]  # a hub
    links += [(n, n + 1) for n in range(400, 440)]  # a chain
    nodes = range(450)
    want = {uid(k): uid(v) for k, v in union_find(nodes, links).items()}
    vertices = spark.createDataFrame([(uid(n),) for n in nodes], "id string")
    rows = [(uid(a), uid(b)) for a, b in links]
    pairs = spark.createDataFrame(rows, "left_id string, right_id string")
    got = graph.connected_components(vertices, pairs, hot_rows=hot_rows).collect()
    assert {r["id"]: r["component"] for r in got} == want


def test_review_edges_never_bridge_and_conflicts_surface(spark):
    df = complaints(spark, [(n, "abc", 0, 0, n, "pothole") for n in range(1, 5)])
    e = edges(spark, [(1, 2, "auto_match"), (2, 3, "review_required"), (1, 4, "auto_match"),
                      (2, 4, "no_match")])
    members = graph.confirmed_components(df, e).cache()
    rows = {r["component"]: r for r in incidents.incident_summary(df, members, e).collect()}
    assert set(rows) == {uid(1), uid(3)}
    assert rows[uid(1)]["status"] == "conflict" and rows[uid(1)]["report_count"] == 3
    assert rows[uid(3)]["status"] == "isolated" and rows[uid(3)]["pending_count"] == 1
    reason = incidents.conflicts(e, members).first()["reason"]
    assert reason.startswith("no_match contradicts confirmed component for " + uid(2))


def test_incident_id_names_the_member_set_at_every_size(spark):
    import hashlib
    import uuid

    members = spark.createDataFrame(
        [(uid(n), uid(1)) for n in range(1, 6)] + [(uid(9), uid(9))], "id string, component string"
    )

    def name(ids):
        rows = [hashlib.sha256(i.encode()).hexdigest() for i in ids]
        lanes = [str(sum(int(r[8 * k : 8 * k + 8], 16) for r in rows)) for k in range(8)]
        digest = hashlib.sha256(":".join([str(len(ids)), *lanes]).encode()).hexdigest()
        return str(uuid.uuid5(uuid.NAMESPACE_URL, "incident-v1:" + digest))

    ids = {r["component"]: r["incident_id"] for r in incidents.incident_ids(members).collect()}
    assert ids == {uid(1): name([uid(n) for n in range(1, 6)]), uid(9): name([uid(9)])}


def test_components_of_a_long_path(spark):
    """A path of 5 000 nodes in shuffled order: as many rounds as it takes."""
    names = list(range(5000))
    random.Random(2).shuffle(names)
    links = [(uid(a), uid(b)) for a, b in zip(names, names[1:])]
    pairs = spark.createDataFrame(links, "left_id string, right_id string")
    nodes = spark.createDataFrame([(uid(n),) for n in names], "id string")
    got = graph.connected_components(nodes, pairs).select("component").distinct().collect()
    assert [r[0] for r in got] == [uid(0)]


def test_a_round_shuffles_three_times_and_sums_while_writing(spark, tmp_path):
    """One shuffle per star and one for the distinct; the signature needs no job of its own."""
    path = f"{tmp_path}/links"
    edges(spark, [(1, 2, "auto_match"), (2, 3, "auto_match"), (7, 8, "auto_match")]).write.parquet(path)
    links = spark.read.parquet(path)
    pairs = links.select(F.col("right_id").alias("a"), F.col("left_id").alias("b"))
    plan = graph._small_star(graph._large_star(pairs, None), None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("FileScan") == 1
    stars, _, seen = graph._write_stars(pairs)
    assert seen[0] == 3 == stars.count() and seen == graph._write_stars(stars.orderBy("a"))[2]
    assert graph._write_stars(pairs.filter("a = b"))[2][0] == 0


def test_edges_at_ids_are_read_once(spark, tmp_path):
    path = f"{tmp_path}/edges"
    rows = [(1, 2, "auto_match"), (1, 2, "auto_match"), (2, 3, "no_match"), (4, 5, "no_match"), (5, 1, "auto_match")]
    edges(spark, rows).write.parquet(path)
    stored = spark.read.parquet(path)
    stored = stored.unionByName(stored.limit(1).withColumn("right_id", F.lit(None).cast("string")).withColumn("left_id", F.lit("x")))
    ids = spark.createDataFrame([(uid(1),), (uid(1),), (uid(3),), (None,)], "id string")
    got = incremental.edges_at(stored, ids)
    assert got.columns == stored.columns
    want = sorted((uid(a), uid(b)) for a, b, _ in rows if {a, b} & {1, 3})
    assert sorted((r.left_id, r.right_id) for r in got.collect()) == want
    plan = incremental.edges_at(spark.read.parquet(path), ids)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_missing_vector_is_no_silent_loss(spark):
    df = complaints(spark, [(n, "pothole block a", 3.0, 101.0, n, "pothole") for n in range(4)])
    vectors = spark.createDataFrame([(uid(n), [1.0, 2.0]) for n in range(3)], "id string, vector array<double>")
    pairs = candidates.candidate_pairs(df)
    scored = matching.score_pairs(pairs, matching.evidence_table(df, vectors))
    assert scored.count() == pairs.count() == 6
    assert {r["right_id"] for r in matching.unusable_pairs(scored).collect()} | {
        r["left_id"] for r in matching.unusable_pairs(scored).collect()
    } == {uid(n) for n in range(4)}
    with pytest.raises(Exception, match="no usable vector"):
        matching.match_pairs(scored).collect()



def _world(spark, copies):
    """Random reports of which a third are copies of one report."""
    rng = random.Random(11)
    rows = []
    for n in range(90):
        block = rng.choice(["block a", "block b", "block a unit 2", ""])
        rows.append((n, f"pothole {block}", 3 + rng.uniform(0, 0.01), 101 + rng.uniform(0, 0.01),
                     rng.uniform(0, 400), rng.choice(["pothole", "pothole", "other"])))
    rows += [(1000 + n, "pothole block a", 3.004, 101.004, n * 2.5, "pothole") for n in range(copies)]
    df = complaints(spark, rows).withColumn("vector_key", F.sha2("normalized_text", 256)).cache()
    # one vector per text, close to each other but not equal
    vectors = df.select(
        "id",
        F.array(F.lit(1.0), (F.pmod(F.xxhash64("normalized_text"), F.lit(7)) / 10).cast("double")).alias("vector"),
    )
    return df, vectors


def test_collapsed_components_need_usable_vectors(spark):
    """A missing or directionless vector fails the job on this path too, for pairs and for copies."""
    df = complaints(spark, [(n, "pothole block a", 3.0 + (n % 2) * 1e-4, 101.0, 0, "pothole") for n in range(4)])
    rows = [(uid(n), [1.0, 0.5 + n * 1e-3]) for n in range(4)]
    good = spark.createDataFrame(rows, "id string, vector array<double>")
    assert {r["component"] for r in collapse.collapsed_components(df, good).collect()} == {uid(0)}
    zero = [(i, [0.0, 0.0]) for i, _ in rows]
    for bad in (rows[:3], rows[1:], [*rows[:3], (uid(3), [0.0, 0.0])], zero, [*rows[:3], (uid(3), [float("nan"), 1.0])]):
        with pytest.raises(Exception, match="no usable vector"):
            collapse.collapsed_components(df, spark.createDataFrame(bad, "id string, vector array<double>")).collect()
    keyed = df.withColumn("vector_key", F.lit("same"))
    with pytest.raises(Exception, match="no usable vector"):
        collapse.collapsed_components(keyed, spark.createDataFrame(zero, "id string, vector array<double>")).collect()


@pytest.mark.parametrize("reviewed", [False, True])
def test_collapsed_components_equal_the_pairwise_graph(spark, reviewed):
    df, vectors = _world(spark, 45)
    policy = MatchingPolicy()
    pairs = candidates.candidate_pairs(df, policy)
    decided = matching.match_pairs(
        matching.score_pairs(pairs, matching.evidence_table(df, vectors)), policy
    ).cache()
    reviews = None
    if reviewed:
        picked = decided.filter(F.pmod(F.xxhash64("left_id", "right_id"), F.lit(9)) == 0)
        approve = F.pmod(F.xxhash64("right_id"), F.lit(2)) == 0
        reviews = picked.select(
            "left_id",
            "right_id",
            F.lit("approved").alias("status"),
            F.when(approve, F.lit("auto_match")).otherwise(F.lit("no_match")).alias(
                "final_relationship_state"
            ),
        )
        # an approval of reports that are no candidates makes no edge in either form
        near = {(r["left_id"], r["right_id"]) for r in decided.collect()}
        ids = sorted(r["id"] for r in df.select("id").collect())
        far = next((a, b) for a in ids for b in ids if a < b and (a, b) not in near)
        stray = [(*far, "approved", "auto_match")]
        reviews = reviews.unionByName(spark.createDataFrame(stray, reviews.schema)).cache()
        decided = matching.apply_overrides(decided, reviews)
    want = {r["id"]: r["component"] for r in graph.confirmed_components(df, decided).collect()}
    got = {
        r["id"]: r["component"]
        for r in collapse.collapsed_components(df, vectors, policy, reviews, hot_rows=4).collect()
    }
    assert got == want and len(set(got.values())) < len(got)


@pytest.mark.parametrize("reviewed", [False, True])
def test_contradictions_between_nodes_equal_the_listed_ones(spark, reviewed):
    """Copies of reports that name two units of one block, over several time windows; an officer rejects some."""
    rng = random.Random(5)
    rows = [(n, f"pothole block a{rng.choice(['', ' unit 2', ' unit 3'])}", 3.004, 101.004, rng.randrange(0, 500), "pothole") for n in range(70)]
    rows += [(100 + n, f"pothole block a unit {n % 4}", 3.004 + rng.uniform(0, 0.008), 101.004, rng.uniform(0, 500), "pothole") for n in range(40)]
    rows += [(200 + n, "pothole block b", 3.004, 101.004, n * 90, rng.choice(["pothole", "other"])) for n in range(8)]
    df = complaints(spark, rows).cache()
    vectors = df.select("id", F.array(F.lit(1.0), F.lit(0.5)).alias("vector"))
    policy = MatchingPolicy()
    scored = matching.score_pairs(candidates.candidate_pairs(df, policy), matching.evidence_table(df, vectors))
    edges = matching.match_pairs(scored, policy).cache()
    reviews = None
    if reviewed:
        one = F.pmod(F.xxhash64("left_id", "right_id"), F.lit(12))
        final = F.when(one == 0, "no_match").otherwise("auto_match")
        reviews = edges.filter(one < 2).select("left_id", "right_id", F.lit("done").alias("status"), final.alias("final_relationship_state")).cache()
        edges = matching.apply_overrides(edges, reviews)
    members = graph.confirmed_components(df, edges)
    listed = incidents.conflicts(edges, members).groupBy("component").count()
    want = {r["component"]: r["count"] for r in listed.collect()}
    found = collapse.collapsed_graph(df, vectors, policy, reviews, hot_rows=5)
    got = {r["component"]: r["conflict_count"] for r in contradictions.conflict_counts(found, df, policy, reviews, hot_rows=5).collect()}
    assert got == want and sum(want.values()) > 500


def test_reports_without_a_place_or_time_stay_alone_in_both_graphs(spark):
    df = complaints(spark, [(n, "pothole block a", 3.0, 101.0, 0, "pothole") for n in range(6)])
    lost = {"latitude": [0, 1], "reported_at": [2, 3]}
    for column, gone in lost.items():
        df = df.withColumn(column, F.when(~F.col("id").isin([uid(n) for n in gone]), F.col(column)))
    vectors = df.select("id", F.array(F.lit(1.0)).alias("vector"))
    got = {r["id"]: r["component"] for r in collapse.collapsed_components(df, vectors).collect()}
    assert got == {uid(n): uid(min(n, 4)) for n in range(6)}


def test_split_lookup_keeps_every_row(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    table = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    got = lookup(rows, table, ["k"], spread_by="id", hot_rows=50)
    assert got.count() == 1000 and got.filter("v != k * 2").count() == 0


@pytest.mark.parametrize(
    ("change", "decision", "reason"),
    [
        ({}, "auto_match", "semantic similarity 0.920 meets threshold"),
        ({"sim": 0.91}, "review_required", "semantic similarity 0.910 is below 0.920 threshold"),
        ({"cat_b": "other"}, "review_required", "category requires officer review"),
        ({"cat_b": "flooding"}, "no_match", "category mismatch: pothole vs flooding"),
        ({"lat": 3.01}, "no_match", "distance 1112.0m exceeds 500.0m policy radius"),
        ({"hours": 200}, "no_match", "time gap 200.0h exceeds 7.0 day policy window"),
        ({"text_b": "block b"}, "no_match", "explicit location conflict prevents auto-match"),
        ({"text_b": "none"}, "review_required", "missing explicit location evidence prevents auto-match"),
    ],
)
def test_decision_ladder(spark, change, decision, reason):
    v = {"sim": 0.92, "cat_b": "pothole", "lat": 3.0, "hours": 1, "text_b": "block a", **change}
    df = complaints(
        spark,
        [(1, "block a", 3.0, 101.0, 0, "pothole"), (2, v["text_b"], v["lat"], 101.0, v["hours"], v["cat_b"])],
    )
    a = df.filter(F.col("id") == uid(1)).select(F.struct("*").alias("a"))
    b = df.filter(F.col("id") == uid(2)).select(F.struct("*").alias("b"))
    one = F.lit(1)
    pair = a.withColumn("j", one).join(b.withColumn("j", one), "j")
    row = matching.decide_explicit_pairs(pair.withColumn("semantic_similarity", F.lit(v["sim"]))).first()
    assert row["decision"] == decision
    assert reason in row["reasons"] and row["reasons"][-1] == f"final decision: {decision}"


def test_union_does_not_claim_the_partitioning_of_its_inputs(spark, capsys):
    """Joins above a union shuffle it: its inputs may be coalesced differently while the query runs."""
    configure(spark)
    rows = lambda m: spark.range(40).groupBy((F.col("id") % m).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    joined = rows(7).unionByName(rows(5)).join(rows(3).withColumnRenamed("n", "o").hint("merge"), "k")
    joined.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning(") == 4
    assert joined.count() == 6


def _dense(spark, n):
    """Reports of one block and week, 0 to 1 km apart, with vectors whose cosines lie at the threshold."""
    threshold = MatchingPolicy().strong_entity_semantic_threshold
    places = ("block a", "block b unit 1", "block a unit 2", "block a unit 1")
    rows = [(i, f"pothole {places[i * 7 % 4]}", 3.0 + (i % 10) * 1e-3, 101.0 + (i % 7) * 1e-4, i % 40, "pothole") for i in range(n)]
    angle = math.acos(threshold)
    turn = lambda i: (i * 5 % 3) * angle + (i % 11 - 5) * 1e-9 * 10 ** (i % 8)
    vectors = [(uid(i), [math.cos(turn(i)) * (1 + i), math.sin(turn(i)) * (1 + i)]) for i in range(n)]
    return complaints(spark, rows), spark.createDataFrame(vectors, "id string, vector array<double>")


@pytest.mark.parametrize("hot_rows", [9, 20_000])
def test_collapsed_components_decide_ties_as_the_pairwise_graph(spark, hot_rows):
    df, vectors = _dense(spark, 90)
    policy = MatchingPolicy()
    decided = matching.match_pairs(
        matching.score_pairs(candidates.candidate_pairs(df, policy), matching.evidence_table(df, vectors)), policy
    )
    want = {r["id"]: r["component"] for r in graph.confirmed_components(df, decided).collect()}
    got = {r["id"]: r["component"] for r in collapse.collapsed_components(df, vectors, hot_rows=hot_rows).collect()}
    assert got == want and 1 < len(set(got.values())) < len(got)


def test_collapsed_links_grow_with_the_nodes(spark, monkeypatch):
    """What is handed on between a dense block's nodes is a forest, not their pairs; vectors stay in the block."""
    n, seen = 150, []
    rows = [(i, "pothole block a", 3.0 + i * 1e-6, 101.0, 0, "pothole") for i in range(n)]
    vectors = spark.createDataFrame([(uid(i), [1.0, i * 1e-3]) for i in range(n)], "id string, vector array<double>")
    components = collapse.connected_components

    def counted(vertices, edges):
        seen.append(edges.count())
        return components(vertices, edges)

    monkeypatch.setattr(collapse, "connected_components", counted)
    got = collapse.collapsed_components(complaints(spark, rows), vectors).collect()
    assert {r["component"] for r in got} == {uid(0)} and len(got) == n
    assert seen[0] < 5 * n  # 11,175 pairs


def test_described_vectors(spark):
    """Usable and equal as before; a sketch is within its error of the unit vector."""
    nan, inf = float("nan"), float("inf")
    given = [[3.0, 4.0], [3.0, 4.0], [], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [1e-200, 0.0], [5.0], [-1.0, 0.25]]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(given)], "id string, vector array<double>")
    rows = {int(r["id"]): r for r in node_links.described(df).collect()}
    want = {int(r["id"]): r["u"] for r in df.select("id", vectors_of.is_usable(F.col("vector")).alias("u")).collect()}
    assert {i: r["usable"] for i, r in rows.items()} == want
    assert rows[0]["digest"] == rows[1]["digest"] and len({bytes(r["digest"]) for r in rows.values()}) == len(given) - 2
    assert [i for i, r in sorted(rows.items()) if r["sketch"] is not None] == [0, 1, 9, 10]
    for i in (0, 9, 10):
        raw = bytes(rows[i]["sketch"])
        step, error = np.frombuffer(raw[:16], "<f8")
        unit = np.array(given[i]) / np.linalg.norm(given[i])
        assert np.linalg.norm(np.frombuffer(raw[16:], "<i2") * step - unit) <= error < 1e-4
