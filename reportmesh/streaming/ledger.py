"""The incident ledger: stored state that a batch reads and extends where it touches it.

Reports, vectors, decided pairs and officer decisions lie in cells of time and place; a batch reads the
cells its reports can reach. Everything else lies in shards of its key. Nothing but folder merges rewrites
stored rows:

* a report keeps the ``label`` of the component it was born into; ``redirects`` (label to root, newest
  version counts) and ``parts`` (root to all labels below it) follow merges. A merge writes one row per
  label below the components that lose their name, so both ways are one lookup, however long the history;
* ``incidents`` and ``reviews`` are versioned rows: touched ones get a new version;
* ``keys`` (first command of an idempotency key) and ``ids`` (stored reports) are looked up by shard;
* removing reports can split components: what is left of those is clustered anew and its members get new
  labels in ``moves`` (newest version counts). ``removed`` names the reports that are gone, in their cells;
* the graph version is kept as sums in the snapshot's metadata, changed by the sums of the new pairs.
  Pending reviews have it as their version: every submission refreshes them all, so it is not stored.

``edges`` hold the matcher's decisions only; officer decisions are applied when edges are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import review_id
from ..functions.vectors import is_usable
from ..operators import candidates, graph, incidents, intake, matching, priority, reviews
from ..operators.layout import CELL, Layout, in_cells, own_cells, with_keys
from ..operators.skew import lookup
from ..plans import incremental
from ..plans.incremental import ClusterState, ClusterStep
from ..policy import AUTO_MATCH, REVIEW_REQUIRED, Policies
from ..session import cut_lineage
from ..sources.store import SnapshotStore, TableSpec, newest
from .intake import created_keys, outcomes_against

_CELLS, _SHARDS = TableSpec(CELL), TableSpec(("shard",))
SPECS = {
    "complaints": _CELLS,
    "vectors": _CELLS,
    "edges": _CELLS,
    "decisions": _CELLS,
    "removed": _CELLS,
    "members": _SHARDS,
    "ids": _SHARDS,
    "parts": TableSpec(("shard",), ("root", "label")),
    "keys": TableSpec(("shard",), ("idempotency_key",)),
    "moves": TableSpec(("shard",), ("id",)),
    "redirects": TableSpec(("shard",), ("label",)),
    "incidents": TableSpec(("shard",), ("component",)),
    "reviews": TableSpec(("shard",), ("review_id",)),
}


def write_checks() -> dict[str, dict[str, Column]]:
    """What is counted while the tables of a publish are written: rows, missing ids, vector sizes, pair ends."""
    rows = F.count(F.lit(1))
    size = F.size("vector")
    ends = F.col("left_id").isNull() | F.col("right_id").isNull() | (F.col("left_id") >= F.col("right_id"))
    return {
        "complaints": {"rows": rows, "bad": F.count_if(F.col("id").isNull() | F.col("label").isNull())},
        "members": {"rows": rows, "bad": F.count_if(F.col("id").isNull() | F.col("label").isNull())},
        "vectors": {"rows": rows, "least": F.min(size), "most": F.max(size), "bad": F.count_if(~is_usable(F.col("vector")))},
        "edges": {"rows": rows, "bad": F.count_if(ends | F.col("decision").isNull())},
    }


def broken_checks(seen: dict[str, dict]) -> list[str]:
    """Coverage, pair ends and vectors of the tables just written."""
    wrong = [f"{table}: {found['bad']} bad rows" for table, found in seen.items() if found.get("bad")]
    counts = {table: found.get("rows", 0) for table, found in seen.items()}  # of an empty table nothing is seen
    if counts.get("members", 0) != counts.get("complaints", 0):
        wrong.append(f"{counts['members']} members for {counts['complaints']} complaints")
    if counts.get("vectors", 0) != counts.get("complaints", 0):
        wrong.append(f"{counts['vectors']} vectors for {counts['complaints']} complaints")
    sizes = seen.get("vectors", {})
    if sizes.get("least") != sizes.get("most"):
        wrong.append(f"vectors of {sizes['least']} to {sizes['most']} numbers")
    return wrong


_MEMBER = ("id", "label", "bucket", "zone")
_DECISION = ("left_id", "right_id", "status", "final_relationship_state", *CELL)


@dataclass(frozen=True)
class Change:
    """What a batch does to the graph. ``members`` are all members of the touched components after it."""

    links: DataFrame  # (component, new_component): components that lose their name
    below: DataFrame  # (root, label) of the touched components as they were
    old_members: DataFrame  # (id, component, bucket, zone) as they were
    members: DataFrame  # (id, component, bucket, zone)


class Ledger:
    def __init__(
        self, store: SnapshotStore, policies: Policies = Policies(), layout: Layout = Layout()
    ) -> None:
        stored = store.metadata().get("layout")
        self.store, self.policies = store, policies
        self.layout = Layout(**stored) if stored else layout
        self.tables = set(store.tables())

    # -- lookups --------------------------------------------------------------------------------

    def _rows(self, table: str) -> DataFrame | None:
        return self.store.read_rows(table)[0] if table in self.tables else None

    def _within(self, table: str, cells: DataFrame, fresh: DataFrame | None = None) -> DataFrame | None:
        """Stored rows of the cells, and ``fresh`` rows of this batch."""
        rows = self._rows(table)
        found = None if rows is None else in_cells(rows, cells)
        if fresh is None or found is None:
            return found if fresh is None else fresh
        return found.unionByName(fresh, allowMissingColumns=True)

    def keyed(self, table: str, keys: DataFrame, column: str) -> DataFrame | None:
        rows = self._rows(table)
        if rows is None:
            return None
        found, key = with_keys(rows, keys, column, self.layout), SPECS[table].key
        return newest(found, key) if key else found

    def shard(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.withColumn("shard", self.layout.shard(F.col(column)))

    def _alive(self, rows: DataFrame | None, cells: DataFrame, *columns: str) -> DataFrame | None:
        """Rows none of whose columns names a report removed from the cells."""
        removed = None if rows is None else self._within("removed", cells)
        if removed is not None:
            removed = cut_lineage(removed.select("id").distinct())
            for column in columns:
                rows = rows.join(removed.withColumnRenamed("id", column), column, "left_anti")
        return rows

    def _moved(self, rows: DataFrame) -> DataFrame:
        """Rows with id and label, the label as a removal left it."""
        if "moves" not in self.tables:
            return rows
        rows = cut_lineage(rows)
        moves = self.keyed("moves", cut_lineage(rows.select("id").distinct()), "id").select("id", F.col("label").alias("_label"))
        return rows.join(moves, "id", "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")

    def _members_below(self, below: DataFrame) -> DataFrame | None:
        """(id, component, bucket, zone) of the members of roots, from a written table of (root, label)."""
        stored = self.keyed("members", below, "label")
        if stored is None:
            return None
        found = lookup(stored.select(*_MEMBER), below, ["label"], spread_by="id").withColumnRenamed("root", "component")
        if "moves" in self.tables:  # rows under a label the member has no more, or of removed reports
            found = self._moved(found.withColumn("_stored", F.col("label"))).filter("label = _stored").dropDuplicates(["id"])
        return cut_lineage(found.select("id", "component", *CELL))

    def roots_of(self, labels: DataFrame) -> DataFrame:
        """(label, root) of a written table of labels."""
        redirects = self.keyed("redirects", labels, "label")
        if redirects is None:
            return labels.select("label", F.col("label").alias("root"))
        return labels.select("label").join(redirects, "label", "left").select("label", F.coalesce("root", "label").alias("root"))

    def labels_below(self, roots: DataFrame) -> DataFrame:
        """(root, label) of all labels that roots, a written table of them, stand for."""
        own = roots.select("root", F.col("root").alias("label"))
        parts = self.keyed("parts", roots, "root")
        return own if parts is None else own.unionByName(parts.select("root", "label")).distinct()

    def version(self) -> incidents.GraphSums:
        return incidents.GraphSums.of(self.store.metadata().get("graph"))

    # -- one batch -------------------------------------------------------------------------------

    def _decided(self, fresh: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(new edges with the cells of both ends, stored reports near the new ones)."""
        policy = self.policies.matching
        cells = cut_lineage(self.layout.cells_near(fresh, policy))
        own = fresh.withColumn("label", F.col("id"))
        local = self._within("complaints", cells, own)
        if "removed" in self.tables:
            local = cut_lineage(self._alive(local, cells, "id"))
        pairs = cut_lineage(candidates.candidate_pairs(local, policy, probe_side=fresh))
        involved = cut_lineage(pairs.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct())
        some = local.join(involved, "id", "left_semi")
        known = self._within("vectors", cells, vectors).join(involved, "id", "left_semi")
        decided = matching.match_pairs(matching.score_pairs(pairs, matching.evidence_table(some, known)), policy)
        place = some.select("id", *CELL)
        edges = decided.join(place.withColumnRenamed("id", "left_id"), "left_id").join(
            place.toDF("right_id", "right_bucket", "right_zone"), "right_id"
        )
        return cut_lineage(edges), local.join(fresh.select("id"), "id", "left_anti")

    def _change(self, ends: DataFrame, confirmed: DataFrame, fresh: DataFrame | None) -> Change:
        """Merge components over confirmed pairs. ``ends`` are (id, label) of stored reports that the batch
        touches, ``fresh`` (id, bucket, zone) its new ones, ``confirmed`` pairs of their ids."""
        roots = cut_lineage(self.roots_of(cut_lineage(ends.select("label").distinct())))
        node = ends.join(roots, "label").select("id", "root")
        if fresh is not None:
            node = node.unionByName(fresh.select("id", F.col("id").alias("root")))
        node = cut_lineage(node)
        bridges = cut_lineage(
            confirmed.join(node.toDF("left_id", "left_root"), "left_id")
            .join(node.toDF("right_id", "right_root"), "right_id")
            .filter("left_root <> right_root")
            .select(F.col("left_root").alias("left_id"), F.col("right_root").alias("right_id"))
            .distinct()
        )
        nodes = bridges.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
        links = cut_lineage(
            graph.connected_components(nodes, bridges).filter("id <> component").toDF("component", "new_component")
        )
        touched = cut_lineage(roots.select("root").distinct())
        below = cut_lineage(self.labels_below(touched))
        old = self._members_below(below)
        name = F.coalesce("new_component", "component").alias("component")
        where = ("id", "component", *CELL)
        new = None if fresh is None else fresh.withColumn("component", F.col("id")).select(*where)
        every = new if old is None else old if new is None else old.unionByName(new)
        members = lookup(every, links, ["component"], spread_by="id", how="left").select("id", name, *CELL)
        return Change(links, below, every.limit(0) if old is None else old, cut_lineage(members))

    def _relabelled(self, change: Change) -> dict[str, DataFrame]:
        """Rows for redirects and parts: one per label below a component that loses its name."""
        moved = change.below.join(change.links.withColumnRenamed("component", "root"), "root")
        rows = cut_lineage(moved.select("label", F.col("new_component").alias("root")))
        return {"redirects": self.shard(rows, "label"), "parts": self.shard(rows, "root")}

    def _scored(
        self, change: Change, fresh: DataFrame | None, edges: DataFrame | None, decisions: DataFrame | None, places: DataFrame, now: Column
    ) -> tuple[DataFrame, ClusterStep]:
        """Incident rows of the touched components, from the cells of their members."""
        members = change.members
        ids = members.select("id")
        own = cut_lineage(own_cells(members))
        complaints = cut_lineage(self._within("complaints", own, fresh).join(ids, "id", "left_semi"))
        around = cut_lineage(self.layout.cells_near(complaints, self.policies.matching))
        near = self._alive(self._within("edges", around, edges), around, "left_id", "right_id")
        near = cut_lineage(incremental.edges_at(near, ids))
        resolved = self._within("decisions", around, decisions)
        if resolved is not None:
            near = cut_lineage(matching.apply_overrides(near, resolved))
        # ends in other components count as candidates; which component that is does not matter
        far = near.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct().join(ids, "id", "left_anti")
        labels = cut_lineage(members.select("id", "component").unionByName(far.withColumn("component", F.lit(""))))
        touched = cut_lineage(members.select("component").distinct())
        state = ClusterState(complaints, complaints.limit(0), near, labels)
        step = ClusterStep(state, near if edges is None else edges, change.links, touched)
        rows = cut_lineage(incremental.touched_incidents(step, self.policies, near=near))
        inputs = priority.priority_inputs(rows, complaints, members.select("id", "component"), places, now, self.policies.priority)
        # inputs and change points stay beside the verdict, which ages
        assessed = priority.assess_priority(cut_lineage(inputs), self.policies.priority)
        return cut_lineage(priority.with_rises(assessed, self.policies.priority)), step

    def _incident_versions(self, scored: DataFrame, change: Change) -> DataFrame:
        """New versions of touched incidents, and marks for components that lost their name."""
        stored = change.below.select(F.col("root").alias("component"))
        lost = change.links.join(stored, "component", "left_semi").select("component").withColumn("_gone", F.lit(True))
        rows = scored.withColumn("_gone", F.lit(False)).unionByName(lost, allowMissingColumns=True)
        return self.shard(rows, "component")

    def outcomes(self, commands: DataFrame) -> DataFrame:
        """Outcome of each command against stored keys and stored reports, read by shard."""
        keys = cut_lineage(commands.select("idempotency_key").distinct())
        found = cut_lineage(outcomes_against(commands, self.keyed("keys", keys, "idempotency_key")))
        created = found.filter("outcome = 'created'").select(F.col("complaint_id").alias("id")).distinct()
        return cut_lineage(intake.claim_complaints(found, self.stored_ids(cut_lineage(created))))

    def stored_ids(self, ids: DataFrame) -> DataFrame:
        """Those of the ids, a written table of them, that are stored reports."""
        found = self.keyed("ids", ids, "id")
        return ids.limit(0) if found is None else found.select("id")

    def submit(
        self, batch: DataFrame, vectors_of: Callable[[DataFrame], DataFrame], places: DataFrame, now: Column
    ) -> tuple[dict[str, DataFrame], dict]:
        """Rows that a batch of submissions appends to each table, and the new metadata."""
        checked = intake.validate_commands(intake.validate_complaints(batch, now))
        valid, rejected = intake.split_valid(checked)
        commands = cut_lineage(intake.with_fingerprint(intake.to_complaints(valid)))
        outcomes = self.outcomes(commands)
        created = outcomes.filter("outcome = 'created'").select(*intake.IDENTITY)
        fresh = commands.join(created, list(intake.IDENTITY), "left_semi").dropDuplicates(["complaint_id"])
        fresh = fresh.drop("idempotency_key", "sequence", "request_fingerprint", "id").withColumnRenamed("complaint_id", "id")
        fresh = cut_lineage(self.layout.located(fresh))
        vectors = vectors_of(fresh).select("id", "vector").join(fresh.select("id", *CELL), "id")
        appended, metadata = self.add(fresh, cut_lineage(vectors), places, now)
        keys = cut_lineage(self.shard(created_keys(commands, outcomes), "idempotency_key"))
        named = keys.select(F.col("complaint_id").alias("id"), "idempotency_key")
        ids = appended["ids"].join(named, "id", "left")
        return appended | {"quarantine": rejected, "outcomes": outcomes, "keys": keys, "ids": ids}, metadata

    def add(self, fresh: DataFrame, vectors: DataFrame, places: DataFrame, now: Column) -> tuple[dict[str, DataFrame], dict]:
        """Cluster located new reports; returns the rows to append to each table and the new metadata."""
        edges, near = self._decided(fresh, vectors)
        ends = edges.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
        stored = cut_lineage(self._moved(near.select("id", "label").join(ends, "id", "left_semi")))
        confirmed = edges.filter(F.col("decision") == AUTO_MATCH).select("left_id", "right_id")
        change = self._change(stored, confirmed, fresh.select("id", *CELL))
        born = fresh.join(change.members.select("id", F.col("component").alias("label")), "id")
        born = cut_lineage(born)
        scored, step = self._scored(change, born, edges, None, places, now)
        graph_sums = self.version() + incidents.graph_sums(edges)
        found = reviews.new_reviews(edges, now, F.lit(graph_sums.version()))
        where = edges.select("left_id", "right_id", *CELL, "right_bucket", "right_zone")
        results = incremental.submission_results(
            ClusterState(born, vectors, edges, change.old_members), step, fresh, places, now, self.policies, scored=scored
        )
        rows = {
            "complaints": born, "vectors": vectors, "edges": edges,
            "members": self.shard(born.select(*_MEMBER), "label"),
            "ids": self.shard(born.select("id", *CELL), "id"),
            "reviews": self.shard(found.join(where, ["left_id", "right_id"]), "review_id"),
            "incidents": self._incident_versions(scored, change), "results": results,
        }
        return rows | self._relabelled(change), {"layout": asdict(self.layout), "graph": asdict(graph_sums)}

    def resolve(self, commands: DataFrame, places: DataFrame, now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
        """Officer decisions: rows to append to each table, and one result row per command."""
        known = self.keyed("reviews", cut_lineage(commands.select("review_id").distinct()), "review_id")
        if known is None:
            raise LookupError("the store has no reviews")
        version = self.version().version()
        known = cut_lineage(_with_version(known, version))
        outcomes = cut_lineage(reviews.resolution_outcomes(commands, known, F.lit(version)), beyond_scope=True)
        accepted = outcomes.filter("final_relationship_state is not null").select("review_id")
        where = known.select("review_id", *CELL, "right_bucket", "right_zone")
        decided = reviews.apply_resolutions(known, outcomes).join(accepted, "review_id", "left_semi")
        decided = cut_lineage(decided.join(where, "review_id"))
        decisions = decided.select(*_DECISION)
        ends = decided.select(F.inline(F.array(
            F.struct(F.col("left_id").alias("id"), *CELL),
            F.struct(F.col("right_id").alias("id"), F.col("right_bucket").alias("bucket"), F.col("right_zone").alias("zone")),
        ))).distinct()
        ends = cut_lineage(ends)
        stored = self._within("complaints", cut_lineage(own_cells(ends)))
        labels = cut_lineage(self._moved(stored.select("id", "label").join(ends.select("id"), "id", "left_semi")))
        approved = decided.filter(F.col("final_relationship_state") == AUTO_MATCH).select("left_id", "right_id")
        change = self._change(labels, approved, None)
        scored, _ = self._scored(change, None, None, decisions, places, now)
        empty = change.members.limit(0)
        before = ClusterState(empty, empty, empty, change.old_members)
        after = ClusterState(empty, empty, empty, change.members)
        views = incremental.mutation_results(before, after, decided.select("review_id", "left_id", "right_id"), scored)
        acted = F.col("final_relationship_state").isNotNull()
        views = views.withColumnRenamed("review_id", "_review").withColumn("_acted", F.lit(True))
        results = outcomes.join(views, (F.col("review_id") == F.col("_review")) & (acted == F.col("_acted")), "left").select(
            "sequence", "review_id", "outcome", *[c for c in views.columns if c not in ("_review", "_acted")]
        )
        rows = {
            "decisions": decisions, "reviews": self.shard(decided, "review_id"),
            "incidents": self._incident_versions(scored, change),
        }
        return rows | self._relabelled(change), cut_lineage(results, beyond_scope=True)

    def remove(self, ids: DataFrame, places: DataFrame, now: Column) -> tuple[dict[str, DataFrame], dict, DataFrame]:
        """Remove reports with their keys, pairs and reviews; rows to append to each table, the new metadata,
        and the ids that were stored.

        Only the components of the removed reports are clustered anew: losing a member can split them. Those that
        had a pair with a removed report are scored anew.
        """
        wanted = cut_lineage(ids.select("id").filter("id is not null").distinct())
        gone = self.keyed("ids", wanted, "id")
        if gone is None:
            raise LookupError("the store has no reports")
        own = cut_lineage(own_cells(gone))
        gone = cut_lineage(self._alive(gone, own, "id").drop("shard"), beyond_scope=True)
        stored = self._within("complaints", own).select("id", "label").join(gone.select("id"), "id", "left_semi")
        roots = cut_lineage(self.roots_of(cut_lineage(self._moved(stored).select("label").distinct())))
        below = cut_lineage(self.labels_below(cut_lineage(roots.select("root").distinct())))
        old = self._members_below(below)
        left = cut_lineage(old.join(gone.select("id"), "id", "left_anti"))
        # pairs of all members, with officer decisions
        reports = cut_lineage(self._within("complaints", cut_lineage(own_cells(old))).join(old.select("id"), "id", "left_semi"))
        around = cut_lineage(self.layout.cells_near(reports, self.policies.matching))
        edges = self._alive(self._within("edges", around), around, "left_id", "right_id")
        ends = lambda df, side: df.join(gone.select(F.col("id").alias(side)), side, "left_semi")
        lost = ends(edges, "left_id").unionByName(ends(edges, "right_id")).dropDuplicates(["left_id", "right_id"])
        lost = cut_lineage(lost)
        decisions = self._within("decisions", around)
        decided = edges if decisions is None else matching.apply_overrides(edges, decisions)
        among = decided.filter(F.col("decision") == AUTO_MATCH)
        for side in ("left_id", "right_id"):
            among = among.join(left.select(F.col("id").alias(side)), side, "left_semi")
        parts = graph.connected_components(left.select("id"), cut_lineage(among.select("left_id", "right_id")))
        members = cut_lineage(left.drop("component").join(parts, "id").select("id", "component", *CELL))
        # incidents that lose a candidate keep their members and count anew
        far = lost.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct().join(old.select("id"), "id", "left_anti")
        beside = self._alive(self._within("complaints", around), around, "id").select("id", "label").join(far, "id", "left_semi")
        beside = cut_lineage(self.roots_of(cut_lineage(self._moved(beside).select("label").distinct())).select("root").distinct())
        others = self._members_below(cut_lineage(self.labels_below(beside)))
        change = Change(members.select("component", F.lit("").alias("new_component")).limit(0), below, old, cut_lineage(members.unionByName(others)))
        # what follows must not see the removed reports: they are named before they are published
        ledger = _Without(self, gone)
        scored, _ = ledger._scored(change, None, None, None, places, now)
        names = cut_lineage(members.select("component").distinct())
        vanished = below.select(F.col("root").alias("component")).distinct().join(names, "component", "left_anti")
        relabelled = members.select("id", F.col("component").alias("label"), *CELL)
        moves = relabelled.select("id", "label").unionByName(gone.select("id", F.lit("").alias("label")))
        pairs = lost.filter(F.col("decision") == REVIEW_REQUIRED).select(review_id(F.col("left_id"), F.col("right_id")).alias("review_id"))
        past = self.keyed("reviews", cut_lineage(pairs), "review_id")
        rows = {
            "removed": gone.select("id", *CELL), "moves": self.shard(moves, "id"),
            "members": self.shard(relabelled, "label"),
            "parts": self.shard(below.filter("root <> label").withColumn("_gone", F.lit(True)), "root"),
            "redirects": self.shard(names.select(F.col("component").alias("label"), F.col("component").alias("root")), "label"),
            "incidents": self.shard(scored.withColumn("_gone", F.lit(False)).unionByName(vanished.withColumn("_gone", F.lit(True)), allowMissingColumns=True), "component"),
            "keys": self.shard(gone.filter("idempotency_key is not null").select("idempotency_key", F.lit(True).alias("_gone")), "idempotency_key"),
        }
        if past is not None:
            rows["reviews"] = self.shard(past.withColumn("_gone", F.lit(True)), "review_id")
        sums = self.version() - incidents.graph_sums(lost)
        return rows, {"layout": asdict(self.layout), "graph": asdict(sums)}, gone.select("id")

    # -- whole tables ----------------------------------------------------------------------------

    def members(self) -> DataFrame:
        """(id, component) of all reports."""
        stored = self.store.read("members").select("id", "label")
        if "moves" in self.tables:
            moves = self.store.read("moves").select("id", F.col("label").alias("_label"))
            stored = stored.join(moves, "id", "left").filter("_label is null or _label = label").drop("_label")
            stored = stored.dropDuplicates(["id"])  # a removal may have left a member its label
        if "redirects" not in self.tables:
            return stored.withColumnRenamed("label", "component")
        redirects = self.store.read("redirects").select("label", "root")
        return lookup(stored, redirects, ["label"], spread_by="id", how="left").select(
            "id", F.coalesce("root", "label").alias("component")
        )

    def reviews(self) -> DataFrame:
        return _with_version(self.store.read("reviews"), self.version().version()).select(*reviews.REVIEW_COLUMNS)

    def state(self) -> ClusterState:
        """All stored tables as one batch would have made them, officer decisions applied."""
        removed = self.store.read("removed").select("id") if "removed" in self.tables else None
        alive = lambda df, c: df if removed is None else df.join(removed.withColumnRenamed("id", c), c, "left_anti")
        edges = alive(alive(self.store.read("edges"), "left_id"), "right_id").drop(*CELL, "right_bucket", "right_zone")
        if "decisions" in self.tables:
            edges = matching.apply_overrides(edges, self.store.read("decisions"))
        complaints = alive(self.store.read("complaints"), "id").drop("label", *CELL)
        vectors = alive(self.store.read("vectors"), "id").drop(*CELL)
        return ClusterState(complaints, vectors, edges, self.members(), self.reviews())

    def whole(self, state: ClusterState, assessed: DataFrame, keys: DataFrame) -> tuple[dict[str, DataFrame], dict]:
        """The tables and metadata of a clustering made elsewhere, as a batch job makes it."""
        born = self.layout.located(state.complaints).join(state.members.select("id", F.col("component").alias("label")), "id")
        born = cut_lineage(born)
        place = born.select("id", *CELL)
        side = lambda df: df.join(place.withColumnRenamed("id", "left_id"), "left_id").join(
            place.toDF("right_id", "right_bucket", "right_zone"), "right_id"
        )
        edges = cut_lineage(side(matching.ordered_pair(matching.without_overrides(state.edges))))
        past = side(matching.ordered_pair(state.reviews)) if state.reviews is not None else None
        sums = incidents.graph_sums(edges)
        tables = {
            "complaints": born, "vectors": state.vectors.select("id", "vector").join(place, "id"), "edges": edges,
            "members": self.shard(born.select(*_MEMBER), "label"),
            "ids": self.shard(born.select("id", *CELL).join(keys.select(F.col("complaint_id").alias("id"), "idempotency_key"), "id", "left"), "id"),
            "keys": self.shard(keys, "idempotency_key"),
            "incidents": self.shard(priority.with_rises(cut_lineage(assessed), self.policies.priority), "component"),
        }
        if past is not None:
            past = cut_lineage(past)
            tables["reviews"] = self.shard(past, "review_id")
            tables["decisions"] = past.filter("status <> 'pending'").select(*_DECISION)
        return tables, {"layout": asdict(self.layout), "graph": asdict(sums)}


class _Without(Ledger):
    """A ledger as it is without some reports that are still stored."""

    def __init__(self, ledger: Ledger, gone: DataFrame) -> None:
        self.__dict__.update(ledger.__dict__)
        self.gone = gone.select("id")

    def _alive(self, rows: DataFrame | None, cells: DataFrame, *columns: str) -> DataFrame | None:
        rows = super()._alive(rows, cells, *columns)
        for column in columns if rows is not None else ():
            rows = rows.join(self.gone.withColumnRenamed("id", column), column, "left_anti")
        return rows


def _with_version(rows: DataFrame, version: str) -> DataFrame:
    """Reviews whose pending ones carry the current graph version."""
    return rows.withColumn(
        "graph_version_at_creation",
        F.when(F.col("status") == "pending", F.lit(version)).otherwise(F.col("graph_version_at_creation")),
    )
