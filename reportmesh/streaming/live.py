"""The live store: submissions and officer decisions, each published as one snapshot.

Imports and streams share the tables of the incident ledger (``streaming/ledger.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import incidents
from ..operators.layout import Layout
from ..plans.incremental import ClusterState
from ..policy import Policies
from ..session import stage_scope
from ..sources.store import SnapshotStore
from .intake import once
from .ledger import SPECS, Ledger, broken_checks, write_checks

STATE = ("complaints", "vectors", "edges", "members")


def load_state(store: SnapshotStore, like: tuple[DataFrame, DataFrame] | None = None) -> ClusterState:
    """State tables of the current snapshot. An empty store gives empty tables shaped ``like`` the
    given complaints and vectors; a store with only some of the tables is refused."""
    present = [t for t in STATE if t in store.tables()]
    if len(present) == len(STATE):
        if "layout" in store.metadata():
            return Ledger(store).state()
        past = store.read("reviews") if "reviews" in store.tables() else None
        return ClusterState(*(store.read(t) for t in STATE), past)
    if present:
        raise ValueError(f"the store lacks {sorted(set(STATE) - set(present))} beside {present}")
    if like is None:
        raise LookupError("the store is empty")
    spark = store.spark
    edges = spark.createDataFrame([], "left_id string, right_id string, decision string")
    members = spark.createDataFrame([], "id string, component string")
    return ClusterState(like[0].limit(0), like[1].limit(0), edges, members)


def submit_stream(
    commands: DataFrame,
    store: SnapshotStore,
    vectors_of: Callable[[DataFrame], DataFrame],
    places: DataFrame,
    now: Column,
    policies: Policies = Policies(),
    layout: Layout = Layout(),
) -> DataStreamWriter:
    """Submissions to incidents: validation, idempotency, vectors, clustering, reviews, priorities.

    ``commands`` have idempotency_key, sequence, complaint_id and the raw report. Each micro-batch
    appends to the ledger's tables and to ``outcomes``, ``quarantine`` and ``results`` (one row per new
    report: its incident, priority, what the incident replaced) in one publish, which checks coverage,
    pair ends and vectors while it writes.
    """

    def apply(batch: DataFrame) -> tuple[dict, dict, dict]:
        appended, metadata = Ledger(store, policies, layout).submit(batch, vectors_of, places, now)
        return {}, appended, metadata

    return commands.writeStream.foreachBatch(once(store, "submit", apply, SPECS, write_checks(), broken_checks))


def resolve_and_publish(
    store: SnapshotStore, commands: DataFrame, places: DataFrame, now: Column, policies: Policies = Policies()
) -> DataFrame:
    """Officer decisions on stored reviews: outcomes, new graph and priorities in one snapshot.

    ``commands`` have sequence, review_id, approve, reviewer_id, note and resolved_at. Returns one row
    per command: outcome, and for accepted ones the incidents before and after, conflict and priorities.
    """
    base = store.current()
    with stage_scope(store.spark):
        appended, results = Ledger(store, policies).resolve(commands, places, now)
        store.publish(appended=appended, base=base, specs=SPECS)
    return results


def delete_and_publish(
    store: SnapshotStore, ids: DataFrame, places: DataFrame, now: Column, policies: Policies = Policies()
) -> DataFrame:
    """Delete reports with all that hangs on them, and recompute their incidents, in one snapshot.

    Returns the ids that were stored. The ids stay taken: a later command cannot create them again.
    """
    base = store.current()
    with stage_scope(store.spark):
        appended, metadata, gone = Ledger(store, policies).remove(ids, places, now)
        store.publish(appended=appended, metadata=metadata, base=base, specs=SPECS)
    return gone


def publish_state(
    store: SnapshotStore,
    state: ClusterState,
    assessed: DataFrame,
    keys: DataFrame,
    base: str | None = None,
    layout: Layout = Layout(),
    policies: Policies = Policies(),
) -> str:
    """A whole state as one snapshot, as an import makes it."""
    with stage_scope(store.spark):
        ledger = Ledger(store, policies, layout)
        tables, metadata = ledger.whole(state, assessed, keys)
        # of an earlier state nothing may stay: tables this one does not have are emptied
        old = [t for t in ("redirects", "parts", "moves", "removed") if t in store.tables()]
        cleared = {t: store.read_rows(t)[0].limit(0).drop("_seq", "_gone") for t in old}
        return store.publish(
            replaced=tables | cleared, metadata=metadata, base=base, specs=SPECS, metrics=write_checks(), verify=broken_checks
        )


def incident_members(store: SnapshotStore) -> DataFrame:
    """(incident_id, id) of the current snapshot."""
    return incidents.incident_members(Ledger(store).members(), store.read("incidents"))
