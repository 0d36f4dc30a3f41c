"""Streaming clustering: every micro-batch merges its reports into the stored incidents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.incremental import add_reports
from ..policy import Policies
from ..session import cut_lineage
from ..sources.store import SnapshotStore
from .intake import once
from .live import load_state


def cluster_stream(
    complaints: DataFrame,
    store: SnapshotStore,
    vectors_of: Callable[[DataFrame], DataFrame],
    policies: Policies = Policies(),
) -> DataStreamWriter:
    """Complaints into ``complaints``, ``vectors``, ``edges`` and ``members`` of the store.

    ``vectors_of`` maps complaints to (id, vector). Complaints, vectors and edges are appended;
    membership is replaced because merges relabel rows.
    """

    def apply(batch: DataFrame):
        fresh = batch.dropDuplicates(["id"])
        if "members" in store.tables():
            fresh = fresh.join(store.read("members").select("id"), "id", "left_anti")
        fresh = cut_lineage(fresh)
        vectors = cut_lineage(vectors_of(fresh))  # an encoder runs once per batch
        step = add_reports(load_state(store, (fresh, vectors)), fresh, vectors, policies)
        appended = {"complaints": fresh, "vectors": vectors, "edges": step.new_edges}
        return {"members": step.state.members}, appended

    return complaints.writeStream.foreachBatch(once(store, "cluster", apply))
