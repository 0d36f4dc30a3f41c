"""Reads over a published ledger, as of any time: no query here reads raw reports to cluster them.

Incidents are stored with the inputs of their priority, so asking later only ages them. The ranked queue
can also be published as a page index, from which any offset reads its own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import pages, priority, read_models, spatial
from ..policy import Policies
from ..session import cut_lineage, stage_scope
from ..sources.store import SnapshotStore, TableSpec
from .ledger import Ledger

PAGES = "queue_pages"


def incidents_at(store: SnapshotStore, now: Column, policies: Policies = Policies()) -> DataFrame:
    """All incidents with their priorities at ``now``."""
    return priority.assess_at(store.read("incidents"), now, policies.priority)


def queue(store: SnapshotStore, now: Column, policies: Policies = Policies(), **page) -> DataFrame:
    """One page of the ranked queue at ``now``; filters, limit, offset and cursor as in ``incident_queue``."""
    return read_models.incident_queue(incidents_at(store, now, policies), **page)


def heat(store: SnapshotStore, now: Column, policies: Policies = Policies(), category: str | None = None) -> DataFrame:
    return spatial.heat_cells(incidents_at(store, now, policies), category)


def review_page(store: SnapshotStore, **page) -> DataFrame:
    return read_models.review_queue(Ledger(store).reviews(), **page)


def risen(store: SnapshotStore, since: Column, until: Column) -> DataFrame:
    """(component, at, level) of incidents that age alone raised in between."""
    return priority.risen(store.read("incidents"), since, until)


def index_queue(
    store: SnapshotStore, now: Column, policies: Policies = Policies(), block_rows: int = pages.BLOCK_ROWS
) -> str:
    """Publish the ranked queue as of ``now`` as a page index beside the snapshot it was made from."""
    base = store.current()
    with stage_scope(store.spark):
        ranked = incidents_at(store, now, policies).withColumn(
            "priority_rank", read_models.priority_rank(F.col("operational_priority"))
        )
        order = [F.desc("priority_rank"), F.desc("latest_reported_at"), F.asc("incident_id")]
        index = cut_lineage(pages.page_index(ranked.drop("shard"), order, block_rows))
        total = index.count()
        return store.publish(
            replaced={PAGES: index}, base=base, specs={PAGES: TableSpec(("block",))},
            metadata={"queue": {"total": total, "block_rows": block_rows}},
        )


def indexed_page(store: SnapshotStore, limit: int, offset: int = 0) -> DataFrame:
    """A page of the indexed queue: the blocks of its positions are read, and no others."""
    read_models.check_page(limit, offset)
    known = store.metadata()["queue"]
    found = pages.page(store.read(PAGES), limit, offset, known["block_rows"])
    return found.withColumn("total", F.lit(known["total"]).cast("bigint"))
