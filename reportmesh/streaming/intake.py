"""Streaming intake: validation with quarantine, and idempotent submissions.

Micro-batches run the same DataFrame operators as batch jobs. Each batch is published as one
snapshot together with its stream's batch number, so a replayed batch is skipped. First commands are
kept without expiry; nothing is ever late.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import intake
from ..session import cut_lineage, stage_scope
from ..sources.store import SnapshotStore, TableSpec


def stream_mark(batch: DataFrame, stream: str) -> str:
    """Name under which a stream's progress is kept: the stream, and the identity of its checkpoint.

    Another stream on the same store, or a restart from a new checkpoint, counts its batches anew.
    """
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{stream}:{query}"


def once(
    store: SnapshotStore,
    stream: str,
    apply: Callable[[DataFrame], tuple[dict, dict] | tuple[dict, dict, dict]],
    specs: dict[str, TableSpec] | None = None,
    metrics: dict | None = None,
    verify: Callable[[dict], list[str]] | None = None,
):
    """foreachBatch body: apply a batch and publish its tables unless this stream published it before.

    ``apply`` returns the tables to replace, those to append to, and metadata where it has some. Stages
    written on the way are dropped after the publish.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        mark, done = stream_mark(batch, stream), store.metadata().get("batches", {})
        if done.get(mark, -1) >= batch_id:
            return
        base = store.current()
        with stage_scope(store.spark):
            replaced, appended, *more = apply(batch)
            metadata = {**(more[0] if more else {}), "batches": {**done, mark: batch_id}}
            store.publish(
                replaced=replaced, appended=appended, metadata=metadata, base=base, specs=specs, metrics=metrics, verify=verify
            )

    return handle


def validate_stream(raw: DataFrame, store: SnapshotStore, now: Column) -> DataStreamWriter:
    """Valid reports to ``accepted``, the others with their reasons to ``quarantine``."""

    def apply(batch: DataFrame):
        valid, rejected = intake.split_valid(intake.validate_complaints(batch, now))
        return {}, {"accepted": valid, "quarantine": rejected}

    return raw.writeStream.foreachBatch(once(store, "validate", apply))


def outcomes_against(commands: DataFrame, stored_keys: DataFrame | None) -> DataFrame:
    """Outcomes of a batch of commands given the first commands stored so far.

    The history side is first cut to the keys of the batch.
    """
    if stored_keys is None:
        return intake.idempotent_outcomes(commands)
    known = stored_keys.join(
        commands.select("idempotency_key").distinct(), "idempotency_key", "left_semi"
    )
    return intake.idempotent_outcomes(commands, known)


def created_keys(commands: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(idempotency_key, request_fingerprint, complaint_id) of the commands that created something."""
    created = outcomes.filter(F.col("outcome") == "created").select("idempotency_key", "sequence", "complaint_id")
    return (
        commands.join(created, ["idempotency_key", "sequence", "complaint_id"], "left_semi")
        .select("idempotency_key", "request_fingerprint", "complaint_id")
        .dropDuplicates(["idempotency_key"])
    )


def submission_stream(commands: DataFrame, store: SnapshotStore) -> DataStreamWriter:
    """Commands to ``outcomes``, with the first command per key remembered in ``keys``.

    Keys lie in shards of the key; a batch reads the shards of its own keys. Commands without a key, a
    sequence or a complaint id get the outcome ``invalid``.
    """
    from .ledger import SPECS, Ledger

    def apply(batch: DataFrame):
        ledger = Ledger(store)
        batch = cut_lineage(intake.with_fingerprint(batch))
        wanted = cut_lineage(batch.select("idempotency_key").distinct())
        outcomes = cut_lineage(outcomes_against(batch, ledger.keyed("keys", wanted, "idempotency_key")))
        keys = ledger.shard(created_keys(batch, outcomes), "idempotency_key")
        return {}, {"outcomes": outcomes, "keys": keys}, {"layout": asdict(ledger.layout)}

    return commands.writeStream.foreachBatch(once(store, "submissions", apply, SPECS))
